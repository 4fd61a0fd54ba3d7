"""The construct scanner in the JVM gives what the kernels give, without a Python worker."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import scan, wrap
from textloom.functions import words as K
from textloom.functions.patterns import AUTOLINK, BARE_URL, CODE_SPAN, HTML_TAGS, LINK, PAIRED_TAGS, PROSE, SINGLE_TAGS, WRAPPING

PIECES = [
    "`a b`", "``x ` y``", "`open", "[link text](http://a.b/c d)", "[ref][two words]", "[open", "](", "<b>", "</b>", "<a href='x y'>", "<http://x.y/z>", "<me@x.y>", "< 3", "{% if a b %}", "{% tag %}{% /tag %}", "{%a%} {% / a%}", "{# note it #}", "{{ var x }}",
    "{{ a }}{{ /a }}", "<!-- long - comment -->", "<!-- f --><!-- /f -->", "<!-- f a-b --> <!-- /f -->", "{% open", "%}", "-->", "https://x.y/a?b=c.", "www.a.b/[c", "h", "w", "word", "Ends.", "\"Said.\"", "\n", "\n\n", "\t", " ", "  ", "\u00a0", "\x1f", "\u3000", "é漢", "\U0001f600", "a" * 100, "`", "``", "(x)", "\ufdd0",
]


def samples():
    rng = random.Random(11)
    out = ["", " ", "\n", "plain words only, no marks at all. " * 9]
    for _ in range(400):
        out.append("".join(rng.choice(PIECES) + rng.choice(["", " ", " ", " ", "\n"]) for _ in range(rng.randint(1, 25))))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(samples()))
    return spark.createDataFrame(rows, "id int, text string").repartition(4).cache(), dict(rows)


def same(texts, column, kernel):
    df, by_id = texts
    for r in df.select("id", column.alias("out")).collect():
        want = kernel(by_id[r.id])
        assert ([tuple(x) if hasattr(x, "asDict") else x for x in r.out] if isinstance(want, list) else r.out) == want, by_id[r.id]


@pytest.mark.parametrize("constructs", [(c,) for c in (*WRAPPING, AUTOLINK, BARE_URL)] + [WRAPPING, PROSE], ids=lambda c: c[0].name if len(c) == 1 else str(len(c)))
def test_constructs(texts, constructs):
    same(texts, scan.construct_matches(F.col("text"), constructs), lambda t: [s.text for s in K.atomic_spans(t, constructs) if s.is_atomic])
    same(texts, scan.atomic_spans(F.col("text"), constructs), lambda t: [(s.text, s.is_atomic, s.name) for s in K.atomic_spans(t, constructs)])


def test_there_are_fourteen():
    assert len({c.name for c in (CODE_SPAN, LINK, AUTOLINK, BARE_URL, *PAIRED_TAGS, *SINGLE_TAGS, *HTML_TAGS)}) == 14


@pytest.mark.parametrize("constructs", [WRAPPING, PROSE])
def test_words(texts, constructs):
    same(texts, scan.atomic_words(F.col("text"), constructs), lambda t: [w.text for w in K.atomic_words(t, constructs)])


@pytest.mark.parametrize("width, column, offset, squeeze, markdown", [(20, 0, 0, True, False), (20, 0, 0, False, False), (5, 2, 2, True, False), (30, 4, 0, True, False), (30, 0, 0, True, True), (3, 5, 5, True, False), (0, 0, 0, True, False), (0, 0, 0, False, False)])
def test_wrapped_lines(texts, width, column, offset, squeeze, markdown):
    want = lambda t: wrap.wrap_lines(t, width, column, offset, squeeze, True, markdown=markdown)
    same(texts, F.transform(scan.wrap_lines(F.col("text"), width, column, offset, squeeze, markdown), lambda x: scan.N.trimmed(x)), want)


@pytest.mark.parametrize("style", sorted(wrap.STYLES))
def test_fill(texts, style):
    same(texts, scan.fill_text(F.col("text"), style, 30), lambda t: wrap.fill_text(t, style, 30))


def test_sentences(texts):
    same(texts, scan.sentences(F.col("text"), 0), lambda t: [" ".join(w.text for w in K.atomic_words(s, PROSE)) for s in K.atomic_sentences(t, 0)])


def test_long_tokens_take_no_stack(spark):
    long = ["a" * 20_000, "`" + "a " * 20_000 + "`", "<!-- f " + "a-b " * 20_000 + "--> <!-- /f -->", "[" * 5_000 + "x", "{% " + "a " * 20_000 + "%}", "`a" * 5_000, "<a " + "b-c " * 20_000 + ">"]
    df = spark.createDataFrame(list(enumerate(long)), "id int, text string")
    out = df.select("id", scan.fill_text(F.col("text")).alias("out"), F.size(scan.atomic_spans(F.col("text"))).alias("n"), F.size(scan.sentences(F.col("text"))).alias("s"))
    for r in out.collect():
        assert r.out == wrap.fill_text(long[r.id])


def test_no_python_worker(spark):
    from textloom.queries import QUERIES

    for name in ("e2_reformat_plaintext", "w1_wrap_lines", "t6_atomic_words"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("least", [0, 1, 6, 15, 40])
def test_plain_sentences(texts, spark, least):
    more = ["", " ", "One. Two. Three four. x", "ab.’ cd.\" e. fg'. Hi? 2ab. _ab. é. né. né! NE. áb. \x85 ab. cd.  end", "Ab. " * 3000]
    own = spark.createDataFrame(list(enumerate(more)), "id int, text string"), dict(enumerate(more))
    same(own, scan.N.split_sentences(F.col("text"), least), lambda t: K.split_sentences(t, least))
    same(texts, scan.N.split_sentences(F.col("text"), least), lambda t: K.split_sentences(t, least))


@pytest.mark.parametrize(("width", "column", "offset"), [(12, 0, 0), (12, 5, 2), (12, 2, 5), (12, 11, 0), (12, 12, 3), (3, 0, 2)])
@pytest.mark.parametrize("markdown", [False, True])
def test_plain_lines(texts, width, column, offset, markdown):
    want = lambda t: wrap.wrap_lines(t, width, column, offset, True, True, splitter=K.plain_words, markdown=markdown)
    same(texts, scan.N.wrap_lines(F.col("text"), width, column, offset, markdown), want)


def test_no_fold_over_words(spark):
    from textloom.queries import QUERIES

    for name in ("n2_sentences_any_length", "n2_sentences", "w6_fill_wrap_indent", "w6_fill_hanging_indent"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan
