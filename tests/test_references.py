"""Reference images, links and notes as relations, and table functions in SQL."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.formatting import fill_markdown
from textloom.functions.tables import register_tables
from textloom.operators import references as R

SCHEMA = "doc_id long, text string"
PIC = "http://e.x/i.png"
IMAGES = {
    "full": (f"![a][i]\n\n[i]: {PIC}\n", [(f"![a]({PIC})", None)]),
    "collapsed": (f"![a][]\n\n[a]: {PIC}\n", [(f"![a]({PIC})", None)]),
    "shortcut": (f"![a]\n\n[a]: {PIC}\n", [(f"![a]({PIC})", None)]),
    "title": (f'![a][i]\n\n[i]: {PIC} "My title"\n', [(f'![a]({PIC} "My title")', None)]),
    "spaces": (f"![Logo][the  logo]\n\n[The logo]: {PIC}\n", [(f"![Logo]({PIC})", None)]),
    "case": (f"![a][IMG]\n\n[Img]: {PIC}\n", [(f"![a]({PIC})", None)]),
    "empty": (f"![][i]\n\n[i]: {PIC}\n", [(f"![]({PIC})", None)]),
    "badge": (f"[![a][i]][u]\n\n[i]: {PIC}\n[u]: http://e.x/p\n", [(f"![a]({PIC})", "http://e.x/p")]),
    "collapsed badge": (f"[![a][]][u]\n\n[a]: {PIC}\n[u]: http://e.x/p\n", [(f"![a]({PIC})", "http://e.x/p")]),
    "shortcut badge": (f"[![a]][u]\n\n[a]: {PIC}\n[u]: http://e.x/p\n", [(f"![a]({PIC})", "http://e.x/p")]),
    "inline badge": (f"[![a]({PIC})][u]\n\n[u]: http://e.x/p\n", [(f"![a]({PIC})", "http://e.x/p")]),
    "undefined": ("![a][none] and ![b]\n", []),
    "first wins": (f"![a][i]\n\n[i]: {PIC}\n[I]: http://e.x/2\n", [(f"![a]({PIC})", None)]),
    "defined later, in a quote": (f"![a][i]\n\n> [i]: {PIC}\n", [(f"![a]({PIC})", None)]),
    "null": (None, []),
    "no text": ("", []),
}


def test_images_are_inlined(spark):
    names = list(IMAGES)
    docs = spark.createDataFrame([(k, IMAGES[n][0]) for k, n in enumerate(names)], SCHEMA)
    got = {k: [] for k in range(len(names))}
    for r in R.inlined(R.reference_rows(docs)).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append((r.image, r.link))
    assert {names[k]: v for k, v in got.items()} == {n: v for n, (_, v) in IMAGES.items()}


@pytest.mark.parametrize("name", IMAGES)
def test_the_renderer_writes_the_same_images(name):
    text, images = IMAGES[name]
    once = fill_markdown(text or "")
    assert all(image in once for image, _ in images) and fill_markdown(once) == once


def test_definitions_notes_and_leftovers(spark):
    text = "[x] [y][X] [z](u 'v')[^2] [^1] [^2] [^gone]\n\n[X]: /one\n[x]: /two 't'\n[q]: /q\n\n[^1]: first\n\n[^2]: second *one*\n    more\n\n[^3]: never\n"
    rows = R.reference_rows(spark.createDataFrame([(1, text), (2, text), (1, "[x]: /three"), (3, None)], SCHEMA)).where("doc_id = 2")
    assert [tuple(r) for r in R.definitions(rows).orderBy("label").collect()] == [(2, "q", "/q", None, 1), (2, "x", "/one", None, 2)]
    assert [(r.label, r.dest, r.title, r.text) for r in R.resolved(rows).orderBy("ord").collect()] == [("x", "/one", None, "x"), ("x", "/one", None, "y"), (None, "u", "v", "z")]
    assert [tuple(r)[1:] for r in R.notes(rows).orderBy("label").collect()] == [("1", "first", 2, 1), ("2", "second one more", 1, 2), ("3", "never", None, 0)]
    assert [r.label for r in R.unused(rows).collect()] == ["q"]


def test_one_parse_for_all_relations(spark):
    rows = R.reference_rows(spark.createDataFrame([(1, "[a]")], SCHEMA))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_table_functions(spark):
    register_tables(spark)
    spark.createDataFrame([(1, "One `a b` two. Three four!\n\n# H"), (2, None), (3, "")], SCHEMA).createOrReplaceTempView("table_docs")
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert sql("SELECT d.doc_id, w.pos, w.word FROM table_docs d, LATERAL loom_word_rows(d.text) w WHERE d.doc_id = 1 ORDER BY pos LIMIT 3") == [(1, 0, "One"), (1, 1, "`a b`"), (1, 2, "two.")]
    assert sql("SELECT w.word, w.start, w.end FROM table_docs d, LATERAL loom_word_rows(d.text, places => true) w WHERE w.pos = 1") == [("`a b`", 4, 9)]
    assert sql("SELECT s.sentence FROM table_docs d, LATERAL loom_sentence_rows(text, min_length => 0) s ORDER BY sid LIMIT 1") == [("One `a b` two.",)]
    assert sql("SELECT b.source FROM table_docs d, LATERAL loom_block_rows(d.text, source => true) b WHERE b.type = 'heading'") == [("# H",)]
    assert sql("SELECT doc_id, count(*) FROM table_docs d, LATERAL loom_block_rows(d.text) b WHERE b.type = 'document' GROUP BY doc_id ORDER BY 1") == [(1, 1), (3, 1)]
    assert sql("SELECT * FROM loom_link_rows('![i](x) [a](b \"c\")', images => true)") == [(0, "i", "x", None), (1, "a", "b", "c")]
    for wrong in ("loom_word_rows(1)", "loom_word_rows('a', places => 3)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {wrong}").collect()
    assert "start" not in spark.sql("SELECT * FROM loom_word_rows('a')").columns


def test_interval_join_rewrites_as_the_kernel_does(spark):
    import random

    from textloom.functions import udfs
    from textloom.functions.markdown import parse
    from textloom.functions.markdown.tree import rewrite_across, segment_table
    from textloom.functions.typography import smart_quotes
    from textloom.operators import intervals as X

    rng = random.Random(9)
    pieces = ['"', "'", ' "a', 'b" ', "don't", "*x*", "`c \"d\"`", "[l \"m](u)", "**\"s\"**", "\n", "\n\n", "  \n", " ", "word ", "| \"t\" |", "# ", "- ", "<http://a.b>", "é\U0001f600"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["", None, '"' + "long " * 900 + '" and ' * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = set()
    for k, t in enumerate(texts):
        if t is not None:
            doc = parse(t)
            old = segment_table(doc)
            rewrite_across(doc, smart_quotes)
            want |= {(k, o["scope"], o["ord"], o["text"], n["text"]) for o, n in zip(old, segment_table(doc)) if o["text"] != n["text"]}
    for size in (3, 1024):
        got = X.changed_segments(X.inline_segments(docs), udfs.smart_quotes(), "doc_id", size)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("make", [R.resolved, R.inlined, R.notes, R.unused])
def test_relations_parse_once_and_broadcast_nothing(spark, make):
    """A table's size in the file says little of its references, so a join that trusts it sends them all through the driver."""
    docs = spark.createDataFrame([(1, "[a][x] ![b][y]\n\n[x]: /u")], "doc_id int, text string")
    plan = make(R.reference_rows(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("ArrowEvalPython") == 1


def test_one_row_group_is_spread_over_the_cores(spark, tmp_path):
    """A file that is cut into many splits is still one task if it is one row group."""
    from textloom.operators.corpus import spread

    at = str(tmp_path / "one")
    spark.range(200_000, numPartitions=1).selectExpr("id", "sha2(cast(id as string), 256) AS text").coalesce(1).write.parquet(at)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        docs = spark.read.parquet(at)
        assert docs.rdd.getNumPartitions() > 4
        sizes = sorted(r["count"] for r in spread(docs).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect())
        assert len(sizes) >= 4 and sizes[-1] < 100_000 and sum(sizes) == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_tasks_grow_in_number_not_in_size(spark):
    """Rows of words and lines are dealt by how many there are, and sorted once for all windows."""
    from textloom.operators import islands

    rows = spark.range(4000).selectExpr("id div 4 AS doc_id", "id % 4 AS line_no", "concat('line ', id) AS line")
    for made in (islands.segments_of_rows(rows, share=100), islands.sentences_of_rows(rows, order="line_no", word="line", share=100)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "40), REPARTITION_BY_NUM" in plan and plan.count("Sort [") == 1
    assert made.count() == 1000
