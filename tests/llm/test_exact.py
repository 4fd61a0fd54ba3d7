"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, bucket string, fp string, node int"


def rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(70)
    texts = [None, "", "  \n\t ", "one", "Same Same", "same same", say(60), say(60) + "\n" + passage, passage, "X " + passage + " " + say(5), say(4000), "a " * 300, "aaaa" * 60, "x" * 49, "y" * 50]
    texts += [texts[7], texts[9].replace("X", "Z"), "mail a.b@c.de, +1 (017) 555-7713; 10.0.0.255 or 300.1.1.1, 4111 1111 1111 1111 é 1.2.3.4.5.6.7.8"]
    out = [(i, t, ["en", None, "xx"][i % 3], [None, "s1", "s2", "s10"][i % 4], 1, 0.5, 1, "b", "f", 2) for i, t in enumerate(texts)]
    return [*out, out[7], out[3], (None, passage, "en", "s1", 1, 0.5, 1, "b", "f", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def as_bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_quality_base(docs, none):
    from textloom.llm.quality import quality_verdicts

    want = Counter()
    for i, t, *_ in rows():
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(win)
        rep = len({p for k, x in enumerate(win) if n[x] > 1 for p in range(k, k + 3)})
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w))] += 1
    out = quality_verdicts(docs)
    assert as_bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.where("base_failed AND kept").count() == 0
    assert quality_verdicts(none).count() == 0


def test_divergence_is_a_distance():
    from textloom.llm.quality import js_distance

    p = np.array([[1.0, 3.0], [0.0, 0.0]])
    assert js_distance(p, np.array([1.0, 3.0])).tolist() == [0.0, 0.0]
    assert js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == pytest.approx(1.0)


def _fingerprint(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    if not w:
        return 0
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, none, spark):
    from textloom.llm.simhash import near_duplicate_groups

    fps = [(i, _fingerprint(t)) for i, t, *_ in rows()]
    parent = {f: f for _, f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[find(f)].append(i)
    want = Counter((i, f - (1 << 64) if f >> 63 else f, min(least[find(f)])) for i, f in fps)
    assert as_bag(near_duplicate_groups(docs), "doc_id", "fp", "component_id") == want
    assert near_duplicate_groups(none).count() == 0


@pytest.mark.parametrize("bucket_rows", [0, 3, 1000])
def test_links_find_all(spark, bucket_rows):
    """Crowded keys go another way; either finds the components of all links."""
    from textloom.llm.components import connected_components
    from textloom.llm.simhash import links

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(15)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = connected_components(links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket_rows=bucket_rows))
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    sizes = Counter(map(find, signed))
    assert {r.node: r.component for r in got.collect()} == {f: find(f) for f in signed if sizes[find(f)] > 1}


def test_decontamination(docs, none, spark, monkeypatch):
    from textloom.llm import decontaminate as decontaminate_
    from textloom.llm.decontaminate import SuffixAutomaton, decontaminate, find_contamination, tokens

    long = rows()[8][1].split()
    items = [("2", " ".join(long[:14])), ("10", " ".join(long[5:16]).upper()), ("short", "same SAME"), ("none", "?!"), (None, "one"), ("n", None)]
    table = spark.createDataFrame(items, "item_id string, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for name, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(name or "")
    want = Counter()
    for i, t, *_ in rows():
        w, hit, names = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= x
        want[(i, len(w), len(hit), ",".join(sorted(names)))] += 1
    hits = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b).alias("h")
    monkeypatch.setattr(decontaminate_, "PASS_BLOCKS", 2)
    for block in (5, 10_000):  # in several passes, and in one
        assert as_bag(find_contamination(docs, table, block_tokens=block).select("row.doc_id", "*"), "doc_id", "n_words", hits, F.array_join("items", ",")) == want
        clean = decontaminate(docs, table, max_coverage=0.9, block_tokens=block)
        automaton = SuffixAutomaton([(n or "", tokens((t or "").encode())) for n, t in items])
        assert all(not automaton.hits(tokens((r.text or "").encode()))[0] for r in clean.collect())
    clashing = docs.withColumns({x: F.lit(1) for x in ("row", "clean", "share", "key", "n_words", "__text")})
    assert decontaminate(clashing, table, max_coverage=0.9).columns == clashing.columns
    automaton = SuffixAutomaton([(n or "", tokens((t or "").encode())) for n, t in items])
    clean = decontaminate(docs, table, max_coverage=0.9)
    assert all(not automaton.hits(tokens((r.text or "").encode()))[0] for r in clean.collect())
    untouched = {i for i, _, h, _ in want if not h}
    kept = [r for r in clean.collect() if r.doc_id in untouched]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t, *_ in rows() if i in untouched)
    assert find_contamination(none, table).count() == 0 and find_contamination(docs, table.limit(0)).where("size(items) > 0").count() == 0


def test_decontamination_is_the_same_in_any_number_of_passes(docs, spark, monkeypatch):
    from textloom.llm import decontaminate as decontaminate_
    from textloom.llm.decontaminate import decontaminate

    monkeypatch.setattr(decontaminate_, "PASS_BLOCKS", 1)
    w = [f"w{k}" for k in range(400)]
    join = " ".join
    halves = join([*w[:5], *w[100:112], *w[5:10]])  # cutting one item brings another one's halves together
    texts = [join(w[:30] + w[200:230] + w[300:340]), halves, join(w[350:390]) + " " + halves, join(w[350:399]), "", None, join(w[0:10])]
    extra = spark.createDataFrame([(900 + k, t, "en", "s", 1, 0.5, 1, "b", "f", 2) for k, t in enumerate(texts)] * 2, docs.schema)
    items = spark.createDataFrame([("a", join(w[:30])), ("b", join(w[200:230])), ("c", join(w[100:112])), ("d", join(w[0:10])), ("e", "same same"), (None, "one")], "item_id string, text string")
    both = docs.union(extra)
    for coverage in (0.5, 0.9):
        one, many = (as_bag(decontaminate(both, items, max_coverage=coverage, block_tokens=b), *both.columns) for b in (200_000, 10))
        assert one == many and sum(one.values()) < both.count()
    assert 900 not in {k[0] for k in one} or coverage == 0.9


def test_quality_references_have_no_cap(spark):
    from textloom.llm import quality

    rows_ = [(k, "the und de la " * 20, f"l{k % 70:02}") for k in range(700)] + [(900, "x " * 60, "rare")]
    docs_ = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    assert {f"l{k:02}" for k in range(70)} | {"", "rare"} == set(quality.language_references(docs_, min_docs=1)) and "rare" not in quality.language_references(docs_)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "MAX_REFERENCE_BYTES", 8 * quality.N_BINS * 20)
        with pytest.raises(ValueError, match="min_docs"):
            quality.language_references(docs_)


def test_suffix_dedup(docs, none):
    from textloom.llm.suffixdedup import NO_ID, remove_duplicate_spans

    data = [(NO_ID if i is None else i, (t or "").encode()) for i, t, *_ in rows()]
    first = {}
    for i, b in data:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = Counter()
    for i, b in data:
        gone = set()
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone.update(range(p, p + 50))
        kept = bytes(c for p, c in enumerate(b) if p not in gone)
        want[(None if i == NO_ID else i, len(b), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(kept).hexdigest())] += 1
    out = remove_duplicate_spans(docs)
    assert as_bag(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert remove_duplicate_spans(none).count() == 0


@pytest.mark.parametrize("rows_held", [16, 100, 1 << 20])
def test_induced_sorting(rows_held, monkeypatch):
    """Against plain sorting, with far fewer rows in memory than the string has, too."""
    from textloom.llm import induced

    rng = random.Random(5)
    monkeypatch.setattr(induced, "PIECE", 64)
    for alphabet in (b"ab", b"a", b"abcdefgh", bytes(range(256))):
        for depth in (5, 50):
            parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(25)]
            parts += [rng.choice(parts) + b"x" for _ in range(6)]
            t = np.array([c for p in parts for c in [*(b + 1 for b in p), 0]], np.uint16)
            with induced.Scratch(rows_held) as scratch:
                got = [(p.copy(), c.copy()) for p, c in induced.suffixes_down(t, depth, scratch)]
                assert (scratch.spilled > 0) == (rows_held < len(t))
            at, common = (np.concatenate(x) for x in zip(*got))
            assert sorted(at.tolist()) == list(range(len(t)))
            keys = [t[i : i + depth].tolist() for i in at]
            for x, y, c in zip(keys, keys[1:], common[1:]):
                assert x >= y
                m = next((k for k, (i, j) in enumerate(zip(x, y)) if i != j), None)
                if m is not None or len(x) == len(y) == depth:
                    assert c == (depth if m is None else m)


def test_substring_dedup_with_little_memory(docs):
    """Shards far larger than what a queue may hold give the same spans."""
    from textloom.llm.suffixdedup import remove_duplicate_spans

    names = ("doc_id", "n_removed", "n_spans", "kept_sha256")
    assert as_bag(remove_duplicate_spans(docs, rows=50, cell_bytes=2000), *names) == as_bag(remove_duplicate_spans(docs), *names)


def test_substring_dedup_shards_follow_the_data(docs):
    """A shard's share of the texts doesn't grow with the table, and more shards than partitions give the same spans."""
    from textloom.llm.suffixdedup import SHARD, remove_duplicate_spans, shard_count

    assert shard_count(1000, 4) == 4 and all(total <= shard_count(total, 200) * SHARD for total in (1 << 29, 6 << 30, 30 << 30))
    names = ("doc_id", "n_removed", "n_spans", "kept_sha256")
    assert as_bag(remove_duplicate_spans(docs, shard_bytes=200), *names) == as_bag(remove_duplicate_spans(docs), *names)


def test_passages(docs, none):
    from textloom.llm.passages import passage_classes

    got = {r.doc_id: r.class_id for r in passage_classes(docs).collect()}
    assert {i for i in got} == {7, 8, 9, 15, 16} and set(got.values()) == {7}
    assert passage_classes(none).count() == 0


def test_passages_of_edited_copies_against_brute_force(spark):
    """A passage in many documents, in two interleaved variants, each copy with edits of its own."""
    from textloom.llm.passages import align, passage_classes, word_shingles

    rng = random.Random(12)
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for k in range(160):
        own = [w if k % 2 or j % 17 else f"v{j}" for j, w in enumerate(passage)]
        for j in rng.sample(range(120), rng.randint(0, 4)):
            own[j] = f"e{rng.randrange(10**6)}"
        fill = [f"r{rng.randrange(10**6)}" for _ in range(30)]
        texts.append(" ".join(fill + own + fill[::-1]))
    h = [word_shingles(t.encode(), 5) for t in texts]
    near = [(i, j) for j in range(len(h)) for i in range(j) if align(h[j], h[i], 46, 0.8)]
    got = {r.doc_id: r.class_id for r in passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(i in got and got[i] == got.get(j) for i, j in near)
    print(f"op4 recall: {found} of {len(near)} pairs, {len(got)} of {len({i for x in near for i in x})} documents")
    assert len(near) > 1000 and found >= 0.997 * len(near)
    assert len(got) >= 0.975 * len({i for x in near for i in x})


def test_passages_of_crowded_hashes_lose_no_link(spark):
    """Two edited variants of a passage, as above, in which landmarks alone miss documents."""
    from textloom.llm.passages import align, passage_classes, word_shingles

    rng = random.Random(12)
    texts = []
    for k in range(160):
        own = [f"p{j}" if k % 2 or j % 17 else f"v{j}" for j in range(120)]
        for j in rng.sample(range(120), rng.randint(0, 4)):
            own[j] = f"e{rng.randrange(10**6)}"
        fill = [f"r{rng.randrange(10**6)}" for _ in range(30)]
        texts.append(" ".join(fill + own + fill[::-1]))
    h = [word_shingles(t.encode(), 5) for t in texts]
    near = [(i, j) for j in range(len(h)) for i in range(j) if align(h[j], h[i], 46, 0.8)]
    got = {r.doc_id: r.class_id for r in passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(near) > 1000 and all(i in got and got[i] == got.get(j) for i, j in near)


def test_passages_about_a_common_line(spark):
    """A line of 40 words is in all documents; pairs share 24 words about it."""
    from textloom.llm.passages import passage_classes

    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    line, texts = say(40), []
    for _ in range(60):
        a, b = say(12), say(12)
        texts += [" ".join(say(40) + a + line + b + say(40)) for _ in range(2)]
    texts += [" ".join(say(52) + line + say(52)) for _ in range(300)]
    got = {r.doc_id: (r.class_id, r.spans) for r in passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: (k - k % 2, "40:104") for k in range(120)}


def test_places_of_a_common_line():
    from textloom.llm.passages import common_places, groups_of, unsettled_count, unsettled_pairs

    assert common_places(np.array([7, 3, 20]), 5, 46).tolist() == [*range(12), *range(16, 25)]
    assert common_places(np.arange(0, 60, 6), 5, 46).tolist() == list(range(0, 60, 6))
    n = 6
    x = {"v": np.array([9, 9, 9, 9, 9, 4], np.uint64), "f": np.zeros(n, int), "id": np.arange(n), "row": np.arange(n).astype(np.uint64), "l": np.zeros(n, int), "c": np.ones(n, int), "r": np.ones(n, int)}
    x |= {"left": np.array([1, 1, 1, 1, 2, 1], np.uint16), "right": np.array([0, 1, 2, 3, 4, 5], np.uint16), "class": np.array([0, 0, 2, 3, 0, 5])}
    x, groups = groups_of([x])
    (a, b), = groups
    assert b - a == 5 and unsettled_count(x, a, b) == 7
    got = sorted((int(x["id"][i]), int(x["id"][j])) for one, two in unsettled_pairs(x, a, b) for i, j in zip(one, two))
    assert got == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_passages_recall_on_a_table_with_edited_passages(spark):
    """Every fifth document gets an edited passage of another; all pairs that share enough shingles are aligned."""
    from textloom.llm.passages import align, passage_classes, word_shingles

    rng = random.Random(3)
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = [w for w in (t.split() for _, t in docs) if len(w) >= 200]
    table = []
    for k, (i, t) in enumerate(docs):
        if k % 5 == 0:
            w = rng.choice(long)
            a = rng.randrange(len(w) - 120)
            passage = w[a : a + rng.randint(60, 120)]
            for _ in range(rng.randint(0, 4)):
                passage[rng.randrange(len(passage))] = f"edit{rng.randrange(10**6)}"
            t += " " + " ".join(passage)
        table.append((i, t))
    h = [word_shingles(t.encode(), 5) for _, t in table]
    holders = defaultdict(set)
    for k, a in enumerate(h):
        for v in a.tolist():
            holders[v].add(k)
    shared = Counter((i, j) for ks in holders.values() for j in ks for i in ks if i < j)
    # Similarity 0.8 over 46 shingles takes 37 that are shared.
    near = [(i, j) for (i, j), n in shared.items() if n >= 37 and align(h[j], h[i], 46, 0.8)]
    got = {r.doc_id: r.class_id for r in passage_classes(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    ids = [i for i, _ in table]
    found = sum(ids[i] in got and got[ids[i]] == got.get(ids[j]) for i, j in near)
    assert len(near) > 20 and found >= 0.9 * len(near)


def test_compact_windows_hold_every_min():
    from textloom.llm.passages import compact_windows

    rng = np.random.default_rng(1)
    for n in (3, 40, 90):
        h = rng.integers(0, 30, n).astype(np.uint64)
        found = compact_windows(h, 10)
        for a in range(n):
            for b in range(a + 9, n):
                assert any(l <= a and b <= r and h[c] == h[a : b + 1].min() for l, c, r in found if h[l : r + 1].min() == h[c])


def test_mixing(docs, none):
    from textloom.llm.mixing import mix

    out = mix(docs, bin_rows=2).collect()
    size = Counter()
    for _, t, _, s, *_ in rows():
        size[s] += len(words(t))
    order = sorted(k for k in size if k is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(words(t))) for i, t, *_ in rows())
    for s in order:
        assert abs(taken[s] - target[s]) <= max((len(words(t)) for _, t, _, x, *_ in rows() if x == s), default=0)
    assert as_bag(mix(docs.repartition(5), bin_rows=2), "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in out)
    assert mix(none).count() == 0


def test_pii(docs, none):
    from textloom.llm.pii import find_pii, redact, spans_text

    got = {r[0]: r[1] for r in find_pii(docs).select("row.doc_id", spans_text(F.col("base"))).where("doc_id IS NOT NULL").collect()}
    text = rows()[17][1]
    want = []
    for kind, s in (("email", "a.b@c.de"), ("phone", "+1 (017) 555-7713"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8")):
        want.append((text.index(s), f"{kind}:{text.index(s)}:{text.index(s) + len(s)}"))
    assert got[17] == ",".join(x for _, x in sorted(want)) and got[0] == got[1] == ""
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[17] == "mail <EMAIL>, <PHONE>; <IP> or 300.1.1.1, <CARD> é <IP>.<IP>" and clean[0] is None
    assert find_pii(none).count() == 0


def test_many_matches_keep_their_places(spark):
    from textloom.llm.pii import find_pii, spans_text

    text = "é x@y.z " * 1500
    got = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(spans_text(F.col("base"))).first()[0]
    assert got == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"x@y\.z", text))


def test_preferences(spark):
    from textloom.llm.preference import next_reply_pairs, preference_format

    schema = "conv_id long, turn int, role string, text string, extra string"
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", None), (3, 0, "user", "only"), (None, 0, "user", "x"), (2, 1, "assistant", "b")]
    out = {r.pair_id: r for r in preference_format(*next_reply_pairs(spark.createDataFrame([(*t, "e") for t in talk], schema))).collect()}
    assert set(out) == {1, 2}
    r = out[1]
    assert r.n_prefix == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert r.rejected == "<|im_start|>assistant\nb<|im_end|>\n" and r.chosen.count("<|im_end|>") == 1
    a, b = map(int, r.rejected_spans.split(":"))
    assert r.rejected[a:b] == "b<|im_end|>"
    empty = spark.createDataFrame([], schema)
    assert preference_format(*next_reply_pairs(empty)).count() == 0


def test_windows_of_many_texts_are_those_of_each():
    from textloom.llm.passages import compact_windows, windows_of_all, word_shingles

    say = random.Random(5)
    texts = [b"a " * 900, b"a b c " * 300, b"one two", *(b" ".join(b"w%d" % say.randrange(40 + 400 * (k % 2)) for _ in range(say.randrange(10, 700))) for k in range(30))]
    held = [word_shingles(t, 5) for t in texts]
    sizes = np.array([len(h) for h in held])
    text, *places = windows_of_all(np.concatenate(held), sizes, 46)
    start = (np.cumsum(sizes) - sizes)[text]
    got = list(zip(text.tolist(), *((p - start).tolist() for p in places)))
    assert sorted(got) == sorted((n, *w) for n, h in enumerate(held) for w in compact_windows(h, 46))


def test_windows_of_texts_that_repeat_themselves_take_few_steps(monkeypatch):
    """Long chains of equal minima are cut at once; other texts' trees are done by then."""
    from textloom.llm import passages

    held = [passages.word_shingles(b"a b c " * 2000, 5), passages.word_shingles(b" ".join(b"w%d" % (k * k % 9973) for k in range(3000)), 5)]
    sizes, steps, frexp = np.array([len(h) for h in held]), [], np.frexp
    monkeypatch.setattr(passages.np, "frexp", lambda *a: steps.append(1) or frexp(*a))
    for least in (1, 2, 5, 46, 64):
        text, *places = passages.windows_of_all(np.concatenate(held), sizes, least)
        start = (np.cumsum(sizes) - sizes)[text]
        got = list(zip(text.tolist(), *((p - start).tolist() for p in places)))
        assert sorted(got) == sorted((n, *w) for n, h in enumerate(held) for w in passages.compact_windows(h, least))
    assert len(steps) <= 5 * 40


def test_pairs_that_share_too_little_are_not_numbered(monkeypatch):
    from textloom.llm import passages

    rng = np.random.default_rng(6)
    a, b, same = (rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (400, 900, 60))
    few, sparse = b.copy(), b.copy()
    few[50:59] = a[10:19]
    sparse[:200:4] = a[:200:4]
    whole = np.concatenate((b[:300], same, b[300:]))
    assert passages.align(np.concatenate((a, same)), whole, 46, 0.8) == [(400, 460, 300, 360, 1.0)]
    assert passages.align(np.repeat(a[:2], 50), np.repeat(a[1:3], 60), 46, 0.8) == [(50, 100, 0, 60, 1.0)]
    monkeypatch.setattr(passages.np, "unique", None)
    assert all(passages.align(a, x, 46, 0.8) == passages.align(x, a, 46, 0.8) == [] for x in (b, few, sparse, b[:0]))


def test_shingles_of_parts_tell_apart_what_word_shingles_do():
    from textloom.llm.passages import shingles_of_parts, word_shingles

    parts = [b"a", b"a b c d e", b"\xc3\xa9 \x00 \x01\x00 \x00\x01 x", b"y " * 3 + b"z " * 9 + b"y", b"ab ba abc a bc ab c", bytes(range(33, 256)) * 90 + b" q" * 7, b"a b c d e"]
    for k in (1, 2, 5):
        got, want = shingles_of_parts(parts, k), [word_shingles(p, k) for p in parts]
        assert [len(x) for x in got] == [len(x) for x in want]
        met = set(zip(np.concatenate(got).tolist(), np.concatenate(want).tolist()))
        assert len(met) == len({x for x, _ in met}) == len({x for _, x in met})


def test_settled_rounds_take_no_sort(monkeypatch):
    from textloom.llm import induced

    level = induced.Level(np.array([5, 3, 4, 1, 2, 5, 1, 4, 0]), 6, induced.Scratch(), each=False)
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(induced.np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    order, members, n = level._ordered([np.array([3, 6])], [], int(level.of[1]), False, 50)
    assert len(members) == n == len(order) and len(sorts) == 1
