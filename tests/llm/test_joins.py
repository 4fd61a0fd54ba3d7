"""The prefix trie, periodic runs and the Jaccard join against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

CONV = "conv_id long, turn long, role string, text string, id string, path string, depth int, n int"
DOCS = "doc_id long, text string, n int, node string, runs string, component_id string"


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def talk(seed=5, convs=60):
    rng = random.Random(seed)
    say = ["", None, "hello", "é" * 40, "a b c", "<|x|>", "long " * 300]
    out = []
    for c in range(convs):
        for t in range(rng.choice([1, 1, 2, 3, 6, 40 if c == 7 else 4])):
            out.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", "assistant", None, ""]), rng.choice(say[:4] if t < 3 else say), "x", "p", 1, 2))
    copies = [(c, t, "user", f"copy {t}", "x", "p", 1, 2) for c in range(100, 160, 5) for t in range(3)]
    return [*out, *copies, out[4], (None, 1, "user", "nobody", "x", "p", 1, 2), (2**40, 0, None, None, "x", "p", 1, 2)]


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t or 0), digest, len(text.encode()), (role, text)))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        r = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(r) + 1):
            members[tuple(r[:d])].append(c)
        ends[tuple(r)].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, ends[k])))) for k, m in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("most, shards", [(1 << 17, 4), (1, 3), (9, 1), (30, 16)])
def test_prefix_trie(spark, most, shards):
    from textloom.llm.prefixtrie import prefix_trie, turn_paths, with_shared_starts

    rows = talk()
    out = prefix_trie(with_shared_starts(turn_paths(spark.createDataFrame(rows, CONV).repartition(3))), most, shards)
    assert Counter(tuple(r) for r in out.select(*TRIE).collect()) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    from textloom.llm.prefixtrie import prefix_trie, turn_paths, with_shared_starts

    assert prefix_trie(with_shared_starts(turn_paths(spark.createDataFrame([], CONV)))).count() == 0


def test_members_in_chunks(spark, monkeypatch):
    from textloom.llm import prefixtrie

    monkeypatch.setattr(prefixtrie, "ID_RANGE", 7)
    rows = [(c, t, "user", "same", "x", "p", 1, 2) for c in range(0, 200, 5) for t in range(2)]
    out = prefixtrie.prefix_trie(prefixtrie.with_shared_starts(prefixtrie.turn_paths(spark.createDataFrame(rows, CONV))))
    assert Counter(tuple(r) for r in out.select(*TRIE).collect()) == brute_trie(rows)


def test_findclose_against_a_stack():
    from textloom.llm.prefixtrie import Parens

    rng = random.Random(2)
    for n in (1, 2, 31, 32, 33, 500, 5000):
        for lean in (0.5, 0.95):
            bits, depth, left = [], 0, n
            while left or depth:
                up = left and (not depth or rng.random() < lean)
                bits.append(bool(up))
                depth, left = (depth + 1, left - 1) if up else (depth - 1, left)
            stack, want = [], {}
            for k, b in enumerate(bits):
                if b:
                    stack.append(k)
                else:
                    want[stack.pop()] = k
            at = np.flatnonzero(np.array(bits))
            assert Parens(np.array(bits)).findclose(at).tolist() == [want[k] for k in at.tolist()]


def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                part = w[i : j + q]
                if not any(all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out)


def run_texts():
    rng = random.Random(8)
    out = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a " * 500, "a b " * 6 + "c", "x " + "p q r s t u " * 2 + "y", ("a b " * 9 + "c ") * 5, "a\x0bb\x0c" * 8, "A a " * 9]
    for _ in range(60):
        size = rng.randint(1, 3)
        out.append(" ".join(rng.choice("abc"[:size]) for _ in range(rng.randint(12, 90))))
    for _ in range(20):  # periods within periods
        part = [rng.choice("abcdef") for _ in range(rng.randint(1, 9))] * rng.randint(1, 4) + [rng.choice("abz")]
        out.append(" ".join([*(rng.choice("uvw") for _ in range(rng.randint(0, 5))), *(part * rng.randint(1, 5))[: rng.randint(10, 90)], "end"]))
    return out


def test_runs_against_brute_force():
    from textloom.llm.periodic import batch_runs, collapse

    words = [(t or "").encode().split() for t in run_texts()]
    for least in (12, 6, 5, 3):
        assert batch_runs(words, least) == [brute_runs(w, least) for w in words]
    for w, runs in zip(words, batch_runs(words)):
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert collapse(w, runs) == b" ".join(x for k, x in enumerate(w) if k not in gone)
    assert batch_runs([]) == []


def test_periodic_query(spark, tmp_path):
    from textloom.llm.queries import QUERIES

    texts = run_texts() * 3
    rows = [(i, t, 1, "n", "r", "c") for i, t in enumerate(texts)]
    rows += [rows[5], rows[70], (None, "a " * 30, 1, "n", "r", "c")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want[(i, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    out = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == want
    assert QUERIES["op12_periodic_runs"](spark, str(tmp_path)).where("doc_id < 0").count() == 0


def join_texts(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [None, "", " \t\n", "one", "One", "one two three", "one two three four", "two three four one"]
    passage = say(60)
    for n in (5, 8, 9, 10, 12, 15, 16, 20, 24, 27, 40, 90, 300):
        base = say(n)
        for _ in range(12):  # edits at the ends and inside, around the threshold
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            w = w[: len(w) - rng.choice([0, 0, 1, 2, max(1, n // 12)])] + say(rng.choice([0, 0, 1, 2]))
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        out.append(" ".join(base + passage))
        out.append(" ".join(base) + "\n" + " ".join(passage * 2))
    return [*out, " ".join(say(6000)), "a " * 500, "a " * 9]


def brute_groups(rows):
    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split()]
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root(k)].append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((r[0], len(sets[k]), low[root(k)] if sets[k] else r[0]) for k, r in enumerate(rows))


@pytest.mark.parametrize("boundary, block, ids", [(None, 512, 1 << 20), (0, 3, 0), (12, 5, 1 << 20), (20, 512, 1 << 20)])
def test_jaccard_join_against_brute_force(spark, boundary, block, ids, monkeypatch):
    from textloom.llm import jaccardjoin

    monkeypatch.setattr(jaccardjoin, "BROADCAST_IDS", ids)
    monkeypatch.setattr(jaccardjoin, "LONG", block // 2)
    rows = [(3 * i + 1, t, 1, "n", "r", "c") for i, t in enumerate(join_texts())]
    rows += [rows[20], (rows[20][0], rows[60][1], 1, "n", "r", "c"), (None, rows[70][1], 1, "n", "r", "c"), (None, "only here and never elsewhere", 1, "n", "r", "c"), (None, None, 1, "n", "r", "c")]
    out = jaccardjoin.similar_groups(spark.createDataFrame(rows, DOCS).repartition(3), boundary=boundary, block=block)
    assert Counter(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()) == brute_groups(rows)
    assert jaccardjoin.similar_groups(spark.createDataFrame([], DOCS), boundary=boundary).count() == 0


def test_jaccard_join_on_a_table(spark):
    """sf0.001 with every third document given an edited copy."""
    from textloom.llm.jaccardjoin import similar_groups

    rng = random.Random(1)
    rows = [(r.doc_id, r.text, 1, "n", "r", "c") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    for i, t, *_ in rows[::3]:
        w = (t or "").split(" ")
        for _ in range(rng.randint(1, 2 + len(w) // 60)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((1000 + i, " ".join(w), 1, "n", "r", "c"))
    out = similar_groups(spark.createDataFrame(rows, DOCS).repartition(4))
    assert Counter(tuple(r) for r in out.collect()) == brute_groups(rows)


def test_subset_sizes_cover_every_partner():
    from textloom.llm.jaccardjoin import choose_boundary, keys_of, need, subset_sizes

    for s in range(1, 25):
        for t in range(s, 30):
            if 100 * s >= 85 * t:
                assert need(s, t) in subset_sizes(s) and need(s, t) in subset_sizes(t)
    assert keys_of(5) == 1 and keys_of(12) == 13
    assert choose_boundary({13: 100, 14: 5}, {13: 99, 14: 7}) == 12 and choose_boundary({13: 2, 14: 5}, {13: 99, 14: 7}) == 13 and choose_boundary({13: 2, 14: 5}, {13: 99, 14: 10**6}) == 14
