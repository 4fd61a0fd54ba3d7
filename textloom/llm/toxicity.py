"""Toxicity by a weighted finite-state pattern grammar.

Transducers over word classes, each a table of arcs, are composed into one: negation and reported speech mark the insults and threats they reach, the threat
transducer turns a verb of violence after an intention into a threat, the target acceptor tells whether somebody is addressed. An insult's arc weighs what a learned lexicon of
words and word stems says, marked ones a part of it (DAMPED). A word of several classes has an arc for each; a clause's match is the best path through the composition, and its
outputs with their weights are sums by kind (plain, targeted, negated, reported, threat). Words outside a matched clause never count; threats only count
where somebody is addressed. A logistic layer over the sums of a document's matched clauses gives the score.

The lexicon and the layer are learned from a bounded sample of labelled rows (`max_positive`, `max_negative`), half for each; rows of
the held-out fold are never used. Labels, language, source and id are no inputs of a score.

Defined results: null or empty texts have no clauses and get the score of a document without matches; very long texts are read whole, clause by clause; labels of one document that
contradict each other count as toxic; without labels of both kinds, or with an empty label table, the lexicon is empty and every
score is the rate of toxic labels (0 without labels); paths of equal weight give way to the first; repeated rows are scored each; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts

MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
THRESHOLD = 0.3
#: Words of the closed classes, in English, French, German and Spanish.
NEGATION = set("not no never none isn aren wasn don doesn pas jamais aucun nicht kein keine nie nunca ningún".split())
REPORT = set("said says quote quoted called wrote according dit disait selon sagte sagt laut schrieb dijo dice según".split())
TARGET = set("you your yourself he she they them vous tu toi ihr du dich euch usted tú ustedes".split())
THREAT = set("kill hurt destroy burn shoot stab die tuer frapper mourir töten schlagen sterben matar golpear morir".split())
INTENT = set("will gonna shall must should vais allez werde wirst voy vas".split())
#: A damping word reaches this many words ahead in its clause.
REACH = 4
STEM_LENGTHS = (5, 6, 7, 8)
CACHE = 1 << 16

_FOLD = str.maketrans("013457", "oieast")
_SPLIT = re.compile(r"[.!?;:\n,\"“”«»|]+")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().translate(_FOLD))


@dataclass(frozen=True)
class Transducer:
    """From a state, a symbol leads to a state and puts out a symbol. Every state has an arc for every symbol that may come; `final` names what ends in a state."""

    start: tuple
    arcs: dict[tuple[tuple, str], tuple[tuple, str]]
    final: dict[tuple, str]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out goes into the other."""
        start = self.start + other.start
        arcs, final, todo = {}, {}, [(self.start, other.start)]
        by_state: dict[tuple, list] = {}
        for (state, symbol), (to, out) in self.arcs.items():
            by_state.setdefault(state, []).append((symbol, to, out))
        while todo:
            a, b = todo.pop()
            if a + b in final:
                continue
            final[a + b] = other.final[b] or self.final[a]
            for symbol, to, out in by_state[a]:
                to_b, out_b = other.arcs[b, out]
                arcs[a + b, symbol] = to + to_b, out_b
                todo.append((to, to_b))
        return Transducer(start, arcs, final)


#: What words are, and what the transducers make of it.
WORD_CLASSES = ("other", "insult", "violence", "target", "negation", "report", "intent")
_MARKED = {"insult": ("insult negated", "insult reported"), "violence": ("violence negated", "violence reported")}
_SYMBOLS = (*WORD_CLASSES, *(m for ms in _MARKED.values() for m in ms))


def damper(trigger: str, mark: int, reach: int) -> Transducer:
    """Marks the insults and the violence that come up to `reach` words after the trigger and aren't marked yet."""
    arcs = {}
    for k in range(reach + 1):
        for symbol in _SYMBOLS:
            out = _MARKED[symbol][mark] if k and symbol in _MARKED else symbol
            arcs[(k,), symbol] = (reach if symbol == trigger else max(0, k - 1),), out
    return Transducer((0,), arcs, {(k,): "" for k in range(reach + 1)})


def threatening(reach: int) -> Transducer:
    """Violence up to `reach` words after an intention is a threat; other violence is nothing."""
    arcs = {}
    for k in range(reach + 1):
        for symbol in _SYMBOLS:
            out = symbol.replace("violence", "threat") if k else "other"
            arcs[(k,), symbol] = (reach if symbol == "intent" else max(0, k - 1),), out if symbol.startswith("violence") else symbol
    return Transducer((0,), arcs, {(k,): "" for k in range(reach + 1)})


def addressed() -> Transducer:
    """Ends in "targeted" after a target, wherever it stands."""
    symbols = (*_SYMBOLS, *(s.replace("violence", "threat") for s in _SYMBOLS if s.startswith("violence")))
    arcs = {((k,), s): ((int(k or s == "target"),), s) for k in (0, 1) for s in symbols}
    return Transducer((0,), arcs, {(0,): "", (1,): "targeted"})


PARTS = (damper("negation", 0, REACH), damper("report", 1, 2 * REACH), threatening(REACH), addressed())
COMPOSED = PARTS[0].then(PARTS[1]).then(PARTS[2]).then(PARTS[3])
#: The part of its weight that a marked arc keeps; symbols that aren't named weigh nothing.
DAMPED = {"insult": 1.0, "threat": 1.0, "insult negated": 0.25, "threat negated": 0.25, "insult reported": 0.5, "threat reported": 0.5}
Path = tuple[float, tuple[tuple[str, float, str], ...]]  # weight, and (symbol, weight, word) of the arcs that weigh something


def best_path(options: list[tuple[str, list[tuple[str, float]]]], grammar: Transducer = COMPOSED) -> tuple[str, Path]:
    """The final name and the best path of a clause: (word, its classes with their weights) for each word."""
    now: dict[tuple, Path] = {grammar.start: (0.0, ())}
    for word, classes in options:
        then: dict[tuple, Path] = {}
        for state, (total, said) in now.items():
            for symbol, weight in classes:
                to, out = grammar.arcs[state, symbol]
                w = weight * DAMPED.get(out, 0.0)
                if to not in then or then[to][0] < total + w:
                    then[to] = (total + w, (*said, (out, w, word)) if w else said)
        now = then
    state = max(now, key=lambda x: (now[x][0], grammar.final[x]))
    return grammar.final[state], now[state]


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    layer: list[float] = field(default_factory=list)  # intercept, then a weight for each feature
    rate: float = 0.0

    def __post_init__(self):
        self.heads = {s[:5] for s in self.stems}
        self.known: dict[str, list[tuple[str, float]]] = {}  # words' arcs, so that each is looked up once; emptied at CACHE words

    def weight(self, word: str) -> float:
        """Of the insult arc for the word; 0 if it has none."""
        w = self.words.get(word, 0.0)
        if word[:5] in self.heads:
            for n in STEM_LENGTHS:
                if len(word) > n:
                    w = max(w, self.stems.get(word[:n], 0.0))
        return w

    def classes(self, word: str) -> list[tuple[str, float]]:
        """The word's arcs."""
        if (out := self.known.get(word)) is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            out = self.known[word] = self._classes(word)
        return out

    def _classes(self, word: str) -> list[tuple[str, float]]:
        w = self.weight(word)
        out = [("insult", w)] if w > 0 else []
        out += [("violence", max(w, 1.0))] if word in THREAT else []
        out += [(name, 0.0) for name, known in (("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("intent", INTENT)) if word in known]
        return out or [("other", 0.0)]

    def clause(self, words: list[str]) -> dict[str, list[tuple[float, str]]]:
        """(weight, word) of the matched arcs by kind; nothing without a match."""
        options = [(w, self.classes(w)) for w in words]
        if not any(c[0][1] for _, c in options):  # insults and violence come first, and weigh something
            return {}
        end, (_, said) = best_path(options)
        out: dict[str, list[tuple[float, str]]] = {}
        for symbol, w, word in said:
            what, _, mark = symbol.partition(" ")
            if what == "threat" and not end:
                continue
            out.setdefault(mark or ("threat" if what == "threat" else end or "plain"), []).append((w, word))
        return out

    def features(self, text: str) -> list[float]:
        """Of the matched clauses; all 0 without one."""
        if not self.words and not self.stems:
            return [0.0] * N_FEATURES
        words = words_of(text)
        heads, known = self.heads, self.words
        if not any(w in known or w[:5] in heads or w in THREAT for w in words):
            return [0.0] * N_FEATURES
        sums = dict.fromkeys(KINDS, 0.0)
        hits = clauses = 0
        words_hit: dict[str, float] = {}
        for part in _SPLIT.split(text):
            found = self.clause(words_of(part))
            clauses += bool(found)
            for kind, arcs in found.items():
                for w, word in arcs:
                    sums[kind] += w
                    hits += 1
                    words_hit[word] = max(words_hit.get(word, 0.0), w)
        strong = sum(min(w, 6.0) for w in words_hit.values())
        n = max(len(words), 1)
        return [math.log1p(sums[k]) for k in KINDS] + [math.log1p(clauses), min(1.0, 20.0 * hits / n), math.log1p(strong), float(len(words_hit) > 1), min(1.0, 10.0 * strong / n)]

    def score(self, text: str) -> float:
        if not self.layer:
            return self.rate
        z = self.layer[0] + sum(a * b for a, b in zip(self.layer[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


KINDS = ("plain", "targeted", "negated", "reported", "threat")
N_FEATURES = len(KINDS) + 5


def learn_lexicon(positive: list[str], negative: list[str], least_odds: float = 1.8) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems whose documents are toxic far more often than others: term -> log odds ratio."""

    def counts(texts):
        words, stems = Counter(), Counter()
        for t in texts:
            seen = {w for w in words_of(t) if len(w) > 3}
            words.update(seen)
            stems.update({w[:n] for w in seen for n in STEM_LENGTHS if len(w) > n})
        return words, stems

    (pw, ps), (nw, ns) = counts(positive), counts(negative)
    np_, nn = len(positive), len(negative)
    odds = lambda a, b: math.log((a + 0.5) / (np_ - a + 1)) - math.log((b + 0.5) / (nn - b + 1))
    # Beyond the least ratio, the difference has to stand out from chance by z standard errors.
    sure = lambda a, b, z: odds(a, b) - z * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > 0
    words = {w: round(o, 4) for w, a in pw.items() if a >= 4 and (o := odds(a, nw[w])) >= least_odds and sure(a, nw[w], 1.5)}
    stems = {s: round(o, 4) for s, a in ps.items() if a >= 8 and (o := odds(a, ns[s])) >= least_odds and sure(a, ns[s], 3.0)}
    return words, stems


def fit_layer(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [round(float(v), 6) for v in w]


def fit(rows: list[tuple[int, str, int]], rate: float) -> Grammar:
    """rows: (id's hash, text, toxic). Near copies of one text count once."""
    seen, kept = set(), []
    for h, t, y in sorted(rows, key=lambda r: (r[0], r[1])):
        marks = tuple(sorted({zlib.crc32(w.encode()) for w in words_of(t)})[:3])
        if marks not in seen:
            seen.add(marks)
            kept.append((h, t, y))
    halves = [[(t, y) for h, t, y in kept if h // 4 % 2 == k] for k in (0, 1)]
    parts = [([t for t, y in p if y], [t for t, y in p if not y]) for p in halves]
    if not all(p and n for p, n in parts):
        return Grammar(rate=rate)
    # The layer learns on texts whose words the lexicon hasn't seen: each half is scored by the other's lexicon; all are used at the end.
    xs, ys = [], []
    for k in (0, 1):
        g = Grammar(*learn_lexicon(*parts[1 - k]))
        xs += [g.features(t) for t, _ in halves[k]]
        ys += [y for _, y in halves[k]]
    x, y = np.array(xs), np.array(ys, float)
    # The sample has its own share of toxic rows: shift the intercept to the share among all labels.
    layer = fit_layer(x, y)
    r = min(max(rate, 1e-4), 1 - 1e-4)
    s = y.mean()
    layer[0] += math.log(r / (1 - r)) - math.log(s / (1 - s))
    return Grammar(*learn_lexicon(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]), layer, rate)


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Grammar:
    """Fit on the labelled documents with the smallest hashes outside the held-out fold, as many of each class as the bounds say."""
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("y")).withColumn("h", fold(id_col)).where("h % 4 <> 2")
    total, toxic = y.agg(F.count(F.lit(1)), F.sum("y")).first()
    rate = (toxic or 0) / total if total else 0.0
    pick = lambda k, n: y.where(F.col("y") == k).orderBy(F.xxhash64("h", id_col), id_col).limit(n)
    chosen = F.broadcast(pick(1, max_positive).union(pick(0, max_negative)))  # bounded by the two parameters
    rows = docs.select(id_col, text).join(chosen, id_col).where(F.col(text).isNotNull()).select("h", text, "y").collect()
    return fit([tuple(r) for r in rows], rate)


def score_documents(docs: DataFrame, grammar: Grammar, text: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(texts: list[bytes]) -> dict:
        g = held.value
        scores = [g.score(t.decode()) for t in texts]
        return {"score": scores, "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}

    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_texts(docs, carry or ["doc_id"], text, run, schema)
