"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are held against references of the
languages by the Jensen-Shannon distance (base 2, so 0 to 1). The references are sums over all documents of
a language (each value of `lang`, however many); a language without a word list is compared by the common words of all lists together, and those
of fewer than `min_docs` documents share the reference of all documents together. A document is judged
against the language it is nearest to, so a wrong or missing `lang` doesn't reject it.

Defined results: null and empty texts have no words and fail the base rules; documents of fewer than `min_words`
words are never judged by divergence (they fail the base rules); very long texts are counted whole; of equally near references, the first by name counts; an empty table gives no rows;
extra columns, whatever their names, are ignored; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts

#: Common function words by language.
COMMON_WORDS = {
    "de": "der die das und den in zu von mit sich ist im nicht ein eine einer auf auch für als dem des an es werden aus er hat dass sie nach wird bei um am sind noch wie über".split(),
    "en": "the of and to in a is that for it was on are as with by be this from at or an not he have had his but they which you were her she there been their we has will".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos".split(),
    "fr": "de la le et les des en un une du dans est que pour qui au par sur ne pas plus ce se il son avec sont ou aux mais comme on tout nous sa leur fait été être ont".split(),
}
LANGUAGES = sorted(COMMON_WORDS)
#: lower, upper, digit, space, sentence punctuation, other ASCII symbols, beyond ASCII, controls
N_CLASSES = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents by which a language without a word list gets a reference of its own (a default; quality_verdicts takes another).
MIN_DOCS = 10
#: Bytes of references that tasks may hold; more languages than that are an error, not fewer references.
MAX_REFERENCE_BYTES = 256 << 20
#: Limits of the two distances; a document beyond either is rejected. Each gets its slack / sqrt(words) on top, as short documents scatter.
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.16, 1.0
MAX_WORD_DISTANCE, WORD_SLACK = 0.12, 2.0


def _class_map() -> np.ndarray:
    m = np.full(256, 5, np.int64)
    m[0x80:0xC0] = 8  # continuation bytes: a code point counts once
    m[0xC0:] = 6
    m[:32] = 7
    m[127] = 7
    m[ord("a") : ord("z") + 1] = 0
    m[ord("A") : ord("Z") + 1] = 1
    m[ord("0") : ord("9") + 1] = 2
    m[[9, 10, 11, 12, 13, 32]] = 3
    m[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    return m


_CLASS = _class_map()
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_SYMBOLS = b"#*$%&|<>"
_NO_POINT = bytes([*range(0x80, 0xC0), 32, 9, 10, 11, 12, 13])
_OFFSETS = np.cumsum([0, *(len(COMMON_WORDS[g]) + 1 for g in LANGUAGES)])
_INDEX: dict[bytes, list[int]] = {}
for _k, _g in enumerate(LANGUAGES):
    for _j, _w in enumerate(COMMON_WORDS[_g]):
        _INDEX.setdefault(_w.encode(), []).append(int(_OFFSETS[_k]) + _j)
N_WORD_BINS = int(_OFFSETS[-1])
N_BINS = N_CLASSES + N_WORD_BINS


def histograms(text: bytes) -> np.ndarray:
    """Character classes, then for each language its common words and the rest."""
    out = np.zeros(N_BINS, np.int64)
    out[:N_CLASSES] = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]
    words = text.translate(_FOLD).split()
    hits = [w for w in words if w in _INDEX]
    for w, n in Counter(hits).items():
        for j in _INDEX[w]:
            out[N_CLASSES + j] += n
    for k in range(len(LANGUAGES)):
        a, b = N_CLASSES + _OFFSETS[k], N_CLASSES + _OFFSETS[k + 1]
        out[b - 1] = len(words) - out[a : b - 1].sum()
    return out


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text.translate(None, _NO_POINT))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the rows of p (counts) and the histogram q; rows without counts are at 0."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(np.where(m > 0, x / m, 1)), 0).sum(axis=-1)
        d = np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(p.sum(axis=-1) > 0, d, 0.0)


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", min_docs: int = MIN_DOCS) -> dict[str, np.ndarray]:
    """Summed histograms of all documents, by language, and "" for everything: a row of 8 * N_BINS bytes each, whose number is checked before they are gathered."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("hist", T.ArrayType(T.LongType())), T.StructField("docs", T.LongType())])
    arrow = to_arrow_schema(schema)

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        count: Counter[str] = Counter()
        for b in batches:
            texts, langs = b.column(1).cast(pa.binary()), b.column(0).to_pylist()
            for i, g in enumerate(langs):
                h = histograms(texts[i].as_py() or b"")
                for key in {"", g or ""}:
                    count[key] += 1
                    if key in total:
                        total[key] += h
                    else:
                        total[key] = h.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([h.tolist() for h in total.values()], arrow.field(1).type), pa.array([count[key] for key in total], pa.int64())], schema=arrow)

    parts = docs.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(sums, schema)
    summed = parts.groupBy("lang").agg(F.array(*[F.sum(F.col("hist")[k]) for k in range(N_BINS)]).alias("hist"), F.sum("docs").alias("docs"))
    listed = F.col("lang").isin("", *LANGUAGES)
    most = MAX_REFERENCE_BYTES // (8 * N_BINS)
    rows = summed.where(listed | (F.col("docs") >= min_docs)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values of {lang} have {min_docs} documents or more; raise min_docs")
    return {r["lang"]: np.array(r["hist"], float) for r in rows}


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_char: float = MAX_CHAR_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    char_slack: float = CHAR_SLACK,
    word_slack: float = WORD_SLACK,
    min_words: int = MIN_WORDS,
    carry: list[str] | None = None,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """The base counts, the two distances, the nearest language and the verdict of every document."""
    refs = language_references(docs, text, lang, min_docs)
    names = [g for g in LANGUAGES if g in refs] + sorted(g for g in refs if g and g not in COMMON_WORDS) + [""]
    held = {g: refs.get(g, np.zeros(N_BINS)) for g in names}

    def judge(texts: list[bytes]) -> dict:
        base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
        hist = np.array([histograms(t) for t in texts], float).reshape(-1, N_BINS)
        chars, words = [], []
        for g in names:
            chars.append(js_distance(hist[:, :N_CLASSES], held[g][:N_CLASSES]))
            k = LANGUAGES.index(g) if g in COMMON_WORDS else 0
            cut = slice(N_CLASSES + _OFFSETS[k], N_CLASSES + _OFFSETS[k + 1]) if g in COMMON_WORDS else slice(N_CLASSES, N_BINS)
            words.append(js_distance(hist[:, cut], held[g][cut]))
        c, w = np.array(chars), np.array(words)
        near = np.argmin(c + w, axis=0)
        at = np.arange(len(texts))
        c, w = c[near, at], w[near, at]
        n = base[:, 0]
        failed = (n < min_words) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * n)
        root = np.sqrt(np.maximum(n, 1))
        kept = ~failed & (c <= max_char + char_slack / root) & (w <= max_word + word_slack / root)
        return {
            **dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(pa.array, base.T.copy()))),
            "base_failed": pa.array(failed), "kept": pa.array(kept), "char_distance": pa.array(c), "word_distance": pa.array(w),
            "nearest_lang": [names[k] for k in near],
        }

    schema = T.StructType(
        [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")]
        + [T.StructField(x, T.DoubleType()) for x in ("char_distance", "word_distance")]
        + [T.StructField("nearest_lang", T.StringType())]
    )
    return map_texts(docs, carry or [id_col], text, judge, schema)
