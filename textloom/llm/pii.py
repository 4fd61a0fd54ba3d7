"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall generators propose spans, which may overlap: an e-mail address (also written with "at" and "dot"), a
dotted quad (also defanged), a run of digits as on a card, a telephone number with or without a plus sign, a secret (a long run of letters and digits, or what is assigned to a
password, token or key). The base rules decide the plain cases; those spans always stay. Boosted trees of depth two score the other candidates by format (digits, separators,
first and neighbouring characters, form) and context (a telling word before the span).

The trees are trained on `examples` self-made texts, none of them from the corpus: each kind in several notations and contexts, and look-alikes of each (dates, versions,
part and book numbers, amounts, file names, prose with "at" and "dot"). A candidate is positive if it is of its text's kind and covers what was put there. Training sees counts by feature
cell, of which there are `cells()` at most. Each kind's threshold is the lowest at which the held-out half of the examples reaches `precision`; a kind that never does adds nothing.
Trees run as CASE expressions on the executors, in one pass over the corpus.

Positions: a regular expression's matches and the pieces between them alternate, so their lengths add up to positions in code points.

Defined results: null and empty texts have no spans; very long texts are scanned whole; repeated rows are scanned each;
an empty table gives no rows; spans of equal start and kind are in order of their ends; extra columns are carried only where asked for, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize

#: The base rules' kinds, then those that only the trees find.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The contract's patterns, made linear: runs are possessive and tried from their first character (or where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of the generators.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:@|\(at\)|\[at\]) ?| at )[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.|\[\.\]|\(\.\))[0-9]{1,3}(?:\.|\[\.\]|\(\.\))[0-9]{1,3}(?:\.|\[\.\]|\(\.\))[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])",
    "secret": r"(?<=[=:]\s?[\"']?)(?<=(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY)\s{0,2}[=:]\s?[\"']?)[^\s\"'<>=:]{6,}+"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}",
    "phone": r"(?<![0-9])(?:\([0-9]{3}\) ?[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])|[+(]?[0-9][\x20().0-9-]{5,30}[0-9](?![0-9]))",
}
TELLING = {
    "email": r"(?i)(?:mail|contact|write to|address|correo|courriel)\W*$",
    "ip": r"(?i)(?:ip|host|server|address)\W*$",
    "card": r"(?i)(?:card|visa|account|konto|carte|tarjeta)\W*$",
    "phone": r"(?i)(?:phone|tel|telefon|call|mobile|fax|contact|number)\W*$",
    "secret": r"(?i)(?:token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credential)\W*$",
}
#: Top-level domains that make words an address; those that are common words themselves ("in", "to") aren't among them.
_TOP = "com|org|net|edu|gov|mil|int|info|biz|example|io|dev|app|de|fr|es|uk|eu|ch|nl|pl|ru|cn|jp|br|ca|au|se|dk|fi|pt|cz|gr|mx"
#: Strict forms pass by themselves, loose ones after a telling word.
STRICT = {
    "email": rf"(?i)^[a-z0-9][a-z0-9._%+-]*+(?: ?(?:@|\(at\)|\[at\]) ?[a-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[a-z0-9-]+?)*(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[a-z]{{2,24}}| at [a-z0-9-]++(?: dot [a-z0-9-]+?)* dot (?:{_TOP}))$",
    "secret": r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[opsu]_[A-Za-z0-9]{30,}$|^sk-[A-Za-z0-9_-]{20,}$|^xox[abp]-[A-Za-z0-9-]{20,}$|^AIza[A-Za-z0-9_-]{30,}$|^eyJ[A-Za-z0-9_-]{20,}",
    "phone": r"^(?:1[\x20.-])?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[\x20.-][0-9]{4}$|^\(0[0-9]{1,4}\)[\x20-]?[0-9]{2,5}(?:[\x20-]?[0-9]{2,5}){1,3}$|^\+[0-9]",
}
LOOSE = {
    "email": rf"(?i) at (?:[a-z0-9-]++(?:\.| dot | ?(?:\(dot\)|\[dot\]) ?))++(?:{_TOP})$",
    "secret": r"^[0-9a-f]{16,}$|^[0-9A-F]{16,}$|^(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^A-Za-z]*+[A-Za-z]){3})[A-Za-z0-9_+/-]{12,}={0,2}$",
    "phone": r"^\(?[0-9]{1,5}\)?(?:[\x20.-]\(?[0-9]{2,6}\)?){1,5}$|^[0-9]{9,15}$",
}
#: Dates, book numbers and dotted quads are grouped like telephone numbers.
NO_PHONE = r"^\(?(?:19|20)[0-9]{2}[\x20.-][01]?[0-9][\x20.-][0-3]?[0-9](?![0-9])|^97[89][\x20-]|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^[0-3]?[0-9][.-][01]?[0-9][.-](?:19|20)[0-9]{2}(?![0-9])"
PRECISION, ROUNDS, RATE = 0.98, 30, 0.4
#: Self-made texts.
EXAMPLES = 6000
BLOCK = 256


def matches(found: Column, pieces: Column) -> Column:
    """array<struct<start, end, v, before, after>> from a pattern's matches and the pieces between them."""
    n = F.size(found)
    lengths = F.zip_with(F.slice(pieces, 1, n), found, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b")))
    # Starts are summed in blocks, so that appending to an array costs little however many matches there are.
    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int")), lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))
    none = F.expr("cast(array() as array<int>)")
    one = lambda at, x: F.struct((at["pos"] + x["a"] + x["b"]).alias("pos"), F.concat(at["out"], F.array(at["pos"] + x["a"])).alias("out"))

    def block(at, xs):
        got = F.aggregate(xs, F.struct(at["pos"].alias("pos"), none.alias("out")), one)
        return F.struct(got["pos"].alias("pos"), F.concat(at["out"], F.array(got["out"])).alias("out"))

    starts = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<array<int>>)").alias("out")), block)["out"])
    rows = F.arrays_zip(starts.alias("s"), found.alias("v"), F.slice(pieces, 1, n).alias("p"), F.slice(pieces, 2, n).alias("q"))
    made = F.transform(rows, lambda r: F.struct(r["s"].alias("start"), (r["s"] + F.length(r["v"])).alias("end"), r["v"].alias("v"), F.right(r["p"], F.lit(24)).alias("before"), F.left(r["q"], F.lit(1)).alias("after")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,v:string,before:string,after:string>>)")
    return F.when(n > 0, made).otherwise(empty)


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    worth = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def valid(kind: str, v: Column) -> Column:
    n = F.length(digits_of(v))
    if kind == "ip":
        return F.forall(F.split(F.regexp_replace(v, r"[\[\]()]", ""), r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(digits_of(v))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


#: Feature name -> number of values.
FEATURES = {"kind": len(KINDS), "digits": 20, "gaps": 4, "left": 5, "right": 5, "first": 4, "told": 2, "form": 3}


def cells() -> int:
    return math.prod(FEATURES.values())


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^\p{L}$"), 3).otherwise(4)


def form(kind: str, r: Column) -> Column:
    """2 for a strict form, 1 for a loose one, 0 for neither."""
    v, last = r["v"], F.right(r["before"], F.lit(1))
    if kind in ("ip", "card"):
        return F.when(valid(kind, v), 2).otherwise(0)
    if kind == "secret":
        return F.when(v.rlike(STRICT[kind]), 2).when(v.rlike(LOOSE[kind]), 1).otherwise(0)
    strict, loose = v.rlike(STRICT[kind]), v.rlike(LOOSE[kind])
    fits = F.lit(True)
    if kind == "phone":
        # The digits of something longer, an amount or a part number aren't a telephone number.
        fits = valid(kind, v) & ~v.rlike(NO_PHONE) & ~last.rlike(r"[\p{L}0-9_$€£#./@=-]") & ~r["after"].rlike(r"[\p{L}0-9_%€@=/-]")
    return F.when(fits & strict, 2).when(fits & loose, 1).otherwise(0)


def features(kind: str, r: Column) -> list[Column]:
    v = r["v"]
    last = F.right(r["before"], F.lit(1))
    first = F.left(F.regexp_replace(v, "^[+(]+", ""), F.lit(1))
    return [
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(F.length(digits_of(v)), F.lit(FEATURES["digits"] - 1)).alias("digits"),
        F.least(F.length(F.regexp_replace(v, r"[^\x20().-]", "")), F.lit(3)).alias("gaps"),
        _side(F.when(last == "+", "").otherwise(last)).alias("left"),
        _side(r["after"]).alias("right"),
        F.when(first == "4", 0).when(first.isin("3", "5", "6"), 1).when(first.rlike("[0-9]"), 2).otherwise(3).alias("first"),
        r["before"].rlike(TELLING[kind]).cast("int").alias("told"),
        form(kind, r).alias("form"),
    ]


def candidates(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` (a struct of carry's columns), `base` (the spans of the base rules) and `more` (all candidates with features, and `free`, whether no base span is touched)."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = t.rlike(r"[0-9@]") | F.lower(t).rlike(r"\(at\)|\[at\]| at [a-z0-9-]++(?:\.| ?(?:\(dot\)|\[dot\])| dot )|(?:password|passwd|pwd|secret|token|key)\s{0,2}[=:]")
    at = docs.select(F.struct(*(carry or ["doc_id"])).alias("row"), F.when(some, t).otherwise("").alias("t"))
    # Matches and positions are columns of their own, one step after the other, so that each is computed once.
    tried = {**BASE, **{f"wide_{k}": p for k, p in WIDE.items()}}
    at = at.withColumns({f"f_{n}": F.regexp_extract_all("t", F.lit(p), F.lit(0)) for n, p in tried.items()} | {f"p_{n}": F.split("t", p, -1) for n, p in tried.items()})
    at = at.withColumns({f"m_{n}": matches(F.col(f"f_{n}"), F.col(f"p_{n}")) for n in tried})
    base = F.concat(*[_base_spans(k, kind) for k, kind in enumerate(KINDS) if kind in BASE])
    at = at.select("row", base.alias("base"), F.concat(*[_wide_spans(kind) for kind in KINDS]).alias("wide"))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return at.select("row", "base", F.transform("wide", lambda c: c.withField("free", free(c))).alias("more"))


def _base_spans(k: int, kind: str) -> Column:
    ok = F.filter(f"m_{kind}", lambda r: valid(kind, r["v"]))
    return F.transform(ok, lambda r: F.struct(r["start"].alias("start"), F.lit(k).alias("k"), r["end"].alias("end")))


def _wide_spans(kind: str) -> Column:
    return F.transform(f"m_wide_{kind}", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), *features(kind, r)))


# Self-made examples. In a template, {h8} is 8 hexadecimal digits, {d3} 3 digits, {n3} 3 digits that don't start with 0 or 1, {l5} 5 small letters, {U16} 16 capitals and digits,
# {m32} 32 letters of both cases and digits, {q} a number up to 255, {q1} a digit but 0, and {card} a card's number.
POSITIVE = {
    "email": ["{l5}.{l4} (at) {l6}.com", "{l6} [at] {l5} [dot] org", "{l4}{d2} at {l6} dot net", "{l5}@{l6}.example", "{l4}_{l4}(at){l5}(dot)de", "{l5} at {l5} dot {l4} dot com", "{l6} (at) {l5} (dot) co (dot) uk"],
    "ip": ["{q}[.]{q}[.]{q}[.]{q}", "{q}(.){q}(.){q}(.){q}", "{q}.{q}.{q}[.]{q}", "{q}.{q}.{q}.{q}"],
    "card": ["{card}"],
    "phone": ["({n3}) {n3}-{d4}", "{n3}-{n3}-{d4}", "{n3}.{n3}.{d4}", "1-{n3}-{n3}-{d4}", "+1 ({n3}) {n3}-{d4}", "(0{d2}) {d4} {d4}", "+{n2} {d3} {d4}{d3}"],
    "secret": ["{h40}", "{h32}", "{h20}", "{m32}", "{m24}", "{m40}", "AKIA{U16}", "AKIA{U16}", "ghp_{m36}", "sk-{m40}", "AIza{m35}", "eyJ{m40}"],
}
NEGATIVE = [
    "20{d2}-0{q1}-1{q1}", "1{q1}.0{q1}.20{d2}", "20{d2}-0{q1}-1{q1} 1{q1}:2{q1}:3{q1}", "978-3-{d2}-{d6}-{q1}", "{q1}.{d2}.{q1}.{d4}.{q1}", "{d12}", "{d8}", "{d10}", "${n3},{d3},{d3}.{d2}", "AB-{d4}-{d4}-{d2}", "19{d2}-20{d2}, 20{d2}-20{d2}", "{q1}{q1}.{d6}, 1{q1}.{d6}",
    "look at {l5} dot dot dot", "{l5} at {l6}", "{l4} at {l5} and {l4}", "meet at {l6}. {l5} dot", "3{d2}.{q1}.{q1}.4{d2}", "{q1}.{q1}.{q1}", "https://{l6}.org/{l4}/{h12}/{h20}", "#{h6}", "{l5}_{d2}_{l6}_{d2}_{l4}", "IMG_20{d2}01{d2}_1{d5}", "{l6}-{l5}-20{d2}-0{q1}-1{q1}",
    "{l8}{l8}{d2}", "{h8}-{h4}-{h4}-{h4}-{h12}", "commit {h40}", "{d4} {d4} {d4} {d4}", "{d16}", "{d3}/{d3}-{d4}", "{d2}:{d2}:{d2}.{d6}", "{l6}/{l6}/{l5}_{d4}.txt", "{n3} {d3} {d3} {d3}", "key {l6}: {l4}", "v{q1}.{q1}.{q1}-{h8}", "{n3}-{d2}-{d4}",
]
LEAD = {
    "email": ["", "write to ", "contact: ", "mail ", "from ", "and "],
    "ip": ["", "host ", "from ", "server: ", "at "],
    "card": ["", "card ", "paid with ", "Visa: "],
    "phone": ["", "call ", "tel. ", "phone: ", "and ", "at "],
    "secret": ["token = \"", "password=", "api_key: ", "secret: ", "Bearer ", "access key ", "the "],
    None: ["", "see ", "the ", "no. ", "and ", "in "],
}
TRAIL = ["", " now", ".", ", thanks", " and more", "\n"]


def _filled(blank: Column, some: Column) -> Column:
    """What goes into a blank, made of the hexadecimal digits `some`."""
    kind, size = F.left(blank, F.lit(1)), F.substring(blank, F.lit(2), F.lit(3)).try_cast("int")
    digits = F.translate(some, "abcdef", "234567")
    cut = lambda c: F.substring(c, F.lit(1), size)
    body = F.concat(F.lit("4"), F.substring(digits, 1, 14))
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(body, d.cast("string"))))[0].cast("string")
    number = F.regexp_replace(F.concat(body, check), "(.{4})(?=.)", F.concat(F.lit("$1"), F.element_at(F.array(*map(F.lit, ("", " ", "-", "."))), F.pmod(F.ascii(some), F.lit(4)) + 1)))
    return (
        F.when(blank == "card", number)
        .when(blank == "q", F.conv(F.left(some, F.lit(2)), 16, 10))
        .when(kind == "q", F.translate(F.left(some, F.lit(1)), "0abcdef", "1234567"))
        .when(kind == "d", cut(digits))
        .when(kind == "n", F.concat(F.translate(F.left(digits, F.lit(1)), "01", "89"), F.substring(digits, F.lit(2), size - 1)))
        .when(kind == "l", cut(F.translate(some, "0123456789", "ghiklmnost")))
        .when(kind == "U", F.upper(cut(F.translate(some, "012345", "KQZXWJ"))))
        .when(kind == "m", cut(F.translate(F.concat(some, F.reverse(some)), "012abc", "XqKzMT")))
        .otherwise(cut(some))
    )


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(text, start, end, k): n self-made texts with what was put into them; k is -1 for a look-alike."""
    kinds = [(k, t, LEAD[kind]) for k, kind in enumerate(KINDS) for t in POSITIVE[kind]] + [(-1, t, LEAD[None]) for t in NEGATIVE]
    shapes = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(j).cast("long").alias("shape"), F.lit(k).alias("k"), F.lit(t).alias("template"), F.array(*map(F.lit, lead)).alias("leads")) for j, (k, t, lead) in enumerate(kinds)])))
    rows = spark.range(n).select("id", F.pmod("id", F.lit(len(kinds))).alias("shape"), (F.col("id") / len(kinds)).cast("int").alias("turn"))
    some = lambda j: F.sha1(F.concat_ws(":", F.col("id").cast("string"), j.cast("string")).cast("binary"))
    body = F.array_join(F.transform(F.split("template", r"[{}]"), lambda p, j: F.when(j % 2 == 0, p).otherwise(_filled(p, some(j)))), "")
    trail = F.element_at(F.array(*map(F.lit, TRAIL)), F.pmod(F.ascii(some(F.lit("t"))), F.lit(len(TRAIL))) + 1)
    lead = F.element_at("leads", F.pmod("turn", F.size("leads")).cast("int") + 1)
    made = rows.join(shapes, "shape").select(F.concat(F.lit("line "), lead).alias("lead"), body.alias("body"), trail.alias("trail"), "k")
    return made.select(F.concat("lead", "body", "trail").alias("text"), F.length("lead").alias("start"), (F.length("lead") + F.length("body")).alias("end"), "k")


# The trees, fitted on the driver over a table of at most cells() rows.


def _best_split(x, g, h, within):
    best = (1e-9, None)
    total_g, total_h = g[within].sum(), h[within].sum()
    parent = total_g**2 / (total_h + 1)
    for j in range(x.shape[1]):
        for cut in np.unique(x[within, j])[:-1]:
            left = within & (x[:, j] <= cut)
            lg, lh = g[left].sum(), h[left].sum()
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - parent
            if gain > best[0] + 1e-9:
                best = (gain, (j, int(cut)))
    return best[1]


def _grow(x, g, h, within, depth):
    split = _best_split(x, g, h, within) if depth else None
    if split is None:
        return round(float(RATE * g[within].sum() / (h[within].sum() + 1)), 6)
    j, cut = split
    return j, cut, _grow(x, g, h, within & (x[:, j] <= cut), depth - 1), _grow(x, g, h, within & (x[:, j] > cut), depth - 1)


def _run(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, a, b = tree
    return np.where(x[:, j] <= cut, _run(a, x), _run(b, x))


def fit_trees(x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = ROUNDS) -> list:
    """Gradient boosting of the logistic loss over cells with counts."""
    z, trees = np.zeros(len(x)), []
    if not len(x):
        return trees
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(_grow(x, positive - total * p, total * p * (1 - p), np.ones(len(x), bool), 2))
        z += _run(trees[-1], x)
    return trees


def train(spark: SparkSession, precision: float = PRECISION, rounds: int = ROUNDS, n: int = EXAMPLES) -> tuple[list, list[float]]:
    """Trees and each kind's calibrated threshold on the summed tree values."""
    names = list(FEATURES)
    # Written once: the examples' expressions would be repeated in every candidate's.
    rows = candidates(materialize(examples(spark, n), "pii-examples"), "text", ["text", "start", "end", "k"]).select("row.*", F.explode("more").alias("c"))
    # What ends or starts a character or two off the mark is found all the same.
    hit = (F.col("c.kind") == F.col("k")) & (F.abs(F.col("c.start") - F.col("start")) <= 2) & (F.abs(F.col("c.end") - F.col("end")) <= 2)
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    counts = rows.groupBy(*[F.col(f"c.{x}").alias(x) for x in names], half).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("y"))
    got = counts.orderBy(*names, "half").collect()  # 2 * cells() rows at most
    table = np.array([[*(r[x] for x in names), r["half"], r["y"], r["n"]] for r in got], float).reshape(-1, len(names) + 3)
    fit, held = table[table[:, -3] == 0], table[table[:, -3] == 1]
    trees = fit_trees(fit[:, : len(names)], fit[:, -2], fit[:, -1], rounds)
    limits = []
    for k in range(len(KINDS)):
        own = held[held[:, 0] == k]
        z = sum((_run(t, own[:, : len(names)]) for t in trees), np.zeros(len(own)))
        order = np.argsort(-z, kind="stable")
        share = np.cumsum(own[order, -2]) / np.maximum(np.cumsum(own[order, -1]), 1)
        # A threshold never falls inside cells of one score.
        ends = np.append(z[order][1:] < z[order][:-1], True) if len(z) else np.zeros(0, bool)
        good = np.flatnonzero(ends & (share >= precision))
        limits.append(float(z[order][good[-1]]) if len(good) else math.inf)
    return trees, limits


def tree_value(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, cut, a, b = tree
    return F.when(c[list(FEATURES)[j]] <= cut, tree_value(a, c)).otherwise(tree_value(b, c))


def find_pii(docs: DataFrame, text: str = "text", carry: list[str] | None = None, precision: float = PRECISION, rounds: int = ROUNDS, n_examples: int = EXAMPLES) -> DataFrame:
    """`row` (a struct of carry's columns), and `base` and `spans`: arrays of (start, k, end) in order, spans being base and what the trees add."""
    trees, limits = train(docs.sparkSession, precision, rounds, n_examples)
    score = lambda c: sum((tree_value(t, c) for t in trees), F.lit(0.0))
    limit = lambda c: F.element_at(F.array(*[F.lit(x) for x in limits]), c["kind"] + 1)
    # A candidate that touches a base span says nothing new.
    chosen = F.filter("more", lambda c: c["free"] & (score(c) >= limit(c)))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("k"), c["end"].alias("end")))
    return candidates(docs, text, carry).select("row", F.array_sort("base").alias("base"), F.array_sort(F.array_distinct(F.concat("base", added))).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span, overlapping ones together, replaced by the kind of the first: <EMAIL>."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, s):
        piece = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["k"] + 1))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """docs with the spans in their texts replaced; other columns and texts without spans stay as they are."""
    out = find_pii(docs, text, docs.columns, precision)
    row = F.col("row")
    return out.select(*[redacted(row[text], F.col("spans")).alias(text) if c == text else row[c].alias(c) for c in docs.columns])
