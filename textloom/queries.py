"""Queries of the text engine, one for each operator, and the SQL that DuckDB answers alike.

Inputs are SQL that both engines read; `$name` stands for a table. The oracles are written for DuckDB by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import native as N
from textloom.functions import scan as S
from textloom.functions import udfs as U
from textloom.functions.formatting import AUTO, FILES, Format
from textloom.functions.patterns import AUTOLINK, BARE_URL, CODE_SPAN, HTML_TAGS, LINK, PAIRED_TAGS, PROSE, SENTENCE_END, SINGLE_TAGS, paired
from textloom.functions.tables import register_tables
from textloom.operators import corpus as C
from textloom.operators import intervals as X
from textloom.operators import islands as I
from textloom.operators import references as REF
from textloom.plans import options as O
from textloom.plans.options import merge_options
from textloom.sources import rules as R
from textloom.sources.ignored import kept_paths

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Inputs

DOCS = "SELECT doc_id AS id, text FROM $documents"
TALK = "SELECT conv_id * 100 + turn AS id, text FROM $conversations"
HTML = "SELECT page_id AS id, html AS text FROM $pages"
MARKDOWN = """SELECT p_partkey AS id, '# **' || p_name || '**' || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type || chr(10) || '  1. ' || p_name || chr(10) || chr(10)
 || '| a | b |' || chr(10) || '|:--|--:|' || chr(10) || '| ' || cast(p_size AS string) || ' | ' || cast(p_partkey AS string) || ' |' AS text FROM $part"""
TAGS = """SELECT event_id AS id, '{% ' || event_type || ' id="' || cast(event_id AS string) || '" %}{% /' || event_type || ' %}' || chr(10) || '- ' || event_type || chr(10)
 || '{{ x }}' || chr(10) || 'value <!-- c -->' || chr(10) || '  {% /' || event_type || ' %}' AS text FROM $events"""
LONG_TAGS = """SELECT event_id AS id, '{% ' || event_type || chr(10) || 'id="' || cast(event_id AS string) || '" %} {% /' || event_type || ' %}' || chr(10) || 'end' AS text FROM $events"""
COMMENTS = """SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN '<!-- ' || c_name || chr(10) || c_mktsegment || ' -->' WHEN c_nationkey % 3 = 1 THEN '<!-- a -->' || chr(10) || '<!-- ' || c_name || ' -->' ELSE c_name || chr(10) || '-->' END AS text FROM $customer"""
FRONT = """SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN '---' || chr(10) || 'title: ' || c_name || chr(10) || '---' || chr(10) || chr(10) || c_mktsegment
 WHEN c_nationkey % 4 = 1 THEN chr(10) || ' ---' || chr(10) || 'open: ' || c_name WHEN c_nationkey % 4 = 2 THEN chr(10) || chr(10) || '---' || chr(10) || '--- ' || chr(10) || c_name || chr(10) ELSE c_name END AS text FROM $customer"""
PARAS = """SELECT c_custkey AS id, c_name || ' says  something about ' || c_mktsegment || chr(10) || 'and so on for quite a long while, until the line is full and wraps around' || chr(10) || chr(10) || chr(10)
 || c_mktsegment || ' is the second paragraph of this text, ' || c_name || ' wrote it in one go without looking back at what was there before' AS text FROM $customer"""
MARKS = """SELECT o_orderkey AS id, o_orderpriority || ' and then some more words that fill the line up to here, ' || cast(o_custkey AS string) || '. # ' || o_orderstatus || ' - ' || cast(o_orderkey % 100 AS string) || ') + > last words of this' AS text FROM $orders"""
QUOTES = """SELECT p_partkey AS id, '"' || p_name || '" is what ' || p_brand || ' calls it, "' || p_type || '", and x="' || p_brand || '" too' AS text FROM $part"""
APOS = """SELECT p_partkey AS id, p_name || chr(39) || 's and James' || chr(39) || ' don' || chr(39) || 't, rock ' || chr(39) || 'n' || chr(39) || ' roll $$James' || chr(39) AS text FROM $part"""
DOTS = """SELECT p_partkey AS id, p_name || '...' || p_type || ' and ' || p_brand || ' ...' AS text FROM $part"""
LINKS = """SELECT page_id AS id, 'See [page ' || cast(page_id AS string) || '](' || url || ') and [two](/x "T"), <' || url || '> or `[no](/code)`.' AS text FROM $pages"""
PATHS = """SELECT doc_id AS id, 'root/' || source || CASE WHEN doc_id % 7 = 0 THEN '/node_modules/' WHEN doc_id % 7 = 1 THEN '/.git/' ELSE '/docs/' END || cast(doc_id % 500 AS string) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS path, n_chars * 40 AS size FROM $documents"""


def source(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(Template(sql).substitute({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def _duck(sql: str) -> str:
    return Template(sql).substitute({t: t for t in TABLES})


def query(name: str, sql: str, make: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    """oracle reads the input as `input`, and its lines as `lines(id, line)`."""
    QUERIES[name] = lambda spark, sf_dir: make(source(spark, sf_dir, sql))
    if oracle:
        ORACLE_SQL[name] = f"WITH input AS ({_duck(sql)}), lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM input) {oracle}"


def scalar(name: str, sql: str, fn, oracle: str | None = None, column: str = "out") -> None:
    """fn(text) beside the id; oracle is an expression over text."""
    query(name, sql, lambda d: C.spread(d).select("id", fn(F.col("text")).alias(column)), oracle and f"SELECT id, {oracle} AS {column} FROM input")


def per_line(name: str, sql: str, fn, oracle: str) -> None:
    query(name, sql, lambda d: C.spread(d).select("id", F.explode(N.lines(F.col("text"))).alias("line")).select("id", "line", fn(F.col("line")).alias("out")), f"SELECT id, line, {oracle} AS out FROM lines")


# DuckDB expressions

_NL = "chr(10)"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_END = SENTENCE_END.replace("'", "''")
_OPEN, _CLOSE = r"(\{%|\{#|\{\{|<!--)", r"(%\}|#\}|\}\}|-->)"
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def _fold(words: str, joins: str, escape: str = "b.now") -> str:
    """Words joined while `joins` holds between a.now and b.now."""
    return f"""list_reduce(list_transform({words}, lambda w: {{'done': CAST([] AS VARCHAR[]), 'now': w}}),
 lambda a, b: CASE WHEN {joins} THEN {{'done': a.done, 'now': a.now || ' ' || b.now}} ELSE {{'done': list_append(a.done, a.now), 'now': {escape}}} END)"""


def _joined(fold: str, sep: str = _NL) -> str:
    return f"(SELECT coalesce(array_to_string(list_append(r.done, r.now), {sep}), '') FROM (SELECT {fold} AS r))"


def _sentences(least: int) -> str:
    return _fold(_WORDS, f"NOT (length(a.now) >= {least} AND regexp_matches(a.now, '{_END}'))")


def _wrapped(words: str, width: int, escape: str = "b.now") -> str:
    return _fold(words, f"length(a.now) + 1 + length(b.now) <= {width}", escape)


_ESCAPED = r"CASE WHEN regexp_matches(b.now, '^[0-9]+[.)]$') THEN left(b.now, -1) || chr(92) || right(b.now, 1) WHEN regexp_matches(b.now, '^([-*+>]|#+)$') THEN chr(92) || b.now ELSE b.now END"
_PARA_WORDS = _WORDS.replace("text", "p")

# Sources, discovery, checks

query("s6_resolve", PATHS, lambda d: R.resolve(d.unionByName(d)).select("path"), "SELECT DISTINCT path FROM input")
query("s7_include", PATHS, lambda d: d.where(R.included(F.col("path"), ["*.md"])).select("id", "path"), r"SELECT id, path FROM input WHERE regexp_matches(path, '(^|/)[^/]*\.md$')")
query("s8_size_limit", PATHS, lambda d: d.where(R.small_enough(F.col("size"), 100_000)).select("id", "size"), "SELECT id, size FROM input WHERE size <= 100000")
query("s11_pruned", PATHS, lambda d: d.where(~R.pruned(F.col("path"))).select("id", "path"), "SELECT id, path FROM input WHERE path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/.git/%'")
query(
    "s9_ignore_file",
    PATHS,
    lambda d: d.where(~R.ignored(F.col("path"), ["# texts", "*.txt", "/root/**/node_modules/", "!3*.txt"])).select("id", "path"),
    "SELECT id, path FROM input WHERE regexp_matches(path, '/3[^/]*[.]txt$') OR NOT (path LIKE '%.txt' OR path LIKE 'root/%/node_modules/%')",
)
query(
    "s13_default_excludes",
    "SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN 'site' WHEN 1 THEN 'out' WHEN 2 THEN 'Pods' WHEN 3 THEN 'third_party' WHEN 4 THEN 'my.egg-info' WHEN 5 THEN '_darcs' WHEN 6 THEN 'htmlcov' WHEN 7 THEN '.env' ELSE 'docs' END || '/' || cast(doc_id AS string) || '.md' AS path FROM $documents",
    lambda d: d.where(~R.pruned(F.col("path"))).select("id", "path"),
    "SELECT id, path FROM input WHERE split_part(path, '/', 1) IN ('site', 'out', '.env', 'docs')",
)
# Nested ignore files: one at the root, one in every other source's folder that takes a name back, and tool files, of which the one nearest to the walk's root counts.
TREE = """SELECT doc_id AS id, 'tree/' || source AS root, 'tree/' || source || CASE doc_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '/gen/' WHEN 2 THEN '/docs/gen/' WHEN 3 THEN '/docs/' ELSE '/out/deep/' END || 'f' || cast(doc_id % 40 AS string) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.md' END AS path FROM $documents"""
_RULES = """SELECT DISTINCT 'tree/' || source AS folder, 'git' AS kind, t.n AS line_no, t.line FROM $documents CROSS JOIN (VALUES (1, '*.txt'), (2, '# none'), (3, '!f1*.txt'), (4, '')) AS t(n, line)
 UNION ALL SELECT DISTINCT 'tree/' || source || '/docs', 'git', t.n, t.line FROM $documents CROSS JOIN (VALUES (1, 'f2*'), (2, '!f21.md')) AS t(n, line) WHERE length(source) % 2 = 0
 UNION ALL SELECT DISTINCT 'tree/' || source || '/gen', 'git', 1, '!f3.txt' FROM $documents"""
_TOOLS = " UNION ALL SELECT 'tree', 'tool', 1, '*' UNION ALL SELECT DISTINCT 'tree/' || source, 'tool', t.n, t.line FROM $documents CROSS JOIN (VALUES (1, 'docs/gen'), (2, 'out/*'), (3, 'f39.md')) AS t(n, line)"
_GIT_KEEPS = r"""(path NOT LIKE '%.txt' OR regexp_matches(path, '/f1[^/]*\.txt$')) AND NOT (length(root) % 2 = 1 AND path LIKE root || '/docs/%' AND regexp_matches(path, '/f2[^/]*$') AND path NOT LIKE '%/f21.md')"""


def _kept(rules: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kept_paths(source(spark, sf_dir, TREE), source(spark, sf_dir, rules)).select("id", "path")

    return run


QUERIES["s9_ignore_chain"] = _kept(_RULES)
ORACLE_SQL["s9_ignore_chain"] = f"WITH input AS ({_duck(TREE)}) SELECT id, path FROM input WHERE {_GIT_KEEPS}"
QUERIES["s10_tool_ignore"] = _kept(_RULES + _TOOLS)
ORACLE_SQL["s10_tool_ignore"] = f"WITH input AS ({_duck(TREE)}) SELECT id, path FROM input WHERE {_GIT_KEEPS} AND path NOT LIKE root || '/docs/gen/%' AND path NOT LIKE root || '/out/deep/%' AND path NOT LIKE '%/f39.md'"

query("s12_force_exclude", PATHS, lambda d: d.where(~R.matches_any(F.col("path"), ["src1*", "*.txt"])).select("id", "path"), "SELECT id, path FROM input WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda x: x LIKE 'src1%' OR x LIKE '%.txt'))")
query("s18_check", DOCS, lambda d: C.changed(d, Format(plaintext=True), "id"), f"SELECT id FROM input WHERE {_joined(_wrapped(_WORDS, 88))} <> text")
query("s19_list_files", PATHS, lambda d: R.resolve(d.where(R.included(F.col("path"), ["*.md"]) & R.small_enough(F.col("size"), 1 << 20) & ~R.pruned(F.col("path")))).select("path"), "SELECT DISTINCT path FROM input WHERE path LIKE '%.md' AND size <= 1048576 AND path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/.git/%'")
_FM = rf"""SELECT id, CASE WHEN s = 0 OR trim(l[s]) <> '---' THEN '' WHEN e = 0 THEN text ELSE array_to_string(l[s:e], {_NL}) || {_NL} END AS frontmatter,
 CASE WHEN s = 0 OR trim(l[s]) <> '---' THEN text WHEN e = 0 THEN '' ELSE array_to_string(CASE WHEN l[-1] = '' THEN l[e + 1:-2] ELSE l[e + 1:] END, {_NL}) END AS content
 FROM (SELECT *, coalesce(list_position(list_transform(l, lambda x, i: trim(x) = '---' AND i > s), true), 0) AS e FROM (SELECT *, coalesce(list_position(list_transform(l, lambda x: trim(x) <> ''), true), 0) AS s FROM (SELECT id, text, string_split(text, {_NL}) AS l FROM input)))"""
query("s21_frontmatter", FRONT, lambda d: C.spread(d).select("id", N.split_frontmatter(F.col("text")).alias("f")).select("id", "f.frontmatter", "f.content"), _FM)
query("s22_has_frontmatter", FRONT, lambda d: d.select("id", (N.split_frontmatter(F.col("text"))["frontmatter"] != "").alias("out")), f"SELECT id, frontmatter <> '' AS out FROM ({_FM})")
query(
    "s25_merge_options",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS cli, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 END AS config, 88 AS preset, c_custkey % 5 = 0 AS locked FROM $customer",
    lambda d: d.select("id", merge_options(F.col("cli"), F.col("config"), F.col("preset"), F.col("locked")).cast("int").alias("out")),
    "SELECT id, CAST(CASE WHEN cli IS NOT NULL THEN cli WHEN NOT locked AND config IS NOT NULL THEN config ELSE preset END AS INT) AS out FROM input",
)

# Blocks

#: Of MARKDOWN: where each line starts, and one more for the end.
_STARTS = "list_transform(range(0, len(l) + 1), lambda k: coalesce(list_sum(list_transform(l[1 : k], lambda x: length(x) + 1)), 0) - CASE WHEN k = len(l) THEN 1 ELSE 0 END)"
#: Its nodes: parent, kind, first line, characters of the line that belong to the parents, line after the last.
_NODES = [(None, "document", 1, 0, 10), (0, "heading", 1, 0, 2), (0, "blank", 2, 0, 3), (0, "list", 3, 0, 6), (3, "item", 3, 0, 4), (4, "paragraph", 3, 2, 4), (3, "item", 4, 0, 6), (6, "paragraph", 4, 2, 5), (6, "list", 5, 2, 6), (8, "item", 5, 2, 6), (9, "paragraph", 5, 5, 6), (0, "blank", 6, 0, 7), (0, "table", 7, 0, 10)]
_NODE_SQL = " UNION ALL ".join(f"SELECT id, {k} AS node_id, CAST({'NULL' if p is None else p} AS INT) AS parent_id, '{kind}' AS type, CAST(s[{a}] + {cut} AS INT) AS start, CAST(s[{b}] AS INT) AS \"end\" FROM marks" for k, (p, kind, a, cut, b) in enumerate(_NODES))
query("b1_blocks", MARKDOWN, lambda d: C.blocks(d, "id").select("id", "node_id", "parent_id", "type", "start", "end"), f"SELECT id, CAST(node_id AS INT) AS node_id, parent_id, type, start, \"end\" FROM (WITH marks AS (SELECT id, {_STARTS} AS s FROM (SELECT id, string_split(text, {_NL}) AS l FROM input)) {_NODE_SQL})")
query("b2_document_span", MARKDOWN, lambda d: C.blocks(d, "id").where("type = 'document'").select("id", "start", "end"), "SELECT id, CAST(0 AS INT) AS start, CAST(length(text) AS INT) AS \"end\" FROM input")
_KINDS = [kind for _, kind, *_ in _NODES]
query("b4_walk_kinds", MARKDOWN, lambda d: C.blocks(d, "id").groupBy("type").agg(F.count("*").alias("n")), " UNION ALL ".join(f"SELECT '{k}' AS type, {_KINDS.count(k)} * count(*) AS n FROM input" for k in sorted(set(_KINDS))))
query(
    "b5_headings",
    MARKDOWN,
    lambda d: C.blocks(d.withColumn("t", F.col("text")), "id").where("type = 'heading'").select("id", "start", "end"),
    r"SELECT id, CAST(0 AS INT) AS start, CAST(length(regexp_extract(text, '^#[^\n]*\n')) AS INT) AS ""end"" FROM input".replace('""', '"'),
)
query("b16_list_items", MARKDOWN, lambda d: C.blocks(d, "id").where("type = 'item'").groupBy("id").agg(F.count("*").alias("n")), r"SELECT id, count(*) AS n FROM lines WHERE regexp_matches(line, '^\s*([-*+]|[0-9]+[.])\s') GROUP BY id")
query("b24_tables", MARKDOWN, lambda d: C.blocks(d, "id").where("type = 'table'").select("id", (F.col("end") - F.col("start")).alias("n")), "SELECT id, CAST(sum(length(line) + 1) - 1 AS INT) AS n FROM lines WHERE line LIKE '|%' GROUP BY id")
scalar("b9_fence_length", "SELECT id, CASE WHEN id % 3 = 0 THEN '````' || chr(10) || text ELSE 'a' || chr(10) || '  ```` x' || chr(10) || '```' END AS text FROM (" + DOCS + ")", N.least_fence, "CAST(greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '(?m)^ {0,3}(`{3,})', 1), lambda x: length(x))), 0)) AS INT)")
scalar("b22_title_quotes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '\"' || p_name || '\"' ELSE p_name || ' \"x\" ' || p_type END AS text FROM $part", N.quoted_title, """'"' || replace(trim(text, '"'), '"', chr(92) || '"') || '"'""")
scalar("i9_code_span", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '`' || p_name WHEN p_partkey % 3 = 1 THEN p_name || '`' ELSE p_name END AS text FROM $part", N.code_span, "CASE WHEN text LIKE '`%' OR text LIKE '%`' THEN '`` ' || text || ' ``' ELSE '`' || text || '`' END")
query(
    "i3_link_labels",
    "SELECT l_orderkey AS doc_id, cast(l_partkey % 5 AS string) AS url, CASE WHEN l_partkey % 2 = 0 THEN 't' END AS title FROM $lineitem",
    lambda d: C.link_labels(d, d.select("doc_id", F.col("url").alias("dest"), "title").where("url in ('1', '2')").distinct().select("*", F.concat(F.lit("r"), "dest").alias("label"), F.col("dest").cast("int").alias("ord"))).select("doc_id", "url", "title", "label"),
    "SELECT doc_id, url, title, CASE WHEN url IN ('1', '2') THEN 'r' || url END AS label FROM (SELECT * FROM input)",
)
query("i13_links", LINKS, lambda d: C.links(d, "id").select("id", "text", "url", "title"), """SELECT id, unnest(['page ' || id, 'two', u]) AS text, unnest([u, '/x', u]) AS url, unnest([NULL, 'T', NULL]) AS title FROM (SELECT id, regexp_extract(text, '<([^>]*)>', 1) AS u FROM input)""")
ORACLE_SQL["i3_link_labels"] = ORACLE_SQL["i3_link_labels"].split(", lines AS", 1)[0] + " SELECT doc_id, url, title, CASE WHEN url IN ('1', '2') THEN 'r' || url END AS label FROM input"

query(
    "b20_can_be_tight",
    "SELECT p_partkey AS id, '- ' || p_brand || chr(10) || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || '  ' || p_type || chr(10) || chr(10) END || '- ' || p_name || CASE WHEN p_size % 3 = 0 THEN chr(10) || '  - in' || chr(10) || '  - side' ELSE '' END || chr(10) || chr(10) || 'end' AS text FROM $part",
    lambda d: C.tight_lists(C.blocks(d, "id"), "id").groupBy("id").agg(F.count("*").alias("n"), F.count_if("can_be_tight").alias("tight")),
    "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, CAST(CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS tight FROM part",
)

# Whole option sets


def _options(d: DataFrame) -> DataFrame:
    s = lambda x: F.lit(x)
    top = F.create_map(s("width"), (F.col("k") + 40).cast("string"), s("list-spacing"), s('"loose"'), s("plaintext"), F.when(F.col("k") % 4 == 0, "3").otherwise("true"))
    rules = F.create_map(s("semantic"), s("false"), s("smartquotes"), s("true"), s("odd-one"), s("1"), s("force_exclude"), s("true"))
    files = F.create_map(s("extend-exclude"), s('["a", "b*"]'), s("files-max-size"), F.col("id").cast("string"), s("odd_one"), s("2"), s("Width"), s("9"), s("list_spacing"), s('"tight"'))
    said = {"width": F.when(F.col("k") % 3 == 0, 50), "ellipses": F.when(F.col("k") % 5 == 0, True), "exclude": F.when(F.col("k") % 5 == 1, F.array(s("x")))}
    preset = {"width": s(88), "plaintext": s(False), "semantic": F.col("auto"), "cleanups": s(True), "smartquotes": F.col("auto"), "ellipses": F.col("auto"), "list_spacing": s("preserve"), "files_max_size": s(1 << 20), "respect_gitignore": s(True), "force_exclude": s(False)}
    filled = lambda have: F.struct(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in O.OPTION_TYPES.items()])
    d = d.withColumn("entries", O.config_entries(F.when(F.col("k") != 7, top), F.create_map(s("rules"), rules, s("files"), files)))
    merged = d.select("id", O.merge_option_structs(filled(said), O.config_struct(F.col("entries")), filled(preset), F.col("auto")).alias("o"), F.array_join(O.unknown_keys(F.col("entries")), ",").alias("unknown"))
    lists = [n for n, t in O.OPTION_TYPES.items() if t.startswith("array")]
    return merged.select("id", *[F.array_join(f"o.{n}", ",").alias(n) if n in lists else F.col(f"o.{n}") for n in O.OPTION_TYPES], "unknown")


query(
    "s25_merge_option_structs",
    "SELECT c_custkey AS id, c_nationkey AS k, c_custkey % 2 = 0 AS auto FROM $customer",
    _options,
    """SELECT id, CAST(CASE WHEN k % 3 = 0 THEN 50 WHEN k = 7 THEN 88 ELSE k + 40 END AS INTEGER) AS width, k <> 7 AND k % 4 <> 0 AS plaintext, auto AS semantic, true AS cleanups, true AS smartquotes, auto OR k % 5 = 0 AS ellipses, 'tight' AS list_spacing,
 CAST(NULL AS VARCHAR) AS extend_include, CASE WHEN k % 5 = 1 THEN 'x' END AS exclude, 'a,b*' AS extend_exclude, CAST(id AS BIGINT) AS files_max_size, true AS respect_gitignore, true AS force_exclude, 'Width,odd_one' AS unknown FROM input""",
)
ORACLE_SQL["s25_merge_option_structs"] = ORACLE_SQL["s25_merge_option_structs"].split(", lines AS", 1)[0] + " SELECT" + ORACLE_SQL["s25_merge_option_structs"].split("FROM input) SELECT", 1)[1]

# References as relations

REFS = """SELECT p_partkey AS id, '[one][A  b] ![alt][PIC] ![pic] [![badge][pic]][home] [in](http://in/' || cast(p_partkey AS string) || ' "t") <http://a.b>[^n] and[^m] again[^n]' || chr(10) || chr(10)
 || '[a b]: http://first/' || cast(p_size AS string) || ' "T"' || chr(10) || '[A B]: http://second' || chr(10) || '[pic]: http://x/' || cast(p_size AS string) || chr(10) || '[home]: http://h' || chr(10) || '[unused]: http://u' || chr(10) || chr(10)
 || '[^m]: ' || p_name || chr(10) || chr(10) || '[^n]: note ' || p_type || chr(10) || '[^n]: never' AS text FROM $part"""
_REFS_OF = "SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS s, p_name, p_type FROM part"


def _refs(name: str, make, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(REF.reference_rows(source(spark, sf_dir, REFS), "id"))
    ORACLE_SQL[name] = f"WITH p AS ({_REFS_OF}) {oracle}"


_refs("b21_definitions", lambda r: REF.definitions(r, "id"), "SELECT id, unnest(['a b', 'pic', 'home', 'unused']) AS label, unnest(['http://first/' || s, 'http://x/' || s, 'http://h', 'http://u']) AS dest, unnest(['T', NULL, NULL, NULL]) AS title, CAST(unnest([2, 1, 1, 1]) AS BIGINT) AS times FROM p")
_refs(
    "i3_resolved_links",
    lambda r: REF.resolved(r, "id").select("id", "kind", "label", "dest", "title", "text"),
    """SELECT id, unnest(['link', 'image', 'image', 'link', 'image', 'link', 'link']) AS kind, unnest(['a b', 'pic', 'pic', 'home', 'pic', NULL, NULL]) AS label,
 unnest(['http://first/' || s, 'http://x/' || s, 'http://x/' || s, 'http://h', 'http://x/' || s, 'http://in/' || id, 'http://a.b']) AS dest, unnest(['T', NULL, NULL, NULL, NULL, 't', NULL]) AS title, unnest(['one', 'alt', 'pic', 'badge', 'badge', 'in', 'http://a.b']) AS text FROM p""",
)
_refs("i5_inlined_images", lambda r: REF.inlined(r, "id").select("id", "image", "link"), "SELECT id, '![' || unnest(['alt', 'pic', 'badge']) || '](http://x/' || s || ')' AS image, unnest([NULL, NULL, 'http://h']) AS link FROM p")
_refs("b23_notes", lambda r: REF.notes(r, "id"), "SELECT id, unnest(['m', 'n']) AS label, unnest([p_name, 'note ' || p_type]) AS text, CAST(unnest([2, 1]) AS INTEGER) AS number, CAST(unnest([1, 2]) AS BIGINT) AS marks FROM p")
_refs("i10_note_marks", lambda r: r.where("kind = 'note_ref'").groupBy("id", "label").agg(F.count("*").alias("n")), "SELECT id, unnest(['m', 'n']) AS label, CAST(unnest([1, 2]) AS BIGINT) AS n FROM p")
_refs("b21_unused", lambda r: REF.unused(r, "id"), "SELECT id, 'unused' AS label FROM p")

# Table functions, by SQL alone


def _by_sql(name: str, sql: str, text: str, oracle: str) -> None:
    """text: the SQL over `docs`, the documents of sql."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(spark)
        return spark.sql(text.replace("FROM docs ", "FROM {docs} "), docs=C.spread(source(spark, sf_dir, sql)))

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle.replace("{input}", _duck(sql))


_by_sql("u_sentence_rows", TALK, "SELECT d.id, count(*) AS n FROM docs d, LATERAL loom_sentence_rows(d.text, min_length => 0) s GROUP BY d.id", f"WITH input AS ({{input}}) SELECT id, CAST(len(list_append(r.done, r.now)) AS BIGINT) AS n FROM (SELECT id, {_sentences(0)} AS r FROM input)")
_by_sql("u_link_rows", LINKS, "SELECT d.id, l.ord, l.text, l.url, l.title FROM docs d, LATERAL loom_link_rows(d.text) l", """SELECT id, CAST(unnest([0, 1, 2]) AS INTEGER) AS ord, unnest(['page ' || id, 'two', u]) AS text, unnest([u, '/x', u]) AS url, unnest([NULL, 'T', NULL]) AS title FROM (SELECT id, regexp_extract(text, '<([^>]*)>', 1) AS u FROM ({input}))""")
_by_sql("u_block_rows", MARKDOWN, "SELECT b.type, b.depth, count(*) AS n, sum(length(b.source)) AS chars FROM docs d, LATERAL loom_block_rows(d.text, source => true) b WHERE b.depth = 0 OR b.type = 'heading' GROUP BY b.type, b.depth", "SELECT unnest(['document', 'heading']) AS type, CAST(unnest([0, 1]) AS INTEGER) AS depth, count(*) AS n, CAST(unnest([sum(length(text)), sum(length(string_split(text, chr(10))[1]) + 1)]) AS BIGINT) AS chars FROM ({input})")
_by_sql("u_word_rows", TAGS, "SELECT d.id, w.word, w.start, w.end FROM docs d, LATERAL loom_word_rows(d.text, places => true) w WHERE w.pos = 1", "SELECT id, '-' AS word, CAST(strpos(text, chr(10)) AS INTEGER) AS start, CAST(strpos(text, chr(10)) + 1 AS INTEGER) AS \"end\" FROM ({input})")
_by_sql("u_reference_rows", REFS, "SELECT r.kind, count(*) AS n, count(r.inside) AS within FROM docs d, LATERAL loom_reference_rows(d.text) r GROUP BY r.kind", "SELECT unnest(['definition', 'link', 'image', 'note', 'note_ref']) AS kind, unnest([5, 4, 3, 3, 3]) * count(*) AS n, unnest([0, 0, 1, 0, 0]) * count(*) AS within FROM ({input})")

# Elements: Markdown with a part's name {n} and brand {b}, and what it is normalised to

ELEMENTS = {
    "b6_setext": ('{n}\n===\n\n{b}\n---\n', '# {n}\n\n## {b}\n\n'),
    "b7_task_boxes": ('- [ ] {n}\n- [X] {b}', '- [ ] {n}\n- [x] {b}\n'),
    "b8_fenced_code": ('~~~py  x\n{n}\n  {b}\n~~~', '~~~py x\n{n}\n  {b}\n~~~\n'),
    "b10_indented_code": ('x\n\n    {n}\n', 'x\n\n```\n{n}\n```\n'),
    "b10_code_with_ticks": ('````\n```\n{n}\n````', '````\n```\n{n}\n````\n'),
    "b11_html_is_text": ('<div>\n{n}\n</div>', '<div> {n} </div>\n'),
    "b12_thematic_break": ('{n}\n\n---\n\n{b}', '{n}\n\n* * *\n\n{b}\n'),
    "b13_blank_lines": ('{n}\n\n\n\n{b}', '{n}\n\n{b}\n'),
    "b14_quote": ('> {n}\n>\n> > {b}', '> {n}\n> \n> > {b}\n'),
    "b14_lazy_quote": ('> {n}\n{b}', '> {n} {b}\n'),
    "b15_alert": ('> [!tip]\n> {n}\n> {b}', '> [!TIP]\n> {n} {b}\n'),
    "b17_nested_items": ('* {n}\n  * {b}\n\n    more\n* c', '* {n}\n\n  * {b}\n\n    more\n* c\n'),
    "b18_loose_list": ('- {n}\n- {b}\n\n- c', '- {n}\n\n- {b}\n\n- c\n'),
    "b16_numbers": ('3) {n}\n3) {b}', '3. {n}\n4. {b}\n'),
    "b21_definition": ("[{n}][k] and [k]\n\n[k]: http://x.y 'T'", '[{n}][k] and [k][]\n\n[k]: http://x.y "T"\n'),
    "b23_footnote": ('{n}[^1]\n\n[^1]: {b}\n    more', '{n}[^1]\n\n[^1]: {b} more\n\n'),
    "b25_cell_escapes": ('| a | b |\n|:-:|--|\n| {n} \\| x | {b} |', '| a | b |\n| :---: | --- |\n| {n} \\| x | {b} |\n'),
    "b26_prefixes": ('> - {n}\n>   1. {b}\n>\n>      more', '> - {n}\n>\n>   1. {b}\n>      \n>      more\n'),
    "i1_emphasis": ('_{n}_ __{b}__ ***x***', '*{n}* **{b}** ***x***\n'),
    "i2_inline_html": ('a <b>{n}</b> <br/> {b}', 'a <b>{n}</b> <br/> {b}\n'),
    "i4_autolink": ('see <http://x.y/7> {b}', 'see <http://x.y/7> {b}\n'),
    "i5_image": ('![{n}](http://x.y/z "{b}")', '![{n}](http://x.y/z "{b}")\n'),
    "i6_literal_escapes": ('1\\. {n} 2\\. {b} \\*x\\*', '1\\. {n} 2. {b} \\*x\\*\n'),
    "i7_cjk_spacing": ('漢字abc {n} x漢字', '漢字 abc {n} x 漢字\n'),
    "i8_line_breaks": ('{n}  \n{b}\\\nend\nx', '{n}\\\n{b}\\\nend x\n'),
    "i10_footnote_ref": ('{n}[^a] {b}[^none]\n\n[^a]: t', '{n}[^a] {b}[^none]\n\n[^a]: t\n\n'),
    "i11_strikethrough": ('~{n}~ ~~{b}~~ ~60 x', '~~{n}~~ ~~{b}~~ ~60 x\n'),
    "i12_bare_url": ('see http://x.y/7. {b}, www.a.b', 'see http://x.y/7. {b}, www.a.b\n'),
}


def _said(template: str) -> str:
    """The template as SQL that both engines read."""
    marks = {"{n}": "p_name", "{b}": "p_brand", "\n": "chr(10)", "\\": "chr(92)", "'": "chr(39)"}
    return " || ".join(marks.get(x) or f"'{x}'" for x in re.split(r"(\{n\}|\{b\}|\n|\\|')", template) if x)


for _name, (_from, _to) in ELEMENTS.items():
    query(_name, f"SELECT p_partkey AS id, {_said(_from)} AS text, {_said(_to)} AS want FROM $part", lambda d: C.spread(d).select("id", U.fill_markdown()(F.col("text")).alias("out")), "SELECT id, want AS out FROM input")
for _spacing, _to in (("loose", "- {n}\n\n- {b}\n\n- c\n"), ("tight", "- {n}\n- {b}\n- c\n")):
    query(f"b19_{_spacing}_lists", f"SELECT p_partkey AS id, {_said('- {n}' + chr(10) + '- {b}' + chr(10) * 2 + '- c')} AS text, {_said(_to)} AS want FROM $part", lambda d, s=_spacing: C.spread(d).select("id", U.fill_markdown(list_spacing=s)(F.col("text")).alias("out")), "SELECT id, want AS out FROM input")

# Tokens

_SPANS = r"(?s)`[^`]+`|\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])?|<[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>]*>"
query("t5_atomic_spans", LINKS, lambda d: C.spread(d).select("id", F.inline(U.atomic_spans(PROSE)(F.col("text")))).where("is_atomic").select("id", "text", "name"), f"SELECT id, x AS text, CASE WHEN x LIKE '`%' THEN 'inline_code_span' WHEN x LIKE '[%' THEN 'markdown_link' ELSE 'autolink' END AS name FROM (SELECT id, unnest(regexp_extract_all(text, '{_SPANS}')) AS x FROM input)")
query("t6_atomic_words", LINKS, lambda d: C.spread(d).select("id", F.explode(S.atomic_words(F.col("text"), PROSE)).alias("text")), rf"SELECT id, unnest(regexp_extract_all(text, '(?:{_SPANS[4:]}|\S)+')) AS text FROM input")
query("t7_plain_words", DOCS, lambda d: C.spread(d).select("id", F.explode(N.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM input) GROUP BY word")
query("t8_markup_words", TAGS, lambda d: C.spread(d).select("id", F.explode(U.markup_words()(F.col("text"))).alias("word")), f"SELECT id, unnest([replace(l[1], '%}}{{%', '%}} {{%'), '-', l[2][3:], l[3], 'value', '<!-- c -->', trim(l[5])]) AS word FROM (SELECT id, string_split(text, {_NL}) AS l FROM input)")
per_line("t9_starts_with_tag", TAGS, N.starts_with_tag, rf"regexp_matches(line, '^\s*{_OPEN}')")
per_line("t9_ends_with_tag", TAGS, N.ends_with_tag, rf"regexp_matches(line, '{_CLOSE}\s*$')")
per_line("t9_tag_only", TAGS, N.is_tag_only, rf"regexp_matches(line, '^{_OPEN}') AND regexp_matches(line, '{_CLOSE}\s*$')")
per_line("t9_tag_at_margin", TAGS, N.is_tag_at_margin, rf"regexp_matches(line, '^{_OPEN}')")
per_line("t9_closing_tag", TAGS, N.is_closing_tag, rf"regexp_matches(line, '^\s*{_OPEN} /')")
scalar("t10_part_tags", TAGS, N.part_tags, "replace(replace(replace(replace(text, '%}{%', '%} {%'), '#}{#', '#} {#'), '}}{{', '}} {{'), '--><!--', '--> <!--')")
scalar("t11_join_tags", LONG_TAGS, N.join_tags, "replace(replace(replace(replace(text, '%} {%', '%}{%'), '#} {#', '#}{#'), '}} {{', '}}{{'), '--> <!--', '--><!--')")
scalar("t12_long_comment", COMMENTS, N.is_long_comment, f"text LIKE '<!--%' AND strpos(text, '-->') = length(text) - 2 AND text LIKE '%' || {_NL} || '%'")
query("t13_template_tags", TAGS, lambda d: C.spread(d).select("id", F.inline(U.atomic_spans(SINGLE_TAGS)(F.col("text")))).where("is_atomic").select("id", F.col("text").alias("tag")), r"SELECT id, unnest(regexp_extract_all(text, '(?s)\{%.*?%\}|\{#.*?#\}|\{\{.*?\}\}|<!--.*?-->')) AS tag FROM input")

# Sentences

query("n1_sentence_end", DOCS, lambda d: C.spread(d).select(F.explode(N.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).select("word", "n", N.ends_sentence(F.col("word")).alias("out")), f"SELECT word, count(*) AS n, regexp_matches(word, '{_END}') AS out FROM (SELECT unnest({_WORDS}) AS word FROM input) GROUP BY word")
query("n2_sentences", DOCS, lambda d: C.spread(d).select("id", F.explode(N.split_sentences(F.col("text"))).alias("sentence")), f"SELECT id, unnest(list_append(r.done, r.now)) AS sentence FROM (SELECT id, {_sentences(15)} AS r FROM input)")
query("n2_sentences_any_length", DOCS, lambda d: C.spread(d).select("id", F.explode(N.split_sentences(F.col("text"), 0)).alias("sentence")), f"SELECT id, unnest(list_append(r.done, r.now)) AS sentence FROM (SELECT id, {_sentences(0)} AS r FROM input)")
scalar("n3_first_sentences", DOCS, lambda t: F.array_join(N.first_sentences(t, 3), "\n"), f"(SELECT coalesce(array_to_string(list_append(r.done, r.now)[1:3], {_NL}), '') FROM (SELECT {_sentences(15)} AS r))")
scalar("n4_first_sentence", DOCS, N.first_sentence, f"(SELECT coalesce(list_append(r.done, r.now)[1], text) FROM (SELECT {_sentences(15)} AS r))")
_FLAT = "SELECT doc_id AS id, trim(regexp_replace(text, '[ ' || chr(10) || ']+', ' '{g})) AS text FROM $documents"
query("n5_sentence_spans", _FLAT.format(g=""), lambda d: C.sentences(d, "id").select("id", "sid", F.length("text").alias("n"), "start", "end"))
ORACLE_SQL["n5_sentence_spans"] = f"""WITH input AS ({_duck(_FLAT.format(g=", 'g'"))}), s AS (SELECT id, list_transform(list_append(r.done, r.now), lambda x: length(x)) AS n FROM (SELECT id, {_sentences(15)} AS r FROM input WHERE text <> '')),
 t AS (SELECT id, n, unnest(range(len(n))) AS k FROM s) SELECT id, CAST(k AS INT) AS sid, CAST(n[k + 1] AS INT) AS n, CAST(coalesce(list_sum(n[1:k]), 0) + k AS INT) AS start, CAST(list_sum(n[1:k + 1]) + k AS INT) AS "end" FROM t"""
SAYINGS = """SELECT p_partkey AS id, p_name || ' ends here. See `a b. Code.` now! Then [x. Then y](u v) and <http://a.b/c.> stop? (Brand ' || p_brand || ')' AS text FROM $part"""
query("n6_atomic_sentences", SAYINGS, lambda d: C.sentences(d, "id", min_length=0).select("id", "text"), "SELECT p_partkey AS id, unnest([p_name || ' ends here.', 'See `a b. Code.` now!', 'Then [x. Then y](u v) and <http://a.b/c.> stop?', '(Brand ' || p_brand || ')']) AS text FROM part")
query("n6_sentences_by_scan", SAYINGS, lambda d: C.spread(d).select("id", F.explode(S.sentences(F.col("text"), 0)).alias("text")), "SELECT p_partkey AS id, unnest([p_name || ' ends here.', 'See `a b. Code.` now!', 'Then [x. Then y](u v) and <http://a.b/c.> stop?', '(Brand ' || p_brand || ')']) AS text FROM part")
query(
    "n2_sentences_of_rows",
    DOCS,
    lambda d: I.sentences_of_rows(C.spread(d).select("id", F.posexplode(N.words(F.col("text"))).alias("pos", "word")), "id").select("id", "sentence"),
    f"SELECT id, unnest(list_append(r.done, r.now)) AS sentence FROM (SELECT id, {_sentences(0)} AS r FROM input)",
)
query("n7_sentences_for_wrapping", TALK, lambda d: C.sentences(d, "id", min_length=0).groupBy("id").agg(F.count("*").alias("n")), f"SELECT id, CAST(len(list_append(r.done, r.now)) AS BIGINT) AS n FROM (SELECT id, {_sentences(0)} AS r FROM input)")

# Constructs, each by itself, among near misses of its own and of the others'. The oracles say the patterns without what RE2 lacks.

CONSTRUCTS = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand || ' ' WHEN 2 THEN '(' ELSE p_type || chr(10) END || t.x || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_name ELSE ', ' || p_type || '.' END AS text
 FROM $part CROSS JOIN (VALUES ('`a b` and `c'), ('[x y](u v) [z][w] [q] [open'), ('<http://a.b/c> <m@x.y> <a b> < 3'), ('see http://x.y/z?q=1. and www.a.b, http://'), ('{% f a %}{% /f %} {% g %} text {% /g %} {% open'), ('{# f #} {# /f #} {# /g #}{# /h #} {#open'),
 ('{{ f }}{{ /f }} {{ x }} {{ open }'), ('<!-- f --> <!-- /f --> <!-- a-b --> <!-- open'), ('<b class="x">bold</b> </i> <1> <br/>')) AS t(x)"""
_PAIRED = r"{o}(\s*([^{x}/\s][^{x}]*)?){c}\s*{o}\s*/[^{x}]*{c}"
_COMMENT = r"[^-]*(?:-[^-]+)*-->"
_PATTERNS = {
    CODE_SPAN: "`[^`]+`",
    LINK: LINK.pattern,
    AUTOLINK: AUTOLINK.pattern,
    BARE_URL: BARE_URL.pattern,
    PAIRED_TAGS[0]: _PAIRED.format(o=r"\{%", c=r"%\}", x="%"),
    PAIRED_TAGS[1]: _PAIRED.format(o=r"\{#", c=r"#\}", x="#"),
    PAIRED_TAGS[2]: _PAIRED.format(o=r"\{\{", c=r"\}\}", x=r"\}"),
    PAIRED_TAGS[3]: rf"<!--(?:\s*[^-/\s]{_COMMENT}|\s*-->)\s*<!--\s*/{_COMMENT}",
    **{c: c.pattern for c in (*SINGLE_TAGS, *HTML_TAGS)},
}
for _c, _p in _PATTERNS.items():
    query(f"t1_{_c.name}", CONSTRUCTS, lambda d, c=_c: C.spread(d).select("id", F.explode(S.construct_matches(F.col("text"), (c,))).alias("found")), f"SELECT id, unnest(regexp_extract_all(text, '(?s){_p.replace(chr(39), chr(39) * 2)}')) AS found FROM input")
query(
    "t2_paired_builder",
    "SELECT p_partkey AS id, '[[' || p_name || ']] [[ /' || p_name || ']] [[/x]] [[/y]] [[' || p_brand || ']]' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' and ' END || '[[/end]]' AS text FROM $part",
    lambda d: C.spread(d).select("id", F.explode(S.construct_matches(F.col("text"), (paired("paired_bracket", "[[", "]]", "]"),))).alias("found")),
    "SELECT p_partkey AS id, unnest(['[[' || p_name || ']] [[ /' || p_name || ']]'] || CASE WHEN p_size % 2 = 0 THEN ['[[' || p_brand || ']][[/end]]'] ELSE [] END) AS found FROM part",
)
# All at once, named: of two that start at one place, the earlier one in the list.
query(
    "t3_named_constructs",
    CONSTRUCTS,
    lambda d: C.spread(d).select("id", F.inline(S.atomic_spans(F.col("text"), PROSE))).where("is_atomic").groupBy("name", "text").agg(F.count("*").alias("n")),
    f"SELECT CASE WHEN x LIKE '`%' THEN 'inline_code_span' WHEN x LIKE '[%' THEN 'markdown_link' WHEN x LIKE '<%' THEN 'autolink' ELSE 'bare_url' END AS name, x AS text, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s){'|'.join(_PATTERNS[c] for c in PROSE).replace(chr(39), chr(39) * 2)}')) AS x FROM input) GROUP BY 1, 2",
)

# Filling

query("w1_wrap_lines", DOCS, lambda d: C.spread(d).select("id", F.array_join(S.wrap_lines(F.col("text"), 60), "\n").alias("out")), f"SELECT id, {_joined(_wrapped(_WORDS, 60))} AS out FROM input")
scalar("w2_wrap_paragraph", DOCS, lambda t: N.wrap_text(t, 60, "* ", "  "), "(SELECT coalesce('* ' || array_to_string(list_append(r.done, r.now), chr(10) || '  '), '') FROM (SELECT " + _wrapped(_WORDS, 58) + " AS r))")
scalar("w3_no_wrap", DOCS, lambda t: F.array_join(N.wrap_lines(t, 0), "\n"), r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
scalar("w4_escape_word", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN cast(o_custkey AS string) || '.' WHEN o_orderkey % 4 = 1 THEN '##' WHEN o_orderkey % 4 = 2 THEN '-' ELSE o_orderpriority END AS text FROM $orders", N.escape_word, _ESCAPED.replace("b.now", "text"))
query("w4_wrap_markdown", MARKS, lambda d: d.select("id", F.array_join(N.wrap_lines(F.col("text"), 40, markdown=True), "\n").alias("out")), f"SELECT id, {_joined(_wrapped(_WORDS, 40, _ESCAPED))} AS out FROM input")
query("w5_paragraphs", PARAS, lambda d: C.spread(d).select("id", F.explode(N.split_paragraphs(F.col("text"))).alias("p")), "SELECT id, " + _TRIM.format("p") + r" AS p FROM (SELECT id, unnest(regexp_split_to_array(text, '\n{2,}')) AS p FROM input)")


def _filled(width: int, first: str, rest: str, hangs: bool = False) -> str:
    """Paragraphs in order, each wrapped; lines begin with first or rest, both of which the width loses. hangs: first is for the first line of all."""
    room = f"(CASE WHEN k = 1 AND len(a.done) = 0 THEN {width + len(rest)} ELSE {width} END)" if hangs else str(width)
    para = f"(SELECT array_to_string(list_append(r.done, r.now), {_NL} || '{rest}') FROM (SELECT {_wrapped(_PARA_WORDS, room)} AS r))"
    lead = f"CASE WHEN k = 1 THEN '{first}' ELSE '{rest}' END" if hangs else f"'{first}'"
    return f"SELECT id, string_agg({lead} || {para}, {_NL} || {_NL} ORDER BY k) AS out FROM (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT id, regexp_split_to_array(text, '\\n{{2,}}') AS ps FROM input)) GROUP BY id"


query("w6_fill_wrap", PARAS, lambda d: C.spread(d).select("id", N.fill_text(F.col("text"), "wrap").alias("out")), _filled(88, "", ""))
query("w6_fill_wrap_indent", PARAS, lambda d: C.spread(d).select("id", N.fill_text(F.col("text"), "wrap_indent").alias("out")), _filled(80, "    ", "    "))
query("w6_fill_hanging_indent", PARAS, lambda d: C.spread(d).select("id", N.fill_text(F.col("text"), "hanging_indent").alias("out")), _filled(80, "", "    ", True))
query("w6_fill_markdown_item", PARAS, lambda d: C.spread(d).select("id", N.fill_text(F.col("text"), "markdown_item").alias("out")), _filled(84, "", "  ", True))
query("w6_fill_wrap_full", PARAS, lambda d: C.spread(d).select("id", N.fill_text(F.col("text"), "wrap_full").alias("out")), _filled(88, "", ""))
scalar("w6_indent_only", PARAS, lambda t: N.fill_text(t, "indent_only"), f"'    ' || replace(text, {_NL}, {_NL} || '    ')")
scalar("w6_no_wrapping", PARAS, lambda t: N.fill_text(t, "none"), "text")
scalar("w7_wrap_to_width", DOCS, U.wrap_by_width(72, markdown=False), _joined(_wrapped(_WORDS, 72)))
query("w8_hard_breaks", "SELECT c_custkey AS id, c_name || chr(92) || chr(10) || c_mktsegment || '  ' || chr(10) || 'end' AS text FROM $customer", lambda d: C.spread(d).select("id", F.explode(N.hard_break_parts(F.col("text"))).alias("part")), r"SELECT id, unnest(regexp_split_to_array(text, '\\\n|  \n')) AS part FROM input")


def _by_sentence(words: str, width: int = 88, least: int = 20) -> str:
    """A fold over words that know whether a sentence ended before them: `last` is a short line that the one after it joins if both fit."""
    marked = f"list_transform(ws, lambda w, i: {{'done': CAST([] AS VARCHAR[]), 'last': '', 'now': w, 'joins': false, 'starts': i > 1 AND regexp_matches(ws[i - 1], '{_END}')}})"
    both = f"(a.joins AND length(a.last) + 1 + length(a.now) <= {width})"
    line, done = f"(CASE WHEN {both} THEN a.last || ' ' || a.now ELSE a.now END)", f"(CASE WHEN a.joins AND NOT {both} THEN list_append(a.done, a.last) ELSE a.done END)"
    fold = f"""list_reduce({marked}, lambda a, b: CASE
 WHEN b.starts AND length({line}) < {least} THEN {{'done': {done}, 'last': {line}, 'now': b.now, 'joins': true, 'starts': false}}
 WHEN b.starts THEN {{'done': list_append({done}, {line}), 'last': '', 'now': b.now, 'joins': false, 'starts': false}}
 WHEN CASE WHEN a.joins THEN length(a.last) ELSE 0 END + length(a.now) + 1 + length(b.now) <= {width} THEN {{'done': a.done, 'last': a.last, 'now': a.now || ' ' || b.now, 'joins': a.joins, 'starts': false}}
 ELSE {{'done': list_append({done}, {line}), 'last': '', 'now': b.now, 'joins': false, 'starts': false}} END)"""
    return f"(SELECT coalesce(array_to_string(list_append({done}, {line}), {_NL}), '') FROM (SELECT {fold} AS a FROM (SELECT {words} AS ws)))"


query("w9_wrap_by_sentence", DOCS, lambda d: C.spread(d).select("id", U.wrap_by_sentence()(F.col("text")).alias("out")), f"SELECT id, {_by_sentence(_WORDS)} AS out FROM input")
query("w9_sentence_lines", "SELECT c_custkey AS id, 'This is what ' || c_mktsegment || ' said about it then. And here is another sentence of some length. The end of it all is near now.' AS text FROM $customer", lambda d: C.spread(d).select("id", U.wrap_by_sentence()(F.col("text")).alias("out")), r"SELECT id, regexp_replace(text, '\. ', '.' || chr(10), 'g') AS out FROM input")
SEGMENTS = """SELECT event_id AS id, event_type || chr(10) || 'plain two' || chr(10) || CASE WHEN event_id % 2 = 0 THEN '{% f %}' || chr(10) ELSE '' END || 'more' || chr(10) || '- item' || chr(10) || '- ' || event_type || chr(10) || 'lines' || chr(10) || '| t |' || chr(10) || '| u |' || chr(10) || 'end' AS text FROM $events"""
_SEGMENTS_OF = f"SELECT id, unnest(CASE WHEN id % 2 = 0 THEN [l[1] || {_NL} || l[2], l[3], l[4], l[5], l[6], l[7], l[8], l[9], l[10]] ELSE [array_to_string(l[1:6], {_NL}), l[7], l[8], l[9]] END) AS segment FROM (SELECT id, string_split(text, {_NL}) AS l FROM input)"
query("w10_tag_segments", SEGMENTS, lambda d: C.spread(d).select("id", F.explode(U.tag_segments()(F.col("text"))).alias("segment")), _SEGMENTS_OF)
query("w10_segments_of_rows", SEGMENTS, lambda d: I.segments_of_rows(C.lines(C.spread(d), "id"), "id").select("id", "segment"), _SEGMENTS_OF)
scalar("w11_comment_verbatim", COMMENTS, U.wrap_by_width(20, True, "> ", "  "), f"'> ' || replace(text, {_NL}, {_NL} || '  ')")
scalar("w12_space_tag_blocks", "SELECT event_id AS id, '{% f %}' || chr(10) || '- ' || event_type || chr(10) || '{% /f %}' || chr(10) || event_type || chr(10) || '| a |' AS text FROM $events", N.space_tag_blocks, "replace(replace(text, '{% f %}' || chr(10) || '- ', '{% f %}' || chr(10) || chr(10) || '- '), chr(10) || '{% /f %}', chr(10) || chr(10) || '{% /f %}')")
scalar("w13_closing_tags", TAGS, N.settle_closing_tags, "replace(text, chr(10) || '  {% /', chr(10) || '{% /')")
scalar("w14_long_tags", LONG_TAGS, N.split_long_tags, "replace(text, '%} {% /', '%}' || chr(10) || '{% /')")

# Lines

for _name, _sql in (("markdown", MARKDOWN), ("tags", TAGS)):
    per_line(f"h1_table_row_{_name}", _sql, N.is_table_row, r"regexp_matches(line, '^\s*\|')")
    per_line(f"h2_list_item_{_name}", _sql, N.is_list_item, r"regexp_matches(line, '^\s*([-*+][ \t]|[0-9]{1,9}[.)][ \t])')")
    per_line(f"h4_block_content_{_name}", _sql, N.is_block, r"regexp_matches(line, '^\s*(\||[-*+][ \t]|[0-9]{1,9}[.)][ \t])')")
per_line("h3_table_separator", MARKDOWN, N.is_table_separator, r"regexp_matches(trim(line), '^\|(\s*:?-+:?\s*\|)+\s*$')")
per_line("h5_normal_separator", MARKDOWN, N.normal_separator, "CASE WHEN line = '|:--|--:|' THEN '| :--- | ---: |' ELSE line END")

# Typography and rewrites

scalar("r1_smart_quotes", QUOTES, U.smart_quotes(), r"""regexp_replace(text, '(^|\s)"([^"]*)"(\s|,)', '\1“\2”\3', 'g')""")
NESTED = """SELECT p_partkey AS id, 'It said ' || chr(39) || p_name || chr(39) || ', and "she said ' || chr(39) || p_brand || chr(39) || ' twice". Not "' || p_type || ' or ' || chr(39) || 'open, nor x="y" here' AS text FROM $part"""
# What stands inside a pair keeps its own marks.
scalar("r2_quote_pairs", NESTED, U.smart_quotes(), r"""regexp_replace(regexp_replace(text, 'It said ''([^'']*)''', 'It said ‘\1’'), '"(she [^"]*)"', '“\1”')""")
scalar("r3_has_paragraphs", FRONT, N.has_paragraphs, r"regexp_matches(text, '\n\s*\n')")
scalar("r4_apostrophes", APOS, N.apostrophes, "replace(replace(replace(text, chr(39) || 's and', '’s and'), 'and James' || chr(39), 'and James’'), 'don' || chr(39) || 't', 'don’t')")
scalar("r5_ellipses", DOTS, U.ellipses(), "replace(replace(text, ' ...', ' …'), '...', ' … ')")
query("r10_quotes_across_inlines", "SELECT p_partkey AS id, 'He said \"the *' || p_name || '* of `x`\" twice.' AS text FROM $part", lambda d: C.spread(d).select("id", U.fill_markdown(smartquotes=True)(F.col("text")).alias("out")), """SELECT id, replace(replace(text, '"the', '“the'), '`"', '`”') || chr(10) AS out FROM input""")
query(
    "r9_segments",
    LINKS,
    lambda d: X.inline_segments(d, "id").groupBy("id").agg(F.count("*").alias("n"), F.max("end").alias("chars")),
    "SELECT id, CAST(9 AS BIGINT) AS n, CAST(length('See page ' || id || ' and two, ' || u || ' or [no](/code).') AS INTEGER) AS chars FROM (SELECT id, regexp_extract(text, '<([^>]*)>', 1) AS u FROM input)",
)
query(
    "r10_interval_join",
    "SELECT p_partkey AS id, '# \"' || p_brand || '\"' || chr(10) || chr(10) || 'He said \"the *' || p_name || '* of `x`\" twice.' AS text FROM $part",
    lambda d: X.changed_segments(X.inline_segments(d, "id"), U.smart_quotes(), "id", 8).select("id", "scope", "ord", "new"),
    "SELECT p_partkey AS id, CAST(unnest([0, 1, 1]) AS INTEGER) AS scope, CAST(unnest([0, 0, 4]) AS INTEGER) AS ord, unnest(['“' || p_brand || '”', 'He said “the ', '” twice.']) AS new FROM part",
)


def _deeper(n) -> None:
    if n.kind == "heading":
        n.attrs["level"] += 1


query("r6_transform_tree", "SELECT p_partkey AS id, '# ' || p_name || chr(10) || chr(10) || '> ## ' || p_brand AS text FROM $part", lambda d: C.spread(d).select("id", U.fill_markdown(transform=_deeper)(F.col("text")).alias("out")), f"SELECT id, '#' || replace(text, '> ##', '> ###') || {_NL} AS out FROM input")
query("r7_coalesced_lines", "SELECT p_partkey AS id, p_name || '...' || chr(10) || p_type || ' `a...b`' AS text FROM $part", lambda d: C.spread(d).select("id", U.fill_markdown(ellipses_=True)(F.col("text")).alias("out")), f"SELECT id, replace(replace(text, '...' || {_NL}, ' … '), 'a … b', 'a...b') || {_NL} AS out FROM input")
query("r8_rewrite_texts", "SELECT p_partkey AS id, p_name || ' `code` *' || p_type || '* [x](y)' AS text FROM $part", lambda d: C.spread(d).select("id", U.fill_markdown(rewrite=str.upper)(F.col("text")).alias("out")), f"SELECT id, replace(replace(upper(text), '`CODE`', '`code`'), '(Y)', '(y)') || {_NL} AS out FROM input")
query("r11_unbold_headings", "SELECT p_partkey AS id, '## **' || p_name || '**' AS text FROM $part", lambda d: C.spread(d).select("id", U.fill_markdown(cleanups=True)(F.col("text")).alias("out")), "SELECT id, replace(text, '**', '') || chr(10) || chr(10) AS out FROM input")
scalar("r12_dedent", "SELECT c_custkey AS id, '    ' || c_name || chr(10) || chr(10) || '      ' || c_mktsegment AS text FROM $customer", N.dedent, "replace(substr(text, 5), chr(10) || '    ', chr(10))")

# Whole documents

query("e1_fill_markdown", MARKDOWN, lambda d: C.spread(d).select("id", U.fill_markdown()(F.col("text")).alias("out")), f"SELECT id, replace(text, '|:--|--:|', '| :--- | ---: |') || {_NL} AS out FROM input")
_PARAS_OF = "string_agg({0}, " + f"{_NL} || {_NL} ORDER BY k) || {_NL} AS {{1}} FROM (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT id, regexp_split_to_array(trim(text), '\\n\\s*\\n') AS ps FROM input)) GROUP BY id"
query("e1_fill_prose", TALK, lambda d: C.spread(d).select("id", U.fill_markdown(semantic=True)(F.col("text")).alias("out")), "SELECT id, " + _PARAS_OF.format(_by_sentence(_PARA_WORDS), "out"))
query("e2_reformat_plaintext", DOCS, lambda d: C.format_corpus(d, Format(plaintext=True)).select("id", F.col("formatted").alias("out")), f"SELECT id, {_joined(_wrapped(_WORDS, 88))} AS out FROM input")
# The documents' marks stand inside lines, where they change nothing.
query("e2_reformat_markdown", DOCS, lambda d: C.format_corpus(d).select("id", "formatted"), "SELECT id, " + _PARAS_OF.format(_by_sentence(_PARA_WORDS), "formatted"))
query("e4_changed", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '# ' || p_name || chr(10) || chr(10) || p_brand || chr(10) ELSE '#  ' || p_name || chr(10) || p_brand END AS text FROM $part", lambda d: C.changed(d, FILES, "id"), "SELECT id FROM input WHERE text LIKE '#  %'")
query("s20_reformat_corpus", TALK, lambda d: C.format_corpus(d, FILES).select("id", "formatted"), "SELECT id, " + _PARAS_OF.format(_joined(_wrapped(_PARA_WORDS, 88, _ESCAPED)), "formatted"))
query("e5_auto", QUOTES, lambda d: C.format_corpus(d, AUTO).select("id", "formatted"), rf"""SELECT id, regexp_replace(text, '(^|\s)"([^"]*)"(\s|,)', '\1“\2”\3', 'g') || {_NL} AS formatted FROM input""")

# Agent artifacts, options and statistics

query("k1_placeholders", "SELECT c_custkey AS id, 'v {{VERSION}} of ' || c_name || ' {{VERSION}}' AS text FROM $customer", lambda d: d.select("id", R.fill_placeholders(F.col("text"), {"{{VERSION}}": "1.2"}).alias("out")), "SELECT id, 'v 1.2 of ' || substr(text, 18, length(text) - 29) || ' 1.2' AS out FROM input")
scalar("k2_release_version", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '1.' || cast(o_orderkey AS string) WHEN o_orderkey % 3 = 1 THEN '2.0.post1' ELSE '1.0.dev' || cast(o_orderkey AS string) END AS text FROM $orders", R.is_release, r"regexp_matches(text, '^[0-9]+(\.[0-9]+)*(\.post[0-9]+)?$')")
scalar("k4_format_stamp", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'x <!-- format=f' || cast(o_orderkey AS string) || ' -->' ELSE 'plain' END AS text FROM $orders", R.format_stamp, "CAST(CASE WHEN text IS NULL THEN NULL WHEN text LIKE '%format=f%' THEN CAST(regexp_extract(text, 'format=f([0-9]+)', 1) AS INT) ELSE 0 END AS INT)")
scalar("k3_insert_marker", FRONT, lambda t: R.insert_marker(t, "<!-- made -->"), "CASE WHEN starts_with(text, '---' || chr(10)) AND strpos(substr(text, 5), chr(10) || '---' || chr(10)) > 0 THEN regexp_replace(text, '(?s)^(---\\n.*?\\n---\\n)', '\\1<!-- made -->' || chr(10) || chr(10)) ELSE '<!-- made -->' || chr(10) || chr(10) || text END")
MARKED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' WHEN o_orderkey % 7 = 2 THEN 'a' || chr(10) WHEN o_orderkey % 7 = 3 THEN 'x ' || o_orderpriority WHEN o_orderkey % 7 = 4 THEN 'a <!-- BEGIN T' || chr(10) || 'never closed'
 ELSE 'a' || chr(10) || '<!-- BEGIN T format=f0' || cast(o_custkey % 5 AS string) || ' -->' || chr(10) || o_orderstatus || '<!-- END T -->' || chr(10) || 'b' || CASE WHEN o_orderkey % 7 = 6 THEN '<!-- BEGIN T --><!-- END T -->c' ELSE '' END END AS text FROM $orders"""
BLOCK = ("<!-- BEGIN T", "<!-- END T -->", "<!-- BEGIN T format=f03 -->\nF<!-- END T -->")
BLOCK_SQL = "'<!-- BEGIN T format=f03 -->' || chr(10) || 'F<!-- END T -->'"
REPLACED_SQL = f"CASE WHEN regexp_matches(text, '(?s)<!-- BEGIN T.*?<!-- END T -->') THEN string_split_regex(text, '(?s)<!-- BEGIN T.*?<!-- END T -->')[1] || {BLOCK_SQL} || array_to_string(string_split_regex(text, '(?s)<!-- BEGIN T.*?<!-- END T -->')[2:], '') ELSE text END"
scalar("k5_replace_blocks", MARKED, lambda t: R.replace_blocks(t, *BLOCK), REPLACED_SQL)
query("k6_upsert_block", MARKED, lambda d: d.select("id", R.upsert_block(F.col("text"), *BLOCK, 3).alias("r")).select("id", "r.action", "r.text"), f"""SELECT id, CASE WHEN newer THEN 'blocked-newer' WHEN text IS NULL THEN 'installed' WHEN text = made THEN 'unchanged' ELSE 'updated' END AS action, CASE WHEN newer THEN text ELSE made END AS text
 FROM (SELECT *, coalesce(text LIKE '%BEGIN T format=f04%', false) AS newer, CASE WHEN text LIKE '%<!-- BEGIN T%' THEN {REPLACED_SQL} WHEN coalesce(text, '') = '' THEN {BLOCK_SQL} || chr(10) WHEN text LIKE '%' || chr(10) THEN text || chr(10) || {BLOCK_SQL} || chr(10) ELSE text || chr(10) || chr(10) || {BLOCK_SQL} || chr(10) END AS made FROM input)""")
query("k7_write_decision", "SELECT o_orderkey AS id, cast(o_orderkey % 4 AS int) AS own, CASE WHEN o_orderkey % 5 > 0 THEN cast(o_orderkey % 6 AS int) END AS found, o_orderkey % 2 = 0 AS same FROM $orders", lambda d: d.select("id", R.write_decision(F.col("found"), F.col("own"), F.col("same")).alias("out")), "SELECT id, CASE WHEN found IS NULL THEN 'installed' WHEN found > own THEN 'blocked-newer' WHEN same THEN 'unchanged' ELSE 'updated' END AS out FROM input")
query("k8_surfaces", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a,b,a' ELSE 'c,z' END AS text FROM $customer", lambda d: d.select("id", F.array_join(R.chosen(F.split("text", ","), ["a", "b", "c"]), ",").alias("chosen"), F.array_join(R.unknown(F.split("text", ","), ["a", "b", "c"]), ",").alias("unknown")), "SELECT id, CASE WHEN text = 'c,z' THEN 'c' ELSE 'a,b' END AS chosen, CASE WHEN text = 'c,z' THEN 'z' ELSE '' END AS unknown FROM input")
query(
    "a1_timing_stats",
    "SELECT event_type AS run, value AS seconds FROM $events",
    lambda d: C.timing_stats(d).select("run", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "least", "most", "stdev")]),
    "SELECT run, count(seconds) AS n, round(avg(seconds), 4) AS mean, round(median(seconds), 4) AS median, round(min(seconds), 4) AS least, round(max(seconds), 4) AS most, round(stddev_samp(seconds), 4) AS stdev FROM input GROUP BY run",
)
ORACLE_SQL["a1_timing_stats"] = ORACLE_SQL["a1_timing_stats"].replace(", lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM input)", "")
for _k in ("s6_resolve", "s7_include", "s8_size_limit", "s11_pruned", "s9_ignore_file", "s13_default_excludes", "s12_force_exclude", "s19_list_files", "s25_merge_options", "k7_write_decision"):
    ORACLE_SQL[_k] = ORACLE_SQL[_k].replace(", lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM input)", "")
