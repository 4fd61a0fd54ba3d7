"""Spark surfaces: sources, checks, streaming, SQL names, configuration, command line."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.functions import udfs
from textloom.functions.formatting import FILES, Format
from textloom.operators import corpus as C
from textloom.plans.options import find_config, load_config, resolve_format
from textloom.sources.files import Discovery, Resolver, TextFiles, read_texts
from textloom.sources.ignore import Rules
from textloom.sources.rules import insert_marker, upsert_block
from textloom.streaming.corpus import format_stream


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.md": "x  y\n", "b.txt": "b", "docs/c.md": "# **C**\n", "node_modules/d.md": "d", ".hid/e.md": "e", "docs/skip.md": "s", "docs/.gitignore": "skip*\n", "big.md": "b" * 99}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_resolver(tree):
    names = lambda o=Discovery(), i=(str(tree),): [p.relative_to(tree).as_posix() for p in Resolver(o).resolve(list(i))]
    assert names() == [".hid/e.md", "a.md", "big.md", "docs/c.md"]
    assert names(Discovery(max_size=50)) == [".hid/e.md", "a.md", "docs/c.md"]
    assert "docs/skip.md" in names(Discovery(respect_gitignore=False))
    assert names(i=(f"{tree}/*.md", f"{tree}/b.txt", f"{tree}/a.md")) == ["a.md", "b.txt", "big.md"]
    assert names(Discovery(force_exclude=True), (f"{tree}/node_modules/d.md",)) == []
    with pytest.raises(FileNotFoundError):
        names(i=(f"{tree}/none.md",))


def test_ignore_rules():
    r = Rules(["*.log", "!keep.log", "/top", "dir/", "a/**/z", "# note", ""])
    assert r.matches("x/y.log") and not r.matches("keep.log") and r.matches("top") and not r.matches("x/top")
    assert r.matches("dir/") and not r.matches("dir") and r.matches("a/b/c/z") and r.matches("a/z")


def test_data_source(spark, tree):
    spark.dataSource.register(TextFiles)
    got = spark.read.format("textloom_files").option("paths", str(tree)).load()
    assert {r.path.split("/")[-1]: r.text for r in got.collect()} == {"e.md": "e", "a.md": "x  y\n", "big.md": "b" * 99, "c.md": "# **C**\n"}
    assert read_texts(spark, str(tree)).where(F.col("path").endswith("a.md")).count() == 1


def test_check_sql_and_nulls(spark):
    docs = spark.createDataFrame([(1, "x  y"), (2, "x y\n"), (3, "x y\r\n"), (4, None)], "doc_id long, text string")
    assert [r.doc_id for r in C.changed(docs, FILES).collect()] == [1]
    udfs.register(spark)
    assert spark.sql("SELECT loom_reformat('a   b') AS x, loom_reformat(cast(NULL AS string)) AS y").first() == ("a b\n", None)


def test_filters_reach_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    plan = C.format_corpus(docs).where("lang = 'en'").select("doc_id", "formatted")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan and plan.count("ArrowEvalPython") == 1


def test_check_formats_behind_the_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for options, work in ((FILES, "ArrowEvalPython"), (Format(plaintext=True), "- Filter ")):
        above, exchange, below = C.changed(docs, options)._jdf.queryExecution().executedPlan().toString().partition("REPARTITION_BY_NUM")
        assert exchange and work in above and work not in below


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a  b")], "doc_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    format_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.formatted for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a b\n"]


def test_config(tmp_path):
    (tmp_path / "textloom.toml").write_text("width = 40\n[rules]\nlist-spacing = 'loose'\nsemantic = false\nodd = 1\n")
    sub = tmp_path / "x"
    sub.mkdir()
    options, unknown = load_config(find_config(sub))
    assert options == {"width": 40, "list_spacing": "loose", "semantic": False} and unknown == ["odd"]
    assert resolve_format({"width": 50}, options, False, FILES) == Format(width=50, semantic=False, list_spacing="loose")
    assert resolve_format({}, options, True, FILES) == Format(40, False, True, True, True, True, "loose")


def test_command_line(tree, monkeypatch, capsys):
    monkeypatch.chdir(tree)
    assert cli.main(["--check", "a.md"]) == 1
    assert cli.main(["--list-files", "docs"]) == 0 and capsys.readouterr().out == "docs/c.md\n"
    assert cli.main(["--auto", "docs"]) == 0 and (tree / "docs/c.md").read_text() == "# C\n\n"
    assert cli.main(["--inplace", "a.md"]) == 0 and (tree / "a.md").read_text() == "x y\n" and (tree / "a.md.orig").exists()
    assert cli.main(["none.md"]) == 1
    assert cli.main(["-o", "out.md", "a.md"]) == 1


def test_marker_blocks(spark):
    begin, end, block = "<!-- BEGIN T", "<!-- END T -->", "<!-- BEGIN T format=f03 -->N<!-- END T -->"
    cases = [
        (None, "installed", block + "\n"),
        ("", "updated", block + "\n"),
        ("a", "updated", f"a\n\n{block}\n"),
        ("a\n", "updated", f"a\n\n{block}\n"),
        (f"a{block}b", "unchanged", f"a{block}b"),
        (f"{begin} -->x{end}a{block}b", "updated", f"{block}ab"),
        (f"a {begin} open", "unchanged", f"a {begin} open"),
        (f"{begin} format=f0004 -->{end}", "blocked-newer", f"{begin} format=f0004 -->{end}"),
        (f"{begin} format=f{'9' * 40} -->{end}", "blocked-newer", f"{begin} format=f{'9' * 40} -->{end}"),
        (f"format=f99 {begin} -->{end}", "updated", f"format=f99 {block}"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "id int, text string")
    got = docs.select("id", upsert_block(F.col("text"), begin, end, block, 3).alias("r")).orderBy("id").collect()
    assert [tuple(r["r"]) for r in got] == [(a, t) for _, a, t in cases]
    fronts = spark.createDataFrame([("---\na: 1\n---\nb",), ("---\n---\nb",), ("b",), ("",)], "text string")
    assert [r[0] for r in fronts.select(insert_marker(F.col("text"), "M")).collect()] == ["---\na: 1\n---\nM\n\nb", "M\n\n---\n---\nb", "M\n\nb", "M\n\n"]


def test_package_ships_to_sessions_elsewhere(tmp_path):
    """A session that is started in another folder finds the package in its workers."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import textloom
from pyspark.sql import SparkSession
from textloom.functions import udfs
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
textloom.ship(spark)
print(spark.sql("SELECT 'a...b' AS t").select(udfs.ellipses()("t")).first()[0])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "a … b" in out.stdout, out.stderr[-2000:]


def test_transform_and_rewrite():
    from textloom import fill_markdown, parse, transform_tree

    seen = []
    transform_tree(parse("# A\n\n- *b*\n"), lambda n: seen.append(n.kind))
    assert seen[:2] == ["document", "heading"] and {"list", "item", "paragraph", "emphasis"} <= set(seen)
    assert fill_markdown("a `b` *c*", rewrite=str.upper) == "A `b` *C*\n"


def test_command_line_takes_plain_files_and_reports_each(tmp_path, capsys):
    from textloom.cli import main

    good, bad = tmp_path / "a.md", tmp_path / "b.md"
    good.write_text("*  x")
    bad.write_bytes(b"\xff\xfe")
    assert main([str(good), str(bad)]) == 1
    got = capsys.readouterr()
    assert got.out == "* x\n" and "b.md" in got.err


def test_queries_ship_the_package(tmp_path):
    """From a folder where workers don't find the package, a query with Python functions runs."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", "{root}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", entry.queries()["r1_smart_quotes"](spark, "/root/testdata/sf0.001").count() > 0, len(entry.queries()["r1_smart_quotes"](spark, "/root/testdata/sf0.001").limit(3).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS True 3" in out.stdout, out.stderr[-2000:]
