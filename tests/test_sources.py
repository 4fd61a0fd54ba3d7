"""Planned scans, the file sink, and ignore files as a relation."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.sources import sink
from textloom.sources.files import Discovery, Resolver, TextFiles, scan_files
from textloom.sources.ignored import kept_paths


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(TextFiles)
    return spark


def plant(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


TREE = {
    "a.md": "a", "b.txt": "b", "docs/c.md": "c" * 50, "docs/deep/er/d.md": "d", "docs/deep/skip1.md": "s", "docs/deep/skip2.md": "s", "docs/.gitignore": "skip*\n!skip2.md\n", "node_modules/x.md": "x", "out/y.md": "y", "src/out/z.md": "z",
    ".gitignore": "# none\n/out/\n", "src/gen/g.md": "g", "src/gen/keep/k.md": "k", "src/note.md": "n", ".textloomignore": "gen/keep\nnote.*\n", "src/.textloomignore": "*\n", "src/sub/.gitignore": "*\n!*.md\n", "src/sub/m.md": "m", "src/sub/dir/n.md": "n",
}


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_scan_lists_what_the_resolver_lists(session, tmp_path, slices):
    plant(tmp_path, TREE)
    load = lambda *paths, **o: sorted(r.path for r in session.read.format("textloom_files").option("slices", slices).options(**o).option("paths", os.pathsep.join(map(str, paths))).load().collect())
    assert load(tmp_path) == [str(p) for p in Resolver().resolve([str(tmp_path)])]
    assert load(tmp_path, tmp_path / "a.md", tmp_path / "b.txt", tmp_path) == [str(p) for p in Resolver().resolve([str(tmp_path), f"{tmp_path}/b.txt"])]
    assert load(tmp_path, respect_gitignore="false") == [str(p) for p in Resolver(Discovery(respect_gitignore=False)).resolve([str(tmp_path)])]
    assert load(tmp_path, max_size="10") == [str(p) for p in Resolver(Discovery(max_size=10)).resolve([str(tmp_path)])]
    assert load(f"{tmp_path}/docs/*.md", tmp_path / "src") == [str(p) for p in Resolver().resolve([f"{tmp_path}/docs/*.md", f"{tmp_path}/src"])]
    with pytest.raises(Exception, match="none"):
        load(tmp_path / "none")


def test_filters_reach_the_listing(session, tmp_path):
    plant(tmp_path, {f"f{k}/{j}.md": "x" * (k + 1) for k in range(6) for j in range(3)})
    (tmp_path / "f5/bad.md").write_bytes(b"\xff")
    df = scan_files(session, tmp_path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    some = df.where((F.col("size") <= 3) & F.col("path").startswith(f"{tmp_path}/f"))
    assert "Filter" not in plan(some).split("BatchScan")[0].replace("PushedFilters", "")
    assert {r.path for r in some.collect()} == {f"{tmp_path}/f{k}/{j}.md" for k in range(3) for j in range(3)} | {f"{tmp_path}/f5/bad.md"}
    assert {r.path for r in df.where(F.col("path").isin(f"{tmp_path}/f1/0.md", f"{tmp_path}/f9/0.md")).collect()} == {f"{tmp_path}/f1/0.md"}
    assert df.where(F.col("path").endswith("2.md") & (F.col("size") > 4) & (F.length("text") < 6)).count() == 1
    assert df.where("error IS NOT NULL").count() == 1
    # Folders that can't hold what is sought, and excluded ones, aren't opened.
    from textloom.sources.files import StringStartsWith, _PushedReader

    reader = _PushedReader(Discovery(), [str(tmp_path)], 64)
    assert list(reader.pushFilters([StringStartsWith(("path",), f"{tmp_path}/f3/")])) == []
    assert {p.at for p in reader.partitions()} == {str(tmp_path), f"{tmp_path}/f3"}
    plant(tmp_path, {".git/x.md": "x", "build/y.md": "y"})
    assert not {p.at for p in _PushedReader(Discovery(), [str(tmp_path)], 64).partitions()} & {f"{tmp_path}/.git", f"{tmp_path}/build"}


def contents(root):
    return {p.relative_to(root).as_posix(): p.read_text() for p in sorted(root.rglob("*")) if p.is_file()}


def test_sink_replaces_all_files(session, tmp_path):
    plant(tmp_path, {f"d/{k}.md": f"old {k}" for k in range(40)})
    df = session.read.format("textloom_files").option("paths", str(tmp_path)).load().select("path", F.concat(F.lit("new "), "text").alias("text"))
    df.write.format("textloom_files").option("root", str(tmp_path)).mode("append").save()
    assert contents(tmp_path) == {f"d/{k}.md": f"new old {k}" for k in range(40)} | {f"d/{k}.md.orig": f"old {k}" for k in range(40)}
    more = session.createDataFrame([("new/é.md", "x"), ("d/1.md", "y")], "path string, text string")
    more.write.format("textloom_files").option("root", str(tmp_path)).option("backup", "false").mode("append").save()
    now = contents(tmp_path)
    assert now["new/é.md"] == "x" and now["d/1.md"] == "y" and now["d/1.md.orig"] == "old 1"


def test_a_lost_task_leaves_all_as_it_was(session, tmp_path):
    old = contents(plant(tmp_path, {f"d/{k}.md": f"old {k}" for k in range(40)}))

    @F.udf("string")
    def dies(path):
        if path.endswith("/33.md"):
            os._exit(1)
        return "new"

    df = session.range(40).repartition(8).select(F.concat(F.lit(f"{tmp_path}/d/"), F.col("id").cast("string"), F.lit(".md")).alias("path")).withColumn("text", dies("path"))
    with pytest.raises(Exception):
        df.write.format("textloom_files").option("root", str(tmp_path)).mode("append").save()
    assert contents(tmp_path) == old and not (tmp_path / sink.STAGING).exists()


@pytest.mark.parametrize("path, text", [("../x.md", "x"), (None, "x"), ("d", "x"), ("/etc/x.md", "x"), ("d/1.md", None), (f"{sink.STAGING}/x", "x")])
def test_the_sink_guards_its_root(session, tmp_path, path, text):
    old = contents(plant(tmp_path, {"d/1.md": "old"}))
    with pytest.raises(Exception):
        session.createDataFrame([(path, text), ("d/1.md", "new")], "path string, text string").coalesce(1).write.format("textloom_files").option("root", str(tmp_path)).mode("append").save()
    assert contents(tmp_path) == old


@pytest.mark.parametrize("fails_at", range(6))
def test_recovery_finishes_or_undoes(tmp_path, monkeypatch, fails_at):
    """The machine stops at any move: afterwards, all files are new or all are old."""
    old = contents(plant(tmp_path, {"a.md": "1", "b.md": "2"}))
    new = {"a.md": "x", "a.md.orig": "1", "b.md": "y", "b.md.orig": "2"}
    writer = sink.FileSink(str(tmp_path), True, ["path", "text"])
    messages = [writer.write([{"path": "a.md", "text": "x"}]), writer.write([{"path": "b.md", "text": "y"}])]
    writer.write([{"path": "a.md", "text": "of an attempt that didn't count"}])
    moves, real = [], os.replace

    def replace(a, b):
        if len(moves) == fails_at:
            raise KeyboardInterrupt
        moves.append(a)
        real(a, b)

    monkeypatch.setattr(os, "replace", replace)
    try:
        writer.commit(messages)
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(os, "replace", real)
    decided = sink.recover(str(tmp_path))
    assert contents(tmp_path) == (old if fails_at == 0 else new)
    assert decided == ((0, 1) if fails_at == 0 else (1, 0) if fails_at < 5 else (0, 0))


def test_ignore_relation_agrees_with_the_walk(spark, tmp_path):
    rng = random.Random(5)
    names = ["a", "b.md", "skip.md", "gen", "x.txt", "keep.md", "out"]
    lines = ["skip*", "!skip.md", "gen/", "/out", "*.md", "!keep.md", "a/", "# c", "", "out/", "**/b.md", "a/gen", "\\!x", "[ab].md", "x.txt "]
    for case in range(4):
        root = tmp_path / f"t{case}"
        for _ in range(40):
            parts = [rng.choice(names[:1] + names[3:4] + names[6:]) for _ in range(rng.randint(0, 3))]
            plant(root, {"/".join([*parts, rng.choice(names[1:3] + names[4:6])]): "t"})
        folders = [p for p in [root, *root.rglob("*")] if p.is_dir()]
        for p in rng.sample(folders, min(4, len(folders))):
            (p / ".gitignore").write_text("\n".join(rng.sample(lines, 4)))
        if case % 2:
            (root / ".textloomignore").write_text("\n".join(rng.sample(lines, 3)))
        (tmp_path / ".textloomignore").write_text("gen/\n")
        files = [p for p in root.rglob("*") if p.is_file() and not p.name.endswith("ignore")]
        read = [(str(p.parent), "git" if p.name == ".gitignore" else "tool", k, x) for p in tmp_path.rglob(".*ignore") for k, x in enumerate(p.read_text().split("\n"))]
        got = kept_paths(spark.createDataFrame([(str(root), str(p)) for p in files], "root string, path string"), spark.createDataFrame(read, "folder string, kind string, line_no int, line string"))
        want = Resolver(Discovery(include=("*",), exclude=())).walk(root)
        assert {r.path for r in got.collect()} == {str(p) for p in want if not p.name.endswith("ignore")}
