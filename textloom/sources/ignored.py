"""Ignore files as a relation: which paths of a tree remain under nested ignore files and the nearest tool file.

Rules are joined to the tree's nodes on the folder they stand in; within a file the last line that matches decides, and any file's verdict counts. A folder that is out takes with it
what is below. Each folder is judged once, however many files it holds. Joins are on folders and roots; Spark broadcasts a side only where its size at run time allows it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.ignore import parsed_line

GIT, TOOL = "git", "tool"


def _parsed(lines: pd.Series) -> pd.DataFrame:
    rows = [r and (r[0], r[1], "^(?:" + r[2].pattern + ")") for r in (parsed_line(x) if x is not None else None for x in lines)]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["excludes", "folders", "pattern"])


def parsed_rules(lines: DataFrame) -> DataFrame:
    """lines(folder, kind, line_no, line) -> (folder, kind, line_no, excludes, folders, pattern), without blank lines and comments."""
    parsed = F.pandas_udf(_parsed, "excludes boolean, folders boolean, pattern string")
    return lines.select("folder", "kind", "line_no", parsed("line").alias("r")).where("r.pattern IS NOT NULL").select("folder", "kind", "line_no", "r.*")


def _prefix(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), n), "/")


def tree_nodes(paths: DataFrame) -> DataFrame:
    """paths(root, path) -> the different (root, node, parent, name, rel, is_folder) on the way from each root to its files."""
    parts, base = F.split("path", "/"), F.size(F.split("root", "/"))
    node = lambda k: F.struct(_prefix(parts, k).alias("node"), _prefix(parts, k - 1).alias("parent"), F.get(parts, k - 1).alias("name"), F.array_join(F.slice(parts, base + 1, k - base), "/").alias("rel"), (k < F.size(parts)).alias("is_folder"))
    return paths.select("root", F.explode(F.transform(F.sequence(base + 1, F.size(parts)), node)).alias("n")).select("root", "n.*").distinct()


def _out(met: DataFrame, by: list[str]) -> DataFrame:
    """Of subjects met with rules, the nodes that the last matching line of a file excludes."""
    hits = met.where(F.rlike("subject", "pattern") & (F.col("is_folder") | ~F.col("folders")))
    last = hits.groupBy("root", "node", "is_folder", *by).agg(F.max_by("excludes", "line_no").alias("out"))
    return last.where("out").select("root", "node", "is_folder").distinct()


def nodes_out(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(root, node, is_folder) that a file of kind git between root and node, or the tool file nearest to the root, excludes by itself."""
    above, base = F.split("parent", "/"), F.size(F.split("root", "/"))
    chain = nodes.withColumn("folder", F.explode(F.transform(F.sequence(base, F.size(above)), lambda k: _prefix(above, k))))
    git = chain.join(rules.where(F.col("kind") == GIT), "folder").withColumn("subject", F.col("name"))
    at = F.split("root", "/")
    towards = nodes.select("root").distinct().select("root", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(at)), lambda k: _prefix(at, k))).alias("depth", "folder"))
    tool = rules.where(F.col("kind") == TOOL)
    nearest = towards.join(tool.select("folder").distinct(), "folder").groupBy("root").agg(F.max_by("folder", "depth").alias("folder"))
    subjects = F.array_distinct(F.when(F.col("is_folder"), F.array("name", "rel")).otherwise(F.array("name")))
    told = nodes.join(nearest, "root").join(tool, "folder").withColumn("subject", F.explode(subjects))
    return _out(git, ["folder"]).union(_out(told, ["subject"])).distinct()


def kept_paths(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """paths(root, path, ...) that remain. lines(folder, kind, line_no, line): the ignore files' lines; folders and paths are written alike, with / between their parts."""
    nodes = tree_nodes(paths)
    out = nodes_out(nodes, parsed_rules(lines))
    parts, base = F.split("path", "/"), F.size(F.split("root", "/"))
    ways = paths.select("root", "path").distinct().withColumn("node", F.explode(F.transform(F.sequence(base + 1, F.size(parts)), lambda k: _prefix(parts, k))))
    gone = ways.join(out.select("root", "node").distinct(), ["root", "node"], "left_semi").select("root", "path").distinct()
    return paths.join(gone, ["root", "path"], "left_anti")
