"""Discovery and reading of text files: walks, globs and single files under include, exclude, ignore and size rules.

As a Spark data source (`textloom_files`), a partition is a folder: tasks list it, prune what doesn't count, and read what remains. The command line lists on the driver. For stores that only Spark reads, `read_texts` uses Spark's own reader.
"""

from __future__ import annotations

import glob as globbing
import operator
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from textloom.sources.ignore import Rules
from textloom.sources.rules import EXCLUDE, INCLUDE, MAX_SIZE
from textloom.sources.sink import FileSink

TOOL_IGNORE = ".textloomignore"


@dataclass(frozen=True)
class Discovery:
    """Which files count. `exclude` replaces the standard list, the extensions add to either."""

    include: tuple[str, ...] = INCLUDE
    extend_include: tuple[str, ...] = ()
    exclude: tuple[str, ...] | None = None
    extend_exclude: tuple[str, ...] = ()
    respect_gitignore: bool = True
    force_exclude: bool = False
    max_size: int = MAX_SIZE


def _lines(path: Path) -> list[str] | None:
    try:
        return path.read_text().split("\n")
    except (OSError, UnicodeDecodeError):
        return None


class Resolver:
    def __init__(self, options: Discovery = Discovery()):
        self.o = options
        self.included = Rules([*options.include, *options.extend_include])
        self.excluded = Rules([*(EXCLUDE if options.exclude is None else options.exclude), *options.extend_exclude])

    def too_large(self, path: Path) -> bool:
        try:
            return 0 < self.o.max_size < path.stat().st_size
        except OSError:
            return False

    def folder(self, root: Path, at: Path, above: list[list[str]], tool: Rules) -> tuple[list[Path], list[Path], list[list[str]]]:
        """One folder's files that count, its folders that are to be entered, and the ignore files down to it. above: those of the folders over it, as lines."""
        rel = "" if at == root else at.relative_to(root).as_posix() + "/"
        own = _lines(at / ".gitignore") if self.o.respect_gitignore else None
        chain = [*above, *([own] if own is not None else [])]
        git = [Rules(lines) for lines in chain]
        out = lambda name: any(r.matches(name) for r in (*git, tool))
        files, folders = [], []
        try:
            found = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            return [], [], chain
        for e in found:
            if e.is_dir():
                d = e.name + "/"
                # Folders that don't count aren't entered at all; neither are links to folders.
                if not e.is_symlink() and not (self.excluded.matches(d) or self.excluded.matches(rel + d) or out(d) or tool.matches(rel + d)):
                    folders.append(at / e.name)
            elif self.included.matches(e.name) and not self.too_large(at / e.name) and not out(e.name):
                files.append(at / e.name)
        return files, folders, chain

    def walk(self, root: Path, start: Path | None = None, above: list[list[str]] = [], enter=lambda p: True) -> Iterator[Path]:  # noqa: B006
        """The files below root, or below one of its folders; enter says which folders may hold what is sought."""
        tool = self.tool_rules(root)
        todo = [(start or root, above)]
        while todo:
            at, chain = todo.pop()
            files, folders, chain = self.folder(root, at, chain, tool)
            yield from files
            todo += [(d, chain) for d in reversed(folders) if enter(d)]

    def tool_rules(self, root: Path) -> Rules:
        """Of the nearest folder from root upwards that has an ignore file."""
        start = root.resolve()
        found = (_lines(p / TOOL_IGNORE) for p in (start, *start.parents))
        return Rules(next((x for x in found if x is not None), []))

    def expand(self, pattern: str) -> Iterator[Path]:
        """Globs: only include and size count."""
        for name in globbing.glob(pattern, recursive=True):
            p = Path(name)
            if p.is_file() and self.included.matches(p.name) and not self.too_large(p):
                yield p

    def explicit(self, path: Path) -> bool:
        if self.o.force_exclude and any(self.excluded.matches(x) for part in path.parts for x in (part, f"{part}/")):
            return False
        return not self.too_large(path)

    def resolve(self, inputs: list[str]) -> list[Path]:
        """Files for mixed inputs, each once, in order; an input that is nothing is an error."""
        found: dict[Path, Path] = {}
        for text in inputs:
            p = Path(text)
            if p.is_dir():
                new = self.walk(p)
            elif p.is_file():
                new = iter([p] if self.explicit(p) else [])
            elif any(c in text for c in "*?["):
                new = self.expand(text)
            else:
                raise FileNotFoundError(text)
            for x in new:
                found.setdefault(x.resolve(), x)
        return sorted(found.values())


def needs_resolving(names: list[str], rules: Discovery) -> bool:
    """Whether names are more than plain files, which are taken as they are."""
    return rules.force_exclude or not all(Path(x).is_file() for x in names)


@dataclass
class _Part(InputPartition):
    """A folder to list, with or without what is below it, or files that were named."""

    root: str
    at: str = ""
    above: list | None = None
    deep: bool = False
    names: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()


_SIZE = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}
_PATH = {EqualTo: operator.eq, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


class _Reader(DataSourceReader):
    """Plans folders, not files: the driver opens folders only until there are enough of them for the tasks, and tasks list the rest."""

    def __init__(self, rules: Discovery, inputs: list[str], slices: int):
        self.rules, self.inputs, self.slices = rules, inputs, slices
        self.path_tests: list[tuple] = []
        self.size_tests: list[tuple] = []

    def wanted(self, path: str) -> bool:
        return all(path in v if k is In else _PATH[k](path, v) for k, v in self.path_tests)

    def may_hold(self, folder: Path) -> bool:
        """Whether paths under a folder can meet the conditions on paths."""
        under = f"{folder}/"
        fits = lambda value: value.startswith(under) or under.startswith(value)
        for k, v in self.path_tests:
            if k is StringStartsWith and not fits(v) or k is EqualTo and not v.startswith(under) or k is In and not any(x.startswith(under) for x in v):
                return False
        return True

    def partitions(self):
        resolver = Resolver(self.rules)
        roots, named = [], []
        for text in self.inputs:
            p = Path(text)
            if p.is_dir():
                roots.append(p)
            elif p.is_file():
                named += [p] if resolver.explicit(p) else []
            elif any(c in text for c in "*?["):
                named += resolver.expand(text)
            else:
                raise FileNotFoundError(text)
        roots = [r for k, r in enumerate(roots) if not any(r.resolve() == x.resolve() for x in roots[:k])]
        parts = [_Part(str(r), str(r), [], True) for r in roots if self.may_hold(r)]
        # Folders are opened, the shallowest first, until the tasks have one each.
        k = 0
        while k < len(parts) and len(parts) < self.slices:
            p = parts[k]
            _, folders, chain = resolver.folder(Path(p.root), Path(p.at), p.above, resolver.tool_rules(Path(p.root)))
            p.deep = False
            parts += [_Part(p.root, str(d), chain, True) for d in folders if self.may_hold(d)]
            k += 1
        names = list(dict.fromkeys(str(p) for p in named if self.wanted(str(p))))
        n = max(1, min(self.slices, len(names)))
        # Named files that a walk might find, too, are read once: as named.
        real = [str(Path(x).resolve()) for x in names]
        for p in parts:
            p.skip = tuple(x for x in real if x.startswith(f"{Path(p.at).resolve()}/"))
        return [*parts, *(_Part("", names=tuple(names[i::n])) for i in range(n) if names)] or [_Part("")]

    def files(self, part: _Part) -> Iterator[Path]:
        if not part.root:
            yield from map(Path, part.names)
            return
        resolver, root = Resolver(self.rules), Path(part.root)
        if part.deep:
            found = resolver.walk(root, Path(part.at), part.above, self.may_hold)
        else:
            found = iter(resolver.folder(root, Path(part.at), part.above, resolver.tool_rules(root))[0])
        yield from (p for p in found if self.wanted(str(p)) and not (part.skip and str(p.resolve()) in part.skip))

    def read(self, partition):
        for p in self.files(partition):
            if self.size_tests and not all(_SIZE[k](p.stat().st_size, v) for k, v in self.size_tests):
                continue
            raw = p.read_bytes()
            try:
                yield str(p), len(raw), raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"), None
            except UnicodeDecodeError as error:
                yield str(p), len(raw), None, str(error)


class _PushedReader(_Reader):
    """Sessions that don't push filters into Python sources refuse a reader that takes any."""

    def pushFilters(self, filters):  # noqa: N802
        """Conditions on path and size are met while listing, so that no other file is read; the rest is Spark's."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, IsNotNull) and column in (("path",), ("size",)):
                continue  # they never are
            if column == ("path",) and type(f) in _PATH:
                self.path_tests.append((type(f), f.value))
            elif column == ("path",) and isinstance(f, In):
                self.path_tests.append((In, tuple(f.value)))
            elif column == ("size",) and type(f) in _SIZE:
                self.size_tests.append((type(f), f.value))
            else:
                yield f


class TextFiles(DataSource):
    """spark.read.format("textloom_files").option("paths", "a.md:docs").load(): (path, size, text, error); a file that is no UTF-8 has an error and no text.

    With the option pushdown, which takes spark.sql.python.filterPushdown.enabled, conditions on path and size reach the listing; scan_files sets both. df.write.format("textloom_files").option("root", ...) replaces files, see sink.py.
    """

    @classmethod
    def name(cls) -> str:
        return "textloom_files"

    def schema(self) -> str:
        return "path string, size bigint, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        split = lambda k, none: tuple(o[k].split(",")) if k in o else none
        rules = Discovery(
            split("include", INCLUDE), split("extend_include", ()), split("exclude", None), split("extend_exclude", ()),
            o.get("respect_gitignore", "true") == "true", o.get("force_exclude", "false") == "true", int(o.get("max_size", MAX_SIZE)),
        )
        kind = _PushedReader if o.get("pushdown", "false") == "true" else _Reader
        return kind(rules, o["paths"].split(os.pathsep), int(o.get("slices", "64")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return FileSink(o["root"], o.get("backup", "true") == "true", schema.fieldNames())


def scan_files(spark: SparkSession, *paths: str, **options: str) -> DataFrame:
    """The files under paths by the data source, with conditions on path and size pushed into the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextFiles)
    return spark.read.format("textloom_files").options(pushdown="true", paths=os.pathsep.join(map(str, paths)), **options).load()


def read_texts(spark: SparkSession, path: str, glob: str = "*.md", max_size: int = MAX_SIZE) -> DataFrame:
    """(path, size, text) by Spark's reader, wherever the files are. Names that begin with . or _ don't count there."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    out = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    return out.where(F.col("size") <= max_size) if max_size else out
