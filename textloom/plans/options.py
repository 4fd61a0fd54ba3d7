"""Options from three places: the command line, a configuration file, and presets."""

from __future__ import annotations

import tomllib
from dataclasses import fields, replace
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.formatting import AUTO, Format

#: The configuration files looked for in each folder, in this order. The last counts only with a section for this tool.
CONFIG_FILES = (".textloom.toml", "textloom.toml", "pyproject.toml")
SECTION = "textloom"
#: What --auto decides; a configuration file can't change it then. List spacing isn't among these.
LOCKED = ("semantic", "cleanups", "smartquotes", "ellipses")


def merge_options(cli: Column, config: Column, preset: Column, locked: Column) -> Column:
    """Said on the command line, else configured unless locked, else the preset."""
    return F.coalesce(cli, F.when(~locked, config), preset)


def find_config(start: Path) -> Path | None:
    """The nearest configuration file from start upwards."""
    for folder in [start, *start.parents]:
        for name in CONFIG_FILES:
            at = folder / name
            if at.is_file() and (name != "pyproject.toml" or SECTION in _read(at).get("tool", {})):
                return at
    return None


def _read(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text())
    except (tomllib.TOMLDecodeError, OSError, UnicodeDecodeError):
        return {}


def load_config(path: Path) -> tuple[dict, list[str]]:
    """(options, unknown keys). Sections are flattened by one level; dashes in names are underscores. A broken file has no options."""
    data = _read(path)
    if path.name == "pyproject.toml":
        data = data.get("tool", {}).get(SECTION, {})
    flat: dict = {}
    for k, v in data.items():
        flat.update(v if isinstance(v, dict) else {k: v})
    flat = {k.replace("-", "_"): v for k, v in flat.items()}
    known = {f.name for f in fields(Format)} | {"include", "extend_include", "exclude", "extend_exclude", "files_max_size", "respect_gitignore", "force_exclude"}
    return {k: v for k, v in flat.items() if k in known}, sorted(set(flat) - known)


def resolve_format(cli: dict, config: dict, auto: bool, preset: Format) -> Format:
    """The merged options; cli holds only what was said explicitly."""
    names = {f.name for f in fields(Format)}
    base = replace(AUTO, width=preset.width, list_spacing=preset.list_spacing) if auto else preset
    configured = {k: v for k, v in config.items() if k in names and not (auto and k in LOCKED)}
    return replace(base, **(configured | {k: v for k, v in cli.items() if k in names and v is not None}))


# Whole option sets as columns: a struct for each source, merged field by field by its schema.

#: Options and their types; the lists hold globs.
OPTION_TYPES = {
    "width": "int", "plaintext": "boolean", "semantic": "boolean", "cleanups": "boolean", "smartquotes": "boolean", "ellipses": "boolean", "list_spacing": "string",
    "extend_include": "array<string>", "exclude": "array<string>", "extend_exclude": "array<string>", "files_max_size": "bigint", "respect_gitignore": "boolean", "force_exclude": "boolean",
}


def config_entries(top: Column, sections: Column) -> Column:
    """array<struct<key, value>> of a configuration: top is map<string, string>, sections map<string, map<string, string>>; values are JSON. Sections are flattened by one level, and dashes in names are underscores."""
    none = F.expr("cast(array() as array<struct<key: string, value: string>>)")
    own = F.coalesce(F.map_entries(top), none)
    nested = F.coalesce(F.flatten(F.transform(F.map_values(sections), F.map_entries)), none)
    return F.transform(F.concat(own, nested), lambda e: F.struct(F.replace(e["key"], F.lit("-"), F.lit("_")).alias("key"), e["value"].alias("value")))


def unknown_keys(entries: Column) -> Column:
    known = F.array(*map(F.lit, OPTION_TYPES))
    return F.array_sort(F.array_distinct(F.filter(F.transform(entries, lambda e: e["key"]), lambda k: ~F.array_contains(known, k))))


def config_struct(entries: Column) -> Column:
    """A struct of all options; of a key that comes more than once, the last one's value. What isn't said, and what isn't of its option's type, is null."""

    def value(name: str, kind: str) -> Column:
        last = F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]
        return F.from_json(F.concat(F.lit('{"v":'), last, F.lit("}")), f"v {kind}")["v"].alias(name)

    return F.struct(*[value(n, k) for n, k in OPTION_TYPES.items()])


def merge_option_structs(cli: Column, config: Column, preset: Column, auto: Column) -> Column:
    """Field by field: said on the command line, else configured unless --auto locks it, else the preset."""
    return F.struct(*[F.coalesce(cli[n], F.when(~auto, config[n]) if n in LOCKED else config[n], preset[n]).alias(n) for n in OPTION_TYPES])
