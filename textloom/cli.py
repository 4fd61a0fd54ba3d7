"""Command line: format, check or list text files. Exit codes: 0 done, 1 changes found by --check or a failure, 2 wrong usage."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from pathlib import Path

import textloom
from textloom.functions.formatting import FILES, reformat
from textloom.plans.options import find_config, load_config, resolve_format
from textloom.sources.files import Discovery, Resolver, needs_resolving


VERSION = "textloom 0.2.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description="Format Markdown and plain text.")
    p.add_argument("files", nargs="*", help="files, folders or globs; - is standard input")
    p.add_argument("-o", "--output", default="-")
    p.add_argument("-w", "--width", type=int)
    for flag, name in (("-p", "plaintext"), ("-s", "semantic"), ("-c", "cleanups")):
        p.add_argument(flag, f"--{name}", action="store_const", const=True)
    for name in ("smartquotes", "ellipses"):
        p.add_argument(f"--{name}", action="store_const", const=True)
    p.add_argument("--list-spacing", choices=("preserve", "loose", "tight"))
    for name in ("inplace", "nobackup", "auto", "check", "list-files", "force-exclude", "no-respect-gitignore"):
        p.add_argument(f"--{name}", action="store_true")
    for name in ("extend-include", "exclude", "extend-exclude"):
        p.add_argument(f"--{name}", action="append")
    p.add_argument("--files-max-size", type=int)
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--docs", action="store_true", help="print what the engine does")
    return p


def write_whole(path: Path, text: str, backup: bool) -> None:
    """Never leaves half a file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", newline="") as f:
        f.write(text)
    if backup and path.exists():
        path.replace(path.with_name(path.name + ".orig"))
    os.replace(name, path)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.docs:
        print(textloom.__doc__, textloom.formatting_docs(), sep="\n\n")
        return 0
    inplace = a.inplace or a.auto
    files = a.files or ([] if a.auto or a.list_files else ["-"])
    if not files:
        print("Nothing to do: name files or folders.", file=sys.stderr)
        return 2
    config_path = find_config(Path.cwd())
    config, unknown = load_config(config_path) if config_path else ({}, [])
    for k in unknown:
        print(f"Unknown option in {config_path}: {k}", file=sys.stderr)
    options = resolve_format(vars(a), config, a.auto, FILES)
    rules = Discovery(
        extend_include=tuple(a.extend_include or config.get("extend_include", ())),
        exclude=tuple(a.exclude) if a.exclude else tuple(config["exclude"]) if "exclude" in config else None,
        extend_exclude=tuple(a.extend_exclude or config.get("extend_exclude", ())),
        respect_gitignore=not a.no_respect_gitignore and config.get("respect_gitignore", True),
        force_exclude=a.force_exclude or config.get("force_exclude", False),
        max_size=a.files_max_size if a.files_max_size is not None else config.get("files_max_size", Discovery.max_size),
    )
    try:
        named = [f for f in files if f != "-"]
        paths: list[Path | None] = [None] * ("-" in files) + (list(Resolver(rules).resolve(named)) if needs_resolving(named, rules) or a.list_files else [Path(f) for f in named])
        if a.list_files:
            print(*filter(None, paths), sep="\n")
            return 0
        if a.output != "-" and named:
            print("--output is for standard input; use --inplace for files.", file=sys.stderr)
            return 1
        changed, failed = [], False
        for p in paths:
            try:
                text = sys.stdin.read() if p is None else p.read_text()
            except UnicodeDecodeError as e:
                print(f"Error: {p or '-'}: {e}", file=sys.stderr)
                failed = True
                continue
            new = reformat(text, options)
            if new != text:
                changed.append(p or "-")
            if a.check:
                continue
            if p is not None and inplace:
                write_whole(p, new, not (a.nobackup or a.auto))
            elif a.output != "-":
                write_whole(Path(a.output), new, False)
            else:
                sys.stdout.write(new)
    except OSError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if a.check and changed:
        print(*(f"Would reformat: {p}" for p in changed), sep="\n", file=sys.stderr)
        return 1
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
