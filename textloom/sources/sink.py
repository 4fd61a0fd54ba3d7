"""Replacing files from tasks, all or none: staged first, journalled, then moved into place.

Tasks write their texts under a staging folder below `root`, each with a manifest; nothing that exists is touched. When all have succeeded, the driver writes a journal of their manifests, which decides:
from then on the job is done, even if the machine stops, as `recover` carries a journal out. Before it, `abort` and `recover` throw the staging folder away. Carrying out moves
a file to its `.orig` and the staged one into its place; each move is atomic, and repeating them does no harm. Attempts that didn't succeed aren't in the journal.

root has to be a folder that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

STAGING = ".textloom-staging"


@dataclass
class Staged(WriterCommitMessage):
    manifest: str
    files: int


def _write(at: Path, data: bytes) -> None:
    with at.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


class FileSink(DataSourceWriter):
    """df.write.format("textloom_files").option("root", folder).mode("append").save(): rows (path, text), paths absolute or relative to root. Of rows with one path, one is kept."""

    def __init__(self, root: str, backup: bool, columns: list[str]):
        missing = {"path", "text"} - set(columns)
        if missing:
            raise ValueError(f"to write files, rows need the columns {', '.join(sorted(missing))}")
        self.root, self.backup = str(Path(root).resolve()), backup
        self.job = f"{self.root}/{STAGING}/{uuid.uuid4().hex}"

    def target(self, path: str | None) -> str:
        """Where a path leads; an error where that is outside of root, a folder, or among the staged files."""
        if not path:
            raise ValueError("a row without a path can't be written")
        at = Path(os.path.normpath(os.path.join(self.root, path)))
        if Path(self.root) not in at.parents or STAGING in at.relative_to(self.root).parts:
            raise ValueError(f"{path} is outside of {self.root}")
        if at.is_dir():
            raise IsADirectoryError(str(at))
        return str(at)

    def write(self, iterator) -> Staged:
        own = Path(self.job) / uuid.uuid4().hex
        own.mkdir(parents=True)
        n = 0
        with (own / "manifest").open("w") as manifest:
            for row in iterator:
                to = self.target(row["path"])
                if row["text"] is None:
                    raise ValueError(f"{row['path']} has no text")
                _write(own / str(n), row["text"].encode())
                manifest.write(json.dumps([str(own / str(n)), to]) + "\n")
                n += 1
            manifest.flush()
            os.fsync(manifest.fileno())
        return Staged(str(own / "manifest"), n)

    def commit(self, messages) -> None:
        job = Path(self.job)
        if not job.exists():
            return
        _write(job / "journal.new", json.dumps({"backup": self.backup, "manifests": [m.manifest for m in messages if m is not None]}).encode())
        os.replace(job / "journal.new", job / "journal")
        carry_out(job)

    def abort(self, messages) -> None:
        shutil.rmtree(self.job, ignore_errors=True)
        _drop_empty(Path(self.job).parent)


def _drop_empty(at: Path) -> None:
    try:
        at.rmdir()
    except OSError:
        pass


def carry_out(job: Path) -> None:
    """Do what a journal says, or what is left of it."""
    journal = json.loads((job / "journal").read_text())
    for name in journal["manifests"]:
        with open(name) as lines:
            for line in lines:
                staged, to = json.loads(line)
                if not os.path.exists(staged):
                    continue  # done before
                os.makedirs(os.path.dirname(to), exist_ok=True)
                if journal["backup"] and os.path.exists(to):
                    os.replace(to, to + ".orig")
                os.replace(staged, to)
    shutil.rmtree(job)
    _drop_empty(job.parent)


def recover(root: str) -> tuple[int, int]:
    """Finish jobs that were decided and throw the others away; (finished, thrown away). Not for a root that a job is writing to."""
    done = gone = 0
    for job in sorted(Path(root).glob(f"{STAGING}/*")):
        if (job / "journal").exists():
            carry_out(job)
            done += 1
        else:
            shutil.rmtree(job)
            gone += 1
    _drop_empty(Path(root) / STAGING)
    return done, gone
