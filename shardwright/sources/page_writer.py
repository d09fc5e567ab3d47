"""Pages written by the tasks that hold them. `df.write.format("pages").mode("append").save(root)` for (rel, text) rows.

Tasks write below a staging folder of the job's own beside the pages; the commit renames every file into place, so readers
see a page's old or its new bytes, never a part. A task that fails, and a job that does, leaves nothing: staging goes, and
pages that are in place stay as they were. The root is a folder that the driver and all executors have mounted.

Defined cases: texts are written as they are (UTF-8, no line ends changed), null texts as empty files; mode overwrite also
deletes files of the same suffix that the job didn't write; the same rel in two rows, a null or absolute rel and one that
leads out of the root fail the job; no rows, no change (overwrite: no pages)."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = ".pages-"


@dataclass
class _Done(WriterCommitMessage):
    """A task's own folder in the staging folder: what it holds is listed when the job commits."""

    folder: str


class DuplicatePage(ValueError):
    """Two rows have one path."""


def _place(root: str, rel: str | None) -> str:
    if not rel or os.path.isabs(rel) or ".." in rel.split("/"):
        raise ValueError(f"no path below the root: {rel!r}")
    return os.path.join(root, rel)


def _files(folder: str) -> Iterator[str]:
    for base, _, names in os.walk(folder):
        for n in names:
            yield os.path.relpath(os.path.join(base, n), folder)


class _PageWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool, suffix: str):
        self.root, self.overwrite, self.suffix = root, overwrite, suffix
        self.staging = os.path.join(root, STAGING + uuid.uuid4().hex)

    def write(self, rows: Iterator) -> _Done:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(folder)
        try:
            for row in rows:
                path = _place(folder, row["rel"])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "xb") as f:
                    f.write((row["text"] or "").encode())
        except FileExistsError as e:
            raise DuplicatePage(str(e)) from e
        return _Done(folder)

    def commit(self, messages: list[_Done | None]) -> None:
        try:
            folders = [m.folder for m in messages if m]
            seen: dict[str, str] = {}
            for folder in folders:
                for rel in _files(folder):
                    if rel in seen:
                        raise DuplicatePage(rel)
                    seen[rel] = folder
            for rel, folder in seen.items():
                path = os.path.join(self.root, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                os.replace(os.path.join(folder, rel), path)
            if self.overwrite:
                staging = os.path.basename(self.staging)
                for rel in list(_files(self.root)):
                    if rel.endswith(self.suffix) and rel not in seen and not rel.startswith(staging):
                        os.remove(os.path.join(self.root, rel))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[_Done | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "rel string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PageWriter(self.options["path"], overwrite, self.options.get("suffix", ".md"))


def write_pages(pages: DataFrame, root: str, overwrite: bool = False, suffix: str = ".md") -> None:
    """pages: (rel, text), each written below root by the task that holds it."""
    os.makedirs(root, exist_ok=True)
    pages.sparkSession.dataSource.register(PagesSource)
    out = pages.select("rel", "text").write.format("pages").option("suffix", suffix)
    out.mode("overwrite" if overwrite else "append").save(root)
