"""Data sources that list folders which all nodes have mounted, as Spark's file sources hide `_` and dot names. The
driver lists paths, tasks read files.

`vault` has pages: `_` names are pages too, dot names are not, line ends become \\n and bytes that are no UTF-8 are
dropped. `checkout` has every file of a working copy as bytes, dot names included, but for git's own folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "rel string, dir string, collection string, stem string, ord long, text string"


class _Part(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, suffix: str, per_part: int):
        self.root, self.suffix, self.per_part = root, suffix, per_part

    def listed(self) -> list[str]:
        rels = []
        for base, dirs, names in os.walk(self.root):
            dirs[:] = [d for d in dirs if not d.startswith(".")]
            rels += [os.path.relpath(os.path.join(base, n), self.root) for n in names if n.endswith(self.suffix) and not n.startswith(".")]
        return rels

    def partitions(self) -> list[InputPartition]:
        rels = list(enumerate(sorted(self.listed())))
        return [_Part(rels[i : i + self.per_part]) for i in range(0, len(rels), self.per_part)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for ord_, rel in partition.files:
            with open(os.path.join(self.root, rel), "rb") as f:
                text = f.read().decode("utf-8", "ignore")
            folder, name = os.path.split(rel)
            yield rel, folder, folder.split("/")[0], name.removesuffix(self.suffix), ord_, text.replace("\r\n", "\n").replace("\r", "\n")


class VaultSource(DataSource):
    """spark.read.format("vault").option("suffix", ".md").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".md"), int(self.options.get("filesPerPartition", "256")))


class _FileReader(_Reader):
    """(path, content) of all files, or names alone."""

    def __init__(self, root: str, per_part: int, contents: bool):
        super().__init__(root, "", per_part)
        self.contents = contents

    def listed(self) -> list[str]:
        rels = []
        for base, dirs, names in os.walk(self.root):
            dirs[:] = [d for d in dirs if d != ".git"]
            rels += [os.path.relpath(os.path.join(base, n), self.root) for n in names if n != ".git"]
        return rels

    def read(self, partition: _Part) -> Iterator[tuple]:
        for _, rel in partition.files:
            if not self.contents:
                yield rel, None
                continue
            try:
                with open(os.path.join(self.root, rel), "rb") as f:
                    content = f.read()
            except FileNotFoundError:  # a dangling link, or gone since it was listed; what can't be read is an error
                continue
            yield rel, content


class CheckoutSource(DataSource):
    """spark.read.format("checkout").option("contents", "true").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "checkout"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"], int(self.options.get("filesPerPartition", "256")), self.options.get("contents", "true") == "true")


class MissingVault(FileNotFoundError):
    """There is no such folder: gates exit with 2."""

    exit_code = 2


def read_vault(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    if not os.path.isdir(path):
        raise MissingVault(path)
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").option("suffix", suffix).load(path)


def read_checkout(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """(path, content) of every file below root, path relative to it; without contents they are null."""
    if not os.path.isdir(root):
        raise MissingVault(root)
    spark.dataSource.register(CheckoutSource)
    return spark.read.format("checkout").option("contents", str(contents).lower()).load(root)


def collection(files: DataFrame, name: str) -> DataFrame:
    """The pages of one collection that have a name, by path."""
    return files.where((files["dir"] == name) & (files["name"] != "")).orderBy("rel")


def lint_scope(files: DataFrame, collections: tuple[str, ...]) -> DataFrame:
    """Pages of the collections and the architecture page, which stands last."""
    return files.where(files["dir"].isin(*collections) | (files["rel"] == "architecture.md"))


def base_names(files: DataFrame, folder: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Sorted names of a folder's pages."""
    own = files.where((files["dir"] == folder) & ~files["stem"].isin(*leave_out)) if leave_out else files.where(files["dir"] == folder)
    return own.select("stem").orderBy("stem")
