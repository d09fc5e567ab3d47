"""Pages written by tasks, results kept by batch, views from their file, scans that fail closed."""

from __future__ import annotations

import json
import os
import socket

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardwright.__main__ import main
from shardwright.operators import views
from shardwright.sources import exports
from shardwright.sources.page_writer import write_pages
from shardwright.sources.vault import read_vault


def tree(root):
    return {os.path.relpath(os.path.join(b, n), root): open(os.path.join(b, n), "rb").read() for b, _, names in os.walk(root) for n in names}


def test_ten_thousand_pages_from_tasks(spark, tmp_path):
    root = str(tmp_path / "vault")
    df = spark.range(10_000).select(F.concat(F.lit("c"), F.col("id") % 7, F.lit("/p"), "id", F.lit(".md")).alias("rel"), F.concat(F.lit("text\r\né "), "id").alias("text")).repartition(6)
    write_pages(df, root)
    found = tree(root)
    assert len(found) == 10_000 and found["c3/p3.md"] == "text\r\né 3".encode()
    write_pages(spark.createDataFrame([("c3/p3.md", None), ("new.md", "x")], "rel string, text string"), root)
    found = tree(root)
    assert len(found) == 10_001 and found["c3/p3.md"] == b"" and found["new.md"] == b"x"
    assert read_vault(spark, root).count() == 10_001
    write_pages(spark.createDataFrame([("new.md", "y")], "rel string, text string"), root, overwrite=True)
    assert tree(root) == {"new.md": b"y"}
    write_pages(df.limit(0), root)
    assert tree(root) == {"new.md": b"y"}


def test_failed_jobs_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "vault")
    write_pages(spark.createDataFrame([("a.md", "old")], "rel string, text string"), root)
    good = spark.range(100).select(F.concat(F.lit("p"), "id", F.lit(".md")).alias("rel"), F.lit("t").alias("text"))
    breaks = spark.range(1).select(F.lit("z.md").alias("rel"), F.when(F.rand() < 2, F.raise_error(F.lit("broken"))).cast("string").alias("text"))
    for rows in (breaks, *(spark.createDataFrame([(rel, "t")], "rel string, text string") for rel in ("../out.md", "/abs.md", None, "p5.md"))):
        with pytest.raises(PySparkException):
            write_pages(good.unionByName(rows).unionByName(spark.createDataFrame([("a.md", "new")], "rel string, text string")), root, overwrite=True)
        assert tree(root) == {"a.md": b"old"} and os.listdir(tmp_path) == ["vault"]


def test_results_once_after_a_crash(spark, tmp_path):
    """The driver dies between a batch's write and its commit: the batch is run again, its results are there once."""
    schema = "id string, answer string"
    items, out, check = (str(tmp_path / x) for x in ("items", "out", "check"))
    os.makedirs(items)
    for i in range(3):
        with open(f"{items}/{i}.json", "w") as f:
            f.write("".join(json.dumps({"id": f"t{i}-{j}", "answer": "x"}) + "\n" for j in range(2)))
    runs = []

    def run(df):
        runs.append(df.count())
        return df.withColumn("answer", F.concat("answer", F.lit(str(len(runs)))))

    exports.checkpoint_results(exports.result_stream(spark, items, schema), out, check, run).awaitTermination()
    assert runs == [2, 2, 2] and exports.kept_results(spark, out, schema).count() == 6
    os.remove(f"{check}/commits/2")  # what a crash after the write looks like
    for f in (f"{check}/commits/.2.crc",):
        if os.path.exists(f):
            os.remove(f)
    exports.checkpoint_results(exports.result_stream(spark, items, schema), out, check, run).awaitTermination()
    kept = exports.kept_results(spark, out, schema).collect()
    assert runs == [2, 2, 2, 2] and sorted(r["id"] for r in kept) == [f"t{i}-{j}" for i in range(3) for j in range(2)]
    assert {r["answer"] for r in kept if r["batch"] == 2} == {"x4"}


FILE = """# a comment
views:
  - type: table
    name: All
    order:
      - file.name
      - type
    sort: []
    columns:
      - property: title
  - type: table
    name: "Open: tasks"
    filter:
      - type: is
        property: type
        valueType: text
        value: task
      - type: isNot
        property: status
        value: 'resolved'
    sort:
      - property: title
        direction: desc
    columns:
      - property: file.name
      - property: title
  - type: table
    name: Order only
    filter:
    - type: isEmpty
      property: area
    order:
    - type
"""


def test_views_from_a_file(spark):
    rows = [("a", "task", "A", "active", "x"), ("b", "task", "B", "resolved", None), ("c", "task", "C", None, ""), ("d", "gotcha", "D", "active", "y")]
    df = spark.createDataFrame(rows, "stem string, type string, title string, status string, area string")
    every = {v.name: v for v in views.parse_views(FILE)}
    assert list(every) == ["All", "Open: tasks", "Order only"]
    shown = lambda n: [tuple(r) for r in views.compiled(every[n], df).collect()]
    assert sorted(shown("All")) == [("A",), ("B",), ("C",), ("D",)]
    assert shown("Open: tasks") == [("c", "C"), ("a", "A")]
    assert shown("Order only") == [("task",), ("task",)]
    assert views.parse_views("# nothing\n") == []


@pytest.mark.parametrize("change", [("type: isNot", "type: near"), ("valueType: text", "valueType: number"), ("    name: All", "    group: All"), ("type: table\n    name: All", "type: cards\n    name: All"), ("views:", "tables:"), ("  - type: table\n    name: Order", "   x\n  - type: table\n    name: Order")])
def test_unknown_syntax_is_an_error(spark, change):
    assert change[0] in FILE
    with pytest.raises(views.ViewError):
        views.parse_views(FILE.replace(*change))


def test_unknown_property_is_an_error(spark):
    with pytest.raises(views.ViewError):
        views.compiled(views.View("v", [("is", "nope", "x")], ["type"]), spark.createDataFrame([("a",)], "type string"))


def test_scan_of_what_cannot_be_read(spark, tmp_path, capsys):
    (tmp_path / "fine.txt").write_text("nothing here\n")
    os.symlink("gone", tmp_path / "dangling")
    assert main(["scan"], spark, {"KB_ROOT": str(tmp_path)}) == 0
    with socket.socket(socket.AF_UNIX) as s:
        s.bind(str(tmp_path / "unreadable"))
        assert main(["scan"], spark, {"KB_ROOT": str(tmp_path)}) == 2
