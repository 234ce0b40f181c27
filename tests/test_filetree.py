"""Filters pushed into the scan of a directory tree."""

import os
import re

import pytest
from pyspark.sql.datasource import EqualTo, IsNull, Not, StringStartsWith

from driftline.sources.filetree import FileTree, InputPartition, PushingReader, column_of, file_tree, holds


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k in range(120):
        folder = root / f"s{k % 4}" / f"t{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.txt").write_text("x" * k)
    (root / "s10").mkdir()
    (root / "s10" / "a b.txt").write_text("yy")
    os.symlink("0.txt", root / "s0" / "link")
    os.symlink("nowhere", root / "top")
    return str(root)


FILTERS = [
    "relative_path like 's1/%'", "relative_path like 's1%'", "relative_path = 's0/t0/0.txt'", "relative_path = 's0'", "size > 100", "size >= 100 and size < 110 and kind = 'File'", "target is null", "target is not null",
    "target = 'nowhere'", "not target = 'nowhere'", "target <> '0.txt'", "kind = 'Symlink' or size = 3", "relative_path like '%9.txt'", "relative_path like '%/t1/%'", "size in (1, 2, 55)", "not size in (1, 2)", "size % 7 = 0",
    "size <=> 5", "relative_path > 's2'", "size(xattrs) = 0 and size <= 4", "mode > 0 and uid >= 0", "false", "relative_path like 's1/%' and relative_path like 's2/%'",
]


@pytest.mark.parametrize("condition", FILTERS)
@pytest.mark.parametrize("splits", ["1", "64"])
def test_pushed_filters_give_the_same_rows(spark, tree, condition, splits):
    spark.dataSource.register(FileTree)
    plain = spark.createDataFrame(spark.read.format("filetree").option("root", tree).load().collect(), FileTree({}).schema())
    assert plain.count() == 123
    key = lambda df: sorted((r["relative_path"], r["kind"], r["size"], r["target"]) for r in df.filter(condition).collect())
    assert key(file_tree(spark, tree, splits=splits)) == key(plain)


def test_filters_stand_in_the_scan(spark, tree):
    above = lambda condition: re.search(r"\bFilter [(i]", file_tree(spark, tree).filter(condition)._jdf.queryExecution().executedPlan().toString())
    assert not above("relative_path like 's1/%' and size > 100") and above("size % 7 = 0")


def test_folders_ruled_out_are_not_opened(tree, monkeypatch):
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(os.path.relpath(path, tree)) or scandir(path))
    reader = PushingReader({"root": tree})
    assert list(reader.pushFilters([StringStartsWith(("relative_path",), "s1/t2/"), EqualTo(("xattrs",), [])])) == [EqualTo(("xattrs",), [])]
    got = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(0).to_pylist()]
    assert got and all(p.startswith("s1/t2/") for p in got) and set(opened) == {".", "s1", "s1/t2"}
    assert list(reader.read(InputPartition(None))) == []


def test_comparisons_with_null():
    equal = EqualTo(("target",), "a")
    assert not holds(equal, None) and not holds(Not(equal), None) and holds(Not(equal), "b") and holds(IsNull(("target",)), None)
    assert column_of(Not(equal)) == "target" and column_of(Not(IsNull(("target",)))) is None and column_of(EqualTo(("a", "b"), 1)) is None


def test_a_tree_of_more_than_a_batch(spark, tmp_path):
    for k in range(5000):
        (tmp_path / str(k)).touch()
    assert file_tree(spark, str(tmp_path)).filter("relative_path <> '7'").count() == 4999
    assert file_tree(spark, str(tmp_path / "none")).filter("size > 1").collect() == []
