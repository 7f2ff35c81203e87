"""Trees listed by tasks, kinds by first bytes, changed files."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from siftstone.sources import files, listing

FILES = {
    "a.txt": b"hello",
    "sub/b.py": b"x = 1",
    "sub/c.log": b"log",
    "sub/deep/er/d.md": b"deep",
    "big.md": b"y" * 5000,
    "empty.txt": b"",
    "empty.log": b"",
    "node_modules/d.js": b"z",
    "sub/node_modules/x/y.js": b"z",
    "pic.PNG": b"\x89PNG....",
    "noext": b"?",
    "page": b"\n <!DOCTYPE html><p>x",
    "run": b"#!/bin/sh\n",
    "feed": b"<?xml version='1.0'?>",
    "photo": b"\xff\xd8\xff\xe0",
    "out/gen/one.txt": b"1",
    "outer/two.txt": b"2",
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    os.symlink(tmp_path / "in" / "a.txt", tmp_path / "in" / "link.txt")
    os.symlink(tmp_path / "in", tmp_path / "in" / "loop")
    return str(tmp_path / "in")


PATTERNS = ["*.log", "node_modules", "out/**"]


@pytest.mark.parametrize("driver", [False, True])
def test_tree(spark, folder, monkeypatch, driver):
    if driver:
        monkeypatch.setattr(listing, "_reachable", lambda path: False)
        monkeypatch.setattr(listing, "CHUNK", 3)
        os.remove(f"{folder}/link.txt")  # the JVM's local file system follows links; the stores that the driver lists have none
        os.remove(f"{folder}/loop")
    rows = listing.tree(spark, folder, PATTERNS).collect()
    assert sorted(r["relative"] for r in rows if r["folder"] and r["ignored"]) == ["node_modules", "out", "outer", "sub/node_modules"]
    assert not [r for r in rows if "node_modules/" in r["relative"] or r["relative"].startswith("out/")]  # never entered
    found, skipped = listing.discover_tree(spark, folder, 1000, ["text"], PATTERNS)
    names = {r["relative"]: r["kind"] for r in found.collect()}
    assert names == {n: "text" for n in ("a.txt", "sub/b.py", "sub/deep/er/d.md", "page", "run", "feed")}
    assert {r["reason"]: r["n"] for r in skipped.collect()} == {"too large": 1, "empty": 2, "ignored": 1, "ignored folder": 4, "unknown kind": 1, "other kind": 2}


def test_links_are_passed_over(spark, folder):
    assert not [r for r in listing.tree(spark, folder).collect() if r["relative"].startswith(("link", "loop"))]


def test_no_patterns_and_all_kinds(spark, folder):
    found, skipped = listing.discover_tree(spark, folder)
    assert found.count() == len(FILES) - 3 and {r["reason"]: r["n"] for r in skipped.collect()} == {"empty": 2, "unknown kind": 1}
    assert listing.discover_tree(spark, folder, kinds=["all"])[0].count() == found.count()
    images = listing.discover_tree(spark, folder, kinds=["image"])[0].collect()
    assert sorted(r["relative"] for r in images) == ["photo", "pic.PNG"]


def test_one_file_and_none(spark, folder):
    found, skipped = listing.discover_tree(spark, f"{folder}/a.txt")
    assert [(r["relative"], r["size"]) for r in found.collect()] == [("a.txt", 5)] and skipped.count() == 0
    assert listing.discover_tree(spark, f"{folder}/a.txt", patterns=["a.txt"])[0].count() == 0
    with pytest.raises(FileNotFoundError):
        listing.tree(spark, f"{folder}/missing")
    os.mkdir(f"{folder}/nothing")
    assert listing.tree(spark, f"{folder}/nothing").count() == 0


def test_content(spark, folder):
    found = listing.discover_tree(spark, folder, 1000, ["text"], PATTERNS)[0]
    lost = found.limit(1).withColumn("path", F.lit(f"{folder}/lost"))
    rows = {r["path"]: r for r in listing.with_content(found.unionByName(lost), 4).collect()}
    assert bytes(rows[f"{folder}/a.txt"]["content"]) == b"hell" and rows[f"{folder}/a.txt"]["error"] is None
    assert rows[f"{folder}/lost"]["content"] is None and "lost" in rows[f"{folder}/lost"]["error"]


@pytest.mark.parametrize("pattern, path, want", [("src/**", "src", True), ("src/**", "srcs", True), ("src/**/x", "src", False), ("*.js", "a.js", False), ("build/", "a/build", True), ("build", "build", True), ("**", "any", True), ("**/x", "x", False)])
def test_folders_that_need_not_be_entered(spark, pattern, path, want):
    assert spark.range(1).select(listing.ignored_folder(F.lit(path), [pattern])).first()[0] is want


def test_halves_of_patterns(spark):
    test = lambda path, p: spark.range(1).select(files.ignored(F.lit(path), [p])).first()[0]
    assert test("src/a/x.py", "src/**/x.py") and test("srcs/x.py", "src/**/x.py") and not test("lib/x.py", "src/**/x.py") and not test("a/b", "a**b**c")


def test_changed_files(spark):
    rows = spark.createDataFrame([("file:/r/a/b.py",), ("file:/r/b.py",), ("file:/r/x/a/b.py",), ("file:/q/b.py",)], "path string")
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert names(files.changed_files(rows, ["a/b.py"])) == ["file:/r/a/b.py", "file:/r/x/a/b.py"]
    assert names(files.changed_files(rows, ["./a//b.py", "", "b.py", "b.py"], "file:/r/")) == ["file:/r/a/b.py", "file:/r/b.py"]
    assert names(files.changed_files(rows, [])) == [] and names(files.changed_files(rows, spark.createDataFrame([(None,)], "p string"))) == []


def test_a_million_changed_paths(spark):
    rows = spark.range(2000).select(F.concat(F.lit("file:/r/d/"), F.col("id").cast("string"), F.lit(".py")).alias("path"))
    many = spark.range(1_000_000).select(F.concat(F.lit("d/"), (F.col("id") * 2).cast("string"), F.lit(".py")).alias("p"))
    for root in ("file:/r", None):
        got = files.changed_files(rows, many, root)
        assert got.count() == 1000 and "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
    assert files.changed_files(rows, [f"d/{k}.py" for k in range(5000)], "file:/r").count() == 2000


def test_changes_by_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for name in ("a.txt", "naïve name.txt", "gone.txt"):
        (tmp_path / name).write_text("1")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "naïve name.txt").write_text("2")
    os.remove(tmp_path / "gone.txt")
    paths = files.changed_paths(spark, str(tmp_path), "HEAD")
    assert sorted(r["value"] for r in paths.collect()) == ["gone.txt", "naïve name.txt"]
    found = listing.discover_tree(spark, str(tmp_path), patterns=[".git"])[0]
    assert [r["relative"] for r in files.changed_files(found, paths, str(tmp_path)).collect()] == ["naïve name.txt"]
    with pytest.raises(ValueError):
        files.changed_paths(spark, str(tmp_path), "no-such-commit")
