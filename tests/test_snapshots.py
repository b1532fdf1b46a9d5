"""Snapshots of an index: saving over what was loaded, failures on the way, readers meanwhile; refreshes by differences."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files, snapshots
from corpusloom.tools import Store

WORDS = "green tea leaves are picked by hand in early spring and dried quickly to keep their fresh colour and scent "


def ids(df):
    return sorted(r[0] for r in df.select("library_id").collect())


def test_written_over_itself(spark, tmp_path):
    path = str(tmp_path / "i")
    assert files.load(spark, path) is None
    files.save(spark, {"t": spark.createDataFrame([("1e5", 1), ("007", 2)], "library_id string, n int")}, path)
    for k in range(4):  # each save reads what the one before wrote
        now = files.load(spark, path)["t"]
        files.save(spark, {"t": now.unionByName(spark.createDataFrame([(f"x{k}", k)], "library_id string, n int"))}, path)
    got = files.load(spark, path)["t"]
    assert ids(got) == ["007", "1e5", "x0", "x1", "x2", "x3"] and got.columns == ["library_id", "n"]
    assert len(snapshots._Files(spark, path).names(f"{path}/data")) == snapshots.KEPT == len(snapshots._Files(spark, path).names(f"{path}/manifests"))


def test_failure_between_two_tables_keeps_the_last_snapshot(spark, tmp_path):
    path = str(tmp_path / "i")
    a = spark.createDataFrame([("a", 1)], "library_id string, n int")
    files.save(spark, {"t": a, "u": a}, path)
    broken = a.withColumn("n", F.raise_error("no").cast("int"))
    with pytest.raises(Exception, match="no"):
        files.save(spark, {"t": a.union(a), "u": broken}, path)
    got = files.load(spark, path)
    assert got["t"].count() == 1 and got["u"].count() == 1
    assert snapshots.sweep(spark, path) == 0 and snapshots.sweep(spark, path, older=-5) == 1  # only what is old is swept
    assert files.load(spark, path)["t"].count() == 1


def test_reader_keeps_its_snapshot(spark, tmp_path):
    path = str(tmp_path / "i")
    files.save(spark, {"t": spark.createDataFrame([("a",)], "library_id string")}, path)
    reader = files.load(spark, path)["t"]
    files.save(spark, {"t": spark.createDataFrame([("b",)], "library_id string")}, path)
    assert ids(reader) == ["a"] and ids(files.load(spark, path)["t"]) == ["b"]


def test_other_versions_and_half_manifests(spark, tmp_path):
    path = str(tmp_path / "i")
    snapshots.commit(spark, path, {"t": spark.range(1)}, version=99)
    assert files.load(spark, path) is None and Store(spark).load_index(path) == (0, 0)
    (tmp_path / "i" / "manifests" / "_000000000009-half.json").write_text("{")
    assert snapshots.newest(spark, path)[0] == 99


def scores(store, query):
    return sorted((r.file_name, r.position, r.bm25, r.ngram, r.total) for r in store.search(query, 50).collect())


def library(tmp_path, n=12):
    d = tmp_path / "lib"
    d.mkdir()
    for k in range(n):
        (d / f"f{k}.md").write_text(f"# Part {k}\n" + WORDS * 3 + f" special{k} words about number {k} " * 5)
    (d / "tiny.txt").write_text("short")
    return d


def test_load_add_save_load(spark, tmp_path):
    d, path = library(tmp_path, 3), str(tmp_path / "index")
    one = Store(spark)
    one.add_library("One", str(d))
    one.save_index(path)
    two = Store(spark)
    assert two.load_index(path) == (1, 0)
    other = tmp_path / "other"
    other.mkdir()
    (other / "o.md").write_text(WORDS * 4)
    two.add_library("Two", str(other))
    two.save_index(path)  # over what it was loaded from
    three = Store(spark)
    assert three.load_index(path) == (2, 0) and sorted(r["name"] for r in three.libraries()) == ["One", "Two"]
    assert scores(three, "green tea special1") == scores(two, "green tea special1") and len(scores(one, "green tea special1")) == 3
    assert {r.file_type: r.files for r in three.file_types(three.by_name("One")["library_id"]).collect()} == {"md": 3}
    with pytest.raises(ValueError):
        Store(spark).save_index(path)


def test_refresh_reads_only_what_changed(spark, tmp_path, monkeypatch):
    d = library(tmp_path)
    s = Store(spark)
    key = s.add_library("L", str(d))
    assert scores(s, "special3 tea") and s.refresh_library(key) == {}
    opened = []
    ingest = files.ingest
    monkeypatch.setattr("corpusloom.tools.S.ingest", lambda *a, **k: opened.append(sorted(x.rsplit("/", 1)[-1] for x in k["only"])) or ingest(*a, **k))
    (d / "f3.md").write_text("# New\n" + WORDS * 2 + " other words here entirely " * 20)
    (d / "f4.md").unlink()
    (d / "new.md").write_text("# Fresh\n" + WORDS * 6 + " special3 ")
    assert s.refresh_library(key) == {"modified": 1, "deleted": 1, "added": 1} and opened == [["f3.md", "new.md"]]
    monkeypatch.undo()
    again = Store(spark)
    again.add_library("L", str(d))
    assert scores(s, "special3 tea") == scores(again, "special3 tea") and s.stats() == again.stats()
    assert s.check_changes(key).count() == 0 and s.refresh_library(key) == {}
    monkeypatch.setattr("corpusloom.tools.MOST_DELTAS", 2)  # the next difference writes the tables anew
    monkeypatch.setattr("corpusloom.tools.MOST_NAMED", 0)  # and reads the folder as a whole
    (d / "f5.md").write_text(WORDS * 9)
    assert s.refresh_library(key) == {"modified": 1} and s.deltas[key] == 0
    monkeypatch.undo()
    again.refresh_library(again.by_name("L")["library_id"])
    assert scores(s, "special3 tea") == scores(again, "special3 tea")
    s.save_index(str(tmp_path / "index"))
    t = Store(spark)
    t.load_index(str(tmp_path / "index"))
    assert t.refresh_library(key) == {} and scores(t, "special3 tea") == scores(s, "special3 tea")
