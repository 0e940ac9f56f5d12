"""Delimited files, dated snapshots and the checkpoint folder."""

import gzip

import pytest
from pyspark.sql import functions as F

from biascomp.sources import files, snapshots


def test_count_matrix(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('"","Family","20C_Pooled.A1.A3.1","C1.T7_S1.1"\n"1","Cal, x",3,0\n"2","Oith",NA,7\n')
    got = sorted(tuple(r) for r in files.read_count_matrix(spark, str(path), "Family").collect())
    assert got == [("Cal, x", "20C_Pooled.A1.A3.1", 3), ("Oith", "C1.T7_S1.1", 7)]
    kept = files.read_count_matrix(spark, str(path), "Family", drop_zero=False)
    assert kept.count() == 4


def test_gzip_and_na(spark, tmp_path):
    path = tmp_path / "t.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("X,a,b\n1,NA,x\n2,2.5,NA\n")
    df = files.read_delimited(spark, str(path), "X int, a double, b string", drop=["X"])
    assert sorted(df.collect(), key=str) == sorted([(None, "x"), (2.5, None)], key=str)


def test_latin1_tsv(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_bytes("id\tname\n1\tcafé\n".encode("latin1"))
    assert files.read_tsv_latin1(spark, str(path)).collect()[0]["name"] == "café"


def test_latest_by_name_and_missing(frame):
    df = frame(
        [("predicted_og_18s_03_21_2024_s1_phy.csv", 1), ("predicted_og_18s_04_02_2023_s1_phy.csv", 2),
         ("predicted_og_coi_01_01_2020_s1_phy.csv", 3), ("predicted_og_18s_03_21_2024_s1_phy_nocollodaria.csv", 4)],
        "file_name string, v int",
    )
    named = snapshots.name_parts(df)
    got = {r.v for r in snapshots.latest(named, ["primer", "suffix", "variant"]).collect()}
    assert got == {1, 3, 4}
    state = {r.v: r.snapshot_state for r in snapshots.snapshot_state(named, ["primer", "suffix", "variant"]).collect()}
    assert state == {1: "current", 2: "past", 3: "current", 4: "current"}
    with pytest.raises(FileNotFoundError):
        snapshots.require_rows(named.where("v = 99"), "marker x")


def test_latest_by_change_time(spark, tmp_path):
    import os

    for i, name in enumerate(["a.csv", "b.csv"]):
        (tmp_path / name).write_text(f"v\n{i}\n")
        os.utime(tmp_path / name, (1_700_000_000 + i * 1000,) * 2)
    df = spark.read.option("header", True).csv(str(tmp_path))
    df = files.with_change_time(files.with_file_name(df))
    assert [r.file_name for r in snapshots.latest(df, [], "changed_at").collect()] == ["b.csv"]


def test_stamped_writes_append(spark, frame, tmp_path):
    df = frame([("a", 1), ("b", 2)], "k string, v int")
    out = str(tmp_path / "out")
    for day in ("2024-01-01", "2024-02-01"):
        files.write_stamped(df, out, F.lit(day).cast("date"), ["k"])
    back = spark.read.parquet(out)
    assert back.count() == 4
    newest = snapshots.latest(back, ["k"])
    assert {(r.k, str(r.snapshot_date)) for r in newest.collect()} == {("a", "2024-02-01"), ("b", "2024-02-01")}


def test_csv_sink_roundtrip(spark, frame, tmp_path):
    df = frame([("a", None), ("b", 2.5)], "k string, v double")
    files.write_delimited(df, str(tmp_path / "c"))
    assert sorted(files.read_delimited(spark, str(tmp_path / "c"), "k string, v double").collect()) == sorted(df.collect())


def test_newest_files_are_read_and_no_other(spark, tmp_path):
    """Superseded files hold no parquet at all, so reading one would end the job."""
    import os

    root = tmp_path / "takes"
    for take, key, age in ((1, "a", 0), (2, "a", 5), (1, "b", 9), (2, "b", 3)):
        spark.range(2).selectExpr(f"id + {take * 10} as v").coalesce(1).write.parquet(f"{root}/take={take}/k={key}")
        newest = (key, take) in {("a", 2), ("b", 1)}
        for f in (root / f"take={take}" / f"k={key}").glob("part-*"):
            if not newest:
                f.write_bytes(b"not parquet")
            os.utime(f, (1_700_000_000 + age,) * 2)
    df = snapshots.read_newest(spark, str(root), ["k"], ["take"], schema="v long, take int, k string")
    assert sorted((r.k, r.take, r.v) for r in df.collect()) == [("a", 2, 20), ("a", 2, 21), ("b", 1, 10), ("b", 1, 11)]
    assert len(df.inputFiles()) == 2
    # equally new versions: the one that sorts last; files without a time never
    listed = files.file_table(spark, str(root)).withColumn("changed_at", F.expr("if(k = 'a', null, timestamp '2024-01-01')"))
    assert {(r.k, r.take) for r in snapshots.newest_files(listed, ["k"], ["take"]).collect()} == {("b", 2)}
    with pytest.raises(FileNotFoundError):
        snapshots.read_newest(spark, str(root), ["k"], ["take"], pattern="*.csv")


def test_newest_by_the_date_in_the_name(spark, tmp_path):
    for name, v in (("predicted_og_18s_03_21_2024_s1_phy.csv", 1), ("predicted_og_18s_04_02_2023_s1_phy.csv", 2)):
        (tmp_path / name).write_text(f"X,v\n1,{v}\n2,NA\n")
    keys = ["primer", "suffix", "variant"]
    df = snapshots.read_newest(
        spark, str(tmp_path), keys, ["file_name"], "snapshot_date", "csv", "X int, v int", "predicted_og_*", snapshots.name_parts
    )
    assert sorted(df.collect(), key=str) == [(1, 1), (2, None)]


def _live(spark, path):
    return sorted(((r.k, r.v) for r in snapshots.read_live(spark, path, "v int, run string, k string").collect()), key=repr)


def test_a_run_that_dies_leaves_the_published_state(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        snapshots.read_live(spark, path)
    with pytest.raises(FileNotFoundError):
        snapshots.archived_files(spark, path)
    first = snapshots.publish(frame([("a", 1), ("b b", 2), (None, 3)], "k string, v int"), path, ["k"])
    before = _live(spark, path)
    assert set(before) == {("a", 1), ("b b", 2), (None, 3)}
    assert snapshots.archived_files(spark, path).count() == 0

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the data, before the manifest
        m.setattr(snapshots, "switch", dies)
        with pytest.raises(RuntimeError):
            snapshots.publish(frame([("a", 9), ("c", 9)], "k string, v int"), path, ["k"])
    assert _live(spark, path) == before
    assert {r.folder for r in snapshots.archived_files(spark, path).collect()} == {"k=a", "k=c"}
    (tmp_path / "p" / "live" / "version=2" / "_temporary").mkdir(parents=True)  # inside the manifest
    assert _live(spark, path) == before
    snapshots.publish(frame([("a", 5), ("d", 6)], "k string, v int"), path, ["k"])
    assert set(_live(spark, path)) == {("a", 5), ("b b", 2), (None, 3), ("d", 6)}
    past = snapshots.archived_files(spark, path)
    assert {r.folder for r in past.where(F.col("run") == first).collect()} == {"k=a"}


def test_publishing_without_keys(spark, frame, tmp_path):
    path = str(tmp_path / "p")
    for v in (1, 2):
        snapshots.publish(frame([(v,)], "v int"), path, [])
    assert [r.v for r in snapshots.read_live(spark, path).collect()] == [2]
    assert snapshots.archived_files(spark, path).select("run").distinct().count() == 1
