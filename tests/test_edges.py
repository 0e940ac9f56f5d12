"""Missing values, repeated writes and bounded forms of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from biascomp.operators import compare, ordered, particles, reshape, stats
from biascomp.session import shared_folder
from biascomp.sources import files

NAN = float("nan")


def test_nan_is_missing(frame):
    df = frame([("a", 1.0), ("a", 2.0), ("a", NAN), ("a", None), ("b", NAN)], "g string, v double")
    assert ordered.median(df, ["g"], "v").collect() == [("a", 1.5)]
    assert {tuple(r) for r in ordered.ecdf(df, ["g"], "v").collect()} == {("a", 1.0, 0.5), ("a", 2.0, 1.0)}
    got = ordered.quantiles(df, ["g"], "v", {}, mean="m", count="n").collect()
    assert got == [("a", 1.5, 2)]
    assert sum(r.n for r in stats.histogram(df, ["g"], "v", 2).collect()) == 2


def test_bin_width_counts_known_values(frame):
    df = frame([("a", float(v)) for v in range(8)] + [("a", None), ("b", 1.0)], "g string, v double")
    got = {r.g: r.bin_width for r in stats.bin_width_fd(df, ["g"], "v").collect()}
    assert got["a"] == pytest.approx(2 * 3.5 / 2) and got["b"] == stats.FALLBACK_BIN_WIDTH


def test_group_middle_names_its_place(frame):
    df = frame([("a", 3), ("a", 1), ("a", 2), ("a", 4), ("b", 7)], "g string, v int")
    assert {tuple(r) for r in ordered.group_middle(df, ["g"], ["v"]).select("g", "v", "rank").collect()} == {("a", 3, 3), ("b", 7, 1)}


def test_stamped_write_twice(spark, frame):
    import uuid

    path = f"{shared_folder(spark)}/stamped-{uuid.uuid4().hex}"
    df = frame([("x", 1), ("y", 2)], "k string, v int")
    for day in ("2024-01-01", "2024-01-01", "2024-01-02"):
        files.write_stamped(df, path, F.lit(day).cast("date"), ["k"])
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("by", [[], ["g"]])
def test_bounded_corrections_agree(frame, by):
    rows = [("a", i, p) for i, p in enumerate([0.01, 0.04, 0.04, None, 0.9])] + [("b", 9, 0.2)]
    df = frame(rows, "g string, i int, p double")
    key = lambda out: sorted((r.g, r.i, r.p_bonferroni or -1, r.p_bh or -1) for r in out.collect())
    plain, bounded = (key(stats.p_adjust(df, "p", ["i"], by, bounded=b)) for b in (False, True))
    assert [x[:2] for x in plain] == [x[:2] for x in bounded] and len(plain) == len(rows)
    assert all(math.isclose(a, b) for x, y in zip(plain, bounded) for a, b in zip(x[2:], y[2:]))


def test_lump_outside_two_lists(frame):
    rows = [("s", "a", 9, 0.1), ("s", "b", 1, 0.9), ("s", "c", 2, 0.2), ("t", "c", 1, 0.1), ("t", None, 1, 0.0)]
    df = frame(rows, "g string, k string, n int, w double")
    got = {(r.g, r.k): r.n for r in ordered.lump_outside_top(df, "k", ["n", "w"], 1, ["g"]).collect()}
    assert got == {("s", "a"): 9, ("s", "b"): 1, ("s", "Other"): 2, ("t", "Other"): 2}


def test_median_errors_of_both_methods(frame):
    df = frame([("a", 1.0, 5.0), ("a", 3.0, 7.0), ("b", None, 2.0)], "g string, se_corrected double, se_raw double")
    got = {r.g: (r.median_se_corrected, r.median_se_raw) for r in compare.median_errors(df, ["g"]).collect()}
    assert got == {"a": (2.0, 6.0), "b": (None, 2.0)}


def test_design_long_lists_every_level(frame):
    df = frame([("o1", "s1", 30), ("o1", "s1", 30), ("o2", "Calibration", 20)], "o string, s string, c int")
    got = {tuple(r) for r in reshape.design_long(df, ["o"], "s", "c").collect()}
    assert got == {("o1", "s1", 1.0), ("o1", "c", 30.0), ("o2", "Calibration", 1.0), ("o2", "c", 20.0)}


def test_pixel_size_of_each_object(frame):
    cols = ["feret_px", "major_px", "minor_px", "area_px", "area_exc_px", "sub_part", "tot_vol", "depth_max"]
    df = frame([(10.0,) * len(cols) + (p,) for p in (0.1, 0.2, None)], ", ".join(f"{c} double" for c in [*cols, "px"]))
    got = [(r.feret_mm, r.area_mm2) for r in particles.geometry(df, "px").orderBy("px").collect()]
    assert got[0] == (None, None)
    assert got[1:] == [(pytest.approx(1.0), pytest.approx(0.1)), (pytest.approx(2.0), pytest.approx(0.4))]
