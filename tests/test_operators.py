"""Hand-made frames for the cases in which the obvious reading is wrong, and invariants."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from biascomp.functions import numeric, text
from biascomp.operators import compare, composition, filters, groups, ordered, particles, reshape, stats, taxonomy


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    "t,df,p",
    [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (3.646, 30, 0.001), (1.984, 100, 0.05)],
)
def test_t_tail_table_values(spark, t, df, p):
    got = spark.range(1).select(numeric.t_two_sided_p(F.lit(t), F.lit(df)).alias("p")).collect()[0].p
    assert got == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize(
    "t,df,log10_p",
    [
        (12.0, 100, -20.357032453), (20.0, 3000, -82.909519101), (30.0, 1e9, -197.008091126), (1e6, 1, -6.196119877),
        (3.0, 2000, -2.563337524), (3.0, 2001, -2.563340181), (0.0, 5, 0.0), (0.5, 1e6, -0.209661916),
    ],
)
def test_t_tail_keeps_its_digits_far_out(spark, t, df, log10_p):
    got = spark.range(1).select(numeric.t_two_sided_log10_p(F.lit(t), F.lit(df)).alias("p")).collect()[0].p
    assert got == pytest.approx(log10_p, abs=2e-9)


def test_t_tail_has_no_step(spark):
    got = spark.range(1900, 2100).select(numeric.t_two_sided_p(F.lit(3.0), F.col("id")).alias("p"), "id").orderBy("id").collect()
    steps = [b.p - a.p for a, b in zip(got, got[1:])]
    assert max(steps) < 0 and min(steps) / max(steps) < 1.3


@pytest.mark.parametrize(
    "df,q",
    [(1, 12.706204736), (5, 2.570581836), (8, 2.306004135), (30, 2.042272456), (100, 1.983971519), (2000, 1.961150826), (1e6, 1.959966357)],
)
def test_t_quantile(spark, df, q):
    got = spark.range(1).select(numeric.t_quantile(0.975, F.lit(df)).alias("q"), numeric.t_quantile(0.025, F.lit(df)).alias("n")).collect()[0]
    assert got.q == pytest.approx(q, rel=1e-9) and got.n == pytest.approx(-q, rel=1e-9)


def test_tests_without_p_stay(frame):
    df = frame([("a", 0.01), ("b", 0.04), ("c", None)], "k string, p double")
    got = {r.k: (r.p_bonferroni, r.p_bh) for r in stats.p_adjust(df, "p", ["k"]).collect()}
    assert got == {"a": (0.02, 0.02), "b": (0.08, 0.04), "c": (None, None)}


def test_decimals_are_summed(frame):
    df = frame([("a", Decimal("1.5"), 2), ("a", Decimal("2.5"), 3)], "g string, d decimal(5,2), n int")
    assert groups.sum_all_numeric(df, ["g"]).collect()[0].asDict() == {"g": "a", "d": Decimal("4.00"), "n": 5}


def test_conservation_of_a_null_group(frame):
    before = frame([(None, 5), ("a", 3), ("b", 1)], "g string, n int")
    after = frame([(None, 5), ("a", 1), ("c", 2)], "g string, n int")
    got = {r.g: (r.before, r.after, r.lost) for r in groups.conservation(before, after, ["g"], "n").collect()}
    assert got == {None: (5, 5, 0), "a": (3, 1, 2), "b": (1, 0, 1), "c": (0, 2, -2)}


def test_guards(frame):
    df = frame([(1.0, 0.0), (0.0, 2.0), (4.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r.q for r in df.select(numeric.log2_ratio("a", "b").alias("q")).collect()]
    assert got == [None, None, 1.0, None]
    assert [r.q for r in df.select(numeric.asin_sqrt("a").alias("q")).collect()][2] is None


def test_text_parsers(frame):
    df = frame([("20C_Pooled.A1.A3.2",), ("C1.T7.H9_S1.1",), ("plain",)], "n string")
    assert rows(reshape.sample_design(df, "n"), "n", "cycle_num", "sample_num") == [
        ("20C_Pooled.A1.A3.2", 20, "Calibration"),
        ("C1.T7.H9_S1.1", 30, "C1.T7.H9_S1"),
        ("plain", 30, "Calibration"),
    ]
    assert rows(df.select(text.drop_last_token("n").alias("s")).na.fill("-"), "s") == [
        ("-",), ("20C_Pooled.A1.A3",), ("C1.T7.H9_S1",),
    ]


def test_run_rules_first_match_wins(frame):
    df = frame([("20C_AllPool.1",), ("C1.T7_S1.2",), ("CX_S1.3",), ("CX_S1.4",), ("none",)], "n string")
    got = dict(rows(reshape.assign_run(df, "n", reshape.RUN_RULES), "n", "run"))
    assert got == {"20C_AllPool.1": "2", "C1.T7_S1.2": "1", "CX_S1.3": "2", "CX_S1.4": "2", "none": None}


def test_dedupe_best_ties(frame):
    df = frame(
        [("h1", "a", None), ("h1", "a", "b"), ("h2", "x", None), ("h2", None, "y"), ("h3", "q", "q")],
        "hash string, r1 string, r2 string",
    )
    assert rows(taxonomy.dedupe_best(df, "hash", ["r1", "r2"]), "hash") == [("h1",), ("h3",)]
    assert rows(taxonomy.dedupe_best(df, "hash", ["r1", "r2"], ties="first"), "hash") == [("h1",), ("h2",), ("h3",)]


def test_labels(frame):
    df = frame(
        [("Calanoida", None), ("Calanoida", ""), ("Calanoida", "other"), ("Rare", "other"), ("Calanoida", "Fam")],
        "o string, f string",
    )
    got = [r.f for r in taxonomy.label_unidentified(df, "f", "o", ["Calanoida"]).collect()]
    assert got == ["Calanoida", "unidentified Calanoida", "unidentified Calanoida", "other", "Fam"]
    low = [r.l for r in taxonomy.label_by_lowest_known(df, ["o", "f"], "l").collect()]
    assert low == ["unidentified Calanoida"] * 3 + ["unidentified Rare", "Fam"]


def test_same_family_under_two_orders_stays_apart(frame):
    counts = frame([("h1", "s", 1), ("h2", "s", 2), ("h3", "s", 4)], "hash string, sample string, n long")
    tax = frame([("h1", "o1", "f"), ("h2", "o2", "f"), ("h3", "o1", None)], "hash string, o string, f string")
    got = rows(taxonomy.rollup(counts, tax, "hash", ["sample"], ["o", "f"], "n"), "o", "f", "n")
    assert got == [("o1", "f", 1), ("o2", "f", 2), ("other", "other", 4)]


def test_rollup_conserves_reads(frame):
    counts = frame([(f"h{i}", f"s{i % 3}", i) for i in range(1, 40)], "hash string, sample string, n long")
    tax = frame([(f"h{i}", "o", None if i % 4 else "f") for i in range(1, 30)], "hash string, o string, f string")
    out = taxonomy.rollup(counts, tax, "hash", ["sample"], ["o", "f"], "n")
    assert groups.conservation(counts, out, ["sample"], "n").where("lost <> 0").count() == 0


def test_exclude_rules_keep_null_rows(frame):
    df = frame([("a", "x"), ("a", None), (None, "x")], "f string, o string")
    assert taxonomy.exclude_lineages(df, [{"f": "a", "o": "x"}]).count() == 2


def test_filters_count_absent_pairs_as_zero(frame):
    df = frame(
        [("g", s, "full", 5) for s in "abcd"] + [("g", "a", "gap", 5)], "g string, s string, taxon string, n long"
    )
    cal = F.col("s").isin("a", "b", "c")
    assert rows(filters.zero_tolerance(df, cal, ["g"], "s", "taxon", "n", 1), "taxon") == [("full",)]
    assert rows(filters.zero_tolerance(df, cal, ["g"], "s", "taxon", "n", 2), "taxon", "n_zero") == [("full", 0), ("gap", 2)]
    assert rows(filters.prevalence(df, ["g"], "s", "taxon", "n", 1, 0.3), "taxon") == [("full",)]
    assert rows(filters.calibration_complete(df, cal, ["g"], "s", "taxon", "n", 0.3), "taxon") == [("full",)]
    assert rows(filters.above_quantile(df, cal, ["g"], "s", "taxon", "n", 0.5), "taxon") == [("full",)]


def test_percent_filter_is_per_category_and_ignores_field_samples(frame):
    df = frame(
        [("g", "E1", "a", 99), ("g", "E1", "b", 1), ("g", "E2", "a", 50), ("g", "E2", "b", 50), ("g", None, "c", 999)],
        "g string, e string, taxon string, n long",
    )
    assert rows(filters.percent_of_experiment(df, "e", ["g"], "taxon", "n", 0.4), "taxon") == [("a",), ("b",)]
    assert rows(filters.percent_of_experiment(df, "e", ["g"], "taxon", "n", 0.6), "taxon") == [("a",)]


def test_lump_conserves_and_drop_high_rest(frame):
    df = frame([("s1", "a", 9), ("s1", "b", 1), ("s2", "a", 1), ("s2", "c", 9)], "s string, taxon string, n long")
    kept = df.where("taxon = 'a'").select("taxon")
    out = filters.lump(df, kept, ["taxon"], "taxon", ["s"], "n")
    assert rows(out, "s", "taxon", "n") == [("s1", "a", 9), ("s1", "other", 1), ("s2", "a", 1), ("s2", "other", 9)]
    assert {r.s for r in filters.drop_high_rest(out, ["s"], "taxon", "n", 0.2).collect()} == {"s1"}


def test_closure_and_clr(frame):
    df = frame([("s", "a", 1), ("s", "b", 3), ("z", "a", 0)], "s string, taxon string, n long")
    shares = composition.closure(df, ["s"], "n")
    assert rows(shares.na.fill(-1.0), "s", "share") == [("s", 0.25), ("s", 0.75), ("z", -1.0)]
    clr = composition.clr(shares.where("s = 's'"), ["s"], "share")
    assert sum(r.clr for r in clr.collect()) == pytest.approx(0, abs=1e-12)


def test_clr_with_absent_categories(frame):
    full = frame([("s", "a", 0.5), ("s", "b", 0.5), ("s", "c", 0.0), ("s", "d", 0.0)], "s string, t string, v double")
    dense = {r.t: r.clr for r in composition.clr(full, ["s"], "v").collect()}
    thin = composition.clr(full.where("v > 0"), ["s"], "v", size=F.lit(4))
    for row in thin.collect():
        assert row.clr == pytest.approx(dense[row.t])


def test_median_depth_rounds_half_to_even(frame):
    df = frame([("g", "a", "x", 1), ("g", "a", "y", 1), ("g", "b", "x", 5)], "g string, s string, t string, n long")
    out = composition.normalise_to_median_depth(df, ["g"], ["s"], "n")
    assert rows(out, "s", "t", "normalised") == [("a", "x", 2.0), ("a", "y", 2.0), ("b", "x", 4.0)]


def test_mean_share_counts_absent_samples(frame):
    df = frame([("g", "s1", "a", 1), ("g", "s1", "b", 1), ("g", "s2", "a", 4)], "g string, s string, t string, n long")
    assert rows(composition.mean_share(df, ["g"], "s", "t", "n"), "t", "mean_share") == [("a", 0.75), ("b", 0.25)]


def test_merge_counts_and_wide(frame):
    a = frame([("x", "s1", 1)], "t string, s string, n long")
    b = frame([("x", "s2", 2), ("y", "s2", 3)], "t string, s string, n long")
    merged = reshape.merge_counts([a, b], ["t", "s"], "n")
    assert rows(reshape.to_wide(merged, ["t"], "s", "n", ["s1", "s2"]), "t", "s1", "s2") == [("x", 1, 2), ("y", 0, 3)]


def test_size_class_first_rule_wins(frame):
    df = frame([(0.5,), (0.50001,), (1.0,), (2.0,), (2.1,)], "feret_mm double")
    got = [(r.size_fraction, r.size_code) for r in particles.size_class(df).collect()]
    assert got == [("0.2-0.5", 0.2), ("0.5-1", 0.5), ("1-2", 1.0), ("1-2", 1.0), (">2", 2.0)]


def test_carbon_relations(frame):
    df = frame(
        [("Oikopleuridae", 1.0, 2.0), ("Calanoida", 0.04, 2.0), ("Calanoida", 1.0, 9.0), ("Eumalacostraca", 1.0, 2.0), ("?", 1.0, 1.0)],
        "category string, esd_mm double, feret_mm double",
    )
    got = [r.carbon_ug for r in particles.length_to_carbon(df, "feret").collect()]
    assert got[0] == pytest.approx(0.49 * (38.8 * (0.262 * 2) ** 2.574) ** 1.12)
    assert got[1] is None  # the converted length is not positive
    assert got[2] == pytest.approx(10 ** (-6.76 + 2.512 * math.log10((1 / 1.2 - 0.038) * 1000)))
    assert got[3] == pytest.approx(10 ** (-0.473 + 3.174 * math.log10(1.04 * 2)))
    assert got[4] is None
    other = [r.carbon_ug for r in particles.length_to_carbon(df, "any other").collect()]
    assert other[3] == pytest.approx(0.133 * 2**2.44 * 1000)
    esd = [r.carbon_ug for r in particles.length_to_carbon(df, "esd").collect()]
    assert esd[0] is None and esd[3] == pytest.approx(0.133 * (1 / 1.7 - 0.064) ** 2.44 * 1000)


def test_biomass_areal(frame):
    w = frame([(1, 3.0), (2, -1.0), (3, 3.0)], "k int, biomass_dry double")
    v = frame([(1, 10.0), (2, 10.0), (3, 0.0)], "k int, volume_m3 double")
    d = frame([(1, 100.0)], "k int, depth_m double")
    got = {r.k: (r.depth_m, r.biomass_mg_m2) for r in particles.biomass_areal(w, v, d, "k").collect()}
    assert got == {1: (100.0, pytest.approx(168.0)), 2: (210.0, None), 3: (210.0, None)}
    own = particles.biomass_areal(w, v, d, "k", depth="column").where("k = 1").collect()[0]
    assert own.biomass_mg_m2 == pytest.approx(80.0)


def test_hierarchy_drops_only_double_na(frame):
    df = frame([("NA", "NA", 1), ("NA", "x", 2), (None, "x", 4), ("a", "b", 8)], "g1 string, g2 string, n long")
    assert rows(compare.hierarchy_area(df, "g1", "g2", "n"), "n") == [(2,), (8,)]


def test_top_page_returns_the_whole_page(frame):
    df = frame([(f"c{i:02d}", 100 - i) for i in range(30)], "c string, n long")
    assert [r.c for r in ordered.top_page(df, "c", "n", 10, 10).collect()] == [f"c{i:02d}" for i in range(10, 20)]


def test_first_values(frame):
    df = frame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5)], "k string, o int")
    assert [r.k for r in ordered.first_values(df, "k", ["o"], 3).collect()] == ["b", "a", "c"]


def test_closeness(frame):
    df = frame([("s", 0.5, 0.4, 0.51)], "s string, bio double, raw double, corrected double")
    got = {r.method: r for r in compare.closeness(df, ["s"], "bio", "raw", "corrected").collect()}
    assert (got["bio"].is_closer, got["bio"].closest, got["bio"].worse) == ("*", "**", None)
    assert got["raw"].is_closer is None and got["raw"].diff_raw == 0


def test_squared_errors(frame):
    df = frame([(0.5, 0.1, 0.4), (0.5, 0.5, 0.1)], "bio double, raw double, corrected double")
    assert [r.winner for r in compare.squared_errors(df, "bio", "raw", "corrected").collect()] == ["corrected", "raw"]


def test_histogram_top_edge_and_flat_group(frame):
    df = frame([("a", float(i)) for i in range(7)] + [("b", 3.0)], "g string, v double")
    got = rows(stats.histogram(df, ["g"], "v", 6), "g", "bin", "n")
    assert ("a", 5, 2) in got and ("b", 0, 1) in got


def test_fd_bin_width_fallback(frame):
    df = frame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "g string, v double")
    assert rows(stats.bin_width_fd(df, ["g"], "v"), "g", "bin_width") == [("a", 0.05), ("b", 0.05)]


def test_too_few_pairs(frame):
    with pytest.raises(ValueError):
        stats.require_pairs(frame([(1,), (2,)], "v int"))


def test_null_keys_keep_their_group(frame):
    df = frame([(None, 1), (None, 3), ("a", 4)], "g string, n long")
    assert rows(groups.share(df, ["g"], "n").na.fill("-"), "g", "share") == [("-", 0.25), ("-", 0.75), ("a", 1.0)]


def test_axis_score_key_joins_equal_scores(frame):
    a = compare.by_axis_score(frame([(0.1 + 0.2, "x")], "pc1 double, a string"), "pc1")
    b = compare.by_axis_score(frame([(0.3, "y")], "pc1 double, b string"), "pc1")
    assert groups.join_on(a, b.drop("pc1"), ["pc1_key"]).collect()[0].b == "y"


def test_whole_table_groups(frame):
    df = frame([("a", 1.0), ("b", 3.0)], "k string, n double")
    assert rows(groups.share(df, [], "n"), "k", "share") == [("a", 0.25), ("b", 0.75)]
    assert sum(r.clr for r in composition.clr(df, [], "n").collect()) == pytest.approx(0)
    assert [r.bin_width for r in stats.bin_width_fd(df, [], "n").collect()] == [pytest.approx(2 / 2 ** (1 / 3))]
    depth = composition.normalise_to_median_depth(df, [], ["k"], "n")
    assert rows(depth, "k", "normalised") == [("a", 2.0), ("b", 2.0)]


def test_publication_table_order(frame):
    grid = frame(
        [("S2", "raw", "x", 0.1, 0.2, 0.3, 0.4), ("S1", "raw", "x", 0.1, 0.2, 0.3, 0.4)],
        "size string, y_variable string, x_variable string, r double, p double, p_bonferroni double, p_bh double",
    )
    out = compare.publication_table(grid, "size", {"r": "Pearson R"})
    assert "Pearson R" in out.columns and [x[0] for x in out.collect()] == ["S1", "S2"]


def test_rollup_levels_equals_one_rollup_per_rank(frame):
    counts = frame([("s1", "a", 5), ("s1", "b", 3), ("s1", "x", 2), ("s2", "c", 4), (None, "b", 1)], "sample string, hash string, n long")
    tax = frame([("a", "o1", "f1"), ("b", "o1", None), ("c", None, "f2")], "hash string, o string, f string")
    for rest in (True, False):
        out = taxonomy.rollup_levels(counts, tax, "hash", ["sample"], ["o", "f"], "n", keep_rest=rest).collect()
        for level, ranks in (("o", ["o"]), ("f", ["o", "f"])):
            want = taxonomy.rollup(counts, tax, "hash", ["sample"], ranks, "n", keep_rest=rest).collect()
            got = [(r["sample"], *[r[c] for c in ranks], r.n) for r in out if r.level == level]
            assert sorted(got, key=str) == sorted([(r["sample"], *[r[c] for c in ranks], r.n) for r in want], key=str)


def test_threshold_scan_over_a_long_grid(frame):
    rows = [("g", "e1", f"t{i}", 1 << i) for i in range(12)] + [("h", "e1", "t", 0), ("k", None, "t", 5)]
    df = frame(rows, "g string, e string, t string, n long")
    grid = [i / 10_000 for i in range(10_000)] + [0.5, 4096 / 8190]
    got = {(r.g, r.threshold): r.n_kept for r in filters.threshold_scan(df, "e", ["g"], "t", "n", grid).collect()}
    shares = [(1 << i) / 4095 for i in range(12)]
    assert {g for g, _ in got} == {"g"} and len(got) == len(set(grid))
    assert all(got["g", th] == sum(s >= th for s in shares) for th in set(grid))


def test_round_half_up_is_round(spark):
    """Ties of the decimal text, large values and what is no number included, to the last bit."""
    special = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 1e300, 5e-324, 1.0000005, 2.5e-7, 5e-7, -5e-7, 1.5e-6, 4503599627370496.5, 8388607.9999995]
    ties = [sign * (k + 0.5) / 1e6 for k in range(0, 200_000, 7) for sign in (1, -1)]
    df = spark.createDataFrame([(v,) for v in special + ties], "v double").unionByName(
        spark.range(200_000).select(((F.rand(5) - 0.5) * F.pow(F.lit(10.0), F.rand(6) * 14 - 7)).alias("v"))
    )
    plain, fast = F.round("v", 6) + F.lit(0.0), numeric.round_half_up("v", 6) + F.lit(0.0)
    assert df.where(~F.hex(F.format_string("%a", plain)).eqNullSafe(F.hex(F.format_string("%a", fast)))).count() == 0
