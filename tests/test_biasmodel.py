"""The fit against a dense solution, recovery of known slopes, and the draws."""

import numpy as np
import pandas as pd
import pytest

from biascomp.operators import biasmodel
from biascomp.operators.biasmodel import BiasModel, Columns

TAXA = ["a", "b", "c", "d"]
SLOPES = np.array([0.06, -0.02, 0.0, -0.04])


@pytest.fixture(scope="module")
def counts():
    """Calibration at three cycles and field samples at thirty, with known slopes and some zeros."""
    rng = np.random.default_rng(3)
    rows = []
    base = rng.normal(size=4)

    def add(obs, sample, cycle, start, run):
        p = np.exp(start + SLOPES * cycle)
        for t, n in zip(TAXA, rng.multinomial(200_000, p / p.sum())):
            if n:
                rows.append(("S1", obs, sample, int(cycle), t, int(n), run))

    for cycle in (20, 24, 28):
        for rep in range(12):
            add(f"{cycle}C.{rep}", "Calibration", cycle, base, rep % 2)
    for s in range(6):
        start = base + rng.normal(scale=0.5, size=4)
        if s == 0:
            start[2] = -40.0
        for rep in range(3):
            add(f"C{s}.{rep}", f"C{s}", 30, start, rep % 2)
    return pd.DataFrame(rows, columns="size_class sample_name sample_num cycle_num taxon n_reads run".split())


def dense(counts, gamma, run=False, pseudo=0.5, centre=0.0):
    """Ridge solution on the full design matrix."""
    wide = counts.pivot_table(index="sample_name", columns="taxon", values="n_reads", fill_value=0)
    design = counts.drop_duplicates("sample_name").set_index("sample_name").loc[wide.index]
    y = np.log(wide.to_numpy() + pseudo)
    y = y - y.mean(axis=1, keepdims=True)
    x = [design.cycle_num.to_numpy() - centre] + ([design.run.to_numpy()] if run else [])
    one_hot = pd.get_dummies(design.sample_num)
    x = np.column_stack([*x, one_hot.to_numpy()]).astype(float)
    m = x.T @ x + np.eye(x.shape[1]) / gamma
    b = np.linalg.solve(m, x.T @ y)
    q = (y * y).sum(axis=0) - (b * (x.T @ y)).sum(axis=0)
    n, d = y.shape
    prior = 3 * (1 - 1 / d)
    v = np.linalg.inv(m)
    log_ml = -0.5 * (np.linalg.slogdet(m)[1] + x.shape[1] * np.log(gamma)) - 0.5 * (n + 5) * np.log1p(q / prior)
    scale2 = (prior + q) / (n + 5)
    names = ["cycle"] + (["run"] if run else []) + list(one_hot.columns)
    return b, v, scale2, log_ml, list(wide.columns), names, y - x @ b


@pytest.mark.parametrize("run", [False, True])
@pytest.mark.parametrize("gamma", [0.5, 20.0, 400.0])
def test_fit_equals_dense_solution(spark, counts, gamma, run):
    model = BiasModel(spark.createDataFrame(counts), Columns(run="run" if run else None))
    fit = model.fit([gamma]).toPandas().set_index("taxon").loc[TAXA]
    b, v, scale2, log_ml, taxa, names, _ = dense(counts, gamma, run)
    assert taxa == TAXA
    assert np.allclose(fit.beta, b[0], atol=1e-10)
    assert np.allclose(fit.v11, v[0, 0])
    assert np.allclose(fit.scale2, scale2)
    if run:
        assert np.allclose(fit.beta_run, b[1], atol=1e-10)
        assert np.allclose(fit.log_ml, log_ml)
    else:
        # an unused run effect adds nothing
        assert np.allclose(fit.beta_run, 0) and np.allclose(fit.log_ml, log_ml)


def test_scan_equals_single_fits(spark, counts):
    model = BiasModel(spark.createDataFrame(counts))
    grid = [0.5, 20.0, 400.0]
    scan = model.gamma_scan(grid).toPandas().set_index("gamma")
    want = {g: dense(counts, g)[3].sum() for g in grid}
    assert np.allclose([scan.loc[g].log_ml for g in grid], list(want.values()))
    assert scan.index[scan.is_best].tolist() == [max(want, key=want.get)]


def test_slopes_are_recovered(spark, counts):
    """With cycles centred at the field level, field samples carry no slope and calibration decides."""
    model = BiasModel(spark.createDataFrame(counts), centre=30.0)
    effs = model.amp_effs(400.0).toPandas().set_index("taxon").loc[TAXA]
    assert np.allclose(effs.p50, SLOPES - SLOPES.mean(), atol=0.01)
    assert (effs.p2_5 < effs.p25).all() and (effs.p75 < effs.p97_5).all()
    share = model.field_share(400.0).collect()[0].field_share
    assert share == pytest.approx(0, abs=1e-9)


def test_prediction_equals_dense_softmax(spark, counts):
    gamma = 20.0
    b, v, scale2, _, _, names, _ = dense(counts, gamma)
    got = BiasModel(spark.createDataFrame(counts)).predict(gamma).toPandas()
    assert set(got["sample"]) == {f"C{i}" for i in range(6)}  # calibration is not predicted
    assert len(got) == 24  # categories unseen in a sample are predicted, too
    for s, part in got.groupby("sample"):
        eta = b[names.index(s)]
        part = part.set_index("taxon").loc[TAXA]
        assert np.allclose(part.clr, eta, atol=1e-9)
        assert np.allclose(part.share, np.exp(eta) / np.exp(eta).sum())
        assert part.share.sum() == pytest.approx(1)
        assert ((part.share_low < part.share) & (part.share < part.share_high)).all()
        half = np.sqrt(scale2 * v[names.index(s), names.index(s)])
        assert np.allclose((part.clr_high - part.clr_low) / half, (part.clr_high - part.clr_low).iloc[0] / half[0])


def test_draws_agree_and_do_not_depend_on_partitions(spark, counts):
    one = BiasModel(spark.createDataFrame(counts)).draws(n=2000).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = BiasModel(spark.createDataFrame(counts).repartition(5)).draws(n=2000).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    keys = ["size_class", "sample", "taxon"]
    one, two = (d.sort_values(keys).reset_index(drop=True) for d in (one, two))
    assert np.allclose(one.mean_value, two.mean_value, rtol=1e-6)
    closed = BiasModel(spark.createDataFrame(counts)).predict().toPandas().sort_values(keys).reset_index(drop=True)
    assert np.allclose(one.p50, closed.share, atol=0.1)
    assert np.allclose(one.groupby("sample").mean_value.sum(), 1)
    assert (one.p2_5 <= one.p50).all() and (one.p50 <= one.p97_5).all()


def test_draws_in_blocks_are_the_same_draws(spark, counts, monkeypatch):
    keys = ["sample", "taxon"]
    whole = BiasModel(spark.createDataFrame(counts)).draws(n=500).toPandas().set_index(keys).sort_index()
    monkeypatch.setattr(biasmodel, "BLOCK", 2)
    model = BiasModel(spark.createDataFrame(counts))
    parts = model.draws(n=500).toPandas().set_index(keys).sort_index()
    assert len(parts) == 24 and np.allclose(whole.drop(columns="size_class"), parts.drop(columns="size_class"), rtol=1e-9)
    seen = model.draws(n=500, seen_only=True).toPandas().set_index(keys).sort_index()
    assert len(seen) == 23 and np.allclose(seen.drop(columns="size_class"), parts.loc[seen.index].drop(columns="size_class"), rtol=1e-9)


@pytest.mark.parametrize("block", [2048, 2])
def test_mean_of_the_draws_is_the_integral(spark, counts, monkeypatch, block):
    """Few shallow observations, so that the mean of the shares is not the share of the means."""
    monkeypatch.setattr(biasmodel, "BLOCK", block)
    model = BiasModel(spark.createDataFrame(counts.assign(n_reads=counts.n_reads // 2_000).query("n_reads > 0")))
    keys = ["sample", "taxon"]
    drawn, want = (d.toPandas().set_index(keys).sort_index() for d in (model.draws(n=20_000), model.expected_shares()))
    assert np.allclose(want.expected.groupby(level=0).sum(), 1, atol=1e-5)
    off = (drawn.mean_value - want.expected) / (drawn.sd_value / np.sqrt(20_000))
    assert off.abs().max() < 5 and 0.5 < off.std() < 1.6
    plain = model.predict().toPandas().set_index(keys).sort_index().share
    assert ((plain - want.expected).abs() / (drawn.sd_value / np.sqrt(20_000))).max() > 8  # the test can tell them apart


@pytest.mark.parametrize("block, chunk, run", [(2048, 1 << 14, False), (2, 5, False), (2, 5, True)])
def test_residual_covariance(spark, counts, monkeypatch, block, chunk, run):
    monkeypatch.setattr(biasmodel, "BLOCK", block)
    monkeypatch.setattr(biasmodel, "CHUNK", chunk)
    counts = counts.assign(run=counts.run.astype(int))
    want = np.cov(dense(counts, 20.0, run=run)[6].T)
    cols = Columns(run="run") if run else Columns()
    got = BiasModel(spark.createDataFrame(counts), cols).residual_covariance(20.0).toPandas()
    assert len(got) == 10
    for row in got.itertuples():
        assert row.covariance == pytest.approx(want[TAXA.index(row.taxon), TAXA.index(row.taxon2)], abs=1e-9)


@pytest.mark.parametrize("block", [2048, 2])
def test_posterior_predictive_covers(spark, counts, monkeypatch, block):
    monkeypatch.setattr(biasmodel, "BLOCK", block)
    got = BiasModel(spark.createDataFrame(counts)).posterior_predictive(n=300).toPandas()
    assert len(got) == counts.sample_name.nunique() * 4
    assert (got.observed == 0).sum() == counts.sample_name.nunique() * 4 - len(counts)
    assert got.covered.mean() > 0.8
    ordered = got.sort_values(["obs", "place"])
    assert (ordered.place.to_numpy() == np.tile([1, 2, 3, 4], len(got) // 4)).all()
    assert (np.diff(ordered.observed.to_numpy().reshape(-1, 4), axis=1) <= 0).all()


def test_a_single_category_takes_all(spark, counts):
    model = BiasModel(spark.createDataFrame(counts.query("taxon == 'a'")))
    assert {round(r.share, 9) for r in model.predict().collect()} == {1.0}
    assert {(round(r.p2_5, 9), round(r.p97_5, 9)) for r in model.draws(n=50).collect()} == {(1.0, 1.0)}


def test_predictive_intervals_have_the_stated_width(spark):
    """Counts from the model itself: 95 % intervals hold about 95 % of them, with as many misses above as below."""
    rng, rows = np.random.default_rng(8), []
    for s in range(60):
        start = rng.normal(size=6)
        for rep in range(2):
            eta = start + rng.normal(scale=0.6, size=6) + np.linspace(-0.05, 0.05, 6) * (20 + 4 * (s % 3))
            counts = rng.multinomial(50_000, np.exp(eta) / np.exp(eta).sum())
            rows += [("S1", f"C{s}.{rep}", f"C{s}", 20 + 4 * (s % 3), f"t{t}", int(n)) for t, n in enumerate(counts) if n]
    df = spark.createDataFrame(rows, "size_class string, sample_name string, sample_num string, cycle_num int, taxon string, n_reads long")
    got = BiasModel(df).posterior_predictive(n=1000).toPandas()
    low, high = (got.observed < got.p2_5).mean(), (got.observed > got.p97_5).mean()
    assert low < 0.06 and high < 0.06
    narrow = (got.observed.between(got.p50 - (got.p50 - got.p2_5) / 4, got.p50 + (got.p97_5 - got.p50) / 4)).mean()
    assert 0.2 < narrow < 0.75  # a quarter of the width holds about 38 %, more as the fit has seen the counts


def test_groups_are_fitted_apart(spark, counts):
    both = pd.concat([counts, counts.assign(size_class="S2", n_reads=counts.n_reads // 2 + 1)])
    fit = BiasModel(spark.createDataFrame(both)).fit().toPandas()
    alone = BiasModel(spark.createDataFrame(counts)).fit().toPandas()
    merged = fit[fit.size_class == "S1"].set_index("taxon").loc[TAXA]
    assert np.allclose(merged.beta, alone.set_index("taxon").loc[TAXA].beta)


def test_sparse_prediction_keeps_the_shares(spark, counts):
    """Rows of categories with reads alone, under the same totals as the dense table."""
    both = BiasModel(spark.createDataFrame(counts.assign(run=counts.run.astype(int))), Columns(run="run"))
    dense_rows = both.predict().toPandas().set_index(["sample", "taxon"])
    sparse = both.predict(seen_only=True).toPandas().set_index(["sample", "taxon"])
    seen = counts[counts.sample_num != "Calibration"].drop_duplicates(["sample_num", "taxon"])
    assert set(sparse.index) == set(zip(seen.sample_num, seen.taxon)) and len(sparse) < len(dense_rows)
    for c in ("share", "share_low", "share_high", "clr"):
        assert np.allclose(sparse[c], dense_rows.loc[sparse.index][c], rtol=1e-12)
    b, *_, names, _ = dense(counts.assign(run=counts.run.astype(int)), 20.0, run=True)
    for sample, part in dense_rows.groupby(level=0):
        eta = b[names.index(sample)]
        want = pd.Series(np.exp(eta) / np.exp(eta).sum(), TAXA)
        assert np.allclose(part.share.droplevel(0).loc[TAXA], want)


def test_samples_of_one_block_are_worked_once(spark, counts):
    """No second pass and no frame per sample or observation while the categories fit into one block."""
    model = BiasModel(spark.createDataFrame(counts))
    for out in (model.draws(n=5), model.expected_shares(), model.posterior_predictive(n=5)):
        plan = out._jdf.queryExecution().toString()
        assert "MapInPandas" in plan and "CoGroup" not in plan and "FlatMapGroups" not in plan


def test_narrow_groups_beside_wide_ones(spark, counts, monkeypatch):
    """Groups of one block and of two in one table give what each gives in one block."""
    both = pd.concat([counts, counts[counts.taxon.isin(["a", "b"])].assign(size_class="S2")])
    keys = ["size_class", "sample", "taxon"]
    results = []
    for block in (2048, 2):
        monkeypatch.setattr(biasmodel, "BLOCK", block)
        model = BiasModel(spark.createDataFrame(both))
        ppc = model.posterior_predictive(n=20).toPandas().set_index(["size_class", "obs", "taxon"]).sort_index()
        results.append([d.toPandas().set_index(keys).sort_index() for d in (model.draws(n=50), model.expected_shares())] + [ppc[["observed", "place"]]])
    for whole, parts in zip(*results):
        assert whole.index.equals(parts.index) and np.allclose(whole, parts, rtol=1e-9)


def test_keys_cut_by_frames_come_whole():
    rows = pd.DataFrame({"g": ["a", "a", None, None, None, "b", "c"], "k": [1, 1, 1, 1, 2, 2, 2], "v": range(7)})
    for size in (1, 2, 3, 7):
        frames = [rows.iloc[i : i + size] for i in range(0, 7, size)]
        got = [f["v"].iloc[a:b].tolist() for f, ends in biasmodel._whole_keys(frames, ["g", "k"]) for a, b in zip(ends[:-1], ends[1:])]
        assert got == [[0, 1], [2, 3], [4], [5], [6]]


def test_weights_and_quantiles_are_those_of_numpy():
    block = pd.DataFrame({"key": [-5, 7, 2**62], "at": [0.0, -1.0, 2.0], "spread": [0.5, 1.0, 0.1], "df": [6.0, 9.5, 300.0]})
    want = [np.exp(r.at + r.spread * biasmodel._stream(r.key).standard_t(r.df, 40)) for r in block.itertuples()]
    got = biasmodel._weights(block, 40)
    assert np.allclose(got, want, rtol=1e-13)
    probs = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    assert np.array_equal(biasmodel._quantiles(np.sort(got, axis=1), probs), np.quantile(got, probs, axis=1).T)


@pytest.mark.parametrize("block", [2048, 2])
def test_draws_of_categories_with_reads_by_design(spark, counts, monkeypatch, block):
    """The same summaries as the draws of all categories, up to their errors, without a row per missing category."""
    monkeypatch.setattr(biasmodel, "BLOCK", block)
    model = BiasModel(spark.createDataFrame(counts.assign(n_reads=counts.n_reads // 2_000).query("n_reads > 0")))
    monkeypatch.setattr(model, "_posterior_rows", None)  # it lays out every category of every sample
    keys = ["sample", "taxon"]
    got = model.draws_seen(n=20_000).toPandas().set_index(keys).sort_index()
    monkeypatch.undo()
    monkeypatch.setattr(biasmodel, "BLOCK", block)
    want = model.draws(n=20_000, seen_only=True).toPandas().set_index(keys).sort_index()
    mean = model.expected_shares().toPandas().set_index(keys).sort_index().expected.loc[want.index]
    assert got.index.equals(want.index)
    error = want.sd_value / np.sqrt(20_000)
    assert ((got.mean_value - mean) / error).abs().max() < 5
    assert np.allclose(got.sd_value, want.sd_value, rtol=0.05)
    for q in ("p2_5", "p25", "p50", "p75", "p97_5"):
        assert ((got[q] - want[q]) / error).abs().max() < 25, q


@pytest.mark.parametrize("draws", [True, False])
@pytest.mark.parametrize("run", [None, "run"])
def test_sparse_predictions_read_the_rows_of_the_draws(spark, counts, run, draws):
    """Nothing is dealt again for the predictions, whether the draws wrote the rows before or not."""
    keys, values = ["sample", "taxon"], ["share", "share_low", "share_high", "clr", "clr_low", "clr_high"]
    model = BiasModel(spark.createDataFrame(counts), Columns(run=run))
    if draws:
        model.draws_seen(n=10)
    sparse = model.predict(seen_only=True)
    assert "Exchange" not in sparse._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning" not in sparse._jdf.queryExecution().executedPlan().toString()
    sparse = sparse.toPandas().set_index(keys).sort_index()
    field = counts[counts.sample_num != "Calibration"]
    assert list(sparse.index) == sorted(set(zip(field.sample_num, field.taxon)))
    full = model.predict().toPandas().set_index(keys).loc[sparse.index]
    assert np.allclose(sparse[values], full[values], rtol=1e-9, atol=1e-12)


def test_sums_of_a_run_that_is_not_modelled_are_not_written(spark, counts, monkeypatch):
    written, plain = [], biasmodel.checkpoint
    monkeypatch.setattr(biasmodel, "checkpoint", lambda df: written.append(df.columns) or plain(df))
    assert set(BiasModel(spark.createDataFrame(counts)).cells.columns) >= {"rd0", "rw", "xrw", "rrw"}
    assert not set(written[0]) & {"rd0", "rw", "xrw", "rrw"}


def test_overlapping_sets_equal_counts_laid_out_per_group(spark, counts):
    """Sums per set give each group what a copy of its rows would; samples of several sets included."""
    sets = [["all", "a", "b"], ["a"], ["b", "all"], ["all"]]
    field = {"C0": 0, "C1": 1, "C2": 2, "C3": 3, "C4": 0}
    number = [
        field.get(s, int(o[-1]) % 4) if s != "Calibration" else int(o.split(".")[1]) % 4
        for s, o in zip(counts.sample_num, counts.sample_name)
    ]
    rows = counts.assign(kind=number)
    copies = pd.concat([rows[rows.kind == k].assign(kind=v) for k, own in enumerate(sets) for v in own])
    group = ["size_class", "kind"]
    model = BiasModel(spark.createDataFrame(rows), Columns(group=group, sets=sets))
    plain = BiasModel(spark.createDataFrame(copies), Columns(group=group))

    def same(a, b, by):
        a, b = (x.toPandas().sort_values(by).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a[b.columns], b, rtol=1e-9, atol=1e-9)

    same(model.fit(), plain.fit(), [*group, "taxon"])
    same(model.fit([1.0, 20.0]), plain.fit([1.0, 20.0]), [*group, "taxon", "gamma"])
    same(model.amp_effs(), plain.amp_effs(), [*group, "taxon"])
    same(model.samples, plain.samples, [*group, "sample"])
    same(model.predict(), plain.predict(), [*group, "sample", "taxon"])
    same(model.obs, plain.obs, [*group, "obs"])
    # a field sample of one set has one row per category, in however many groups it is
    kept = model._cells.where("sample = 'C0'")
    assert kept.select("kind").distinct().collect() == [(0,)]
    assert kept.count() == counts[counts.sample_num == "C0"].taxon.nunique()
