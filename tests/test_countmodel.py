"""The fit with count noise against a plain version, and slopes from shallow samples."""

import numpy as np
import pandas as pd
import pytest

from biascomp.operators import countmodel
from biascomp.operators.biasmodel import BiasModel

TAXA = list("abcdef")
SLOPES = np.array([0.08, -0.05, 0.0, -0.06, 0.05, -0.02])


def simulate(seed, depth, scale=0.5):
    """(size_class, sample_name, sample_num, cycle_num, taxon, n_reads): calibration and field samples."""
    rng = np.random.default_rng(seed)
    base, rows = rng.normal(size=6, scale=scale), []

    def add(obs, sample, cycle, start):
        eta = start + SLOPES * (cycle - 24) + rng.normal(scale=0.1, size=6)
        p = np.exp(eta)
        rows.extend(
            (f"D{seed}", obs, sample, cycle, t, int(n)) for t, n in zip(TAXA, rng.multinomial(depth, p / p.sum())) if n
        )

    for cycle in (20, 24, 28):
        for rep in range(12):
            add(f"{cycle}C.{rep}", "Calibration", cycle, base)
    for s in range(6):
        start = base + rng.normal(scale=0.5, size=6)
        for rep in range(3):
            add(f"C{s}.{rep}", f"C{s}", 30, start)
    return rows


def plain_fit(rows, gamma, centre, rounds):
    """The same rounds on dense arrays; a variance follows from the residuals of the round before."""
    obs = sorted({(r[1], r[2], r[3]) for r in rows})
    at = {o: i for i, o in enumerate(obs)}
    n = np.zeros((len(obs), len(TAXA)))
    for _, o, s, c, t, k in rows:
        n[at[o, s, c], TAXA.index(t)] += k
    x = np.array([o[2] - centre for o in obs], float)[:, None]
    names = sorted({o[1] for o in obs})
    member = np.array([[o[1] == s for s in names] for o in obs], float)
    depth = n.sum(1, keepdims=True)
    eta, s2, rest = np.log(n + 0.5), np.ones(len(TAXA)), None
    for turn in range(rounds + 1):
        eta = eta - eta.mean(1, keepdims=True)
        mu = depth * np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
        w, z, pen = 1 / (s2 + 1 / mu), eta + (n - mu) / mu, 1 / (gamma * s2)
        m, wx, wz = member.T @ w + pen, member.T @ (w * x), member.T @ (w * z)
        info = (w * x * x).sum(0) - (wx * wx / m).sum(0) + pen
        b = ((w * x * z).sum(0) - (wx * wz / m).sum(0)) / info
        a = (wz - b * wx) / m
        following = s2 if rest is None else (3 * (1 - 1 / len(TAXA)) + rest) / (len(obs) + 5)
        if turn == rounds:
            return b, 1 / np.sqrt(info), following
        line = member @ a + x * b
        eta = eta + np.clip(line + s2 * w * (z - line) - eta, -1, 1)
        rest = ((eta - line) ** 2 + s2 * (1 - s2 * w)).sum(0) + ((a * a).sum(0) + b * b) / gamma
        s2 = following


SCHEMA = "size_class string, sample_name string, sample_num string, cycle_num int, taxon string, n_reads long"


@pytest.mark.parametrize("rounds", [1, 5])
def test_rounds_equal_plain_rounds(spark, rounds):
    rows = {f"D{seed}": simulate(seed, 50) for seed in (0, 7)}
    model = BiasModel(spark.createDataFrame(sum(rows.values(), []), SCHEMA), centre=30.0)
    got = countmodel.fit(model, tolerance=0.0, rounds=rounds).toPandas().set_index(["size_class", "taxon"])
    for group, own in rows.items():
        b, se, s2 = plain_fit(own, 20.0, 30.0, rounds)
        mine = got.loc[group].loc[TAXA]
        assert np.allclose(mine.beta, b, atol=1e-9) and np.allclose(mine.beta_se, se) and np.allclose(mine.scale2, s2)


def test_shallow_samples_come_closer_than_log_counts():
    """Sixteen experiments of 50 reads a sample: settled slopes of both models against the true ones.

    The plain rounds stand for the model here, as the test above holds one against the other.
    """
    true, counted, closed = SLOPES - SLOPES.mean(), [], []
    for seed in range(16):
        rows = simulate(seed, 50)
        b, _, _ = plain_fit(rows, 20.0, 30.0, 60)
        counted.append(((b - true) ** 2).mean())
        wide = pd.DataFrame(rows, columns="g obs sample x taxon n".split())
        y = np.log(wide.pivot_table(index=["obs", "sample", "x"], columns="taxon", values="n", fill_value=0) + 0.5)[TAXA]
        design = y.index.to_frame()
        x = np.column_stack([design.x - 30.0, pd.get_dummies(design["sample"])]).astype(float)
        y = y.to_numpy() - y.to_numpy().mean(axis=1, keepdims=True)
        closed.append(((np.linalg.solve(x.T @ x + np.eye(x.shape[1]) / 20, x.T @ y)[0] - true) ** 2).mean())
    assert np.sqrt(np.mean(counted)) < 0.97 * np.sqrt(np.mean(closed))


def test_nulls_single_category_and_empty(spark):
    rows = [("S1", "a", "Calibration", 20, "t", 5), ("S1", "b", "Calibration", 28, "t", 9), (None, "c", "C1", 30, "t", None),
            (None, "d", "C1", 30, "u", 4), (None, "d", "C1", 30, None, 4)]
    got = {(r.size_class, r.taxon): r for r in countmodel.fit(BiasModel(spark.createDataFrame(rows, SCHEMA)), rounds=3).collect()}
    assert set(got) == {("S1", "t"), (None, "u"), (None, None)}
    assert abs(got["S1", "t"].beta) < 1e-9
    assert countmodel.fit(BiasModel(spark.createDataFrame([], SCHEMA))).count() == 0
