"""Amplification-bias model with the noise of the counts: latent log-ratios by damped Newton rounds.

The closed form of ``biasmodel`` takes log counts as they are, so a shallow sample weighs as much as
a deep one and a zero is half a read. Here the log-ratio of every observation and category is
latent: normal around its line with the category's variance, and the counts are a multinomial of
the shares it stands for. A round

* turns latent values into expected reads and those into weights, ``1 / (variance + 1 / reads)``;
* solves each category's arrowhead of slope and sample intercepts from keyed sums of them;
* moves every latent value towards its mode by at most ``CAP`` and renews the variances.

The state of a round is written (checkpoint), the next round reads nothing else, and one maximum
tells whether to go on. Zeros are information here, so the state has a row for every observation
and category of a group; all sums combine ahead of their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biascomp.functions.numeric import t_quantile
from biascomp.operators.biasmodel import GAMMA, PRIOR_DF, PRIOR_SCALE, SUMMARY, BiasModel
from biascomp.operators.groups import join_on
from biascomp.session import checkpoint

#: Largest move of a latent value in a round, smallest change that calls for another, and most rounds.
CAP, TOLERANCE, ROUNDS = 1.0, 1e-2, 40
#: Latent values and variances stay above these, so that no expected count becomes zero.
LOWEST, LEAST_VARIANCE = -60.0, 1e-9


def _start(model: BiasModel) -> DataFrame:
    """Every observation with every category of its group: log counts as the first latent values."""
    g = model.group
    # read once: everything below starts from these sums
    seen = checkpoint(model.rows.groupBy(*g, "obs", "sample", "x", "taxon").agg(F.sum("n_reads").cast("double").alias("n")))
    obs = seen.groupBy(*g, "obs", "sample", "x").agg(F.sum("n").alias("depth"))
    taxa = seen.select(*g, "taxon").distinct()
    size = obs.groupBy(*g).agg(F.count(F.lit(1)).alias("n_obs"))
    size = join_on(size, taxa.groupBy(*g).agg(F.count(F.lit(1)).alias("n_taxa")), g)
    cells = join_on(obs, join_on(taxa, size, g), g, "inner")
    cells = join_on(cells, seen.select(*g, "obs", "taxon", "n"), [*g, "obs", "taxon"]).na.fill(0.0, ["n"])
    return cells.select(
        *g, "obs", "sample", "taxon", "x", "depth", "n", "n_obs",
        (F.lit(PRIOR_SCALE) * (1 - 1 / F.col("n_taxa"))).alias("prior"),
        F.ln(F.col("n") + F.lit(model.pseudo)).alias("eta"),
        F.lit(1.0).alias("s2"), F.lit(None).cast("double").alias("q"), F.lit(None).cast("double").alias("was"),
        F.lit(None).cast("double").alias("gap"),
    )


def _weighted(state: DataFrame, g: list[str]) -> DataFrame:
    """Centred latent values with their expected reads, weights and working values."""
    level = state.groupBy(*g, "obs").agg(F.avg("eta").alias("__level"), F.sum(F.exp("eta")).alias("__total"))
    cells = join_on(state, level, [*g, "obs"])
    cells = cells.withColumns(
        {
            "eta": F.greatest(F.col("eta") - F.col("__level"), F.lit(LOWEST)),
            "mu": F.col("depth") * F.exp(F.greatest(F.col("eta"), F.col("__level") + LOWEST)) / F.col("__total"),
        }
    ).drop("__level", "__total")
    return cells.withColumns(
        {
            "z": F.col("eta") + (F.col("n") - F.col("mu")) / F.col("mu"),
            "w": 1 / (F.col("s2") + 1 / F.col("mu")),
            "gap": F.abs(F.col("eta") - F.col("was")),
        }
    )


def _sums(cells: DataFrame, g: list[str], gamma: float) -> DataFrame:
    """Per sample and category: weighted sums, ``m`` including the prior of an intercept."""
    x, z, w = F.col("x"), F.col("z"), F.col("w")
    sums = cells.groupBy(*g, "sample", "taxon").agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"),
        F.sum(w * z).alias("swz"), F.sum(w * x * z).alias("swxz"), F.sum("q").alias("q"),
        F.count(F.lit(1)).alias("k"), F.max("s2").alias("s2"), F.max("prior").alias("prior"), F.max("n_obs").alias("n_obs"),
    )
    return sums.withColumn("m", F.col("sw") + 1 / (F.lit(gamma) * F.col("s2")))


def _slopes(sums: DataFrame, g: list[str], gamma: float) -> DataFrame:
    """Per category: slope, its information, and the variance that the last residuals give."""
    df = F.max("n_obs") + PRIOR_DF
    info = F.sum(F.col("swxx") - F.col("swx") * F.col("swx") / F.col("m")) + 1 / (F.lit(gamma) * F.max("s2"))
    score = F.sum(F.col("swxz") - F.col("swx") * F.col("swz") / F.col("m"))
    # the first round has no residuals yet
    left = F.sum("q")
    renewed = F.when(left.isNotNull(), F.greatest((F.max("prior") + left) / df, F.lit(LEAST_VARIANCE))).otherwise(F.max("s2"))
    return sums.groupBy(*g, "taxon").agg(
        (score / info).alias("beta"), info.alias("info"), df.alias("df"), F.max("s2").alias("s2"),
        renewed.alias("next_s2"),
    )


def _round(state: DataFrame, g: list[str], gamma: float) -> DataFrame:
    cells = _weighted(state, g)
    sums = _sums(cells, g, gamma)
    slopes = _slopes(sums, g, gamma).select(*g, "taxon", "beta", "next_s2")
    own = join_on(sums.select(*g, "sample", "taxon", "k", "swx", "swz", "m"), slopes, [*g, "taxon"]).select(
        *g, "sample", "taxon", "beta", "next_s2", "k",
        ((F.col("swz") - F.col("beta") * F.col("swx")) / F.col("m")).alias("alpha"),
    )
    line = F.col("alpha") + F.col("beta") * F.col("x")
    mode = line + F.col("s2") * F.col("w") * (F.col("z") - line)
    move = F.greatest(F.least(mode - F.col("eta"), F.lit(CAP)), F.lit(-CAP))
    # what is left: residual, its uncertainty, and the cell's part of the penalties
    left = F.col("next") - F.col("line")
    penalty = F.col("alpha") * F.col("alpha") / F.col("k") + F.col("beta") * F.col("beta") / F.col("n_obs")
    q = left * left + F.col("s2") * (1 - F.col("s2") * F.col("w")) + penalty / F.lit(gamma)
    moved = join_on(cells, own, [*g, "sample", "taxon"]).withColumns({"line": line, "next": F.col("eta") + move})
    return moved.select(
        *g, "obs", "sample", "taxon", "x", "depth", "n", "n_obs", "prior",
        F.col("next").alias("eta"), F.col("next_s2").alias("s2"), q.alias("q"), F.col("eta").alias("was"), "gap",
    )


def fit(
    model: BiasModel, gamma: float = GAMMA, tolerance: float = TOLERANCE, rounds: int = ROUNDS
) -> DataFrame:
    """Slope per category with its standard error, the variance around the line, and the last change.

    ``gap`` is the largest change of a latent value of the group in the last round: above
    ``tolerance`` the group has not settled within ``rounds``. Rows without reads (NULL or zero) are
    zeros; an empty table gives an empty one.
    """
    g = model.group
    state = checkpoint(_start(model))
    for _ in range(rounds):
        state = checkpoint(_round(state, g, gamma))
        # one number; the first round has no earlier values to compare with
        first, gap = state.agg(F.count(F.when(F.col("gap").isNull(), 1)), F.max("gap")).first()
        if not first and (gap is None or gap < tolerance):
            break
    slopes = _slopes(_sums(_weighted(state, g), g, gamma), g, gamma)
    gaps = state.groupBy(*g).agg(F.max("gap").alias("gap"))
    found = slopes.select(*g, "taxon", "beta", F.sqrt(1 / F.col("info")).alias("beta_se"), "df", F.col("next_s2").alias("scale2"))
    return join_on(found, gaps, g)


def amp_effs(
    model: BiasModel, gamma: float = GAMMA, tolerance: float = TOLERANCE, rounds: int = ROUNDS
) -> DataFrame:
    """Amplification efficiency per category, as ``BiasModel.amp_effs`` gives it, plus ``gap``."""
    found = checkpoint(fit(model, gamma, tolerance, rounds))
    probs = {n: p for n, p in SUMMARY.items() if p != 0.5}
    steps = found.groupBy(*model.group).agg(F.max("df").alias("__df"))
    steps = steps.select(*model.group, *[t_quantile(p, "__df").alias(f"t_{n}") for n, p in probs.items()])

    def at(name: str) -> Column:
        return F.col("beta") + F.col(f"t_{name}") * F.col("beta_se") if name in probs else F.col("beta")

    return join_on(found, steps, model.group).select(
        *model.group, "taxon", *[at(n).alias(n) for n in SUMMARY], F.col("beta").alias("mean_value"), "gap"
    )
