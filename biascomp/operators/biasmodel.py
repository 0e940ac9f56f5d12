"""Amplification-bias model: conjugate log-ratio regression from grouped sums.

Per group and category, the centred log-ratio of the counts of an observation is a line in its
cycle number plus one intercept per sample (and an optional run effect). With normal priors of
scale ``gamma`` the coefficient matrix is an arrowhead, so slopes, intercepts, their variances and
the marginal likelihood follow from sums per sample and per category:

* counts that are zero are never stored. ``ln(n + pseudo) - ln(pseudo)`` is zero for them, so all
  sums split into a part shared by every category and a part over the rows that exist;
* the sample sums enter divided by ``n_s + 1/gamma``, where ``n_s`` is a small whole number, so
  they are kept per distinct ``n_s`` and any number of gammas is evaluated on that small table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biascomp.functions.numeric import t_quantile
from biascomp.operators.groups import join_on, spread
from biascomp.operators.reshape import CALIBRATION
from biascomp.session import checkpoint

# Prior degrees of freedom, prior scale and the gammas of the scan.
PRIOR_DF = 5
PRIOR_SCALE = 3.0
PSEUDO_COUNT = 0.5
GAMMA = 20.0
GAMMAS = [
    0.1, 0.25, 0.5, 0.75, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0, 15.0, 20.0, 50.0, 100.0, 200.0, 300.0,
    400.0, 500.0, 700.0, 1000.0,
]
SUMMARY = {"p2_5": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p97_5": 0.975}


#: Samples whose observations differ in their sets up to which the list of them is broadcast.
FEW_SAMPLES = 10_000


@dataclass(frozen=True)
class Columns:
    """Column names of the counts: one row per (group, observation, category).

    ``sets``: overlapping groups. The last group column then holds a number, the same for all rows of
    an observation, and the observation belongs to every group that this place of ``sets`` lists.
    """

    group: Sequence[str] = field(default_factory=lambda: ["size_class"])
    obs: str = "sample_name"
    sample: str = "sample_num"
    category: str = "taxon"
    cycle: str = "cycle_num"
    value: str = "n_reads"
    run: str | None = None
    sets: Sequence[Sequence[str]] | None = None


class BiasModel:
    """Sums behind the fit. The counts are read once, when the first result is asked for."""

    def __init__(
        self, counts: DataFrame, cols: Columns = Columns(), pseudo: float = PSEUDO_COUNT, centre: float = 0.0
    ):
        self.cols, self.centre, self.pseudo = cols, centre, pseudo
        self._fits: dict[float, DataFrame] = {}
        self._posteriors: dict[tuple[float, float, int], DataFrame] = {}
        self._seen: dict[tuple[float, float], DataFrame] = {}
        g = list(cols.group)
        self.group = g
        run = F.col(cols.run).cast("double") if cols.run else F.lit(0.0)
        # a sample may also be summed for one group alone: sets of one, after the given ones
        own = list(dict.fromkeys(v for s in cols.sets or () for v in s))
        self._sets = [*map(list, cols.sets), *([v] for v in own)] if cols.sets is not None else None
        self._rows = counts.where(F.col(cols.value) > 0).select(
            *g,
            F.col(cols.obs).alias("obs"),
            F.col(cols.sample).alias("sample"),
            F.col(cols.category).alias("taxon"),
            (F.col(cols.cycle) - F.lit(centre)).cast("double").alias("x"),
            run.alias("r"),
            F.col(cols.value).alias("n_reads"),
            F.ln(1 + F.col(cols.value) / F.lit(pseudo)).alias("d"),
        )
        self._obs = self._rows.groupBy(*g, "obs", "sample", "x", "r").agg(
            F.sum("d").alias("s"), F.sum("n_reads").alias("depth"), F.count("d").alias("n_seen"),
            F.bool_or(F.col("sample") != CALIBRATION).alias("is_field"),
        )

    def _in_groups(self, df: DataFrame) -> DataFrame:
        """A row for every group of its set; without sets the rows as they are."""
        if self._sets is None:
            return df
        groups = F.array(*[F.array(*map(F.lit, s)) for s in self._sets])
        return df.withColumn(self.group[-1], F.explode(F.get(groups, F.col(self.group[-1]))))

    @property
    def rows(self) -> DataFrame:
        """Counts above zero and their logs, per group."""
        return self._in_groups(self._rows)

    @property
    def obs(self) -> DataFrame:
        """Per observation: log counts of all categories added up; over the number of categories it
        is the centre of the observation."""
        return self._in_groups(self._obs)

    @property
    def cells(self) -> DataFrame:
        """Per group, sample and category with reads: own sums."""
        return self._in_groups(self._cells)

    @cached_property
    def _cells(self) -> DataFrame:
        """Per sample and category with reads: own sums. Written once, read by every result.

        With sets, a sample's sums are kept per set and not per group, so the counts are never
        multiplied by their groups. A sample whose observations differ in their sets has sums per
        group instead, as a group needs all its observations in one sum.
        """
        cells = self._set_cells()
        if self._sets is None:
            return cells
        fixed, last, keys = self.group[:-1], self.group[-1], [*self.group[:-1], "sample"]
        mixed = cells.groupBy(*keys).agg(F.min(last).alias("low"), F.max(last).alias("high"))
        mixed = checkpoint(mixed.where("low < high").select(*keys))
        if mixed.limit(FEW_SAMPLES + 1).count() <= FEW_SAMPLES:  # one number for the driver
            mixed = F.broadcast(mixed)
        place = {s[0]: k for k, s in enumerate(self._sets) if len(s) == 1}
        number = F.element_at(F.create_map(*[F.lit(x) for pair in place.items() for x in pair]), F.col(last))
        sums = [c for c in cells.columns if c not in (*self.group, "sample", "taxon")]
        apart = self._in_groups(join_on(cells, mixed, keys, "left_semi")).groupBy(*fixed, last, "sample", "taxon")
        apart = apart.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(last, number)
        return join_on(cells, mixed, keys, "left_anti").unionByName(checkpoint(apart))

    def _set_cells(self) -> DataFrame:
        """Sums per sample and category, samples apart by their sets.

        Terms of an observation that do not depend on the category are spread evenly over the
        categories seen in it (weight ``w``), so that adding up a sample's rows gives them back and
        the counts are read a single time.
        """
        g = self.group
        x, r, d, s, w = (F.col(c) for c in ("x", "r", "d", "s", "w"))
        of_run = {"rd0": r * d, "rw": r * w, "xrw": x * r * w, "rrw": r * r * w}
        if self.cols.run is None:  # all zero, neither shuffled nor written
            sums, zero = {}, {n: F.lit(0.0) for n in of_run}
        else:
            sums, zero = of_run, {}
        centre = self._obs.select(*g, "obs", "s", (1 / F.col("n_seen")).alias("w"))
        cells = join_on(self._rows, centre, [*g, "obs"]).groupBy(*g, "sample", "taxon").agg(
            F.sum(d).alias("sd"), F.sum(x * d).alias("xd0"), F.sum(s * d).alias("sd0"), F.sum(d * d).alias("d20"),
            F.sum(w).alias("kw"), F.sum(x * w).alias("xw"), F.sum(x * x * w).alias("xxw"),
            *[F.sum(c).alias(n) for n, c in sums.items()],
        )
        return checkpoint(cells).withColumns(zero)

    @property
    def samples(self) -> DataFrame:
        """Per group and sample: number of observations and sums shared by all categories."""
        return self._in_groups(self._samples)

    @property
    def _samples(self) -> DataFrame:
        return self._cells.groupBy(*self.group, "sample").agg(
            F.round(F.sum("kw")).cast("long").alias("k"),
            F.sum("xw").alias("sx"), F.sum("rw").alias("sr"), F.sum("sd").alias("ss"),
            F.sum("xxw").alias("xx0"), F.sum("xrw").alias("xr0"), F.sum("rrw").alias("rr0"),
            F.sum("xd0").alias("xs0"), F.sum("rd0").alias("rs0"), F.sum("sd0").alias("s20"),
        )

    def n_taxa(self) -> DataFrame:
        """Categories with reads per group."""
        taxa = self._cells.select(*self.group, "taxon").distinct()
        if self._sets is not None:
            taxa = self._in_groups(taxa).distinct()
        return taxa.groupBy(*self.group).agg(F.count("taxon").alias("n_taxa"))

    def _over_m(
        self, df: DataFrame, keys: list[str], gammas: Sequence[float], over: dict[str, Column], plain: list[str],
        per_k: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Sums per key and gamma: ``over`` divided by ``k + 1/gamma``, ``plain`` as they are.

        One gamma takes one aggregation. Several are evaluated on sums kept per distinct k, so that
        the scan multiplies a small table and never the data.
        """
        per_k = per_k or {}
        if len(gammas) == 1:
            df, first = df.withColumn("gamma", F.lit(float(gammas[0]))), over
        else:
            sums = [F.sum(c).alias(n) for n, c in over.items()] + [F.sum(c).alias(c) for c in plain]
            df = df.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("__s"), *sums)
            df = df.withColumn("gamma", F.explode(F.array(*[F.lit(float(v)) for v in gammas])))
            first = {n: F.col(n) for n in over}
        m = F.col("k") + 1 / F.col("gamma")
        weight = F.lit(1) if len(gammas) == 1 else F.col("__s")
        out = df.groupBy(*keys, "gamma").agg(
            *[F.sum(c / m).alias(f"{n}_m") for n, c in first.items()],
            *[F.sum(c).alias(c) for c in plain],
            *[F.sum(weight * c).alias(n) for n, c in per_k.items()],
        )
        if self._sets is None:
            return out
        sums = [c for c in out.columns if c not in (*keys, "gamma")]
        return self._in_groups(out).groupBy(*keys, "gamma").agg(*[F.sum(c).alias(c) for c in sums])

    def fit(self, gammas: Sequence[float] = (GAMMA,)) -> DataFrame:
        """Slope, variance factors, scale and log marginal likelihood per category and gamma."""
        g = self.group
        sx, sr, ss, sd = (F.col(c) for c in ("sx", "sr", "ss", "sd"))
        shared = self._over_m(
            self._samples, g, gammas,
            {"xx": sx * sx, "xr": sx * sr, "rr": sr * sr, "xs": sx * ss, "rs": sr * ss, "ss": ss * ss},
            ["xx0", "xr0", "rr0", "xs0", "rs0", "s20"],
            {"n_samples": F.lit(1), "n_obs": F.col("k"), "ln_m": F.ln(F.col("k") + 1 / F.col("gamma"))},
        )
        own = join_on(self._cells, self._samples.select(*g, "sample", "k", "sx", "sr", "ss"), [*g, "sample"])
        over, plain = {"xd": sx * sd, "rd": sr * sd, "sd": ss * sd, "dd": sd * sd}, ["xd0", "rd0", "sd0", "d20"]
        if len(gammas) == 1:
            # what is left of each sum, taken before they are added up: half the columns
            m = F.col("k") + F.lit(1 / gammas[0])
            left = [(F.col(p) - c / m).alias(n) for (n, c), p in zip(over.items(), plain)]
            own = self._over_m(own.select(*g, "taxon", "k", *left), [*g, "taxon"], gammas, {}, list(over))
        else:
            own = self._over_m(own, [*g, "taxon"], gammas, over, plain)
            own = own.withColumns({n: F.col(p) - F.col(f"{n}_m") for n, p in zip(over, plain)})
        t = join_on(own, join_on(shared, self.n_taxa(), g), [*g, "gamma"])
        inv, n = 1 / F.col("gamma"), F.col("n_taxa")
        c = {name: F.col(name) for name in t.columns}
        det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
        t = t.withColumns(
            {
                "a11": c["xx0"] + inv - c["xx_m"],
                "a12": c["xr0"] - c["xr_m"],
                "a22": c["rr0"] + inv - c["rr_m"],
                "c1": (c["xs_m"] - c["xs0"]) / n + c["xd"],
                "c2": (c["rs_m"] - c["rs0"]) / n + c["rd"],
                "yy": (c["s20"] - c["ss_m"]) / (n * n) - c["sd"] * 2 / n + c["dd"],
            }
        ).withColumn("det", det)
        t = t.withColumns(
            {
                "beta": (F.col("c1") * F.col("a22") - F.col("c2") * F.col("a12")) / F.col("det"),
                "beta_run": (F.col("c2") * F.col("a11") - F.col("c1") * F.col("a12")) / F.col("det"),
            }
        )
        # residual plus penalty: what the coefficients leave of the sum of squares
        left = F.col("yy") - F.col("beta") * F.col("c1") - F.col("beta_run") * F.col("c2")
        q = F.greatest(left, F.lit(0.0))
        prior = PRIOR_SCALE * (1 - 1 / n)
        df = F.col("n_obs") + PRIOR_DF
        log_det = F.col("ln_m") + F.ln("det") + (F.col("n_samples") + 2) * F.ln("gamma")
        return t.select(
            *g, "taxon", "gamma", "n_obs", "n_samples", "n_taxa", "beta", "beta_run",
            (F.col("a22") / F.col("det")).alias("v11"),
            (-F.col("a12") / F.col("det")).alias("v12"),
            (F.col("a11") / F.col("det")).alias("v22"),
            df.alias("df"),
            ((prior + q) / df).alias("scale2"),
            (-0.5 * log_det - 0.5 * df * F.ln(1 + F.coalesce(F.try_divide(q, prior), F.lit(0.0)))).alias("log_ml"),
        )

    def gamma_scan(self, gammas: Sequence[float] = tuple(GAMMAS)) -> DataFrame:
        """Log marginal likelihood per gamma, added over categories, and the best gamma."""
        total = self.fit(gammas).groupBy(*self.group, "gamma").agg(F.sum("log_ml").alias("log_ml"))
        best = total.groupBy(*self.group).agg(F.max_by("gamma", "log_ml").alias("best_gamma"))
        return join_on(total, best, self.group).withColumn("is_best", F.col("gamma") == F.col("best_gamma"))

    def amp_effs(self, gamma: float = GAMMA) -> DataFrame:
        """Amplification efficiency per category: cycle slope with its posterior quantiles."""
        steps = {n: p for n, p in SUMMARY.items() if p != 0.5}
        fit = join_on(self.fitted(gamma), self._t_steps(gamma, {f"t_{n}": p for n, p in steps.items()}), self.group)
        sd = F.sqrt(F.col("scale2") * F.col("v11"))
        quant = {n: F.col("beta") + F.col(f"t_{n}") * sd if n in steps else F.col("beta") for n in SUMMARY}
        return fit.select(
            *self.group, "taxon", *[c.alias(n) for n, c in quant.items()], F.col("beta").alias("mean_value")
        )

    def field_share(self, gamma: float = GAMMA) -> DataFrame:
        """How much of the slope's information comes from samples that never vary in cycle."""
        info = F.col("xx0") - F.col("sx") * F.col("sx") / (F.col("k") + F.lit(1 / gamma))
        own = F.sum(F.when(F.col("sample") != CALIBRATION, info).otherwise(0.0))
        return self.samples.groupBy(*self.group).agg((own / (F.sum(info) + F.lit(1 / gamma))).alias("field_share"))

    # ------------------------------------------------------------------ predictions

    def fitted(self, gamma: float = GAMMA) -> DataFrame:
        """The fit at one gamma, one row per category, written once for all that reads it."""
        if gamma not in self._fits:
            self._fits[gamma] = checkpoint(self.fit([gamma]))
        return self._fits[gamma]

    def _wide(self, gamma: float) -> bool:
        """Whether a group has more categories than one block holds; one number for the driver."""
        return (self.fitted(gamma).agg(F.max("n_taxa").alias("n")).first()["n"] or 0) > BLOCK

    def _t_steps(self, gamma: float, probs: dict[str, float]) -> DataFrame:
        """Student-t quantiles per group. All categories of a group have the same degrees of freedom,
        so the quadrature behind a quantile runs once per group and never per row."""
        df = self.fitted(gamma).groupBy(*self.group).agg(F.max("df").alias("df"))
        return df.select(*self.group, *[t_quantile(p, "df").alias(n) for n, p in probs.items()])

    def _designs(self, gamma: float, x0: float, r0: float) -> tuple[DataFrame, DataFrame]:
        """Field samples, and the distinct designs (observations and cycles) among them with what a line needs."""
        g, m = self.group, F.col("k") + F.lit(1 / gamma)
        # sums of whole cycles carry rounding noise that would tell equal designs apart
        samples = self.samples.where(F.col("sample") != CALIBRATION).select(
            *g, "sample", "k", F.round("sx", 9).alias("sx"), F.round("sr", 9).alias("sr"), "ss"
        )
        spans = self.fitted(gamma).groupBy(*g).agg(
            F.max("n_taxa").alias("n_taxa"),
            *[f(c).alias(f"{n}_{c}") for c in ("beta", "beta_run") for n, f in (("low", F.min), ("high", F.max))],
        )
        highest = [
            F.greatest(F.col(f"low_{c}") * F.col(d), F.col(f"high_{c}") * F.col(d)) for c, d in (("beta", "dx"), ("beta_run", "dr"))
        ]
        designs = join_on(samples.select(*g, "k", "sx", "sr").distinct(), spans, g).withColumns(
            {"m": m, "dx": F.lit(x0) - F.col("sx") / m, "dr": F.lit(r0) - F.col("sr") / m}
        ).withColumn("top", highest[0] + highest[1])
        return samples, designs.select(*g, "k", "sx", "sr", "n_taxa", "m", "dx", "dr", "top")

    def _totals(self, gamma: float, x0: float, r0: float) -> DataFrame:
        """Per field sample: what its line needs and the total of its shares before they become one.

        Log counts are positive, so a category with reads only adds to what it would weigh without
        any. The weights without reads depend on the sample's cycles alone: they are added up over
        all categories once per distinct design, and a sample adds what its own categories have on
        top. No sample is laid out over all categories. ``top`` keeps the exponentials in range.
        """
        g, slopes = self.group, self.fitted(gamma).select(*self.group, "taxon", "beta", "beta_run")
        samples = self._floors(gamma, x0, r0)
        plain = F.exp(F.col("beta") * F.col("dx") + F.col("beta_run") * F.col("dr") - F.col("top"))
        own = join_on(self.cells.select(*g, "sample", "taxon", "sd"), samples, [*g, "sample"], "inner")
        more = join_on(own, slopes, [*g, "taxon"]).groupBy(*g, "sample").agg(
            F.sum(plain * F.expm1(F.col("sd") / F.col("m"))).alias("more")
        )
        total = F.col("floor") + F.col("more")
        return join_on(samples, more, [*g, "sample"]).withColumn("total", total).drop("k", "sx", "sr", "floor", "more")

    def _floors(self, gamma: float, x0: float, r0: float) -> DataFrame:
        """Field samples with what their line needs and the total weight of all categories without reads."""
        g, design = self.group, [*self.group, "k", "sx", "sr"]
        samples, designs = self._designs(gamma, x0, r0)
        slopes = self.fitted(gamma).select(*g, "taxon", "beta", "beta_run")
        plain = F.exp(F.col("beta") * F.col("dx") + F.col("beta_run") * F.col("dr") - F.col("top"))
        floors = join_on(designs, slopes, g).groupBy(*designs.columns).agg(F.sum(plain).alias("floor"))
        return join_on(samples, floors, design)

    def _own_lines(self, gamma: float, at_cycle: float) -> tuple[DataFrame, DataFrame]:
        """Field samples with their lines and blocks, and their categories with reads.

        ``at`` is a category's log weight, ``gain`` the part of the weight that its reads add, ``shift``
        takes ``at`` to the log-ratio.
        """
        g, keys = self.group, [*self.group, "sample"]
        field = self.cells.where(F.col("sample") != CALIBRATION).select(*keys, "taxon", "sd")
        sizes = field.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        dx, dr, m, sd = F.col("dx"), F.col("dr"), F.col("m"), F.col("sd")
        lines = join_on(self._floors(gamma, float(at_cycle) - self.centre, 0.0), sizes, keys).withColumn(
            "shift", F.col("top") - F.col("ss") / F.col("n_taxa") / m
        ).drop("ss", "n_taxa")
        fit = self.fitted(gamma).select(*g, "taxon", "beta", "beta_run", "v11", "v12", "v22", "scale2", "df")
        var = 1 / m + dx * dx * F.col("v11") + 2 * dx * dr * F.col("v12") + dr * dr * F.col("v22")
        own = join_on(join_on(field, lines.drop("k", "sx", "sr"), keys, "inner"), fit, [*g, "taxon"]).select(
            *keys, "taxon", (F.col("beta") * dx + F.col("beta_run") * dr - F.col("top") + sd / m).alias("at"),
            F.sqrt(F.col("scale2") * var).alias("spread"), F.col("df").cast("double").alias("df"), (-F.expm1(-sd / m)).alias("gain"),
            "shift", "floor", "blocks",
        )
        return lines, own

    def _written_seen(self, gamma: float, at_cycle: float, rows: DataFrame) -> DataFrame:
        """Rows of ``_own_lines``, the rows of a sample together, with the total of its shares.

        Written once for draws and predictions. The total needs no further shuffle, and what reads the
        rows finds the samples whole and in order.
        """
        keys = [*self.group, "sample"]
        more = F.sum(F.exp("at") * F.col("gain")).over(Window.partitionBy(*keys))
        known = (gamma, float(at_cycle))
        self._seen[known] = checkpoint(_together(rows, keys).withColumn("total", F.col("floor") + more).drop("floor"))
        return self._seen[known]

    def predict(
        self, gamma: float = GAMMA, at_cycle: float = 0.0, level: float = 0.95, seen_only: bool = False
    ) -> DataFrame:
        """Corrected share per field sample and category, with an interval.

        The share is the softmax of the mean log-ratios over all categories. Its interval moves the
        category's own log-ratio to its interval ends while the others stay at their means. A
        category without reads in a sample has a share, too; ``seen_only`` leaves those rows out, so
        that the result is as sparse as the counts, with the same shares.
        """
        g = self.group
        step = self._t_steps(gamma, {"t_step": 1 - (1 - level) / 2})
        if seen_only:
            return self._predict_seen(gamma, at_cycle, step)
        totals = join_on(self._totals(gamma, float(at_cycle) - self.centre, 0.0), step, g)
        own = self.cells.select(*g, "sample", "taxon", "sd")
        fit = self.fitted(gamma).drop("n_taxa", "n_obs", "n_samples", "gamma", "log_ml", "df")
        rows = join_on(join_on(totals, fit, g), own, [*g, "sample", "taxon"])
        dx, dr, m = F.col("dx"), F.col("dr"), F.col("m")
        sd = F.coalesce("sd", F.lit(0.0))
        line = F.col("beta") * dx + F.col("beta_run") * dr
        var = 1 / m + dx * dx * F.col("v11") + 2 * dx * dr * F.col("v12") + dr * dr * F.col("v22")
        rows = rows.withColumns(
            {
                "eta": (sd - F.col("ss") / F.col("n_taxa")) / m + line,
                "e": F.exp(line + sd / m - F.col("top")),
                "h": F.col("t_step") * F.sqrt(F.col("scale2") * var),
            }
        )
        return self._with_intervals(rows)

    def _predict_seen(self, gamma: float, at_cycle: float, step: DataFrame) -> DataFrame:
        """Predictions of the categories with reads, from the rows that the draws read, too."""
        known = (gamma, float(at_cycle))
        rows = self._seen.get(known)
        if rows is None:
            rows = self._written_seen(gamma, at_cycle, self._own_lines(gamma, at_cycle)[1])
        step = checkpoint(step)
        if step.limit(FEW_SAMPLES + 1).count() <= FEW_SAMPLES:  # one number for the driver
            step = F.broadcast(step)
        rows = rows.where("seen") if "seen" in rows.columns else rows
        return self._with_intervals(
            join_on(rows, step, self.group).withColumns(
                {"eta": F.col("at") + F.col("shift"), "e": F.exp("at"), "h": F.col("t_step") * F.col("spread")}
            )
        )

    def _with_intervals(self, rows: DataFrame) -> DataFrame:
        """Shares and log-ratios, with the ends of their intervals."""
        e, h, eta = F.col("e"), F.col("h"), F.col("eta")
        rest = F.greatest(F.col("total") - e, F.lit(0.0))

        def moved(step: Column) -> Column:
            v = e * F.exp(step)
            return v / (v + rest)

        return rows.select(
            *self.group, "sample", "taxon",
            (e / F.col("total")).alias("share"), moved(-h).alias("share_low"), moved(h).alias("share_high"),
            eta.alias("clr"), (eta - h).alias("clr_low"), (eta + h).alias("clr_high"),
        )

    def predicted_and_observed(self, gamma: float = GAMMA, observed_cycle: int = 30) -> DataFrame:
        """Corrected rows at cycle 0 over the observed shares of every replicate of the sample."""
        predicted = self.predict(gamma).select(
            *self.group, "sample", "taxon", F.lit(0).alias("cycle_num"), "share", "share_low", "share_high",
            F.concat(F.lit("predicted "), "sample").alias("replicate"),
        )
        depth = self.obs.select(*self.group, "obs", "depth", "is_field")
        observed = join_on(self.rows, depth, [*self.group, "obs"]).where("is_field").select(
            *self.group, "sample", "taxon", F.lit(observed_cycle).alias("cycle_num"),
            (F.col("n_reads") / F.col("depth")).alias("share"), F.col("obs").alias("replicate"),
        )
        return predicted.unionByName(observed, allowMissingColumns=True)

    def _posterior_rows(self, gamma: float, at_cycle: float, seed: int) -> DataFrame:
        """Per field sample and category: place and spread of its log weight, random key and block.

        ``at`` is the log weight up to a constant of the sample, in range for an exponential. Written
        once, the rows of a sample together and by category, for all that reads it.
        """
        known = (gamma, float(at_cycle), seed)
        if known not in self._posteriors:
            g, keys = self.group, [*self.group, "sample"]
            totals = self._totals(gamma, float(at_cycle) - self.centre, 0.0)
            rows = join_on(join_on(totals, self.fitted(gamma).drop("n_taxa"), g), self.cells.select(*keys, "taxon", "sd"), [*keys, "taxon"])
            dx, dr, m = F.col("dx"), F.col("dr"), F.col("m")
            at = F.col("beta") * dx + F.col("beta_run") * dr + F.coalesce("sd", F.lit(0.0)) / m - F.col("top")
            var = 1 / m + dx * dx * F.col("v11") + 2 * dx * dr * F.col("v12") + dr * dr * F.col("v22")
            rows = rows.select(
                *keys, "taxon", at.alias("at"), F.sqrt(F.col("scale2") * var).alias("spread"), F.col("df").cast("double").alias("df"),
                F.log("total").alias("ln_total"), F.col("sd").isNotNull().alias("seen"), *_blocked(keys, seed),
            )
            self._posteriors[known] = checkpoint(_together(rows, keys))
        return self._posteriors[known]

    def draws(
        self, gamma: float = GAMMA, n: int = 1000, seed: int = 0, at_cycle: float = 0.0, seen_only: bool = False
    ) -> DataFrame:
        """Monte-Carlo summaries of the corrected shares: mean, standard deviation and quantiles.

        Categories are drawn independently from their t marginals, then brought to one per draw. Every
        (sample, category) has a random stream of its own, so a draw can be made twice and nowhere are
        more than ``BLOCK`` categories of a sample laid out: a sample of one block is drawn and divided in
        one go; otherwise a task adds up the draws of one block, the blocks of a sample are added as
        vectors, and a second pass divides by the joined totals.
        ``seen_only`` returns the categories with reads; the others still count in the totals.
        """
        def work(block: pd.DataFrame) -> np.ndarray:
            return _weights(block, n)

        def add(w: np.ndarray) -> np.ndarray:
            return w.sum(axis=0)

        rows = self._posterior_rows(gamma, at_cycle, seed)
        return _over_totals(
            rows, [*self.group, "sample"], work, add, _summaries, ["mean_value", "sd_value", *SUMMARY], self._wide(gamma),
            "seen" if seen_only else None,
        )

    def draws_seen(self, gamma: float = GAMMA, n: int = 1000, seed: int = 0, at_cycle: float = 0.0) -> DataFrame:
        """Summaries as in ``draws`` for the categories with reads, by work that follows the counts.

        A category has one random stream for all samples. What the categories weigh without reads then
        depends on a sample's design alone: it is drawn once per design, and a sample adds what its own
        categories have on top, as in the totals of ``predict``. Within a sample the categories are still
        drawn independently from their t marginals, so its summaries estimate the same values; the
        errors of different samples are no longer independent of each other, as those of ``draws`` are.
        """
        g, keys, design = self.group, [*self.group, "sample"], [*self.group, "k", "sx", "sr"]
        designs = self._designs(gamma, float(at_cycle) - self.centre, 0.0)[1]
        fit = self.fitted(gamma).drop("n_taxa")
        dx, dr, m = F.col("dx"), F.col("dr"), F.col("m")
        plain = F.col("beta") * dx + F.col("beta_run") * dr - F.col("top")
        var = 1 / m + dx * dx * F.col("v11") + 2 * dx * dr * F.col("v12") + dr * dr * F.col("v22")
        key = F.xxhash64(*g, "taxon", F.lit(seed)).alias("key")
        drawn = [F.sqrt(F.col("scale2") * var).alias("spread"), F.col("df").cast("double").alias("df"), key]

        def blocked(blocks: Column) -> list[Column]:
            return [F.pmod(F.xxhash64("taxon"), blocks).cast("int").alias("block"), blocks.alias("blocks")]

        def work(block: pd.DataFrame) -> np.ndarray:
            """Weights, and in the last column the part of a weight that its reads add."""
            out = np.column_stack([_weights(block, n), block["gain"].to_numpy()])
            for i in np.flatnonzero(block["drawn"].notna().to_numpy()):
                out[i, :n] = block["drawn"].iloc[i]
            return out

        def add(w: np.ndarray) -> np.ndarray:
            return (w[:, :n] * w[:, n:]).sum(axis=0)

        def summaries(w: np.ndarray, total: np.ndarray) -> np.ndarray:
            return _summaries(w[:, :n], total)

        floors = _block_sums(
            join_on(designs, fit, g).select(*design, "taxon", plain.alias("at"), *drawn, *blocked(F.greatest(F.ceil(F.col("n_taxa") / BLOCK), F.lit(1)).cast("int"))),
            design, lambda block: _weights(block, n).sum(axis=0),
        ).select(*design, F.col("v").alias("drawn"))
        lines, own = self._own_lines(gamma, at_cycle)
        own = own.withColumns({"drawn": F.lit(None).cast("array<double>"), "seen": F.lit(True)})
        # the draws of the design, once per sample
        zero = {"at": 0.0, "spread": 0.0, "df": 1.0, "gain": 0.0}
        base = join_on(lines, floors, design).withColumns(
            {"taxon": F.lit(None).cast(own.schema["taxon"].dataType), "seen": F.lit(False)} | {c: F.lit(v) for c, v in zero.items()}
        )
        rows = self._written_seen(gamma, at_cycle, own.unionByName(base.select(*own.columns)))
        wide = (rows.agg(F.max("blocks").alias("n")).first()["n"] or 0) > 1
        block, blocks = blocked(F.col("blocks"))
        rows = rows.withColumn("gain", F.when(F.col("seen"), F.col("gain")).otherwise(1.0)).select(
            *keys, "taxon", "at", "spread", "df", "gain", "drawn", "seen", key, F.when(F.col("seen"), block).otherwise(0).alias("block"), blocks
        )
        return _over_totals(rows, keys, work, add, summaries, ["mean_value", "sd_value", *SUMMARY], wide, "seen")

    def expected_shares(self, gamma: float = GAMMA, at_cycle: float = 0.0) -> DataFrame:
        """What the mean of ``draws`` tends to, by quadrature instead of draws.

        With independent weights e, the mean of e_i / sum(e) is the integral over s of
        E[e_i exp(-s e_i)] times the product of E[exp(-s e_j)] over all others, so the logs of those
        factors add up by sample on a grid of ln(s), in the same passes as the draws.
        """
        def factors(block: pd.DataFrame) -> np.ndarray:
            """E[exp(-s e)] and E[s e exp(-s e)] per category and grid point."""
            t, df = np.arange(-9, 9.01, 0.25), block["df"].to_numpy()
            weights = {v: (1 + t * t / v) ** (-(v + 1) / 2) for v in set(df)}
            ln_s = GRID - block["ln_total"].iloc[0]
            out = np.empty((len(block), 2, len(GRID)))
            for i, (at, spread, v) in enumerate(zip(block["at"].to_numpy(), block["spread"].to_numpy(), df)):
                # the exponential of a sum as a product, kept in range
                x = np.exp(np.clip(ln_s + at, -700.0, 700.0))[:, None] * np.exp(np.clip(spread * t, -700.0, 700.0))
                np.minimum(x, 1e300, out=x)
                fall = np.exp(-x)
                out[i, 0], out[i, 1] = fall @ weights[v], np.multiply(x, fall, out=x) @ weights[v]
                out[i] /= weights[v].sum()
            np.maximum(out[:, 0], 1e-300, out=out[:, 0])
            return out

        def add(found: np.ndarray) -> np.ndarray:
            return np.log(found[:, 0]).sum(axis=0)

        def integrate(found: np.ndarray, total: np.ndarray) -> np.ndarray:
            return ((found[:, 1] / found[:, 0] * np.exp(total)).sum(axis=1) * (GRID[1] - GRID[0]))[:, None]

        rows = self._posterior_rows(gamma, at_cycle, 0)
        return _over_totals(rows, [*self.group, "sample"], factors, add, integrate, ["expected"], self._wide(gamma))

    # ------------------------------------------------------------------ checks of the fit

    def _lines(self, gamma: float) -> DataFrame:
        """Per observation: its sample's sums and where its line is read off."""
        g = self.group
        samples = self.samples.select(*g, "sample", "k", "sx", "sr", "ss")
        m = F.col("k") + F.lit(1 / gamma)
        lines = join_on(self.obs.drop("is_field", "n_seen"), samples, [*g, "sample"])
        return lines.withColumns({"m": m, "dx": F.col("x") - F.col("sx") / m, "dr": F.col("r") - F.col("sr") / m})

    def residual_covariance(self, gamma: float = GAMMA) -> DataFrame:
        """Covariance of the residuals of every pair of categories.

        A residual is u + a + b * beta + c * beta_run, where a, b and c belong to the observation and u
        is zero for categories without reads in the sample. Cross products therefore need sums per
        category, a few numbers per group, and the products of the u alone. Those are added up by pairs
        of blocks of categories and chunks of observations: a task holds one small matrix, never all
        categories, and the work follows the counts that exist.
        """
        g = self.group
        fit = self.fitted(gamma).select(*g, "taxon", "beta", "beta_run")
        lines = join_on(self._lines(gamma), self.n_taxa(), g).select(
            *g, "obs", "sample", "m", (F.col("ss") / F.col("m") / F.col("n_taxa") - F.col("s") / F.col("n_taxa")).alias("a"),
            (-F.col("dx")).alias("b"), (-F.col("dr")).alias("c"), "n_taxa",
        )
        own = join_on(self.cells.select(*g, "sample", "taxon", "sd"), lines, [*g, "sample"], "inner")
        d = self.rows.select(*g, "obs", "taxon", "d")
        u = join_on(own, d, [*g, "obs", "taxon"]).select(
            *g, "obs", "taxon", "a", "b", "c", "n_taxa", (F.coalesce("d", F.lit(0.0)) - F.col("sd") / F.col("m")).alias("u")
        )
        u = checkpoint(u)
        names = {"aa": "a*a", "ab": "a*b", "ac": "a*c", "bb": "b*b", "bc": "b*c", "cc": "c*c", "a": "a", "b": "b", "c": "c"}
        whole = lines.groupBy(*g).agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(f"s_{k}") for k, e in names.items()])
        each = u.groupBy(*g, "taxon").agg(F.sum("u").alias("u"), *[F.sum(F.col("u") * F.col(c)).alias(f"u{c}") for c in "abc"])
        each = join_on(fit, each, [*g, "taxon"])
        left = each.withColumnsRenamed({c: f"{c}_1" for c in ("beta", "beta_run", "u", "ua", "ub", "uc")})
        right = each.withColumnsRenamed({c: f"{c}_2" for c in ("taxon", "beta", "beta_run", "u", "ua", "ub", "uc")})
        pairs = join_on(left, right.withColumnRenamed("taxon_2", "taxon2"), g).where("taxon <= taxon2")
        pairs = join_on(join_on(pairs, whole, g), _block_products(u, g), [*g, "taxon", "taxon2"])
        s12 = F.expr(
            "coalesce(s12, 0) + ua_1 + beta_2*ub_1 + beta_run_2*uc_1 + ua_2 + beta_1*ub_2 + beta_run_1*uc_2"
            " + s_aa + (beta_1+beta_2)*s_ab + (beta_run_1+beta_run_2)*s_ac + beta_1*beta_2*s_bb"
            " + (beta_1*beta_run_2+beta_run_1*beta_2)*s_bc + beta_run_1*beta_run_2*s_cc"
        )
        s1, s2 = (F.expr(f"u_{k} + s_a + beta_{k}*s_b + beta_run_{k}*s_c") for k in (1, 2))
        return pairs.select(*g, "taxon", "taxon2", "n", ((s12 - s1 * s2 / F.col("n")) / (F.col("n") - 1)).alias("covariance"))

    def posterior_predictive(self, gamma: float = GAMMA, n: int = 500, seed: int = 0) -> DataFrame:
        """Observed counts beside the interval of counts the fitted model predicts, largest count first (``place``).

        Each draw of the shares is followed by a draw of as many reads as the observation has: the reads
        are dealt over blocks of categories by conditional binomials on the joined totals, then within
        each block. An observation of one block is dealt in one go; none is laid out over more categories.
        """
        g = self.group
        keys = [*g, "obs"]
        rows = join_on(self._lines(gamma), self.fitted(gamma), g)
        rows = join_on(rows, self.cells.select(*g, "sample", "taxon", "sd"), [*g, "sample", "taxon"])
        rows = join_on(rows, self.rows.select(*keys, "taxon", "n_reads"), [*keys, "taxon"])
        dx, dr, m = F.col("dx"), F.col("dr"), F.col("m")
        at = F.col("beta") * dx + F.col("beta_run") * dr + F.coalesce("sd", F.lit(0.0)) / m
        var = 1 + 1 / m + dx * dx * F.col("v11") + 2 * dx * dr * F.col("v12") + dr * dr * F.col("v22")
        rows = rows.select(
            *keys, "taxon", F.coalesce("n_reads", F.lit(0)).cast("long").alias("observed"), "depth", at.alias("at"),
            F.sqrt(F.col("scale2") * var).alias("spread"), F.col("df").cast("double").alias("df"), *_blocked(keys, seed),
        )
        fields = {f.name: f.dataType.simpleString() for f in rows.schema}
        named = ", ".join(f"`{k}` {fields[k]}" for k in keys)
        found = f"{named}, taxon {fields['taxon']}, observed long, p2_5 double, p50 double, p97_5 double"
        covered = F.col("observed").between(F.col("p2_5"), F.col("p97_5"))

        def counted(block: pd.DataFrame, reads: np.ndarray) -> np.ndarray:
            """Interval of the counts of a block's categories, in the order of the categories."""
            w = _weights(block, n)
            counts = _stream(int(block["key"].min())).multinomial(reads, (w / w.sum(axis=0)).T)
            return _quantiles(np.sort(np.ascontiguousarray(counts.T), axis=1), [0.025, 0.5, 0.975])

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame, ends in _whole_keys(frames, keys):
                none, depth, observed = frame["taxon"].isna().to_numpy(), frame["depth"].to_numpy(), frame["observed"].to_numpy()
                values, place = np.empty((len(frame), 3)), np.empty(len(frame), np.int32)
                for a, b in zip(ends[:-1], ends[1:]):
                    values[a:b] = counted(frame.iloc[a:b], np.full(n, int(depth[a])))
                    by = np.lexsort((np.where(none[a:b], -1, np.arange(b - a)), -observed[a:b]))
                    place[a + by] = np.arange(1, b - a + 1)
                out = frame[[*keys, "taxon", "observed"]]
                yield out.assign(p2_5=values[:, 0], p50=values[:, 1], p97_5=values[:, 2], place=place)

        def in_one(rows: DataFrame) -> DataFrame:
            out = _together(rows, keys).mapInPandas(whole, f"{found}, place int")
            return out.select(*out.columns[:-1], covered.alias("covered"), "place")

        if not self._wide(gamma):
            return in_one(rows)
        all_rows = checkpoint(rows)
        rows = all_rows.where("blocks > 1")

        def add(block: pd.DataFrame) -> pd.DataFrame:
            one = block[[*keys, "block", "depth"]].head(1)
            return one.assign(w=[_weights(block, n).sum(axis=0)])

        def deal(parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("block")
            w = np.stack(parts["w"].to_list())
            rest = np.cumsum(w[::-1], axis=0)[::-1]
            rng = _stream(int(parts["stream"].iloc[0]))
            left, out = np.full(n, int(parts["depth"].iloc[0])), []
            for k in range(len(w)):
                out.append(left if k == len(w) - 1 else rng.binomial(left, np.minimum(w[k] / rest[k], 1.0)))
                left = left - out[-1]
            return parts[[*keys, "block"]].assign(reads=out)

        def within(block: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("taxon")
            low, mid, high = counted(block, np.asarray(dealt["reads"].iloc[0])).T
            return block[[*keys, "taxon", "observed"]].assign(p2_5=low, p50=mid, p97_5=high)

        parts = rows.groupBy(*keys, "block").applyInPandas(add, f"{named}, block int, depth {fields['depth']}, w array<double>")
        streams = parts.withColumn("stream", F.xxhash64(*keys, F.lit(seed), F.lit("blocks")))
        dealt = streams.groupBy(*keys).applyInPandas(deal, f"{named}, block int, reads array<long>")
        both = rows.groupBy(*keys, "block").cogroup(dealt.groupBy(*keys, "block"))
        out = both.applyInPandas(within, found)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("observed").desc(), "taxon"))
        out = out.withColumn("covered", covered).withColumn("place", place)
        return in_one(all_rows.where("blocks <= 1")).unionByName(out)


#: Categories whose draws a task holds at a time, observations of one chunk of cross products.
BLOCK, CHUNK = 2048, 1 << 14
#: Grid of ln(s) round minus the log of the total weight.
GRID = np.arange(-26, 6.01, 0.25)


def _blocked(keys: Sequence[str], seed: int) -> list[Column]:
    """Random key of every row, its block of categories and the number of blocks."""
    blocks = F.ceil(F.col("n_taxa") / BLOCK).cast("int")
    return [
        F.xxhash64(*keys, "taxon", F.lit(seed)).alias("key"), F.pmod(F.xxhash64("taxon"), blocks).cast("int").alias("block"),
        blocks.alias("blocks"),
    ]


def _together(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key one after the other, by category, NULL last; work that is heavy per row stays spread."""
    return spread(rows, keys).sortWithinPartitions(*keys, F.asc_nulls_last("taxon"))


def _whole_keys(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Rows that come key by key, in frames that cut no key, with the places where each key begins and the end."""
    left = None
    for frame in frames:
        frame = frame if left is None or not len(left) else pd.concat([left, frame], ignore_index=True)
        codes = [pd.factorize(frame[k], use_na_sentinel=False)[0] for k in keys]
        starts = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0)).tolist()
        if len(starts) > 1:
            yield frame.iloc[: starts[-1]], starts
        left = frame.iloc[starts[-1] :] if starts else frame
    if left is not None and len(left):
        yield left, [0, len(left)]


def _over_totals(rows: DataFrame, keys: list[str], work, add, finish, names: list[str], wide: bool, only: str | None = None) -> DataFrame:
    """Result rows (keys, taxon, names) of every category, from its own part and the sum over its key.

    ``work`` makes an array with a line per category from a block of rows, ``add`` the vector that is added
    up from such an array, ``finish`` the results from an array and the sum. The rows lie as ``_together``
    leaves them, so a key of one block is worked once; keys of more blocks (``wide``) take two passes.
    ``only`` names a flag of the rows that are returned.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + f", taxon {fields['taxon']}, " + ", ".join(f"{c} double" for c in names)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ends in _whole_keys(frames, keys):
            chosen = frame[only].to_numpy(bool) if only else np.ones(len(frame), bool)
            values = []
            for a, b in zip(ends[:-1], ends[1:]):
                part = work(frame.iloc[a:b])
                values.append(finish(part[chosen[a:b]], add(part)))
            yield frame.loc[chosen, [*keys, "taxon"]].assign(**dict(zip(names, np.concatenate(values).T)))

    def second(block: pd.DataFrame, total: np.ndarray) -> pd.DataFrame:
        if only:
            block = block[block[only].to_numpy(bool)]
        return block[[*keys, "taxon"]].assign(**dict(zip(names, finish(work(block), total).T)))

    if not wide:
        return rows.mapInPandas(whole, schema)
    # a filter keeps the order within the partitions
    narrow = rows.where("blocks <= 1").mapInPandas(whole, schema)
    return narrow.unionByName(_in_two_passes(rows.where("blocks > 1"), keys, lambda block: add(work(block)), second, names))


def _block_sums(rows: DataFrame, keys: list[str], add) -> DataFrame:
    """(keys, blocks, v): the vectors that ``add`` gives for the blocks of a key, added up in the order of the blocks."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = ", ".join(f"`{k}` {fields[k]}" for k in keys)

    def first(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("taxon")
        return block[[*keys, "block", "blocks"]].head(1).assign(v=[add(block)])

    parts = rows.groupBy(*keys, "block").applyInPandas(first, f"{named}, block int, blocks int, v array<double>")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block", "v"))), lambda x: x["v"])
    total = F.aggregate(
        F.slice("all", 2, F.size("all")), F.element_at("all", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    )
    return parts.groupBy(*keys).agg(F.max("blocks").alias("blocks"), listed.alias("all")).select(*keys, "blocks", total.alias("v"))


def _in_two_passes(rows: DataFrame, keys: list[str], add, finish, names: list[str]) -> DataFrame:
    """A vector per block of categories, added up per key, then every block with the sum of its key.

    ``add`` gives the vector of a block of rows, ``finish`` the result rows (keys, taxon, names) from a block and the sum.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = ", ".join(f"`{k}` {fields[k]}" for k in keys)

    def second(block: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        return finish(block.sort_values("taxon"), np.asarray(total["v"].iloc[0]))

    sums = _block_sums(rows, keys, add).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "v"
    )
    both = rows.groupBy(*keys, "block").cogroup(sums.groupBy(*keys, "block"))
    out = both.applyInPandas(
        lambda block, v: second(block, v) if len(block) else pd.DataFrame(columns=[*keys, "taxon", *names]),
        f"{named}, taxon {fields['taxon']}, " + ", ".join(f"{c} double" for c in names),
    )
    return out


def _weights(block: pd.DataFrame, n: int) -> np.ndarray:
    """n draws of the weight of every row of a block; each row has a random stream of its own."""
    keys = block["key"].to_numpy(np.int64).view(np.uint64)
    out, bits = np.empty((len(block), n)), np.random.Philox(key=np.uint64(0))
    rng, fresh = np.random.Generator(bits), bits.state
    for i, df in enumerate(block["df"].to_numpy()):
        # as a generator made from the key, without the cost of making one
        fresh["state"]["key"][0] = keys[i]
        bits.state = fresh
        out[i] = rng.standard_t(df, n)
    out *= block["spread"].to_numpy()[:, None]
    out += block["at"].to_numpy()[:, None]
    return np.exp(np.minimum(out, 700.0, out=out), out=out)


def _quantiles(ordered: np.ndarray, probs: Sequence[float]) -> np.ndarray:
    """Quantiles of every line of an array sorted by line, between neighbours as ``numpy.quantile`` does."""
    at = np.asarray(probs) * (ordered.shape[1] - 1)
    low = np.floor(at).astype(int)
    a, b, part = ordered[:, low], ordered[:, np.minimum(low + 1, ordered.shape[1] - 1)], at - low
    return np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))


def _summaries(weights: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Mean, standard deviation and quantiles of the drawn shares of every row."""
    share = weights / total
    mean, sd = share.mean(axis=1), share.std(axis=1, ddof=1)
    share.sort(axis=1)
    return np.column_stack([mean, sd, _quantiles(share, list(SUMMARY.values()))])


def _block_products(u: DataFrame, group: list[str]) -> DataFrame:
    """(group, taxon, taxon2, s12): products of ``u`` over observations, for pairs of categories that meet."""
    blocks = F.ceil(F.col("n_taxa") / BLOCK).cast("int")
    own = u.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("taxon"), F.col("blocks")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")),
    )
    chunks = u.groupBy(*group).agg(F.ceil(F.approx_count_distinct("obs") / CHUNK).cast("int").alias("chunks"))
    rows = join_on(own.withColumn("ij", F.explode(met)), chunks, group).select(
        *group, "ij.i", "ij.j", F.pmod(F.xxhash64("obs"), F.greatest("chunks", F.lit(1))).cast("int").alias("chunk"), "own", "obs", "taxon", "u"
    )
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def product(part: pd.DataFrame) -> pd.DataFrame:
        obs = pd.factorize(part["obs"])[0]
        taxon, taxa = pd.factorize(part["taxon"])
        x = np.zeros((obs.max() + 1, len(taxa)))
        x[obs, taxon] = part["u"].to_numpy()
        side = np.zeros(len(taxa), int)
        side[taxon] = part["own"].to_numpy()
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        s = x[:, a].T @ x[:, b]
        k, l = np.nonzero(s)
        first, second = np.asarray(taxa)[a[k]], np.asarray(taxa)[b[l]]
        keep = (first <= second) if i == j else np.ones(len(k), bool)
        swap = first > second
        out = pd.DataFrame({"taxon": np.where(swap, second, first)[keep], "taxon2": np.where(swap, first, second)[keep], "s12": s[k, l][keep]})
        for at, name in enumerate(group):
            out.insert(at, name, part[name].iloc[0])
        return out

    named = "".join(f"`{k}` {fields[k]}, " for k in group)
    parts = rows.groupBy(*group, "i", "j", "chunk").applyInPandas(product, f"{named}taxon {fields['taxon']}, taxon2 {fields['taxon']}, s12 double")
    return parts.groupBy(*group, "taxon", "taxon2").agg(F.sum("s12").alias("s12"))


def _stream(key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.uint64(np.int64(key))))


def prior_scale(n_taxa: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """Prior of a centred log-ratio coordinate per group: degrees of freedom, scale, slope range.

    The prior is centred at zero, so its median slope is zero whatever the data.
    """
    d = F.col("n_taxa")
    scale2 = PRIOR_SCALE * (1 - 1 / d) / PRIOR_DF
    half = t_quantile(0.975, F.lit(PRIOR_DF)) * F.sqrt(scale2 * F.lit(gamma))
    return n_taxa.withColumns(
        {
            "upsilon": d + 3,
            "prior_df": F.lit(PRIOR_DF),
            "prior_scale2": scale2,
            "slope_p2_5": -half,
            "slope_p50": F.lit(0.0),
            "slope_p97_5": half,
        }
    )


def effs_vs_abundance(effs: DataFrame, mean_share: DataFrame, by: Sequence[str]) -> DataFrame:
    """Efficiency beside the mean share of the same category; shares of zero leave."""
    joined = join_on(effs, mean_share, [*by, "taxon"], "inner")
    return joined.where(F.col("mean_share") > 0).withColumn("log2_share", F.log2("mean_share"))
