"""Correlation, regression, multiple testing, diversity, histograms and interval summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biascomp.functions.numeric import ratio, t_quantile, t_two_sided_p
from biascomp.operators import ordered
from biascomp.operators.groups import add_group_aggs, join_groups, join_on
from biascomp.operators.ordered import OrderedRows
from biascomp.session import checkpoint

#: Posterior summary columns and their probabilities.
SUMMARY_PROBS = {"p2_5": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p97_5": 0.975}
INTERVAL_WIDTHS = (0.5, 0.8, 0.95, 0.99)
#: Bin width used where the spread gives none.
FALLBACK_BIN_WIDTH = 0.05


def correlation_columns(r: Column, n: Column) -> dict[str, Column]:
    """t statistic and two-sided p of a correlation over n pairs."""
    df = n - 2
    t = r * F.sqrt(ratio(df, F.greatest(1 - r * r, F.lit(0.0))))
    return {"t": t, "df": df, "p": F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided_p(t, df))}


def _both_known(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def _pairs(x: str, y: str) -> tuple[Column, Column, Column]:
    """Both values where both are known, and their number.

    Masking instead of filtering keeps the filter from changing shared scans below.
    """
    known = _both_known(x, y)
    return F.when(known, F.col(x)), F.when(known, F.col(y)), F.count(F.when(known, F.lit(1)))


def cor_test(
    df: DataFrame, by: Sequence[str], x: str, y: str, method: str = "pearson"
) -> DataFrame:
    """Correlation per group with its t-test; NULL p below three pairs."""
    if method == "spearman":
        # counted pairs, written once: both rankings and the sums read them
        pairs = checkpoint(df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__w"))).where(_both_known(x, y))
        for v, name in ((x, "__rx"), (y, "__ry")):
            ranks = ordered.average_ranks(pairs, by, v, name, weight="__w")
            pairs = join_on(pairs, ranks, [*by, v])
        w, a, b = F.col("__w"), F.col("__rx"), F.col("__ry")
        n, sx, sy = F.sum(w), F.sum(w * a), F.sum(w * b)
        cov = F.sum(w * a * b) - sx * sy / n
        r = ratio(cov, F.sqrt((F.sum(w * a * a) - sx * sx / n) * (F.sum(w * b * b) - sy * sy / n)))
        out = pairs.groupBy(*by).agg(r.alias("r"), n.alias("n"))
    else:
        a, b, n = _pairs(x, y)
        out = df.groupBy(*by).agg(F.corr(a, b).alias("r"), n.alias("n")).where(F.col("n") > 0)
    return out.withColumns(correlation_columns(F.col("r"), F.col("n")))


def ols(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group: slope, intercept, R² and p of the slope."""
    a, b, n = _pairs(x, y)
    fit = df.groupBy(*by).agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.corr(a, b).alias("__r"),
        n.alias("n"),
    ).where(F.col("n") > 0)
    p = correlation_columns(F.col("__r"), F.col("n"))["p"]
    return fit.withColumn("r2", F.col("__r") * F.col("__r")).withColumn("p", p).drop("__r")


def line_errors(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group with what its uncertainty needs.

    ``sigma`` is the residual standard deviation, ``slope_se`` and ``intercept_se`` the standard
    errors, ``df`` the degrees of freedom, ``x_mean`` and ``sxx`` the centre and spread of x. They
    are NULL where they do not exist: below three pairs, or without spread in x.
    """
    a, b, n = _pairs(x, y)
    fit = df.groupBy(*by).agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), n.alias("n"),
        F.regr_avgx(b, a).alias("x_mean"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("__syy"),
    ).where(F.col("n") > 0)
    df_ = F.col("n") - 2
    left = F.greatest(F.col("__syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    # greatest() passes over NULL, but a line without a slope has no residuals
    sigma = F.when((df_ > 0) & F.col("slope").isNotNull(), F.sqrt(ratio(left, df_)))
    fit = fit.withColumns({"df": df_, "sigma": sigma})
    return fit.withColumns(
        {
            "slope_se": F.col("sigma") * F.sqrt(ratio(F.lit(1.0), "sxx")),
            "intercept_se": F.col("sigma") * F.sqrt(1 / F.col("n") + ratio(F.col("x_mean") * F.col("x_mean"), "sxx")),
        }
    ).drop("__syy")


def line_band(
    df: DataFrame, points: DataFrame, by: Sequence[str], x: str, y: str, level: float = 0.95
) -> DataFrame:
    """Fitted line and confidence band of its mean at the points (columns ``by`` and ``x``).

    Points of a group without a line stay with NULLs. The Student-t quantile is found once per
    distinct number of degrees of freedom, never per point.
    """
    fit = line_errors(df, by, x, y)
    t = fit.select("df").distinct().withColumn("__t", t_quantile((1 + level) / 2, "df"))
    lines = join_on(fit, t, ["df"])
    out = join_on(points, lines, by) if by else join_groups(points, lines, by)
    away = F.col(x) - F.col("x_mean")
    se = F.col("sigma") * F.sqrt(1 / F.col("n") + ratio(away * away, "sxx"))
    mid = F.col("intercept") + F.col("slope") * F.col(x)
    cols = {"fit": mid, "low": mid - F.col("__t") * se, "high": mid + F.col("__t") * se}
    return out.select(*points.columns, *[c.alias(name) for name, c in cols.items()])


def p_adjust(
    df: DataFrame, p: str, key: Sequence[str], by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Bonferroni and Benjamini–Hochberg corrections over the tests of each family.

    ``key`` names the test inside its family and only breaks ties in the order. A test without a p
    stays, without corrections, and does not count towards its family. ``bounded`` is for families
    whose size is fixed by parameters, such as pairs of named metrics: one window then does it all.
    """
    if bounded:
        family = Window.partitionBy(*by)
        tests = F.count(p).over(family)
        place = F.row_number().over(family.orderBy(F.col(p).asc_nulls_last(), *key))
        back = family.orderBy(F.col(p).desc_nulls_first(), *[F.desc(k) for k in key])
        stepped = df.withColumns({"__m": tests, "__i": place}).withColumn("__s", F.col(p) * F.col("__m") / F.col("__i"))
        best = F.min("__s").over(back.rowsBetween(Window.unboundedPreceding, 0))
        known = F.col(p).isNotNull()
        return stepped.withColumns(
            {
                "p_bonferroni": F.when(known, F.least(F.col(p) * F.col("__m"), F.lit(1.0))),
                "p_bh": F.when(known, F.least(best, F.lit(1.0))),
            }
        ).drop("__m", "__i", "__s")
    # the tests are written once: their number, their ranks and the result all read them
    df = checkpoint(df)
    known = df.where(F.col(p).isNotNull())
    tests = add_group_aggs(known, by, {"__m": F.count(F.lit(1))})
    run = OrderedRows(tests, by, [p, *key]).running(F.lit(1).cast("long"), "__i")
    scaled = F.col(p) * F.col("__m") / F.col("__i")
    done = run.running(scaled, "__bh", "min", backwards=True).done()
    corrected = done.withColumns(
        {
            "p_bonferroni": F.least(F.col(p) * F.col("__m"), F.lit(1.0)),
            "p_bh": F.least(F.col("__bh"), F.lit(1.0)),
        }
    ).drop("__m", "__i", "__bh")
    none = F.lit(None).cast("double")
    unknown = df.where(F.col(p).isNull()).withColumns({"p_bonferroni": none, "p_bh": none})
    return corrected.unionByName(unknown)


def shannon(df: DataFrame, by: Sequence[str], category: str, weight: str | None = None) -> DataFrame:
    """Shannon diversity of the category counts per group, zero counts left out."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, category).agg(n.cast("double").alias("__n")).where(F.col("__n") > 0)
    # -sum(p ln p) = ln N - sum(n ln n) / N, so the total needs no second pass
    total = F.sum("__n")
    return counts.groupBy(*by).agg(
        (F.ln(total) - F.sum(F.col("__n") * F.ln("__n")) / total).alias("shannon")
    )


def bin_width_fd(df: DataFrame, by: Sequence[str], x: str, out: str = "bin_width") -> DataFrame:
    """Freedman–Diaconis bin width, with a fallback for a single value or no spread."""
    q = ordered.quantiles(df, by, x, {"__q1": 0.25, "__q3": 0.75}, count="__n")
    iqr = F.col("__q3") - F.col("__q1")
    width = F.when((F.col("__n") <= 1) | (iqr == 0), F.lit(FALLBACK_BIN_WIDTH)).otherwise(
        2 * iqr / F.pow(F.col("__n").cast("double"), F.lit(1.0 / 3))
    )
    return q.withColumn(out, width).drop("__q1", "__q3", "__n")


def histogram(df: DataFrame, by: Sequence[str], x: str, bins: int = 6) -> DataFrame:
    """Counts in equal bins between the group's extremes; the top edge belongs to the last bin."""
    full = add_group_aggs(
        df.where(ordered.is_known(df, x)), by, {"__lo": F.min(x).cast("double"), "__hi": F.max(x).cast("double")}
    )
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.coalesce(F.floor(ratio(F.col(x) - F.col("__lo"), width)), F.lit(0))
    low = F.min(F.col("__lo") + F.col("bin") * width)
    return (
        full.withColumn("bin", F.least(index, F.lit(bins - 1)).cast("int"))
        .groupBy(*by, "bin")
        .agg(low.alias("bin_low"), F.count(F.lit(1)).alias("n"))
    )


def posterior_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """p2.5, p25, p50, mean, p75 and p97.5 of a long value column."""
    return ordered.quantiles(df, by, value, SUMMARY_PROBS, mean="mean_value")


def interval_widths(
    df: DataFrame, by: Sequence[str], value: str, widths: Sequence[float] = INTERVAL_WIDTHS
) -> DataFrame:
    """Central intervals of several widths around the mean, one row per width."""
    probs = {}
    for i, w in enumerate(widths):
        probs[f"__lo{i}"], probs[f"__hi{i}"] = (1 - w) / 2, 1 - (1 - w) / 2
    q = ordered.quantiles(df, by, value, probs, mean="mean_value")
    rows = F.array(
        *[
            F.struct(F.lit(float(w)).alias("width"), F.col(f"__lo{i}").alias("low"), F.col(f"__hi{i}").alias("high"))
            for i, w in enumerate(widths)
        ]
    )
    return q.select(*by, "mean_value", F.inline(rows))


def require_pairs(df: DataFrame, least: int = 3) -> DataFrame:
    """Stop when fewer than ``least`` rows are left for a correlation."""
    if df.limit(least).count() < least:
        raise ValueError("Not enough finite observations for a correlation.")
    return df
