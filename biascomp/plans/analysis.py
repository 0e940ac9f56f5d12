"""Windows, rankings, statistics, taxonomy, abundance filters and composition transforms."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from biascomp.functions import numeric as num
from biascomp.operators import composition, filters, groups, ordered, reshape, stats, taxonomy
from biascomp.plans.bindings import RANKS
from biascomp.plans.registry import query, r
from biascomp.plans.tables import _KEPT, SC, kept_taxa

SAMPLE = [SC, "sample_name"]

# ------------------------------------------------------------------ ordered operators


@query(
    "dedupe_best",
    "taxonomy taxonomy_b",
    """with u as (select * from taxonomy union all select * from taxonomy_b),
       s as (select *, (class_rank is not null)::int+(order_rank is not null)::int+(family_rank is not null)::int
             +(genus_rank is not null)::int as score from u),
       m as (select *, max(score) over (partition by hash) as best, count(*) over (partition by hash, score) as c from s)
       select hash, class_rank, order_rank, family_rank, genus_rank from m where score=best and c=1""",
)
def dedupe_best(t):
    return taxonomy.dedupe_best(reshape.union_all([t.taxonomy, t.taxonomy_b]), "hash", RANKS)


@query(
    "order_in_group",
    "reads taxonomy",
    """select family_rank, hash, round(mean_reads,6) as mean_reads, hash_order from (
         select *, row_number() over (partition by family_rank order by mean_reads, hash) as hash_order from (
           select coalesce(family_rank,'other') as family_rank, r.hash, avg(n_reads) as mean_reads
           from reads r join taxonomy t on r.hash=t.hash group by all))""",
)
def order_in_group(t):
    return _hash_order(t).withColumn("mean_reads", r("mean_reads"))


def _hash_order(t):
    means = t.reads.groupBy("hash").agg(F.avg("n_reads").alias("mean_reads"))
    labelled = taxonomy.attach_label(means, t.taxonomy, "hash", "family_rank")
    return ordered.row_number(labelled, ["family_rank"], ["mean_reads", "hash"], "hash_order")


@query(
    "group_middle",
    "reads taxonomy",
    """select family_rank, hash, hash_order from (
         select *, row_number() over (partition by family_rank order by mean_reads, hash) as hash_order,
           count(*) over (partition by family_rank) as n from (
           select coalesce(family_rank,'other') as family_rank, r.hash, avg(n_reads) as mean_reads
           from reads r join taxonomy t on r.hash=t.hash group by all)) where hash_order=n//2+1""",
)
def group_middle(t):
    means = t.reads.groupBy("hash").agg(F.avg("n_reads").alias("mean_reads"))
    labelled = taxonomy.attach_label(means, t.taxonomy, "hash", "family_rank")
    middle = ordered.group_middle(labelled, ["family_rank"], ["mean_reads", "hash"], "hash_order")
    return middle.select("family_rank", "hash", "hash_order")


@query(
    "fill_downup",
    "particles",
    """with p as (select object_id, category, taken_at, case when status='validated' then feret_px end as v from particles)
       select object_id, category, coalesce(
         last_value(v ignore nulls) over (partition by category order by taken_at, object_id
           rows between unbounded preceding and current row),
         first_value(v ignore nulls) over (partition by category order by taken_at, object_id
           rows between current row and unbounded following)) as feret_px from p""",
)
def fill_downup(t):
    p = t.particles.select(
        "object_id", "category", "taken_at", F.when(F.col("status") == "validated", F.col("feret_px")).alias("feret_px")
    )
    return ordered.fill_down_up(p, ["category"], ["taken_at", "object_id"], "feret_px").drop("taken_at")


@query(
    "category_order",
    "obs",
    """select taxon, round(mean_value,6) as mean_value, row_number() over (order by mean_value, taxon) as category_order
       from (select taxon, avg(n_reads) as mean_value from obs group by taxon)""",
)
def category_order(t):
    return ordered.order_by_mean(t.obs, [], "taxon", "n_reads").withColumn("mean_value", r("mean_value"))


@query(
    "top_n",
    "reads",
    """select hash, cast(sum(n_reads) as bigint) as total from reads group by hash order by total desc, hash limit 10""",
)
def top_n(t):
    return ordered.top_n(t.reads, "hash", "n_reads", 10)


@query(
    "top_page",
    "reads",
    """select hash, cast(sum(n_reads) as bigint) as total from reads group by hash order by total desc, hash
       limit 10 offset 10""",
)
def top_page(t):
    return ordered.top_page(t.reads, "hash", "n_reads", 10, 10)


@query(
    "lump_other_topn",
    "obs",
    """with a as (select taxon from obs group by taxon order by sum(n_reads) desc, taxon limit 10),
       c as (select taxon from (select *, n_reads/sum(n_reads) over (partition by size_class, sample_name) as share
         from obs) group by taxon order by round(sum(share),9) desc, taxon limit 10)
       select size_class, taxon, cast(sum(n_reads) as bigint) as n_reads, round(sum(share),6) as share from (
         select size_class, case when taxon in (select taxon from a union select taxon from c) then taxon else 'Other' end
           as taxon, n_reads, n_reads/sum(n_reads) over (partition by size_class, sample_name) as share from obs)
       group by all""",
)
def lump_other_topn(t):
    shares = composition.closure(t.obs, SAMPLE, "n_reads")
    out = ordered.lump_outside_top(shares, "taxon", ["n_reads", "share"], 10, [SC])
    return out.withColumn("share", r("share"))


# ------------------------------------------------------------------ statistics


@query(
    "quantile_cutoff",
    "hashed",
    """select size_class, round(quantile_cont(total,0.9),6) as cutoff from
       (select size_class, hash, sum(n_reads)::bigint as total from hashed group by all) group by size_class""",
)
def quantile_cutoff(t):
    totals = t.reads.groupBy(SC, "hash").agg(F.sum("n_reads").alias("total"))
    return ordered.quantiles(totals, [SC], "total", {"cutoff": 0.9}).withColumn("cutoff", r("cutoff"))


@query(
    "summary_quantiles",
    "particles",
    """select category, round(quantile_cont(feret_px,0.025),6) as p2_5, round(quantile_cont(feret_px,0.25),6) as p25,
       round(quantile_cont(feret_px,0.5),6) as p50, round(avg(feret_px),6) as mean_value,
       round(quantile_cont(feret_px,0.75),6) as p75, round(quantile_cont(feret_px,0.975),6) as p97_5
       from particles group by category""",
)
def summary_quantiles(t):
    out = stats.posterior_summary(t.particles, ["category"], "feret_px")
    return out.withColumns({c: r(c) for c in out.columns if c != "category"})


@query(
    "interval_widths",
    "particles",
    """select category, round(avg(feret_px),6) as mean_value, w as width,
       round(quantile_cont(feret_px,(1-w)/2),6) as low, round(quantile_cont(feret_px,1-(1-w)/2),6) as high
       from particles, (select unnest([0.5,0.8,0.95,0.99]::double[]) as w) group by category, w"""
    .replace("quantile_cont(feret_px,(1-w)/2)", "case w when 0.5 then quantile_cont(feret_px,0.25) when 0.8 then "
             "quantile_cont(feret_px,0.1) when 0.95 then quantile_cont(feret_px,0.025) else "
             "quantile_cont(feret_px,0.005) end")
    .replace("quantile_cont(feret_px,1-(1-w)/2)", "case w when 0.5 then quantile_cont(feret_px,0.75) when 0.8 then "
             "quantile_cont(feret_px,0.9) when 0.95 then quantile_cont(feret_px,0.975) else "
             "quantile_cont(feret_px,0.995) end"),
)
def interval_widths(t):
    out = stats.interval_widths(t.particles, ["category"], "feret_px")
    return out.withColumns({c: r(c) for c in ["mean_value", "low", "high"]})


@query(
    "fd_bin_width",
    "particles",
    """select category, round(case when count(*)<=1 or quantile_cont(feret_px,0.75)=quantile_cont(feret_px,0.25) then 0.05
       else 2*(quantile_cont(feret_px,0.75)-quantile_cont(feret_px,0.25))/pow(count(*),1.0/3) end,6) as bin_width
       from particles group by category""",
)
def fd_bin_width(t):
    return stats.bin_width_fd(t.particles, ["category"], "feret_px").withColumn("bin_width", r("bin_width"))


@query(
    "histogram",
    "particles",
    """with e as (select category, min(feret_px) as lo, (max(feret_px)-min(feret_px))/6 as w from particles group by category)
       select category, bin, round(min(lo+bin*w),6) as bin_low, count(*) as n from (
         select p.category, lo, w, cast(least(coalesce(floor((feret_px-lo)/nullif(w,0)),0),5) as integer) as bin
         from particles p join e on p.category=e.category) group by category, bin""",
)
def histogram(t):
    return stats.histogram(t.particles, ["category"], "feret_px").withColumn("bin_low", r("bin_low"))


@query(
    "ecdf",
    "hashed",
    """select distinct size_class, total, round(cume_dist() over (partition by size_class order by total),6) as ecdf from
       (select size_class, hash, sum(n_reads)::bigint as total from hashed group by all)""",
)
def ecdf(t):
    totals = t.reads.groupBy(SC, "hash").agg(F.sum("n_reads").alias("total"))
    return ordered.ecdf(totals, [SC], "total").withColumn("ecdf", r("ecdf"))


def sql_t_p(tval: str, df: str) -> str:
    """Two-sided Student-t tail in SQL, by the finite cosine series in gamma functions."""
    cos2 = f"({df}/({df}+({tval})*({tval})))"
    odd = (
        f"2/pi()*(atan(abs({tval})/sqrt({df})) + abs({tval})/sqrt({df}+({tval})*({tval}))*sqrt({cos2})*"
        f"(case when {df}<3 then 0 else list_sum(list_transform(range(0, cast(({df}-3)/2+1 as bigint)), "
        f"lambda i: exp(lgamma(i+1)-lgamma(i+1.5)+ln(sqrt(pi())/2)+i*ln({cos2})))) end))"
    )
    even = (
        f"abs({tval})/sqrt({df}+({tval})*({tval}))*list_sum(list_transform(range(0, cast(({df}-2)/2+1 as bigint)), "
        f"lambda i: exp(lgamma(i+0.5)-lgamma(i+1)-ln(sqrt(pi()))+i*ln({cos2}))))"
    )
    return (
        f"case when {df}<1 then null else greatest(0, least(1, 1-(case when cast({df} as bigint)%2=1 "
        f"then {odd} else {even} end))) end"
    )


def sql_tq(p: float, df: str) -> str:
    """Student-t quantile in SQL: an expansion around the normal quantile, then one Newton step on the tail."""
    # fixed values: quantiles at the prior's five degrees of freedom
    if df == "5":
        return {0.975: "2.570581835636314::double"}[p]
    z = NormalDist().inv_cdf(p)
    g = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    q = "(" + f"{z!r}::double" + "".join(f"+({v!r}::double)/pow({df},{i + 1})" for i, v in enumerate(g)) + ")"
    log_density = f"lgamma(({df}+1)/2)-lgamma({df}/2)-ln({df}*pi())/2-({df}+1)/2*ln(1+{q}*{q}/{df})"
    gap = f"(({sql_t_p(q, df)})-{2 * min(p, 1 - p)!r}::double)"
    return f"({q}{'+' if p > 0.5 else '-'}{gap}/(2*exp({log_density})))"


def sql_t_log10_p(tval: str, df: str) -> str:
    """Decimal log of the tail in SQL by the power series of the incomplete beta function.

    Every term is positive, so small tails lose no digits; below |t| = 2 the body leaves enough of
    them and the series above is used.
    """
    a, x = f"({df}/2)", f"({df}/({df}+({tval})*({tval})))"
    terms = f"cast(least(100000, 45/-ln({x})+10) as bigint)"
    series = (
        f"list_sum(list_transform(range(0, {terms}), lambda n: exp(lgamma({a}+0.5+n)-lgamma({a}+0.5)-lgamma({a}+1+n)"
        f"+lgamma({a}+1)+n*ln({x}))))"
    )
    log_beta = f"(lgamma({a})+ln(pi())/2-lgamma({a}+0.5))"
    log_tail = f"({a}*ln({x})+ln(1-{x})/2-ln({a})-{log_beta}+ln({series}))"
    return f"case when {df}<1 then null when abs({tval})<2 then log10({sql_t_p(tval, df)}) else {log_tail}/ln(10) end"


_COR = f"""select size_class, taxon, r, n, r*sqrt(df/greatest(1-r*r,0)) as t, df, {sql_t_p('r*sqrt(df/(1-r*r))', 'df')} as p
  from (select *, cast(n-2 as double) as df from
    (select size_class, taxon, corr(pc1, share) as r, count(*) as n from shares where pc1 is not null group by all))"""


@query(
    "cor_test",
    "shares",
    f"""select size_class, taxon, round(r,6)+0.0 as r, n, round(t,6)+0.0 as t, cast(df as bigint) as df, round(p,6) as p,
        round({sql_t_log10_p('t', 'df')},6)+0.0 as log10_p from ({_COR})""",
)
def cor_test(t):
    out = stats.cor_test(t.shares, [SC, "taxon"], "pc1", "share").withColumn("log10_p", num.t_two_sided_log10_p("t", "df"))
    return out.withColumns({c: r(c) for c in ["r", "t", "p", "log10_p"]})


@query(
    "spearman",
    "shares",
    f"""with p as (select size_class, n_reads, pc1 from shares where pc1 is not null),
        k as (select size_class,
          rank() over (partition by size_class order by n_reads)
            + (count(*) over (partition by size_class, n_reads)-1)/2.0::double as a,
          rank() over (partition by size_class order by pc1)
            + (count(*) over (partition by size_class, pc1)-1)/2.0::double as b from p),
        c as (select size_class, corr(a,b) as r, count(*) as n, cast(count(*)-2 as double) as df from k group by size_class),
        v as (select *, r*sqrt(df/(1-r*r)) as t from c)
        select size_class, round(r,6)+0.0 as r, n, round(t,6)+0.0 as t, round({sql_t_p('t', 'df')},6) as p from v""",
)
def spearman(t):
    out = stats.cor_test(t.shares, [SC], "n_reads", "pc1", "spearman")
    return out.select(SC, "n", *[r(c).alias(c) for c in "rtp"])


@query(
    "ols_by_group",
    "shares",
    f"""with f as (select size_class, taxon, regr_slope(y,pc1) as slope, regr_intercept(y,pc1) as intercept, corr(y,pc1) as r,
          count(*) as n, cast(count(*)-2 as double) as df
          from (select size_class, taxon, pc1, log2(share) as y from shares where share>0 and pc1 is not null)
          group by size_class, taxon)
        select size_class, taxon, round(slope*1000,6)+0.0 as slope, round(intercept,6)+0.0 as intercept, n, round(r*r,6) as r2,
          round({sql_t_p('r*sqrt(df/(1-r*r))', 'df')},6) as p from f""",
)
def ols_by_group(t):
    logs = t.shares.withColumn("y", num.log2_ratio("share", F.lit(1.0)))
    out = stats.ols(logs, [SC, "taxon"], "pc1", "y").withColumn("slope", F.col("slope") * 1000)
    return out.withColumns({c: r(c) for c in ["slope", "intercept", "r2", "p"]})


@query(
    "line_band",
    "shares",
    f"""with f as (select size_class, regr_slope(share,pc1) as b, regr_intercept(share,pc1) as a, regr_avgx(share,pc1) as m,
          regr_sxx(share,pc1) as sxx, regr_syy(share,pc1) as syy, count(*) as n, cast(count(*)-2 as double) as df
          from shares where pc1 is not null group by size_class),
        l as (select *, sqrt((syy-b*b*sxx)/df) as s, {sql_tq(0.975, 'df')} as q from f),
        p as (select size_class, zone, avg(pc1) as x from shares where pc1 is not null group by all),
        e as (select p.size_class, zone, x, a+b*x as y, q*s*sqrt(1/n+(x-m)*(x-m)/sxx) as h, s/sqrt(sxx) as se
          from p join l on p.size_class=l.size_class)
        select size_class, zone, round(x,4) as pc1, round(y,6)+0.0 as fit, round(y-h,6)+0.0 as low, round(y+h,6)+0.0 as high,
          round(se*1e6,4)+0.0 as slope_se from e""",
)
def line_band(t):
    """Band of the line of shares over the axis score at the mean score of each zone."""
    points = t.shares.where("pc1 is not null").groupBy(SC, "zone").agg(F.avg("pc1").alias("pc1"))
    band = stats.line_band(t.shares, points, [SC], "pc1", "share")
    errors = stats.line_errors(t.shares, [SC], "pc1", "share").select(SC, r(F.col("slope_se") * 1e6, 4).alias("slope_se"))
    out = groups.join_on(band, errors, [SC])
    return out.withColumns({"pc1": r("pc1", 4)} | {c: r(c) for c in ["fit", "low", "high"]})


@query(
    "p_adjust",
    "shares",
    f"""with c as ({_COR}),
        k as (select *, row_number() over (partition by size_class order by p, taxon) as i,
              count(*) over (partition by size_class) as m from c)
        select size_class, taxon, round(p,6) as p, round(least(p*m,1),6) as p_bonferroni,
          round(least(min(p*m/i) over (partition by size_class order by i
            rows between current row and unbounded following),1),6) as p_bh from k""",
)
def p_adjust(t):
    tests = stats.cor_test(t.shares, [SC, "taxon"], "pc1", "share").select(SC, "taxon", "p")
    out = stats.p_adjust(tests, "p", ["taxon"], [SC])
    return out.withColumns({c: r(c) for c in ["p", "p_bonferroni", "p_bh"]})


@query(
    "shannon",
    "particles",
    """select sample_id, round(-sum(p*ln(p)),6)+0.0 as shannon from (select sample_id,
         count(*)/sum(count(*)) over (partition by sample_id) as p from particles group by sample_id, category)
       group by sample_id""",
)
def shannon(t):
    return stats.shannon(t.particles, ["sample_id"], "category").withColumn("shannon", r("shannon"))


# ------------------------------------------------------------------ taxonomy


@query(
    "taxonomy_merge",
    "taxonomy taxonomy_b",
    """select coalesce(a.hash,b.hash) as hash, coalesce(a.class_rank,b.class_rank) as class_rank,
       coalesce(a.order_rank,b.order_rank) as order_rank, coalesce(a.family_rank,b.family_rank) as family_rank,
       coalesce(a.genus_rank,b.genus_rank) as genus_rank from taxonomy a full join taxonomy_b b on a.hash=b.hash""",
)
def taxonomy_merge(t):
    return taxonomy.merge(t.taxonomy, t.taxonomy_b, "hash", RANKS)


_BACK = """a as (select hash, class_rank, case when trim(coalesce(order_rank,''))='' then class_rank else order_rank end
    as order_rank, family_rank, genus_rank from taxonomy),
  b as (select hash, class_rank, order_rank, case when trim(coalesce(family_rank,''))='' then order_rank else family_rank
    end as family_rank, genus_rank from a)"""


@query(
    "backfill_ranks",
    "taxonomy",
    f"""with {_BACK} select hash, class_rank, order_rank, family_rank,
        case when trim(coalesce(genus_rank,''))='' then family_rank else genus_rank end as genus_rank,
        (case when trim(coalesce(genus_rank,''))='' then family_rank else genus_rank end)||'.'||hash as genus_hash from b""",
)
def backfill_ranks(t):
    return taxonomy.backfill(t.taxonomy, RANKS).withColumn("genus_hash", F.concat_ws(".", "genus_rank", "hash"))


_LABEL = """lab as (select hash, class_rank, order_rank,
  case when c='other' and coalesce(order_rank,'') in ('ring','bolt','gear') then 'unidentified '||order_rank else c end
    as family_rank, genus_rank from (select *, case when trim(coalesce(family_rank,order_rank))='' then 'other'
    else coalesce(family_rank,order_rank) end as c from taxonomy))"""


def labelled(t):
    return taxonomy.label_unidentified(t.taxonomy, "family_rank", "order_rank", ["ring", "bolt", "gear"])


@query(
    "unidentified_label",
    "taxonomy",
    f"""with {_LABEL} select *, case when trim(coalesce(genus_rank,''))<>'' and genus_rank<>'other' then genus_rank
        when trim(coalesce(family_rank,''))<>'' and family_rank<>'other' then 'unidentified '||family_rank
        when trim(coalesce(order_rank,''))<>'' and order_rank<>'other' then 'unidentified '||order_rank
        when trim(coalesce(class_rank,''))<>'' then 'unidentified '||class_rank else 'unidentified' end as lowest from lab""",
)
def unidentified_label(t):
    return taxonomy.label_by_lowest_known(labelled(t), RANKS, "lowest")


@query(
    "rollup_rank",
    "hashed taxonomy",
    """select size_class, sample_name, class_rank, order_rank, family_rank, cast(sum(n_reads) as bigint) as n_reads
       from hashed h join taxonomy t on h.hash=t.hash where family_rank is not null group by all""",
)
def rollup_rank(t):
    return taxonomy.rollup(t.reads, t.taxonomy, "hash", SAMPLE, RANKS[:3], "n_reads", keep_rest=False)


@query(
    "rollup_with_other",
    "hashed taxonomy_b",
    """select size_class, sample_name, case when family_rank is null then 'other' else class_rank end as class_rank,
       case when family_rank is null then 'other' else order_rank end as order_rank,
       coalesce(family_rank,'other') as family_rank, cast(sum(n_reads) as bigint) as n_reads
       from hashed h left join taxonomy_b t on h.hash=t.hash group by all""",
)
def rollup_with_other(t):
    return taxonomy.rollup(t.reads, t.taxonomy_b, "hash", SAMPLE, RANKS[:3], "n_reads")


_LEVELS = [
    f"select size_class, sample_name, '{RANKS[k]}' as level, "
    + ", ".join(f"case when {RANKS[k]} is null then 'other' else {c} end as {c}" for c in RANKS[: k + 1])
    + "".join(f", null::varchar as {c}" for c in RANKS[k + 1 : 3])
    + ", n_reads from hashed h left join taxonomy_b t on h.hash=t.hash"
    for k in range(3)
]


@query(
    "rollup_levels",
    "hashed taxonomy_b",
    f"""select size_class, sample_name, level, class_rank, order_rank, family_rank, cast(sum(n_reads) as bigint) as n_reads
        from ({' union all '.join(_LEVELS)}) group by all""",
)
def rollup_levels(t):
    """Class, order and family level at once."""
    return taxonomy.rollup_levels(t.reads, t.taxonomy_b, "hash", SAMPLE, RANKS[:3], "n_reads")


@query(
    "lineage_table",
    "taxonomy",
    f"""with {_LABEL} select distinct case when family_rank='other' then 'other' else class_rank end as class_rank,
        case when family_rank='other' then 'other' else order_rank end as order_rank, family_rank from lab""",
)
def lineage_table(t):
    return taxonomy.lineage_table(labelled(t), RANKS[:3])


#: Lineages known to be wrong in the driver's hierarchy.
RULES = [{"family_rank": "red", "order_rank": "widget"}, {"family_rank": "cold", "class_rank": "PROMO"}]


@query(
    "exclude_rules",
    "taxonomy",
    """select * from taxonomy where not coalesce(family_rank='red' and order_rank='widget',false)
       and not coalesce(family_rank='cold' and class_rank='PROMO',false)""",
)
def exclude_rules(t):
    return taxonomy.exclude_lineages(t.taxonomy, RULES)


_EXP = r"""e as (select *, nullif(regexp_extract(sample_name,'C_(AllPool|Pooled\.[A-C][0-9]\.[A-C][0-9])\.',1),'')
  as experiment from {0})"""
_KEPT_HASH = f"""{_EXP.format('hashed')}, kept as (select size_class, hash from (select size_class, experiment, hash,
  sum(n_reads)/sum(sum(n_reads)) over (partition by size_class, experiment) as share from e where experiment is not null
  group by size_class, experiment, hash) group by size_class, hash having max(share)>=0.0012)"""


def kept_hashes(t):
    h = t.hashed.withColumn("experiment", reshape.experiment_of(F.col("sample_name")))
    return filters.percent_of_experiment(h, "experiment", [SC], "hash", "n_reads", 0.0012)


@query(
    "rest_composition",
    "hashed taxonomy",
    f"""with {_KEPT_HASH}, q as (select size_class, sample_name, order_rank, cast(sum(n_reads) as bigint) as n_reads
          from (select h.* from hashed h anti join kept k on h.size_class=k.size_class and h.hash=k.hash) h
          left join taxonomy t on h.hash=t.hash group by all)
        select *, round(n_reads/sum(n_reads) over (partition by size_class, sample_name),6) as share from q""",
)
def rest_composition(t):
    rejected = groups.rows_without(t.hashed, kept_hashes(t), [SC, "hash"])
    out = taxonomy.rest_composition(rejected, t.taxonomy, "hash", SAMPLE, "order_rank", "n_reads")
    return out.withColumn("share", r("share"))


# ------------------------------------------------------------------ abundance filters



def calib():
    return F.col("sample_num") == reshape.CALIBRATION


@query(
    "filter_zero_tolerance",
    "design",
    """with c as (select * from design where sample_num='Calibration'),
       n as (select size_class, count(distinct sample_name) as ns from c group by all)
       select c.size_class, taxon, max(ns)-count(*) filter (n_reads>0) as n_zero from c join n on c.size_class=n.size_class
       group by all having max(ns)-count(*) filter (n_reads>0)<=2""",
)
def filter_zero_tolerance(t):
    return filters.zero_tolerance(t.design, calib(), [SC], "sample_name", "taxon", "n_reads")


@query(
    "filter_percent_experiment",
    "obs",
    f"""with {_EXP.format('obs')} select size_class, taxon, round(max(share),6) as max_share from (
          select size_class, experiment, taxon, sum(n_reads)/sum(sum(n_reads)) over (partition by size_class, experiment)
            as share from e where experiment is not null group by size_class, experiment, taxon)
        group by size_class, taxon having max(share)>=0.045""",
)
def filter_percent_experiment(t):
    return kept_taxa(t).withColumn("max_share", r("max_share"))


@query(
    "filter_all_treatments",
    "design",
    r"""with c as (select *, regexp_extract(sample_name,'^(\d{2}C)_',1) as treatment,
          regexp_extract(sample_name,'C_(AllPool|Pooled\.[A-C][0-9]\.[A-C][0-9])\.',1) as experiment
          from design where sample_num='Calibration'),
        cells as (select size_class, treatment, experiment, pool, taxon, sum(n_reads) as v from c group by all),
        n as (select size_class, count(*) as n_cells from (select distinct size_class, treatment, experiment, pool
          from cells) group by all)
        select x.size_class, taxon, count(*) as n_hit, max(n_cells) as n_cells from cells x
        join n on x.size_class=n.size_class where v>0 group by all having count(*)=max(n_cells)""",
)
def filter_all_treatments(t):
    c = t.design.where(calib()).withColumns(
        {"treatment": reshape.treatment_of("sample_name"), "experiment": reshape.experiment_of(F.col("sample_name"))}
    )
    return filters.in_all_treatments(c, ["treatment", "experiment", "pool"], [SC], "taxon", "n_reads")


@query(
    "filter_quantile",
    "design",
    """with tot as (select size_class, taxon, cast(sum(n_reads) as bigint) as total from design group by all),
       cut as (select size_class, quantile_cont(total,0.5) as cutoff from tot group by all),
       c as (select * from design where sample_num='Calibration'),
       n as (select size_class, count(distinct sample_name) as ns from c group by all),
       ok as (select c.size_class, taxon from c join n on c.size_class=n.size_class group by all
              having count(*) filter (n_reads>0)=max(ns))
       select tot.size_class, tot.taxon, total, round(cutoff,6) as cutoff from tot join cut on tot.size_class=cut.size_class
       join ok on tot.size_class=ok.size_class and tot.taxon=ok.taxon where total>cutoff""",
)
def filter_quantile(t):
    out = filters.above_quantile(t.design, calib(), [SC], "sample_name", "taxon", "n_reads", 0.5)
    return out.withColumn("cutoff", r("cutoff"))


@query(
    "filter_prevalence",
    "obs",
    """with n as (select size_class, count(distinct sample_name) as ns from obs group by all)
       select o.size_class, taxon, round(count(*) filter (n_reads>60)/max(ns),6) as prevalence from obs o
       join n on o.size_class=n.size_class group by all having count(*) filter (n_reads>60)/max(ns)>=0.3""",
)
def filter_prevalence(t):
    out = filters.prevalence(t.obs, [SC], "sample_name", "taxon", "n_reads", 60, 0.3)
    return out.withColumn("prevalence", r("prevalence"))


@query(
    "filter_calibration_complete",
    "design",
    """with p as (select size_class, taxon, sample_num='Calibration' as c, count(*) filter (n_reads>0) as seen,
         count(*) filter (n_reads>1) as often from design group by all),
       n as (select size_class, sample_num='Calibration' as c, count(distinct sample_name) as ns from design group by all),
       j as (select p.*, ns from p join n on p.size_class=n.size_class and p.c=n.c)
       select a.size_class, a.taxon from j a join j b on a.size_class=b.size_class and a.taxon=b.taxon
       where a.c and not b.c and a.often>0 and a.seen=a.ns and b.often>0 and (b.ns-b.seen)/b.ns<=0.3""",
)
def filter_calibration_complete(t):
    return filters.calibration_complete(t.design, calib(), [SC], "sample_name", "taxon", "n_reads", 0.3)


_LUMPED = f"""{_KEPT}, lumped as (select o.size_class, o.sample_name, case when k.taxon is null then 'other' else o.taxon
  end as taxon, cast(sum(n_reads) as bigint) as n_reads from obs o
  left join kept k on o.size_class=k.size_class and o.taxon=k.taxon group by all)"""


def lumped(t):
    return filters.lump(t.obs, kept_taxa(t), [SC, "taxon"], "taxon", SAMPLE, "n_reads")


@query("lump_other", "obs", f"with {_LUMPED} select * from lumped")
def lump_other(t):
    return lumped(t)


@query(
    "drop_high_other",
    "obs",
    f"""with {_LUMPED} select size_class, sample_name, taxon, n_reads from (select *,
          coalesce(sum(n_reads) filter (taxon='other') over (partition by size_class, sample_name),0) as rest,
          sum(n_reads) over (partition by size_class, sample_name) as depth from lumped) where rest<=depth*0.3""",
)
def drop_high_other(t):
    return filters.drop_high_rest(lumped(t), SAMPLE, "taxon", "n_reads", 0.3)


@query(
    "lump_named",
    "obs",
    """select size_class, sample_name, case when taxon='Brand#3' then 'other' else taxon end as taxon,
       cast(sum(n_reads) as bigint) as n_reads from obs group by all""",
)
def lump_named(t):
    return filters.lump_named(t.obs, ["Brand#3"], "taxon", SAMPLE, "n_reads")


@query(
    "lump_other_split",
    "hashed taxonomy",
    f"""with {_KEPT_HASH} select h.size_class, h.sample_name,
          case when k.hash is not null then cast(h.hash as varchar)
               when order_rank is not null and trim(order_rank)<>'' and order_rank<>'other' then 'unidentified '||order_rank
               else 'other' end as category, cast(sum(n_reads) as bigint) as n_reads
        from hashed h left join taxonomy t on h.hash=t.hash
        left join kept k on h.size_class=k.size_class and h.hash=k.hash group by all""",
)
def lump_other_split(t):
    h = t.hashed.join(t.taxonomy.select("hash", "order_rank"), "hash", "left")
    h = h.withColumn("category", F.col("hash").cast("string"))
    return filters.lump(h, kept_hashes(t), [SC, "hash"], "category", SAMPLE, "n_reads", split_by="order_rank")


@query(
    "lump_unmatched",
    "hashed taxonomy_b",
    """select size_class, sample_name, coalesce(genus_rank,'other') as genus_rank, cast(sum(n_reads) as bigint) as n_reads
       from hashed h left join taxonomy_b t on h.hash=t.hash group by all""",
)
def lump_unmatched(t):
    labelled_reads = taxonomy.attach_label(t.reads, t.taxonomy_b, "hash", "genus_rank")
    return labelled_reads.groupBy(*SAMPLE, "genus_rank").agg(F.sum("n_reads").alias("n_reads"))


@query(
    "median_normalise",
    "obs",
    """with k as (select * from obs where taxon<>'Brand#1'),
       g as (select size_class, quantile_cont(n_reads,0.5) as gm from k group by all),
       s as (select size_class, sample_name, quantile_cont(n_reads,0.5) as sm from k group by all)
       select k.size_class, k.sample_name, taxon, n_reads, round_even(n_reads*gm/nullif(sm,0),0) as normalised
       from k join g on k.size_class=g.size_class join s on k.size_class=s.size_class and k.sample_name=s.sample_name""",
)
def median_normalise(t):
    return composition.normalise_to_median_count(t.obs, [SC], ["sample_name"], "taxon", "n_reads", drop="Brand#1")


@query(
    "threshold_scan",
    "obs",
    f"""with {_EXP.format('obs')}, b as (select size_class, taxon, max(share) as ms from (
          select size_class, experiment, taxon, sum(n_reads)/sum(sum(n_reads)) over (partition by size_class, experiment)
            as share from e where experiment is not null group by size_class, experiment, taxon) group by all)
        select size_class, th as threshold, count(*) filter (ms>=th) as n_kept from b,
          (select unnest([0.05,0.045,0.01,0.005,0.001]::double[]) as th) group by all""",
)
def threshold_scan(t):
    o = t.obs.withColumn("experiment", reshape.experiment_of(F.col("sample_name")))
    return filters.threshold_scan(o, "experiment", [SC], "taxon", "n_reads", [0.05, 0.045, 0.01, 0.005, 0.001])


# ------------------------------------------------------------------ composition


@query(
    "closure",
    "obs",
    """select size_class, sample_name, taxon, round(n_reads/sum(n_reads) over (partition by size_class, sample_name),6)
       as share from obs""",
)
def closure(t):
    return composition.closure(t.obs, SAMPLE, "n_reads").select(*SAMPLE, "taxon", r("share").alias("share"))


@query(
    "clr",
    "obs",
    """with s as (select *, n_reads/sum(n_reads) over (partition by size_class, sample_name) as share from obs)
       select size_class, sample_name, taxon, round(ln(share+0.00001)-avg(ln(share+0.00001))
         over (partition by size_class, sample_name),6)+0.0 as clr from s""",
)
def clr(t):
    shares = composition.closure(t.obs, SAMPLE, "n_reads")
    return composition.clr(shares, SAMPLE, "share").select(*SAMPLE, "taxon", r("clr").alias("clr"))


@query(
    "normalise_median_depth",
    "obs",
    """with d as (select size_class, sample_name, sum(n_reads)::bigint as depth from obs group by all),
       m as (select size_class, quantile_cont(depth,0.5) as md from d group by all)
       select o.size_class, o.sample_name, taxon, round_even(md*n_reads/depth,0) as normalised from obs o
       join d on o.size_class=d.size_class and o.sample_name=d.sample_name join m on o.size_class=m.size_class""",
)
def normalise_median_depth(t):
    out = composition.normalise_to_median_depth(t.obs, [SC], ["sample_name"], "n_reads")
    return out.select(*SAMPLE, "taxon", "normalised")


@query(
    "mean_relative_abundance",
    "obs",
    """with s as (select *, n_reads/sum(n_reads) over (partition by size_class, sample_name) as share from obs),
       n as (select size_class, count(distinct sample_name) as ns from obs group by all)
       select s.size_class, taxon, round(sum(share)/max(ns),6) as mean_share from s join n on s.size_class=n.size_class
       group by all""",
)
def mean_relative_abundance(t):
    out = composition.mean_share(t.obs, [SC], "sample_name", "taxon", "n_reads")
    return out.withColumn("mean_share", r("mean_share"))
