"""Bias model: fits, scans, predictions and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from biascomp.operators import biasmodel, composition, groups, ordered, reshape, stats
from biascomp.operators.biasmodel import BiasModel, Columns
from biascomp.plans.analysis import sql_t_p, sql_tq
from biascomp.plans.registry import query, r
from biascomp.plans.tables import SC
from biascomp.session import checkpoint


def model(t) -> BiasModel:
    return BiasModel(t.design)


def sql_fit(src: str, gamma: str = "20.0::double", run: str = "0.0::double", gammas: str | None = None) -> str:
    """The dense fit: every (observation, taxon) pair is laid out, sums are taken as defined.

    ``src`` selects grp, obs, samp, x, taxon, n (and run).
    """
    gam = f"(select unnest({gammas}::double[]) as gamma)" if gammas else f"(select {gamma} as gamma)"
    return f"""src as ({src}),
 o as (select distinct grp, obs, samp, x, {run} as r from src),
 tx as (select distinct grp, taxon from src),
 grid as (select o.*, tx.taxon, ln(coalesce(s.n,0)+0.5) as l from o join tx on o.grp=tx.grp
   left join src s on s.grp=o.grp and s.obs=o.obs and s.taxon=tx.taxon),
 y as (select *, l-avg(l) over (partition by grp, obs) as y from grid),
 gam as {gam},
 sa as (select grp, samp, taxon, gamma, count(*) as k, sum(x) as sx, sum(r) as sr, sum(y) as sy,
   count(*)+1/gamma as m from y, gam group by grp, samp, taxon, gamma),
 tot as (select grp, taxon, count(*) as n_obs, sum(x*x) as xx, sum(x*r) as xr, sum(r*r) as rr, sum(x*y) as xy,
   sum(r*y) as ry, sum(y*y) as yy from y group by grp, taxon),
 sm as (select grp, taxon, gamma, count(*) as n_samples, sum(ln(m)) as ln_m, sum(sx*sx/m) as xxm, sum(sx*sr/m) as xrm,
   sum(sr*sr/m) as rrm, sum(sx*sy/m) as xym, sum(sr*sy/m) as rym, sum(sy*sy/m) as yym from sa group by grp, taxon, gamma),
 dd as (select grp, count(*) as n_taxa from tx group by grp),
 ab as (select tot.grp, tot.taxon, gamma, n_obs, n_samples, n_taxa, ln_m, xx+1/gamma-xxm as a11, xr-xrm as a12,
   rr+1/gamma-rrm as a22, xy-xym as c1, ry-rym as c2, yy-yym as y2
   from tot join sm on tot.grp=sm.grp and tot.taxon=sm.taxon join dd on tot.grp=dd.grp),
 be as (select *, (c1*a22-c2*a12)/(a11*a22-a12*a12) as beta, (c2*a11-c1*a12)/(a11*a22-a12*a12) as beta_run,
   a11*a22-a12*a12 as det, 3*(1-1/n_taxa) as prior from ab),
 fit as (select *, a22/det as v11, -a12/det as v12, a11/det as v22, n_obs+5 as df,
   (prior+y2-beta*c1-beta_run*c2)/(n_obs+5) as scale2,
   -0.5*(ln_m+ln(det)+(n_samples+2)*ln(gamma))-0.5*(n_obs+5)*ln(1+(y2-beta*c1-beta_run*c2)/prior) as log_ml from be),
 post as (select sa.grp, sa.samp, sa.taxon, (sy-beta*sx-beta_run*sr)/m as eta,
   sqrt(scale2*(1/m+sx/m*sx/m*v11+2*sx/m*sr/m*v12+sr/m*sr/m*v22)) as sd, df
   from sa join fit on sa.grp=fit.grp and sa.taxon=fit.taxon and sa.gamma=fit.gamma where samp<>'Calibration'),
 sft as (select *, exp(eta)/sum(exp(eta)) over (partition by grp, samp) as share,
   exp(eta) as e, sum(exp(eta)) over (partition by grp, samp)-exp(eta) as rest, {sql_tq(0.975, 'df')}*sd as h from post),
 pred as (select *, e*exp(-h)/(e*exp(-h)+rest) as share_low, e*exp(h)/(e*exp(h)+rest) as share_high from sft)"""


SRC = "select size_class as grp, sample_name as obs, sample_num as samp, cycle_num::double as x, taxon, n_reads as n from design"
FIT = sql_fit(SRC)
_FIT_COLS = """round(beta,6)+0.0 as beta, round(scale2,6) as scale2, round(v11*1000,6) as v11, n_obs, n_samples, n_taxa,
  cast(df as bigint) as df"""


def fit_columns(df):
    return [
        r("beta").alias("beta"), r("scale2").alias("scale2"), r(F.col("v11") * 1000).alias("v11"),
        "n_obs", "n_samples", "n_taxa", "df",
    ]


@query("bias_fit", "design", f"with {FIT} select grp as size_class, taxon, {_FIT_COLS} from fit")
def bias_fit(t):
    fit = model(t).fit()
    return fit.select(SC, "taxon", *fit_columns(fit))


_RUN_SRC = """select size_class as grp, sample_name || '/' || run as obs,
  case when starts_with(sample_name,'C') then regexp_extract(sample_name,'^(.*)\\.[^.]+$',1) else 'Calibration' end as samp,
  coalesce(try_cast(substring(sample_name,1,2) as integer),30)::double as x, taxon, n_reads as n,
  (run='2')::integer::double as rr from obs_run"""


@query(
    "bias_fit_run",
    "obs_run",
    f"""with {sql_fit(_RUN_SRC, run='rr')} select grp as size_class, taxon, {_FIT_COLS}, round(beta_run,6)+0.0 as beta_run
        from fit""",
)
def bias_fit_run(t):
    d = reshape.sample_design(t.obs_run, "sample_name").withColumns(
        {"obs": F.concat_ws("/", "sample_name", "run"), "second_run": (F.col("run") == "2").cast("int")}
    )
    fit = BiasModel(d, Columns(obs="obs", run="second_run")).fit()
    return fit.select(SC, "taxon", *fit_columns(fit), r("beta_run").alias("beta_run"))


@query(
    "prior_scale",
    "design",
    f"""select size_class, count(distinct taxon) as n_taxa, count(distinct taxon)+3 as upsilon, 5 as prior_df,
        round(3*(1-1/count(distinct taxon))/5,6) as prior_scale2,
        round(-{sql_tq(0.975, '5')}*sqrt(3*(1-1/count(distinct taxon))/5*20),6) as slope_p2_5, 0.0::double as slope_p50,
        round({sql_tq(0.975, '5')}*sqrt(3*(1-1/count(distinct taxon))/5*20),6) as slope_p97_5
        from design where n_reads>0 group by size_class""",
)
def prior_scale(t):
    out = biasmodel.prior_scale(model(t).n_taxa())
    return out.withColumns({c: r(c) for c in ["prior_scale2", "slope_p2_5", "slope_p97_5"]})


@query(
    "gamma_scan",
    "design",
    f"""with {sql_fit(SRC, gammas=str(biasmodel.GAMMAS))},
        s as (select grp, gamma, sum(log_ml) as log_ml from fit group by grp, gamma)
        select grp as size_class, gamma, round(log_ml,4) as log_ml, arg_max(gamma, log_ml) over (partition by grp)
          as best_gamma, gamma=arg_max(gamma, log_ml) over (partition by grp) as is_best from s""",
)
def gamma_scan(t):
    return model(t).gamma_scan().withColumn("log_ml", r("log_ml", 4))


def _effs_sql(fit: str, cols: str) -> str:
    q = ", ".join(
        f"round(beta{'' if p == 0.5 else '+' + sql_tq(p, 'df') + '*sqrt(scale2*v11)'},6)+0.0 as {n}"
        for n, p in biasmodel.SUMMARY.items()
    )
    return f"select {cols}, {q}, round(beta,6)+0.0 as mean_value from {fit}"


EFF_COLS = [*biasmodel.SUMMARY, "mean_value"]


@query("amp_effs", "design", f"with {FIT} {_effs_sql('fit', 'grp as size_class, taxon')}")
def amp_effs(t):
    return model(t).amp_effs().withColumns({c: r(c) for c in EFF_COLS})


@query(
    "significant_effects",
    "design",
    f"""with {FIT} select grp as size_class, taxon, round(beta,6)+0.0 as mean_value from fit
        where beta-{sql_tq(0.75, 'df')}*sqrt(scale2*v11)>0 or beta+{sql_tq(0.75, 'df')}*sqrt(scale2*v11)<0""",
)
def significant_effects(t):
    from biascomp.functions.numeric import significant_interval

    effs = model(t).amp_effs().where(significant_interval("p25", "p75"))
    return effs.select(SC, "taxon", r("mean_value").alias("mean_value"))


_POOLS_SQL = """select unnest(case when starts_with(sample_name,'C1') then ['All','A1','B3','C5','AllandSub']
     when contains(sample_name,'AllPool') then ['All','AllandSub'] when contains(sample_name,'A1') then ['A1','AllandSub']
     when contains(sample_name,'B3') then ['B3','AllandSub'] else ['C5','AllandSub'] end)
   || '_' || size_class || '_' || case run when '1' then '18S' else 'COI' end as grp, sample_name as obs,
  case when starts_with(sample_name,'C') then regexp_extract(sample_name,'^(.*)\\.[^.]+$',1) else 'Calibration' end as samp,
  coalesce(try_cast(substring(sample_name,1,2) as integer),30)::double as x, taxon, n_reads as n from obs_run"""


@query(
    "amp_effs_all",
    "obs_run",
    f"""with {sql_fit(_POOLS_SQL)}, e as ({_effs_sql('fit', 'grp as pool, taxon')})
        select *, regexp_extract(pool,'^([^_]+)',1) as pool_type, regexp_extract(pool,'(S1|S2|S3)',1) as size,
          regexp_extract(pool,'([^_]+)$',1) as primer,
          case regexp_extract(pool,'(S1|S2|S3)',1) when 'S1' then 0.2::double when 'S2' then 0.5 else 1 end as size_fraction,
          case regexp_extract(pool,'^([^_]+)',1) when 'All' then 1 when 'A1' then 2 when 'B3' then 3 when 'C5' then 4
            else 5 end as rank_pool from e""",
)
def amp_effs_all(t):
    """All pool sets, sizes and markers in one fit: an observation counts in every pool set it belongs to."""
    n = F.col("sample_name")
    sets = [["All", "A1", "B3", "C5", "AllandSub"], ["C5", "AllandSub"]]
    member = F.when(n.startswith("C1"), 0)
    for token, own in {"AllPool": "All", "A1": "A1", "B3": "B3"}.items():
        member = member.when(n.contains(token), len(sets))
        sets.append([own, "AllandSub"])
    primer = F.when(F.col("run") == "1", "18S").otherwise("COI")
    d = reshape.sample_design(t.obs_run, "sample_name").withColumns({"kind": member.otherwise(1), "primer": primer})
    effs = BiasModel(d, Columns(group=[SC, "primer", "kind"], sets=sets)).amp_effs()
    effs = effs.select(F.concat_ws("_", "kind", SC, "primer").alias("pool"), "taxon", *EFF_COLS)
    return reshape.parse_pool_key(effs.withColumns({c: r(c) for c in EFF_COLS}))


@query(
    "predict_cycle0",
    "design",
    f"""with {FIT} select grp as size_class, samp as sample, taxon, round(share,6) as share, round(share_low,6) as share_low,
        round(share_high,6) as share_high, round(eta,6)+0.0 as clr, round(eta-h,6)+0.0 as clr_low,
        round(eta+h,6)+0.0 as clr_high from pred""",
)
def predict_cycle0(t):
    out = model(t).predict()
    return out.withColumns({c: r(c) for c in out.columns if c not in (SC, "sample", "taxon")})


@query("predict_cycle0_draws")
def predict_cycle0_draws(t):
    return model(t).draws()


@query(
    "draws_check",
    "design",
    f"""with {FIT} select grp as size_class, samp as sample, count(*) as n_taxa, true as sums_to_one, true as in_order
        from pred group by grp, samp""",
)
def draws_check(t):
    """What holds of the drawn shares for any seed, per sample."""
    rising = (F.col("p2_5") <= F.col("p25")) & (F.col("p25") <= F.col("p50"))
    rising = rising & (F.col("p50") <= F.col("p75")) & (F.col("p75") <= F.col("p97_5"))
    return model(t).draws().groupBy(SC, "sample").agg(
        F.count(F.lit(1)).alias("n_taxa"),
        (F.abs(F.sum("mean_value") - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(rising & (F.col("p2_5") >= 0) & (F.col("p97_5") <= 1)).alias("in_order"),
    )


@query(
    "draws_mean_check",
    "design",
    f"""with {FIT}, wsum as (select grp, samp, ln(sum(exp(eta))) as lt from pred group by grp, samp),
        us as (select unnest(range(0,129))*0.25::double-26 as u), ts as (select unnest(range(0,73))*0.25::double-9 as t),
        nodes as (select p.grp, p.samp, p.taxon, u, pow(1+t*t/df,-(df+1)/2) as w, exp(least(u-lt+eta+sd*t,700)) as x
          from post p join wsum on p.grp=wsum.grp and p.samp=wsum.samp, us, ts),
        fac as (select grp, samp, taxon, u, greatest(sum(w*exp(-x))/sum(w),1e-300) as none, sum(w*x*exp(-x))/sum(w) as one
          from nodes group by all),
        lsum as (select grp, samp, u, sum(ln(none)) as l from fac group by all)
        select fac.grp as size_class, fac.samp as sample, taxon, round(sum(one/none*exp(l))*0.25,6) as expected, true as is_within
        from fac join lsum on fac.grp=lsum.grp and fac.samp=lsum.samp and fac.u=lsum.u group by all""",
)
def draws_mean_check(t):
    """The integral that the mean of the drawn shares tends to, and whether the mean lies within six standard errors."""
    fitted, keys = model(t), [SC, "sample", "taxon"]
    drawn = fitted.draws(n=1000)
    both = drawn.join(fitted.expected_shares(), keys)
    off = F.abs(F.col("mean_value") - F.col("expected"))
    within = off <= 6 * F.col("sd_value") / F.sqrt(F.lit(1000.0)) + 1e-9
    return both.select(*keys, r("expected").alias("expected"), within.alias("is_within"))


_HASH_SRC = r"""select size_class as grp, sample_name as obs, case when starts_with(sample_name,'C')
  then regexp_extract(sample_name,'^(.*)\.[^.]+$',1) else 'Calibration' end as samp,
  coalesce(try_cast(substring(sample_name,1,2) as integer),30)::double as x, hash as taxon, n_reads as n from hashed"""


@query(
    "draws_by_hash",
    "hashed",
    f"""with {sql_fit(_HASH_SRC)} select grp as size_class, samp as sample, pred.taxon, round(share,6) as share, true as inside
        from pred semi join (select distinct grp, samp, taxon from src) seen using (grp, samp, taxon)""",
)
def draws_by_hash(t):
    """Drawn shares of thousands of categories, for those with reads: the closed form lies inside their interval."""
    fitted = BiasModel(reshape.sample_design(t.hashed, "sample_name"), Columns(category="hash"))
    both = fitted.draws_seen(n=100).join(fitted.predict(seen_only=True), [SC, "sample", "taxon"])
    inside = (F.col("share") >= F.col("p2_5")) & (F.col("share") <= F.col("p97_5"))
    return both.select(SC, "sample", "taxon", r("share").alias("share"), inside.alias("inside"))


@query(
    "ppc_order",
    "design",
    f"""with {FIT}, cells as (select o.grp, o.obs, tx.taxon, coalesce(s.n,0) as n from o join tx on o.grp=tx.grp
          left join src s on s.grp=o.grp and s.obs=o.obs and s.taxon=tx.taxon)
        select grp as size_class, obs, taxon, cast(n as bigint) as observed,
          row_number() over (partition by grp, obs order by n desc, taxon) as place from cells""",
)
def ppc_order(t):
    """Observed counts of the predictive check from the largest down within each observation."""
    out = model(t).posterior_predictive(n=50)
    return out.select(SC, "obs", "taxon", "observed", F.col("place").cast("long").alias("place"))


@query("ppc")
def ppc(t):
    return model(t).posterior_predictive()


#: Share of the observed counts that their 95 % intervals must cover, with room for counts on the edge.
COVERAGE_BAND = (0.9, 1.0)


@query(
    "ppc_coverage",
    "design",
    f"""with {FIT} select o.grp as size_class, count(*) as n_cells, cast(sum(coalesce(s.n,0)) as bigint) as observed,
        count(s.n) as n_seen, true as in_order, true as coverage_in_band from o join tx on o.grp=tx.grp
        left join src s on s.grp=o.grp and s.obs=o.obs and s.taxon=tx.taxon group by o.grp""",
)
def ppc_coverage(t):
    """Coverage of the predictive intervals per size class, as flags that hold for any seed."""
    low, high = COVERAGE_BAND
    covered = F.avg(F.col("covered").cast("double"))
    return model(t).posterior_predictive().groupBy(SC).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("observed").alias("observed"),
        F.count(F.when(F.col("observed") > 0, F.lit(1))).alias("n_seen"),
        F.bool_and((F.col("p2_5") <= F.col("p50")) & (F.col("p50") <= F.col("p97_5"))).alias("in_order"),
        covered.between(low, high).alias("coverage_in_band"),
    )


@query(
    "focus_filters",
    "design",
    f"""with {FIT} select * from ({_effs_sql('fit', 'grp as size_class, taxon')}) where size_class='S2' and taxon='Brand#3'""",
)
def focus_filters(t):
    """Slope of one coordinate in one size class."""
    return amp_effs(t).where((F.col(SC) == "S2") & (F.col("taxon") == "Brand#3"))


@query(
    "predicted_observed",
    "design",
    f"""with {FIT} select grp as size_class, samp as sample, taxon, 0 as cycle_num, round(share,6) as share,
          round(share_low,6) as share_low, round(share_high,6) as share_high, 'predicted '||samp as replicate from pred
        union all select size_class, sample_num, taxon, 30,
          round(n_reads/sum(n_reads) over (partition by size_class, sample_name),6), null, null, sample_name
        from design where sample_num<>'Calibration'""",
)
def predicted_observed(t):
    out = model(t).predicted_and_observed()
    return out.withColumns({c: r(c) for c in ["share", "share_low", "share_high"]})


@query(
    "residual_covariance",
    "design",
    f"""with {FIT}, res as (select y.grp, y.obs, y.taxon, y.y-f.beta*y.x-(sa.sy-f.beta*sa.sx)/sa.m as e from y
          join fit f on y.grp=f.grp and y.taxon=f.taxon
          join sa on sa.grp=y.grp and sa.samp=y.samp and sa.taxon=y.taxon)
        select a.grp as size_class, a.taxon, b.taxon as taxon2, count(*) as n, round(covar_samp(a.e,b.e),6)+0.0 as covariance
        from res a join res b on a.grp=b.grp and a.obs=b.obs and a.taxon<=b.taxon group by all""",
)
def residual_covariance(t):
    return model(t).residual_covariance().withColumn("covariance", r("covariance"))


@query(
    "residual_covariance_median",
    "design",
    f"""with {FIT}, res as (select y.grp, y.obs, y.taxon, y.y-f.beta*y.x-(sa.sy-f.beta*sa.sx)/sa.m as e from y
          join fit f on y.grp=f.grp and y.taxon=f.taxon
          join sa on sa.grp=y.grp and sa.samp=y.samp and sa.taxon=y.taxon),
        c as (select a.grp, covar_samp(a.e,b.e) as c from res a join res b on a.grp=b.grp and a.obs=b.obs
          and a.taxon<=b.taxon group by a.grp, a.taxon, b.taxon)
        select grp as size_class, count(*) as n_pairs, round(median(c),6)+0.0 as median_covariance from c group by grp""",
)
def residual_covariance_median(t):
    pairs = checkpoint(model(t).residual_covariance())
    mid = ordered.median(pairs, [SC], "covariance", "median_covariance")
    n = pairs.groupBy(SC).agg(F.count(F.lit(1)).alias("n_pairs"))
    return groups.join_on(n, mid, [SC]).withColumn("median_covariance", r("median_covariance"))


# ------------------------------------------------------------------ raw versus corrected

RAW = """rawf as (select size_class, sample_num as sample, taxon, sum(n_reads) as n, sum(n_reads)/sum(sum(n_reads))
  over (partition by size_class, sample_num) as raw from design where sample_num<>'Calibration'
  group by size_class, sample_num, taxon),
 rc as (select p.grp as size_class, p.samp as sample, p.taxon, raw, share as corrected, share_low, share_high
   from pred p left join rawf r on p.grp=r.size_class and p.samp=r.sample and p.taxon=r.taxon)"""


def raw_and_corrected(t, seen_only: bool = False):
    """Observed and corrected share of every category in every field sample, or of those with reads."""
    counts = t.design.groupBy(SC, F.col("sample_num").alias("sample"), "taxon").agg(F.sum("n_reads").alias("n_reads"))
    raw = composition.closure(counts, [SC, "sample"], "n_reads", "raw").drop("n_reads")
    pred = model(t).predict(seen_only=seen_only).withColumnRenamed("share", "corrected")
    return groups.join_on(pred, raw, [SC, "sample", "taxon"])


@query(
    "bias_log2",
    "design meta",
    f"""with {FIT}, {RAW}, b as (select size_class, taxon, zone, log2(raw/corrected) as l, log2(raw/share_high) as lo,
          log2(raw/share_low) as hi from rc left join meta on split_part(sample,'_',1)=station where raw>0),
        s as (select size_class, taxon, zone, avg(l) as log2_bias, avg(lo) as log2_low, avg(hi) as log2_high
          from b group by all),
        ord as (select taxon, row_number() over (order by avg(log2_bias), taxon) as taxon_order from s group by taxon)
        select size_class, s.taxon, zone, round(log2_bias,6)+0.0 as log2_bias, round(log2_low,6)+0.0 as log2_low,
          round(log2_high,6)+0.0 as log2_high, taxon_order from s join ord on s.taxon=ord.taxon""",
)
def bias_log2(t):
    both = raw_and_corrected(t, seen_only=True).withColumn("station", F.substring_index("sample", "_", 1))
    bias = composition.log2_bias(both, "raw", "corrected", "share_low", "share_high")
    cols = ["log2_bias", "log2_low", "log2_high"]
    mean = checkpoint(groups.join_on(bias, t.meta, ["station"], null_safe=False).groupBy(SC, "taxon", "zone").agg(*[F.avg(c).alias(c) for c in cols]))
    order = ordered.order_by_mean(mean, [], "taxon", "log2_bias", "taxon_order").drop("mean_value")
    return groups.join_on(mean, order, ["taxon"]).withColumns({c: r(c) for c in cols})


@query(
    "corrected_counts",
    "design",
    f"""with {FIT}, d as (select size_class, sample_num as sample, sum(n_reads)::bigint as depth from design group by all)
        select p.grp as size_class, p.samp as sample, taxon, depth, round(share*depth,6) as corrected from pred p
        left join d on p.grp=d.size_class and p.samp=d.sample""",
)
def corrected_counts(t):
    counts = t.design.withColumnRenamed("sample_num", "sample")
    out = composition.corrected_counts(model(t).predict(), counts, [SC, "sample"], "share", "n_reads")
    return out.select(SC, "sample", "taxon", "depth", r("corrected").alias("corrected"))


@query(
    "raw_vs_corrected",
    "design",
    f"""with {FIT}, {RAW}, s as (select size_class, split_part(sample,'_',1) as station, taxon, coalesce(sum(raw),0) as raw,
          coalesce(sum(corrected),0) as corrected from rc group by all),
        l as (select size_class, station, taxon, 'raw' as metric, raw as reads from s
              union all select size_class, station, taxon, 'corrected', corrected from s)
        select size_class, station, taxon, metric, round(reads,6) as reads,
          round(reads/sum(reads) over (partition by size_class, station, metric)+1e-9::double,6) as proportion from l""",
)
def raw_vs_corrected(t):
    both = raw_and_corrected(t).withColumn("station", F.substring_index("sample", "_", 1))
    out = composition.raw_vs_corrected(both, [SC, "station"], "taxon", "raw", "corrected")
    # raw shares are often decimal ties (33/640) that the order of summation tips either way; both
    # sides add the same tiny amount before rounding
    return out.withColumns({"reads": r("reads"), "proportion": r(F.col("proportion") + 1e-9)})


@query(
    "effs_vs_abundance",
    "design",
    f"""with {FIT}, sh as (select *, n_reads/sum(n_reads) over (partition by size_class, sample_name) as s from design),
        n as (select size_class, count(distinct sample_name) as ns from design group by all),
        ms as (select sh.size_class, taxon, sum(s)/max(ns) as mean_share from sh join n on sh.size_class=n.size_class
               group by all),
        j as (select ms.size_class, beta, mean_share, log2(mean_share) as l from fit
              join ms on fit.grp=ms.size_class and fit.taxon=ms.taxon where mean_share>0),
        f as (select size_class, corr(beta,mean_share) as r, regr_slope(l,beta) as slope, regr_intercept(l,beta) as intercept,
              corr(l,beta) as r2, count(*) as n, cast(count(*)-2 as double) as df from j group by size_class)
        select size_class, n, round(r,6)+0.0 as r, round({sql_t_p('r*sqrt(df/(1-r*r))', 'df')},6) as p,
          round(slope,6)+0.0 as slope, round(intercept,6)+0.0 as intercept, round(r2*r2,6) as r2,
          round({sql_t_p('r2*sqrt(df/(1-r2*r2))', 'df')},6) as p_slope from f""",
)
def effs_vs_abundance(t):
    share = composition.mean_share(t.design, [SC], "sample_name", "taxon", "n_reads")
    both = biasmodel.effs_vs_abundance(model(t).amp_effs(), share, [SC])
    cor = stats.cor_test(both, [SC], "mean_value", "mean_share").select(SC, "n", r("r").alias("r"), r("p").alias("p"))
    line = stats.ols(both, [SC], "mean_value", "log2_share").select(
        SC, *[r(c).alias(c) for c in ["slope", "intercept", "r2"]], r("p").alias("p_slope")
    )
    return groups.join_on(cor, line, [SC])
