"""Corrections guarded on two blocks, a constrained weight grid and the composition of fitted trials, over all forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.operators import composition as X
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import SERIES, forecasts, series_day
from asoflow.sources.scratch import written

_METHODS = ("average", "seasonal", "blend")
_BLOCK = "case when target < date'1998-01-01' then 1 when target < date'2000-01-01' then 2 else 3 end"
_ROWS = f"""m0 as (select f.product, f.location, f.channel, f.origin, f.h, f.target, f.y, f.p as average, coalesce(s.units, f.p) as seasonal, 0.5 * (f.p + coalesce(s.units, f.p)) as blend, {_BLOCK.replace("date'", "date '")} as block from forecasts f left join series_day s on s.product = f.product and s.location = f.location and s.channel = f.channel and s.day = f.target - 14 where f.p is not null and f.y is not null),
    ml as (select product, location, channel, origin, h, target, y, block, 'average' as method, 0 as place, average as raw from m0 union all select product, location, channel, origin, h, target, y, block, 'seasonal', 1, seasonal from m0 union all select product, location, channel, origin, h, target, y, block, 'blend', 2, blend from m0)"""
_CHOICE = """f1 as (select channel, method, place, median(y - raw) as shift, sum(y) as sy, sum(raw) as sp, avg(y) as my from ml where block = 1 group by all),
    fx as (select channel, method, place, 'median' as head, 0 as mode, 1.0::double as ratio, 0.0::double as shift from f1 union all select channel, method, place, 'mean', 0, 1.0, 0.0 from f1 union all select channel, method, place, 'median', 1, 1.0, shift from f1
        union all select channel, method, place, 'mean', 1, case when sp = 0 then 1.0 else least(greatest(sy / sp, 0.8), 1.25) end, case when sp = 0 then my else 0.0 end from f1),
    fe as (select ml.channel, head, ml.method, ml.place, mode, ratio, shift, block, y, greatest(0.0, raw * ratio + shift) - y as e from ml join fx on fx.channel = ml.channel and fx.method = ml.method where block < 3),
    fb as (select channel, head, method, place, mode, ratio, shift, block, count(*) as n, round(avg(case when head = 'median' then abs(e) else e * e end), 9) as cost, round(sum(e) / nullif(sum(y), 0), 9) as bias from fe group by all),
    fo as (select a.* exclude (block, n, cost, bias), a.n as n1, a.cost as cost1, a.bias as bias1, b.n as n2, b.cost as cost2, b.bias as bias2 from fb a join fb b on a.channel = b.channel and a.head = b.head and a.method = b.method and a.mode = b.mode where a.block = 1 and b.block = 2),
    fr as (select channel, head, method as baseline, cost1 as r1, cost2 as r2, n1 as rn1, n2 as rn2 from fo where mode = 0 and method in ('average', 'seasonal') qualify row_number() over (partition by channel, head order by cost2, place) = 1),
    fa as (select fo.*, baseline, r2, row_number() over (partition by fo.channel, fo.head order by cost2, mode, place) as k from fo join fr on fr.channel = fo.channel and fr.head = fo.head where cost1 <= r1 * case when fo.head = 'median' then 1.02 else 1.0 end and cost2 <= r2 * case when fo.head = 'median' then 1.02 else 1.0 end and (fo.head = 'median' or (abs(bias1) <= 0.05 and abs(bias2) <= 0.05))),
    fc as (select fr.channel, fr.head, fr.baseline, least(rn1, rn2) < 100 as few, method is null or (fr.head = 'median' and cost2 >= fr.r2) as nothing, method, mode, ratio, shift from fr left join fa on fa.channel = fr.channel and fa.head = fr.head and k = 1),
    ch as (select channel, head, baseline, case when few or nothing then baseline else method end as selected, case when few or nothing then 0 else mode end as mode, case when few or nothing then 1.0 else ratio end as ratio, case when few or nothing then 0.0 else shift end as shift, case when few then 'sparse_fallback' when nothing or (method = baseline and mode = 0) then 'baseline_retained' else 'guarded_selection' end as reason from fc)"""


def _rows(spark, d):
    back = series_day(spark, d).select(*SERIES, F.date_add("day", 14).alias("target"), F.col("units").alias("_u"))
    f = forecasts(spark, d).where("p is not null and y is not null").join(back, [*SERIES, "target"], "left").withColumn("seasonal", F.coalesce("_u", "p"))
    raws = {"average": F.col("p"), "seasonal": F.col("seasonal"), "blend": 0.5 * (F.col("p") + F.col("seasonal"))}
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("place"), raws[m].alias("raw")) for k, m in enumerate(_METHODS)])
    return f.select(*SERIES, "origin", "h", "target", "y", F.expr(_BLOCK).alias("block"), F.inline(methods))


@query("ag30_guarded_correction", sql(f"with {_ROWS}, {_CHOICE} select channel, head, baseline, selected, mode, round(ratio, 6) as ratio, round(shift, 6) as \"offset\", reason from ch", "forecasts", "series_day"))
def _(spark, d):
    """Per channel and head: ratio of sums or median residual fitted before 1998, kept only if it holds there and in 1998 and 1999."""
    c = X.guarded_selection(_rows(spark, d), ["channel"], ["average", "seasonal"])
    return c.withColumns({"ratio": F.round("ratio", 6), "offset": F.round("offset", 6)})


@query("ml14_fitted_composition", sql(f"""with {_ROWS}, {_CHOICE}, cp as (select ml.channel, product, location, origin, h, max(y) as y, max(case when head = 'median' and method = selected then greatest(0.0, raw * ratio + shift) end) as median, max(case when head = 'mean' and method = selected then greatest(0.0, raw * ratio + shift) end) as mean,
        max(case when head = 'median' and method = baseline then greatest(0.0, raw) end) as rmedian, max(case when head = 'mean' and method = baseline then greatest(0.0, raw) end) as rmean, max(block) as block from ml join ch on ch.channel = ml.channel where block > 1 group by all),
    bd as (select channel, quantile_cont(abs(y - median), 0.9) as half from cp where block = 2 group by 1)
    select cp.channel, h, count(*) as n, round(avg(abs(y - median)), 6) as mae, round(avg(abs(y - rmedian)), 6) as reference_mae, round(avg((y - mean) * (y - mean)), 4) as mse, round(avg((y - rmean) * (y - rmean)), 4) as reference_mse, round(avg(case when y between greatest(0.0, median - half) and median + half then 1.0 else 0.0 end), 6) as coverage from cp join bd on bd.channel = cp.channel where block = 3 group by all""", "forecasts", "series_day"))
def _(spark, d):
    """Trials fitted and chosen before 2000 are frozen and composed for all later days, with a band of the chosen median's residuals, beside the frozen reference."""
    rows = written(_rows(spark, d))  # fitting, choosing, composing and the band read them
    choice = X.guarded_selection(rows, ["channel"], ["average", "seasonal"])
    made = X.composed(rows.where("block > 1"), choice, ["channel"], [*SERIES, "origin", "h", "block"])
    band = X.quantiles(made.where("block = 2").withColumn("_e", F.abs(F.col("y") - F.col("median"))), ["channel"], "_e", {"half": 0.9}).drop("n")
    later = made.where("block = 3").join(band, "channel")
    gap = {c: F.col("y") - F.col(c) for c in ("median", "mean", "reference_median", "reference_mean")}
    inside = F.col("y").between(F.greatest(F.lit(0.0), F.col("median") - F.col("half")), F.col("median") + F.col("half"))
    return later.groupBy("channel", "h").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(gap["median"])), 6).alias("mae"), F.round(F.avg(F.abs(gap["reference_median"])), 6).alias("reference_mae"), F.round(F.avg(gap["mean"] * gap["mean"]), 4).alias("mse"),
        F.round(F.avg(gap["reference_mean"] * gap["reference_mean"]), 4).alias("reference_mse"), F.round(F.avg(inside.cast("double")), 6).alias("coverage"),
    )


@query("ag31_constrained_grid", sql(f"""with {_ROWS}, r as (select channel, block, raw as base, y from ml where method = 'average' and block < 3), o as (select channel, block, avg(y - base) as off from r group by all), b as (select r.channel, r.block, base, any_value(off) as off, count(*) as n, sum(y) as sy, sum(y * y) as syy from r join o on o.channel = r.channel and o.block = r.block group by all),
    g as (select channel, block, w, sum(n) as n, sum(sy) as sy, sum(greatest(0.0, base + w * off) * n) as sp, sum(syy - 2 * greatest(0.0, base + w * off) * sy + greatest(0.0, base + w * off) * greatest(0.0, base + w * off) * n) as sse from b cross join (select unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.5])::double as w) group by all),
    e as (select channel, block, w, n, round(sse / n, 6) as mse, round((sp - sy) / nullif(sy, 0), 9) as bias from g), z as (select e.*, x.mse as base from e join e x on x.channel = e.channel and x.block = e.block and x.w = 0),
    v as (select channel, w, max(case when block = 2 then mse end) as mse, max(case when block = 2 then bias end) as bias, count(case when n >= 100 and mse <= base and abs(bias) <= 0.05 then 1 end) = 2 as feasible from z group by all)
    select channel, w as weight, round(mse, 4) as mse, round(bias, 6) as bias, feasible, feasible and row_number() over (partition by channel, feasible order by mse, w) = 1 as chosen from v""", "forecasts", "series_day"))
def _(spark, d):
    """How much of each channel's mean residual to add to its forecasts: the cheapest weight that breaks no constraint in either block."""
    rows = _rows(spark, d).where("method = 'average' and block < 3").select("channel", "block", F.col("raw").alias("base"), "y")
    offsets = rows.groupBy("channel", "block").agg(F.avg(F.col("y") - F.col("base")).alias("offset"))
    bins = rows.groupBy("channel", "block", "base").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")).join(offsets, ["channel", "block"])
    return X.weight_grid(bins, ["channel"], (0.0, 0.25, 0.5, 0.75, 1.0, 1.5)).withColumns({"mse": F.round("mse", 4), "bias": F.round("bias", 6)})
