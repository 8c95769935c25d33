"""Queries on metrics, order statistics, scores and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.functions import columns as C
from asoflow.operators import metrics as M
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import SERIES, forecasts, returns, scores, series_day, table
from asoflow.sources.scratch import written

_E = "case when y is not null and p is not null then p - y end"
_POINT = f"""count(y) as n, count(case when y is not null and p is not null then 1 end) as n_predicted, count(case when p > y then 1 end) as n_over, count(case when p < y then 1 end) as n_under, count(case when p is not null and y > 0 then 1 end) as n_positive,
    sum(abs({_E})) as s_abs, sum(({_E}) * ({_E})) as s_sq, sum({_E}) as s_e, sum(case when p is not null then y end) as s_y, sum(case when y > 0 then abs({_E}) / y end) as s_ape"""


def _metrics(sums: str, group: str) -> str:
    def m(x: str) -> str:
        return f"round(case when n > 0 and n = n_predicted then {x} end, 6)"

    return f"""select {group}, n, n_predicted, n_over, n_under, n_positive, {m('s_abs / n')} as mae, {m('s_sq / n')} as mse, {m('sqrt(s_sq / n)')} as rmse, {m('s_e / n')} as bias, {m('s_e / nullif(s_y, 0)')} as normalized_bias,
    {m('s_abs / nullif(s_y, 0)')} as wape, {m('0.0')} as zero_excess, {m('s_ape / nullif(n_positive, 0)')} as mape, round(n_predicted / nullif(n, 0), 6) as prediction_coverage from ({sums})"""


@query("ag02_point_metrics", sql(_metrics(f"select h, {_POINT} from forecasts group by h", "h"), "forecasts"))
def _(spark, d):
    return M.point_metrics(forecasts(spark, d).groupBy("h").agg(*M.point_sums()))


@query("ag03_segment_metrics", sql(_metrics(f"select product, channel, {_POINT} from forecasts where p is not null group by all", "product, channel"), "forecasts"))
def _(spark, d):
    return M.point_metrics(forecasts(spark, d).where("p is not null").groupBy("product", "channel").agg(*M.point_sums()))


_TAGS = " union all ".join(f"select '{c}' as dimension, cast({c} as varchar) as value, y, p from forecasts" for c in ("product", "location", "channel", "h")) + " union all select 'all', 'all', y, p from forecasts"


@query("ag05_by_dimensions", sql(_metrics(f"select dimension, value, {_POINT} from ({_TAGS}) group by all", "dimension, value") + " union all select 'channel', 'X', 0, 0, null, null, null, null, null, null, null, null, null, null, null, null", "forecasts"))
def _(spark, d):
    cells = forecasts(spark, d).groupBy("product", "location", "channel", "h").agg(*M.point_sums())
    dims = ["product", "location", "channel", "h"]
    tags = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dims])
    required = cells.select(F.inline(tags)).distinct().union(spark.createDataFrame([("channel", "X")], "dimension string, value string"))
    return M.point_metrics(M.by_dimensions(cells, dims, required))


@query("ag06_merge", sql(_metrics(f"select channel, {_POINT} from forecasts where p is not null group by all", "channel"), "forecasts"))
def _(spark, d):
    cells = forecasts(spark, d).where("p is not null").groupBy("channel", "origin").agg(*M.point_sums())
    return M.point_metrics(M.merged(cells, ["channel"]))


@query("ag35_leaf_margins", sql("""select dimension, value, count(y) as n, round(sum(abs(p - y)), 4) as s_abs from (select 'location' as dimension, location as value, y, p from forecasts union all select 'channel', channel, y, p from forecasts union all select 'all', 'all', y, p from forecasts) group by all""", "forecasts"))
def _(spark, d):
    cells = forecasts(spark, d).groupBy("location", "channel", "product").agg(*M.point_sums())
    return M.by_dimensions(cells, ["location", "channel"]).select("dimension", "value", "n", F.round("s_abs", 4).alias("s_abs"))


_SCORE = "(p + 40 - (p - 40)) + 2.0 / (1.0 - 0.8) * (greatest(p - 40 - y, 0) + greatest(y - (p + 40), 0))"


@query("ag04_interval_metrics", sql(f"select location, count(y) as n, round(avg(case when y between p - 40 and p + 40 then 1 else 0 end), 6) as coverage, round(avg(80.0), 6) as mean_width, round(avg({_SCORE}), 6) as mean_score from forecasts where p is not null and y is not null group by 1", "forecasts"))
def _(spark, d):
    f = forecasts(spark, d).where("p is not null and y is not null").withColumns({"low": F.col("p") - 40, "high": F.col("p") + 40})
    return M.interval_metrics(f, ["location"], "y", "low", "high", 0.8)


_RES = "(select product, location, channel, h, origin, target, y, p, y - p as e from forecasts where y is not null and p is not null)"


def _errors(spark, d):
    return forecasts(spark, d).where("y is not null and p is not null").withColumn("e", F.col("y") - F.col("p"))


@query("ag07_residual_quantile", sql(f"""select h, product, max(n) as n, case when max(n) >= 30 and ceil(round((max(n) + 1) * 0.9, 9)) <= max(n) then max(case when k = ceil(round((n + 1) * 0.9, 9)) then r end) end as quantile, case when max(n) >= 30 and ceil(round((max(n) + 1) * 0.9, 9)) <= max(n) then 'ready' else 'not_ready' end as status
    from (select h, product, round(abs(e), 6) as r, row_number() over (partition by h, product order by round(abs(e), 6)) as k, count(*) over (partition by h, product) as n from {_RES}) group by all""", "forecasts"))
def _(spark, d):
    return M.residual_quantile(_errors(spark, d), ["h", "product"], F.round(F.abs("e"), 6), 0.9, 30)


_BANDS = "(select product, channel, location, round(y - (p - 40), 6) as lo, round(y - (p + 40), 6) as hi from forecasts where y is not null)"
_SHIFT = """select {keys} count(*) as rows, count(*) filter (lo is null) as without, min(lo) filter (kl >= floor(round((n + 1) * 0.05, 9)) and lo is not null) as lower_shift, min(hi) filter (kh >= ceil(round((n + 1) * 0.95, 9)) and hi is not null) as upper_shift
    from (select *, count(*) over w as n, row_number() over (w order by lo nulls last) as kl, row_number() over (w order by hi nulls last) as kh from {bands} window w as (partition by {by})) group by {group}"""
_READY = "{t}.rows >= 150 and {t}.without = 0 and floor(round(({t}.rows + 1) * 0.05, 9)) >= 1 and ceil(round(({t}.rows + 1) * 0.95, 9)) <= {t}.rows"


def _shift(keys: str) -> str:
    return _SHIFT.format(keys=f"{keys}," if keys else "", by=keys or "1", group=keys or "()", bands=_BANDS)


def _pick(column: str) -> str:
    return "case " + " ".join(f"when {_READY.format(t=t)} then {t}.{column}" for t in "abc") + f" end as {column}"


@query("ag08_endpoint_shift", sql(f"""with a as ({_shift('product, channel, location')}), b as ({_shift('product, channel')}), c as ({_shift('')})
    select a.product, a.channel, a.location, {_pick('lower_shift')}, {_pick('upper_shift')}, {_pick('rows')}, case when {_READY.format(t='a')} then 0 when {_READY.format(t='b')} then 1 when {_READY.format(t='c')} then 2 end as level from a join b using (product, channel) cross join c""", "forecasts"))
def _(spark, d):
    f = written(forecasts(spark, d)).withColumns({"low": F.col("p") - 40, "high": F.col("p") + 40})  # each level reads them four times
    out = M.endpoint_shift(f, [["product", "channel", "location"], ["product", "channel"], []], "y", "low", "high", 0.05, 150)
    return out.withColumns({c: F.round(c, 6) for c in ("lower_shift", "upper_shift")})


_SCALED = "(select product, channel, round((y - p) / greatest(0.5, sqrt(greatest(p, 0.0))), 6) as r from forecasts where y is not null and p is not null)"


def _window(keys: str) -> str:
    name, by = (f"{keys}," if keys else ""), keys or "1"
    same = " and ".join(["b.k = a.k + least(a.n, ceil(round((a.n + 1) * 0.8, 9))) - 1", *[f"a.{c} = b.{c}" for c in keys.split(", ") if c]])
    return f"""select * from (select {', '.join([*[f'a.{c}' for c in keys.split(', ') if c], 'a.n as n', 'a.r as low', 'b.r as high'])}, row_number() over (partition by {', '.join(f'a.{c}' for c in keys.split(', ')) if keys else '1'} order by round(b.r - a.r, 9), a.r) as place
        from s{len(keys.split(', ')) if keys else 0} a join s{len(keys.split(', ')) if keys else 0} b on {same}) where place = 1"""


def _sorted(keys: str) -> str:
    return f"select *, row_number() over (partition by {keys or '1'} order by r) as k, count(*) over (partition by {keys or '1'}) as n from {_SCALED}"


@query("ag34_shortest_band", sql(f"""with s2 as ({_sorted('product, channel')}), s1 as ({_sorted('product')}), s0 as ({_sorted('')}), a as ({_window('product, channel')}), b as ({_window('product')}), c as ({_window('')}), g as (select distinct product, channel from {_SCALED})
    select g.product, g.channel, case when a.n >= 4000 then round(a.high - a.low, 5) when b.n >= 4000 then round(b.high - b.low, 5) when c.n >= 4000 then round(c.high - c.low, 5) end as width, case when a.n >= 4000 then a.n when b.n >= 4000 then b.n when c.n >= 4000 then c.n end as n,
    case when a.n >= 4000 then 0 when b.n >= 4000 then 1 when c.n >= 4000 then 2 end as level from g left join a using (product, channel) left join b on b.product = g.product cross join c""", "forecasts"))
def _(spark, d):
    b = M.signed_band(forecasts(spark, d), [["product", "channel"], ["product"], []], "y", "p", 0.8, 4000)
    return b.select("product", "channel", F.round(F.col("high") - F.col("low"), 5).alias("width"), "n", "level")


@query("ag13_confusion", sql("""select segment, count(case when p >= 0.5 and y = 1 then 1 end) as tp, count(case when p >= 0.5 and y = 0 then 1 end) as fp, count(case when p < 0.5 and y = 1 then 1 end) as fn, count(case when p < 0.5 and y = 0 then 1 end) as tn,
    round(count(case when p >= 0.5 and y = 1 then 1 end) / nullif(count(case when p >= 0.5 then 1 end), 0), 6) as "precision", round(count(case when p >= 0.5 and y = 1 then 1 end) / nullif(count(case when y = 1 then 1 end), 0), 6) as recall,
    count(case when p >= 0.5 and y = 0 then 1 end) * 1.0::double + count(case when p < 0.5 and y = 1 then 1 end) * 5.0::double as cost from scores group by 1""", "scores"))
def _(spark, d):
    return scores(spark, d).groupBy("segment").agg(*M.confusion(F.col("p") >= 0.5, F.col("y")))


@query("ag14_average_precision", sql("""with t as (select segment, p, sum(y) as t, count(*) as n from scores group by all), c as (select *, sum(t) over w as ct, sum(n) over w as cn from t window w as (partition by segment order by p desc rows unbounded preceding))
    select segment, cast(sum(n) as bigint) as n, cast(sum(t) as bigint) as n_positive, round(case when sum(t) > 0 and sum(t) < sum(n) then sum(t * ct / cn) / sum(t) end, 6) as average_precision from c group by 1""", "scores"))
def _(spark, d):
    return M.average_precision(scores(spark, d), ["segment"], "p", "y")


@query("ag15_roc_auc", sql("""with c as (select segment, count(*) filter (y = 1) as n_positive, count(*) filter (y = 0) as n_negative from scores group by 1), r as (select a.segment, round(avg(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end), 6) as roc_auc from scores a join scores b on a.segment is not distinct from b.segment and a.y = 1 and b.y = 0 group by 1)
    select c.segment, n_positive, n_negative, roc_auc from c left join r on c.segment is not distinct from r.segment""", "scores"))
def _(spark, d):
    return M.roc_auc(scores(spark, d), ["segment"], "p", "y")


@query("ag16_brier", sql("select segment, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier, round(avg(y), 6) as prevalence, round(avg(y) * (1 - avg(y)), 6) as constant_brier from scores group by 1", "scores"))
def _(spark, d):
    return M.brier(scores(spark, d), ["segment"], "p", "y")


@query("ag17_reliability", sql("""select segment, bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate, round(abs(avg(p) - avg(y)) * count(*) / sum(count(*)) over (partition by segment), 6) as gap from (select *, cast(least(floor(p * 5), 4) as bigint) as bin from scores) group by segment, bin""", "scores"))
def _(spark, d):
    return M.reliability(scores(spark, d), ["segment"], "p", "y")


@query("ag18_threshold_sweep", sql("select t / 10.0 as threshold, count(case when p >= t / 10.0 and y = 1 then 1 end) as tp, count(case when p >= t / 10.0 and y = 0 then 1 end) as fp, count(case when p < t / 10.0 and y = 1 then 1 end) as fn from scores cross join (select unnest(range(1, 10)) as t) group by 1", "scores"))
def _(spark, d):
    t = spark.range(1, 10).select((F.col("id") / 10.0).alias("threshold"))
    s = scores(spark, d).crossJoin(F.broadcast(t))  # nine thresholds
    return s.groupBy("threshold").agg(*M.confusion(F.col("p") >= F.col("threshold"), F.col("y"))[:3])


@query("ag36_segmented_risk", sql("""select dimension, value, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier, round(avg(y), 6) as prevalence, round(avg(y) * (1 - avg(y)), 6) as constant_brier from (select 'all' as dimension, 'all' as value, p, y from scores union all select 'segment', segment, p, y from scores
    union all select 'risk', case when p < 0.2 then 'low' when p < 0.5 then 'medium' when p < 0.8 then 'high' else 'critical' end, p, y from scores) group by all""", "scores"))
def _(spark, d):
    from asoflow.functions.columns import risk_band

    tags = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), F.struct(F.lit("segment").alias("dimension"), F.col("segment").alias("value")), F.struct(F.lit("risk").alias("dimension"), risk_band(F.col("p")).alias("value")))
    return M.brier(scores(spark, d).select("p", "y", F.inline(tags)), ["dimension", "value"], "p", "y")


@query("wn13_topk_per_origin", sql("""select segment, doc_id, p, rank from (select segment, doc_id, p, row_number() over (partition by segment order by p desc, doc_id) as rank, count(*) over (partition by segment) as n from scores) where rank <= ceil(round(n * 0.1, 9))""", "scores"))
def _(spark, d):
    return M.top_k_per_origin(scores(spark, d), ["segment"], "p", "doc_id", 0.1).select("segment", "doc_id", "p", "rank")


@query("ag22_cluster_sums", sql(f"select cast(floor((target - date '1998-01-01') / 28) as bigint) as block, product, count(*) as n, round(sum(abs(e)), 4) as s_abs, sum(y) as s_y from {_RES} group by all", "forecasts"))
def _(spark, d):
    e = _errors(spark, d).withColumn("block", F.floor(F.datediff("target", F.lit("1998-01-01").cast("date")) / 28))
    return e.groupBy("block", "product").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("e")), 4).alias("s_abs"), F.sum("y").alias("s_y"))


_POISSON = " + ".join(f"case when u >= {t!r} then 1 else 0 end" for t in M.poisson_steps())


@query("ag23_cluster_bootstrap", sql(f"""with c as (select cast(floor((target - date '1998-01-01') / 28) as bigint) as block, product, location, channel, sum(abs(e)) as a, sum(y) as b from {_RES} group by all), u as (select a, b, rep, cast(('0x' || substr(md5(block || '|' || product || '|' || location || '|' || channel || '|' || rep || '|42'), 1, 8)) as bigint) / 4294967296.0 as u from c cross join (select unnest(range(1, 501)) as rep)),
    m as (select rep, a, b, {_POISSON} as m from u), r as (select rep, sum(a * m) / nullif(sum(b * m), 0) as ratio from m group by 1), l as (select quantile_cont(ratio, 0.025) as low, quantile_cont(ratio, 0.975) as high, count(ratio) as valid from r), w as (select sum(a) / sum(b) as estimate, count(*) as clusters from c)
    select round(estimate, 6) as estimate, case when clusters >= 10 and valid = 500 then round(low, 6) end as low, case when clusters >= 10 and valid = 500 then round(high, 6) end as high, clusters, valid from w cross join l""", "forecasts"))
def _(spark, d):
    e = _errors(spark, d).withColumns({"block": F.floor(F.datediff("target", F.lit("1998-01-01").cast("date")) / 28), "a": F.abs("e")})
    return M.cluster_bootstrap(e, ["block", *SERIES], "a", "y", 500)


@query("ag24_pool_folds", sql("""with f as (select month(origin) % 3 as fold, h, count(*) as n, count(y) as ny, sum(abs(p - y)) as s from forecasts where p is not null group by all) select h, cast(sum(n) as bigint) as n, round(sum(s), 4) as s_abs, case when min(ny) >= 200 then round(sum(s) / sum(ny), 6) end as mae from f group by 1""", "forecasts"))
def _(spark, d):
    f = forecasts(spark, d).where("p is not null").groupBy((F.month("origin") % 3).alias("fold"), "h").agg(F.count("*").alias("n"), F.count("y").alias("ny"), F.sum(F.abs(F.col("p") - F.col("y"))).alias("s"))
    return f.groupBy("h").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("s_abs"), F.when(F.min("ny") >= 200, F.round(F.sum("s") / F.sum("ny"), 6)).alias("mae"))


@query("ag25_seed_summary", sql(f"""select product, round(avg(m), 6) as mean, round(min(m), 6) as least, round(max(m), 6) as most, round(stddev_pop(m), 6) as std from (select product, month(origin) % 3 as seed, avg(abs(e)) as m from {_RES} group by all) group by 1 having count(*) = 3""", "forecasts"))
def _(spark, d):
    m = _errors(spark, d).groupBy("product", (F.month("origin") % 3).alias("seed")).agg(F.avg(F.abs("e")).alias("m"))
    return m.groupBy("product").agg(*[F.round(f("m"), 6).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max), ("std", F.stddev_pop))], F.count("*").alias("k")).where("k = 3").drop("k")


@query("ag29_shrunk_offsets", sql(f"""with t as (select product, avg(e) as top from {_RES} group by 1) select r.product, channel, count(distinct target) as n_targets, round(count(distinct target) / (count(distinct target) + 50.0) * avg(e) + (1 - count(distinct target) / (count(distinct target) + 50.0)) * max(top), 6) as "offset" from {_RES} r join t on t.product = r.product group by all""", "forecasts"))
def _(spark, d):
    return M.shrunk_offsets(_errors(spark, d), ["product"], ["channel"], "e", "target", 50.0)


@query("ag30_ratio_correction", sql(f"select product, channel, round(least(greatest(sum(y) / nullif(sum(p), 0), 0.8), 1.25), 6) as ratio from {_RES} where target < date '1998-09-01' group by all", "forecasts"))
def _(spark, d):
    r = F.try_divide(F.sum("y"), F.sum("p"))
    return _errors(spark, d).where("target < date'1998-09-01'").groupBy("product", "channel").agg(F.round(F.least(F.greatest(r, F.lit(0.8)), F.lit(1.25)), 6).alias("ratio"))


@query("ag31_weight_grid", sql(f"""with s as (select w / 10.0 as weight, avg((w / 10.0 * p - y) * (w / 10.0 * p - y)) as mse, avg(w / 10.0 * p - y) as bias from {_RES} cross join (select unnest(range(5, 16)) as w) group by 1) select weight, round(mse, 4) as mse, round(bias, 4) as bias, row_number() over (order by mse, weight) = 1 as chosen from s""", "forecasts"))
def _(spark, d):
    from pyspark.sql import Window

    e = _errors(spark, d).agg(F.count("*").alias("n"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("p") * F.col("y")).alias("py"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    g = e.crossJoin(spark.range(5, 16).select((F.col("id") / 10.0).alias("weight")))
    g = g.select("weight", ((F.col("weight") * F.col("weight") * F.col("pp") - 2 * F.col("weight") * F.col("py") + F.col("yy")) / F.col("n")).alias("m"), F.round((F.col("weight") * F.col("sp") - F.col("sy")) / F.col("n"), 4).alias("bias"))
    return g.select("weight", F.round("m", 4).alias("mse"), "bias", (F.row_number().over(Window.orderBy("m", "weight")) == 1).alias("chosen"))  # eleven weights


@query("ag32_fit_fills", """select 'p_size' as field, cast(median(p_size) as double) as fill, count(distinct p_size) as n_values from part where p_partkey % 3 = 0 union all select 'p_retailprice', round(median(p_retailprice), 6), count(distinct p_retailprice) from part where p_partkey % 3 = 0""")
def _(spark, d):
    p = table(spark, d, "part").where("p_partkey % 3 = 0")
    long = p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in ("p_size", "p_retailprice")])))
    counts = long.groupBy("field").agg(F.countDistinct("v").alias("n_values"))
    return M.quantiles(long, ["field"], "v", {"fill": 0.5}).join(counts, "field").select("field", F.round("fill", 6).alias("fill"), "n_values")


@query("ag33_standardise", "select p_partkey, round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part), 6) as z, round(0.0, 6) as constant from part")
def _(spark, d):
    p = table(spark, d, "part").withColumn("one", F.lit(1.0))
    s = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("sd"), F.avg("one").alias("m1"), F.stddev_pop("one").alias("sd1"))
    j = p.crossJoin(F.broadcast(s))  # one row
    return j.select("p_partkey", F.round((F.col("p_retailprice") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), 6).alias("z"), F.round((F.col("one") - F.col("m1")) / F.when(F.col("sd1") > 0, F.col("sd1")).otherwise(1.0), 6).alias("constant"))


@query("wn17_rank_candidates", sql(f"""with m as (select product, avg(abs(e)) as a, avg(abs(y - 1.02 * p)) as b from {_RES} group by 1) select product, case when least(a, b) <= a * 0.95 then case when b < a then 'scaled' else 'plain' end else 'plain' end as chosen, round(least(a, b), 6) as best_metric from m""", "forecasts"))
def _(spark, d):
    e = _errors(spark, d).select("product", F.inline(F.array(F.struct(F.lit("plain").alias("name"), F.abs("e").alias("err")), F.struct(F.lit("scaled").alias("name"), F.abs(F.col("y") - 1.02 * F.col("p")).alias("err")))))
    m = e.groupBy("product", "name").agg(F.avg("err").alias("metric"))
    return M.best_candidate(m, ["product"], "metric", "name", "plain", 0.05)


@query("ml10_forecast_gate", sql("""with f as (select *, 1.02 * p as q from forecasts), g as (select 'product' as dimension, product as value, y, p, q from f union all select 'channel', channel, y, p, q from f union all select 'global', 'global', y, p, q from f),
    m as (select dimension, value, count(y) as n, count(*) as rows, count(case when y is not null and p is not null then 1 end) as n_predicted, avg(abs(p - y)) as mae, avg(abs(q - y)) as base, avg((p - y) * (p - y)) as mse, avg((q - y) * (q - y)) as base_mse, sum(p - y) / nullif(sum(case when p is not null then y end), 0) as nb, avg(y) as mean_y,
    avg(case when p is not null and y is not null then case when y between p - 150 and p + 150 then 1.0 else 0.0 end end) as coverage, avg(case when p is not null and y is not null then 300.0 + 10.0 * greatest(p - 150 - y, 0) + 10.0 * greatest(y - p - 150, 0) end) as score from g group by all)
    select dimension, value, n, concat_ws(',', case when n < case when dimension = 'global' then 2000 else 500 end then 'insufficient_sample' end, case when n_predicted < 0.5 * n then 'prediction_coverage_incomplete' end, case when nb is null then 'bias_not_evaluable' end, case when mean_y is null or mean_y = 0 then 'zero_actuals' end) as not_ready_reasons,
    concat_ws(',', case when abs(nb) > 0.02 then 'bias' end, case when n < 0.2 * rows then 'eligibility_coverage' end, case when dimension = 'global' and mae > base * 0.995 then 'mae_improvement' end, case when dimension <> 'global' and mae > base * 1.02 then 'mae_regression' end, case when mse > base_mse * 1.02 then 'mse_regression' end, case when coverage < 0.9 then 'interval_coverage' end, case when 300.0 > 3.0 * mean_y then 'interval_width' end, case when score > 4.0 * mean_y then 'interval_score' end) as failed_reasons,
    case when not_ready_reasons <> '' then 'not_ready' when failed_reasons <> '' then 'failed' else 'passed' end as verdict from m""", "forecasts"))
def _(spark, d):
    """The forecast against a reference of 1.02 times its value, by product, by channel and over all, with a band of 150 to either side (coverage 0.8)."""
    f = forecasts(spark, d).withColumns({"q": 1.02 * F.col("p"), "low": F.col("p") - 150, "high": F.col("p") + 150})
    e, b = F.col("p") - F.col("y"), F.col("q") - F.col("y")
    both = e.isNotNull()
    score = F.when(both, C.interval_score(F.col("y"), F.col("low"), F.col("high"), 0.8))
    inside = F.when(both, F.col("y").between(F.col("low"), F.col("high")).cast("double"))
    sums = {"n": F.count("y"), "rows": F.count("*"), "np": F.count_if(both), "sa": F.sum(F.abs(e)), "sb": F.sum(F.abs(b)), "qa": F.sum(e * e), "qb": F.sum(b * b), "se": F.sum(e), "sy": F.sum("y"), "sp": F.sum(F.when(both, F.col("y"))), "si": F.sum(inside), "ss": F.sum(score)}
    cells = f.groupBy("product", "channel").agg(*[x.alias(c) for c, x in sums.items()])
    tags = F.array(F.struct(F.lit("global").alias("dimension"), F.lit("global").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("product", "channel")])
    m = cells.select(*sums, F.inline(tags)).groupBy("dimension", "value").agg(*[F.sum(c).alias(c) for c in sums])
    mean, all_ = F.col("sy") / F.col("n"), F.col("dimension") == "global"
    bias = F.try_divide("se", "sp")
    waiting = [
        (F.col("n") < F.when(all_, 2000).otherwise(500), "insufficient_sample"), (F.col("np") < 0.5 * F.col("n"), "prediction_coverage_incomplete"), (bias.isNull(), "bias_not_evaluable"),
        (F.coalesce(F.col("sy"), F.lit(0.0)) == 0, "zero_actuals"),
    ]
    failed = [
        (F.abs(bias) > 0.02, "bias"), (F.col("n") < 0.2 * F.col("rows"), "eligibility_coverage"), (all_ & (F.col("sa") > F.col("sb") * 0.995), "mae_improvement"), (~all_ & (F.col("sa") > F.col("sb") * 1.02), "mae_regression"),
        (F.col("qa") > F.col("qb") * 1.02, "mse_regression"), (F.col("si") / F.col("np") < 0.9, "interval_coverage"), (300.0 > 3.0 * mean, "interval_width"), (F.col("ss") / F.col("np") > 4.0 * mean, "interval_score"),
    ]
    return M.gates(m, failed, waiting).select("dimension", "value", "n", "not_ready_reasons", "failed_reasons", "verdict")


_REQUIRED = "('all'), ('segment:en'), ('segment:fr'), ('segment:de'), ('segment:es'), ('segment:xx')"
_TAGGED = "select 'all' as segment, p, y from scores union all select 'segment:' || segment, p, y from scores where segment is not null"
_AP = "select segment, case when sum(t) > 0 and sum(t) < sum(n) then sum(t * ct / cn) / sum(t) end as ap from (select *, sum(t) over w as ct, sum(n) over w as cn from (select segment, p, sum(y) as t, count(*) as n from g group by all) window w as (partition by segment order by p desc rows unbounded preceding)) group by 1"
_ECE = "select segment, sum(abs(mp - my) * n) / sum(n) as ece from (select segment, least(floor(p * 5), 4) as bin, count(*) as n, avg(p) as mp, avg(y) as my from g group by all) group by 1"


@query("ml11_risk_gates", sql(f"""with g as ({_TAGGED}), b as (select segment, count(*) as n, cast(sum(y) as bigint) as n_positive, avg((p - y) * (p - y)) as br, avg(y) as pr, avg(((select avg(y) from scores) - y) * ((select avg(y) from scores) - y)) as cb from g group by 1), ap as ({_AP}), e as ({_ECE}), q as (select * from (values {_REQUIRED}) v(segment))
    select q.segment, coalesce(n, 0) as n, concat_ws(',', case when n is null then 'required_segment_missing' end, case when n < 50 or n_positive < 10 or n - n_positive < 10 then 'insufficient_support' end) as not_ready_reasons,
    concat_ws(',', case when ap <= pr then 'no_skill' end, case when br >= cb then 'brier' end, case when ece > 0.2 then 'calibration' end) as failed_reasons, case when not_ready_reasons <> '' then 'not_ready' when failed_reasons <> '' then 'failed' else 'passed' end as verdict
    from q left join b using (segment) left join ap using (segment) left join e using (segment)""", "scores"))
def _(spark, d):
    return M.risk_gates(scores(spark, d), ["segment:en", "segment:fr", "segment:de", "segment:es", "segment:xx"])


@query("ml12_capacity_comparison", sql("""with r as (select f, y, row_number() over (partition by f order by p desc, doc_id) as k, count(*) over (partition by f) as n from scores cross join (select unnest([0.4, 0.5])::double as f)) select f as share, count(case when k <= ceil(round(n * f, 9)) then 1 end) as workload, count(case when k <= ceil(round(n * f, 9)) and y = 0 then 1 end) + 5 * count(case when k > ceil(round(n * f, 9)) and y = 1 then 1 end) as cost from r group by 1""", "scores"))
def _(spark, d):
    s = scores(spark, d).withColumn("share", F.explode(F.array(F.lit(0.4), F.lit(0.5))))
    s = M.ranked_down(s, ["share"], "p", "doc_id").withColumn("taken", F.col("rank") <= F.ceil(F.round(F.col("n") * F.col("share"), 9)))
    return s.groupBy("share").agg(F.count_if(F.expr("taken")).alias("workload"), (F.count_if(F.expr("taken and y = 0")) + 5 * F.count_if(F.expr("not taken and y = 1"))).alias("cost"))


@query("ag12_supply_features", """select l_suppkey, sum(case when l_shipdate >= timestamp '1998-06-01' then l_quantity end) as open_quantity, sum(case when l_shipdate >= timestamp '1998-06-01' and l_shipdate < timestamp '1998-06-08' then l_quantity end) as due_7d, min(case when l_shipdate >= timestamp '1998-06-01' then datediff('day', date '1998-06-01', cast(l_shipdate as date)) end) as next_days, arg_min(l_partkey, (l_extendedprice, l_partkey)) as cheapest_part from lineitem group by 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    open_ = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")
    due = open_ & (F.col("l_shipdate") < F.lit("1998-06-08").cast("timestamp"))
    return li.groupBy("l_suppkey").agg(F.sum(F.when(open_, F.col("l_quantity"))).alias("open_quantity"), F.sum(F.when(due, F.col("l_quantity"))).alias("due_7d"), F.min(F.when(open_, F.datediff("l_shipdate", F.lit("1998-06-01").cast("date")))).cast("long").alias("next_days"), F.min_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("cheapest_part"))
