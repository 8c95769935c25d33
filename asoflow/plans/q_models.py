"""Queries that fit and score models, and the last composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.operators import models as ML
from asoflow.operators import panel as P
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import SERIES, demand_versions, ledger, lines, scores, series_day, table
from asoflow.sources.scratch import written

_ROLE = "case when day <= date '1998-12-31' - 15 then 'train' when day <= date '1998-12-31' then 'purged' when day <= date '1999-12-31' - 15 then 'tune' when day <= date '1999-12-31' then 'purged' when day <= date '2000-12-31' then 'test' else 'outside' end"
FEATURES = ["lag_1", "lag_7", "mean_28", "weekday"]


def _frame(spark, d):
    """A row for each series and day, at most the days of the data times the series. It is written, for every pass of a fit reads it and the lines are many more."""
    from asoflow.operators.joins import lagged

    rows = P.rolling(written(series_day(spark, d)), SERIES, "day", "units", (28,))
    rows = lagged(lagged(rows, SERIES, "day", "units", 1, "lag_1"), SERIES, "day", "units", 7, "lag_7")
    return written(rows.withColumn("weekday", F.weekday("day").cast("double")).fillna(-1.0, ["lag_1", "lag_7"]))


_BEFORE = "day < date'2000-01-01'"


@query("ml02_tree_regressor")
def _(spark, d):
    """A forest for means and boosted trees for medians, fitted to the days before 2000 and scored on all later ones."""
    rows = _frame(spark, d).persist()
    mean = ML.fit_regressor(rows.where(_BEFORE), FEATURES, "units", "forest", numTrees=24, maxDepth=8)
    median = ML.fit_regressor(rows.where(_BEFORE), FEATURES, "units", "boosted_median", maxIter=8, maxDepth=4)
    p = ML.predict(median, ML.predict(mean, rows.where(f"not {_BEFORE}"), FEATURES, "p_mean"), FEATURES, "p_median")
    error = {name: F.avg(F.abs(F.col(name) - F.col("units"))).alias(f"mae_{name}") for name in ("p_mean", "p_median")}
    return p.groupBy("product").agg(F.count("*").alias("n"), *error.values(), F.count_if(F.expr("p_mean < 0 or p_median < 0")).alias("n_negative"))


#: an imported model: nodes of two trees (tree, node, feature, threshold, left, right, value), leaves have no feature
_NODES = (
    (0, 0, "lag_7", 60.0, 1, 2, 0.0), (0, 1, "lag_1", 20.0, 3, 4, 0.0), (0, 2, None, 0.0, -1, -1, 55.0), (0, 3, None, 0.0, -1, -1, -12.5), (0, 4, None, 0.0, -1, -1, 8.0),
    (1, 0, "weekday", 4.5, 1, 2, 0.0), (1, 1, None, 0.0, -1, -1, 3.25), (1, 2, "mean_28", 75.0, 3, 4, 0.0), (1, 3, None, 0.0, -1, -1, -30.0), (1, 4, None, 0.0, -1, -1, 14.0),
)


@query("ml03_tree_scoring", sql("""with f as (select a.product, a.location, a.channel, a.day, coalesce(b.units, -1.0) as lag_1, coalesce(c.units, -1.0) as lag_7, avg(a.units) over (partition by a.product, a.location, a.channel order by a.day range between interval 27 days preceding and current row) as mean_28, isodow(a.day) - 1 as weekday from series_day a
    left join series_day b on b.product = a.product and b.location = a.location and b.channel = a.channel and b.day = a.day - 1 left join series_day c on c.product = a.product and c.location = a.location and c.channel = a.channel and c.day = a.day - 7)
    select product, location, channel, day, greatest(0.0, 20.0 + case when lag_7 <= 60 then case when lag_1 <= 20 then -12.5 else 8.0 end else 55.0 end + case when weekday <= 4.5 then 3.25 when mean_28 <= 75 then -30.0 else 14.0 end) as p from f""", "series_day"))
def _(spark, d):
    """All days scored by the imported node table: intercept plus the sum of its trees, not below zero."""
    return ML.portable_scores(_frame(spark, d), ML.node_table(_NODES), FEATURES, intercept=20.0).select(*SERIES, "day", "p")


@query("ud05_tree_scorer")
def _(spark, d):
    """A forest of MLlib as a node table: the portable scorer against the library's own transform, on all later days."""
    rows = _frame(spark, d)
    model = ML.fit_regressor(rows.where(_BEFORE), FEATURES, "units", "forest", numTrees=6, maxDepth=5)
    both = ML.portable_scores(ML.predict(model, rows.where(f"not {_BEFORE}"), FEATURES, "own"), ML.exported_nodes(model, FEATURES), FEATURES, mean=True)
    return both.groupBy("product").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("own") - F.col("p")) > 1e-9).alias("n_different"))


def _risk(spark, d):
    """Written, for every pass of a fit and every shuffle of features reads these few numbers; the texts are read once."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.ln("n_chars").alias("a"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("b"))
    return written(docs.join(table(spark, d, "labels"), "doc_id").withColumn("y", F.col("quality")))


@query("ml04_risk_classifier")
def _(spark, d):
    rows = _risk(spark, d)
    model = ML.fit_risk(rows.where("doc_id % 3 > 0"), ["a", "b"], "y")
    return ML.risk_scores(model, rows.where("doc_id % 3 = 0"), ["a", "b"]).select("doc_id", "p", "y")


@query("ml05_calibration")
def _(spark, d):
    """A sigmoid on the raw score with an offset for each language; languages without ten rows of each class have none."""
    rows = _risk(spark, d).withColumn("segment", F.coalesce("lang", F.lit("none")))
    model = ML.fit_risk(rows.where("doc_id % 3 > 0"), ["a", "b"], "y", "boosted", maxIter=5)
    raw = ML.risk_scores(model, rows, ["a", "b"]).persist()
    slope, intercept, offsets = ML.calibrate_by(raw, "y", "segment")
    return raw.select("doc_id", "segment", ML.calibrated(F.col("raw"), slope, intercept, ML.offset_column("segment", offsets)).alias("p"), "y")


@query("ml06_isolation_forest")
def _(spark, d):
    rows = lines(spark, d).select("channel", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    forest = ML.isolation_forest(rows, ["channel"], features, trees=16, sample=128)
    return ML.isolation_scores(rows, forest, ["channel"], features, sample=128).groupBy("channel").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("top_score"))


@query("ml13_permutation_importance")
def _(spark, d):
    rows = _risk(spark, d).select("doc_id", "a", "b", "y")
    model = ML.fit_risk(rows, ["a", "b"], "y")
    return ML.permutation_importance(rows, lambda x: ML.risk_scores(model, x, ["a", "b"]), {"length": ["a"], "capitals": ["b"]}, "y", ["doc_id"], rounds=5)


@query("ml09_model_selection", sql("""with m as (select segment, avg((p - y) * (p - y)) as b0, avg((p * 0.9 - y) * (p * 0.9 - y)) as b1, avg(y) * (1 - avg(y)) as cb from scores group by 1), c as (select 'plain' as name, count(case when b0 >= cb then 1 end) as failing, avg(b0) as brier from m union all select 'shrunk', count(case when b1 >= cb then 1 end), avg(b1) from m)
    select name, failing, round(brier, 6) as brier, row_number() over (order by failing, brier, name) as place from c""", "scores"))
def _(spark, d):
    from pyspark.sql import Window

    s = scores(spark, d).select("segment", "y", F.inline(F.array(F.struct(F.lit("plain").alias("name"), F.col("p").alias("q")), F.struct(F.lit("shrunk").alias("name"), (F.col("p") * 0.9).alias("q")))))
    m = s.groupBy("name", "segment").agg(F.avg((F.col("q") - F.col("y")) * (F.col("q") - F.col("y"))).alias("b"), (F.avg("y") * (1 - F.avg("y"))).alias("cb"))
    c = m.groupBy("name").agg(F.count_if(F.expr("b >= cb")).alias("failing"), F.avg("b").alias("brier"))
    return c.select("name", "failing", F.round("brier", 6).alias("brier"), F.row_number().over(Window.orderBy("failing", "brier", "name")).cast("long").alias("place"))  # two candidates


@query("ml16_recipe_fit", sql("""with e as (select product, target, y, p, y - p as e from forecasts where y is not null and p is not null), t as (select product, median(e) as median_shift, avg(e) as mean_shift, least(greatest(sum(y) / sum(p), 0.8), 1.25) as ratio, quantile_cont(e, 0.1) as low, quantile_cont(e, 0.9) as high from e where target < date '1999-01-01' group by 1),
    v as (select e.product, avg(abs(y - (p + median_shift))) as m1, avg(abs(y - (p + mean_shift))) as m2, avg(abs(y - p * ratio)) as m3, avg(abs(y - p)) as m0, count(*) as n from e join t on t.product = e.product where target >= date '1999-01-01' and target < date '2000-01-01' group by 1),
    c as (select *, case when least(m0, m1, m2, m3) = m0 then 'plain' when least(m1, m2, m3) = m1 then 'median' when least(m2, m3) = m2 then 'mean' else 'ratio' end as chosen from v)
    select c.product, round(max(median_shift), 6) as median_shift, round(max(mean_shift), 6) as mean_shift, round(max(ratio), 6) as ratio, chosen, max(c.n) as n_validation, count(e.y) as n_test, round(avg(abs(e.y - case chosen when 'plain' then p when 'median' then p + median_shift when 'mean' then p + mean_shift else p * ratio end)), 6) as test_mae, round(avg(case when e.y between p + low and p + high then 1.0 else 0.0 end), 6) as band_coverage
    from c join t on t.product = c.product left join e on e.product = c.product and e.target >= date '2000-01-01' group by c.product, chosen""", "forecasts"))
def _(spark, d):
    """Recipes fitted before 1999, one chosen on 1999, and measured, with the band, on all later days."""
    from asoflow.operators.metrics import quantiles
    from asoflow.sources.adapters import forecasts

    e = forecasts(spark, d).where("y is not null and p is not null").withColumn("e", F.col("y") - F.col("p"))
    ratio = F.least(F.greatest(F.sum("y") / F.sum("p"), F.lit(0.8)), F.lit(1.25))
    early = e.where("target < date'1999-01-01'")
    t = early.groupBy("product").agg(F.avg("e").alias("mean_shift"), ratio.alias("ratio")).join(quantiles(early, ["product"], "e", {"median_shift": 0.5, "low": 0.1, "high": 0.9}).drop("n"), "product")
    made = {"plain": F.col("p"), "median": F.col("p") + F.col("median_shift"), "mean": F.col("p") + F.col("mean_shift"), "ratio": F.col("p") * F.col("ratio")}
    tried = e.join(t, "product")
    errors = [F.struct(F.avg(F.abs(F.col("y") - x)).alias("m"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, x) in enumerate(made.items())]
    v = tried.where("target >= date'1999-01-01' and target < date'2000-01-01'").groupBy("product").agg(F.count("*").alias("n_validation"), F.array_min(F.array(*errors))["name"].alias("chosen"))
    chosen = F.coalesce(*[F.when(F.col("chosen") == name, x) for name, x in made.items()])
    later = tried.where("target >= date'2000-01-01'").join(v, "product")
    test = later.groupBy("product").agg(F.count("y").alias("n_test"), F.round(F.avg(F.abs(F.col("y") - chosen)), 6).alias("test_mae"), F.round(F.avg(F.col("y").between(F.col("p") + F.col("low"), F.col("p") + F.col("high")).cast("double")), 6).alias("band_coverage"))
    out = v.join(t, "product").join(test, "product", "left")
    return out.select("product", *[F.round(c, 6).alias(c) for c in ("median_shift", "mean_shift", "ratio")], "chosen", "n_validation", F.coalesce("n_test", F.lit(0)).alias("n_test"), "test_mae", "band_coverage")


@query("ds02_curate_inventory", sql("""with x as (select l.*, case when sequence % 83 = 0 then 'unheard' else kind end as kind2, case when sequence % 89 = 0 then day - 2 else available end as available2 from ledger l), d as (select product, location, channel, min(day) as opened from ledger group by all), s as (select product, location, channel, day, sum(units) as units from series_day group by all),
    j as (select x.*, r.stock, r.known, r.from_day, d.opened, s.units from x left join routes r on r.location = x.location and r.from_day <= x.day and x.day < r.to_day and not (r.location = 'ASIA' and year(r.from_day) = 1997) left join d on d.product = x.product and d.location = x.location and d.channel = x.channel left join s on s.product = x.product and s.location = x.location and s.channel = x.channel and s.day = x.day),
    c as (select *, case when kind2 not in ('opening_stock', 'sale', 'receipt', 'inventory_adjustment') then 'kind_unknown' when stock is null then 'route_missing' when kind2 = 'sale' and delta >= 0 then 'sale_sign' when kind2 = 'sale' and (units is null or units <> -delta) then 'sale_differs' when available2 < day then 'known_before_day' end as reason, greatest(day, available2, known, from_day, opened, day + cast(sequence % 3 as integer)) as clock from j)
    select coalesce(reason, 'accepted') as outcome, stock, count(*) as n, sum(delta) as delta, max(clock) as last_clock, cast(sum(clock - day) as bigint) as delay from c group by all""", "ledger", "series_day", "routes"))
def _(spark, d):
    """Movements at the stock that their location was routed to, with the causes that sales must have; a row is available at the latest of six clocks."""
    from asoflow.operators.curate import curate
    from asoflow.sources.adapters import routes

    moves = ledger(spark, d).withColumns({"kind": F.when(F.col("sequence") % 83 == 0, "unheard").otherwise(F.col("kind")), "available": F.when(F.col("sequence") % 89 == 0, F.date_sub("day", 2)).otherwise(F.col("available"))})
    opened = ledger(spark, d).groupBy(*SERIES).agg(F.min("day").alias("opened"))
    r = routes(spark, d).where("not (location = 'ASIA' and year(from_day) = 1997)").select(F.col("location").alias("_l"), "stock", "known", "from_day", "to_day")
    j = moves.join(r, (F.col("location") == F.col("_l")) & (F.col("from_day") <= F.col("day")) & (F.col("day") < F.col("to_day")), "left").join(opened, SERIES, "left").join(series_day(spark, d), [*SERIES, "day"], "left")
    j = j.withColumn("posted", F.expr("date_add(day, cast(sequence % 3 as int))"))
    sale = F.col("kind") == "sale"
    rules = [
        (~F.col("kind").isin("opening_stock", "sale", "receipt", "inventory_adjustment"), "kind_unknown"), (F.col("stock").isNull(), "route_missing"), (sale & (F.col("delta") >= 0), "sale_sign"),
        (sale & (F.col("units").isNull() | (F.col("units") != -F.col("delta"))), "sale_differs"), (F.col("available") < F.col("day"), "known_before_day"),
    ]
    c = curate(j, rules, clocks=["day", "available", "known", "from_day", "opened", "posted"])
    return c.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"), "stock").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"), F.max("curated_available_at").alias("last_clock"), F.sum(F.datediff("curated_available_at", "day")).alias("delay"))


@query("ds03_demand_rules", sql("""select reason, count(*) as n from (select case when status = 'observed' and units is null then 'observed_without_units' when status = 'gap' and units is not null then 'gap_with_units' when units < 0 then 'negative' end as reason from (select case when day(day) % 9 = 0 then null else units end as units, case when day(day) % 10 = 0 then 'gap' else 'observed' end as status from series_day)) group by 1""", "series_day"))
def _(spark, d):
    from asoflow.functions.columns import first_reason

    s = series_day(spark, d).select(F.when(F.dayofmonth("day") % 9 != 0, F.col("units")).alias("units"), F.when(F.dayofmonth("day") % 10 == 0, "gap").otherwise("observed").alias("status"))
    reason = first_reason([((F.col("status") == "observed") & F.col("units").isNull(), "observed_without_units"), ((F.col("status") == "gap") & F.col("units").isNotNull(), "gap_with_units"), (F.col("units") < 0, "negative")])
    return s.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("ds05_verify_operations", sql("""with m as (select * from ledger where sequence % 61 <> 0), s as (select m.product, count(*) as n, count(case when s.units is null or s.units <> -m.delta then 1 end) as bad from m left join series_day s using (product, location, channel, day) where kind = 'sale' group by 1), i as (select s.product, count(*) as n, count(case when m.delta is null then 1 end) as bad from series_day s left join (select * from m where kind = 'sale') m using (product, location, channel, day) group by 1),
    k as (select product, location, channel, week, sum(units) as sold from ledger_sales group by all), w as (select k.product, count(*) as n, count(case when m.delta is null or m.delta <> sold then 1 end) as bad from k join ledger_ends on true left join (select * from m where kind = 'receipt') m on m.product = k.product and m.location = k.location and m.channel = k.channel and m.day = start + cast((week + 1) * 7 as integer) where week < last_week group by 1),
    q as (select p_type as product, count(*) as n, count(case when o.total is null then 1 end) as bad from returned join part on p_partkey = part left join (select l_orderkey as order_id, cast(l_linenumber as bigint) as line, sum(l_quantity) as total from lineitem where l_linestatus = 'F' group by all) o using (order_id, line) group by 1), f as (select product, count(*) as n, count(case when available > (select last_day + 2 from span) then 1 end) as bad from demand_versions group by 1)
    select 'sale_has_demand' as rule, * from s union all select 'demand_has_issue', * from i union all select 'week_is_restocked', * from w union all select 'return_has_sale', * from q union all select 'known_by_watermark', * from f""", "ledger", "returned", "demand_versions"))
def _(spark, d):
    """Five rules over a ledger that lost some movements: rule, product, rows and how many break it."""
    from asoflow.sources.adapters import returns, span

    key = [*SERIES, "day"]
    moves, demand = ledger(spark, d).where("sequence % 61 <> 0"), series_day(spark, d)
    sales = moves.where("kind = 'sale'").select(*key, "delta")
    ends = span(spark, d).select(F.trunc("first_day", "week").alias("start"), F.floor(F.datediff("last_day", F.trunc("first_day", "week")) / 7).alias("last_week"), "last_day")
    weekly = demand.crossJoin(F.broadcast(ends)).withColumn("week", F.floor(F.datediff("day", "start") / 7)).where("week < last_week")  # one row
    weekly = weekly.groupBy(*SERIES, F.expr("date_add(start, cast((week + 1) * 7 as int))").alias("day")).agg(F.sum("units").alias("sold"))
    sold = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line")).agg(F.sum("l_quantity").alias("total"))
    back = returns(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("product")), "part").join(sold, ["order_id", "line"], "left")
    seen = demand_versions(spark, d).crossJoin(F.broadcast(ends))  # one row
    checks = {
        "sale_has_demand": (sales.join(demand, key, "left"), F.col("units").isNull() | (F.col("units") != -F.col("delta"))), "demand_has_issue": (demand.join(sales, key, "left"), F.col("delta").isNull()),
        "week_is_restocked": (weekly.join(moves.where("kind = 'receipt'").select(*key, "delta"), key, "left"), F.col("delta").isNull() | (F.col("delta") != F.col("sold"))),
        "return_has_sale": (back, F.col("total").isNull()), "known_by_watermark": (seen, F.col("available") > F.date_add("last_day", 2)),
    }
    out = None
    for rule, (rows, bad) in checks.items():
        own = rows.groupBy("product").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).select(F.lit(rule).alias("rule"), "product", "n", "bad")
        out = own if out is None else out.union(own)
    return out


@query("ds10_qualified_outcomes", sql(f"""with o as (select product, location, channel, day, {_ROLE} as role, max(case when available <= day + 2 then version end) as early, max(version) as top, max_by(units, version) as units, max_by(units, version) filter (available <= day + 2) as seen from demand_versions group by all)
    select role, case when role in ('purged', 'outside') then 'no_role' when early is null then 'immature' when role = 'test' and early < top then 'corrected_later' when seen > 400 then 'censored' else 'eligible' end as reason, count(*) as n, sum(units) as units from o group by all""", "demand_versions"))
def _(spark, d):
    """Outcomes by role as known two days after their day: not there yet, corrected after that (which a test outcome may not be), above what is counted, or eligible."""
    early = F.col("available") <= F.date_add("day", 2)
    o = demand_versions(spark, d).groupBy(*SERIES, "day").agg(F.max(F.when(early, F.col("version"))).alias("early"), F.max("version").alias("top"), F.max_by("units", "version").alias("units"), F.max_by(F.when(early, F.col("units")), F.when(early, F.col("version"))).alias("seen"))
    o = P.membership(o, "day", "1998-12-31", "1999-12-31", "2000-12-31", 15)
    reason = (
        F.when(F.col("role").isin("purged", "outside"), "no_role").when(F.col("early").isNull(), "immature").when((F.col("role") == "test") & (F.col("early") < F.col("top")), "corrected_later")
        .when(F.col("seen") > 400, "censored").otherwise("eligible")
    )
    return o.groupBy("role", reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("units").alias("units"))


@query("ds11_source_versions", sql("""select v.version, count(*) as n, count(case when v.version = m.top then 1 end) as n_current, count(case when v.version = m.top and v.units = s.units then 1 end) as n_equal from demand_versions v join (select product, location, channel, day, max(version) as top from demand_versions group by all) m using (product, location, channel, day) join series_day s using (product, location, channel, day) group by 1""", "demand_versions", "series_day"))
def _(spark, d):
    key = [*SERIES, "day"]
    v = demand_versions(spark, d)
    top = v.groupBy(*key).agg(F.max("version").alias("top"))
    j = v.join(top, key).join(series_day(spark, d).withColumnRenamed("units", "now"), key)
    return j.groupBy("version").agg(F.count("*").alias("n"), F.count_if(F.expr("version = top")).alias("n_current"), F.count_if(F.expr("version = top and units = now")).alias("n_equal"))


@query("ds22_key_context", sql("""with r as (select (last_day - first_day + 1) as days from span), h as (select product, location, channel, count(*) / (select days from r) as share, avg(units) as m, stddev_pop(units) / nullif(avg(units), 0) as cv from series_day group by all), b as (select *, sum(delta) over (partition by product, location, channel order by sequence) as balance from ledger),
    g as (select product, location, channel, count(distinct case when balance <= 0 then day end) / count(distinct day) as dry, count(case when kind = 'receipt' then 1 end) as n_receipts, round((max(case when kind = 'receipt' then day end) - min(case when kind = 'receipt' then day end)) / nullif(count(case when kind = 'receipt' then 1 end) - 1, 0), 4) as lead_days from b group by all), v as (select product, location, channel, avg(case when available <= day + 1 then 1.0 else 0.0 end) as prompt from (select product, location, channel, day, min(available) as available from demand_versions group by all) group by all)
    select h.product, h.location, h.channel, case when share < 0.25 then 'sparse' when share < 0.75 then 'intermittent' else 'regular' end as pattern, case when m is null then 'unknown' when m = 0 then 'zero' when m < 50 then 'low' when m < 150 then 'medium' else 'high' end as volume, case when cv < 0.5 then 'smooth' else 'erratic' end as variation, case when dry < 0.1 then 'ample' when dry < 0.5 then 'tight' else 'constrained' end as stock, n_receipts, lead_days, round(prompt, 6) as prompt_share
    from h left join g using (product, location, channel) left join v using (product, location, channel)""", "series_day", "ledger", "demand_versions"))
def _(spark, d):
    """Demand pattern, volume, variation, how often stock runs dry, days between receipts and how prompt the data are, for each series."""
    from asoflow.functions.columns import volume_bin
    from asoflow.operators.ledger import running_balance
    from asoflow.sources.adapters import span

    days = span(spark, d).select((F.datediff("last_day", "first_day") + 1).alias("days"))
    h = series_day(spark, d).groupBy(*SERIES).agg(F.count("*").alias("n"), F.avg("units").alias("m"), F.try_divide(F.stddev_pop("units"), F.avg("units")).alias("cv")).crossJoin(F.broadcast(days))  # one row
    receipt = F.when(F.col("kind") == "receipt", F.col("day"))
    g = running_balance(ledger(spark, d), SERIES, "sequence").groupBy(*SERIES).agg(
        (F.countDistinct(F.when(F.col("balance") <= 0, F.col("day"))) / F.countDistinct("day")).alias("dry"), F.count(receipt).alias("n_receipts"),
        F.round(F.try_divide(F.datediff(F.max(receipt), F.min(receipt)), F.count(receipt) - 1), 4).alias("lead_days"),
    )
    first = demand_versions(spark, d).groupBy(*SERIES, "day").agg(F.min("available").alias("available"))
    v = first.groupBy(*SERIES).agg(F.round(F.avg(F.when(F.expr("available <= date_add(day, 1)"), 1.0).otherwise(0.0)), 6).alias("prompt_share"))
    share = F.col("n") / F.col("days")
    return h.join(g, SERIES, "left").join(v, SERIES, "left").select(
        *SERIES, F.when(share < 0.25, "sparse").when(share < 0.75, "intermittent").otherwise("regular").alias("pattern"), volume_bin(F.col("m")).alias("volume"), F.when(F.col("cv") < 0.5, "smooth").otherwise("erratic").alias("variation"),
        F.when(F.col("dry") < 0.1, "ample").when(F.col("dry") < 0.5, "tight").otherwise("constrained").alias("stock"), "n_receipts", "lead_days", "prompt_share",
    )


@query("ds23_truth_windows", sql("""with i as (select product, location, channel, min(day) as start, max(day) as "end", max(available) as known, count(*) as n_days, max(units) as peak from (select *, day - cast(row_number() over (partition by product, location, channel order by day) as integer) as g from (select product, location, channel, day, max(available) as available, max_by(units, version) as units from demand_versions group by all)) group by product, location, channel, g having count(*) >= 3),
    x as (select *, cast(unnest(range(start, "end" + 1, interval 1 day)) as date) as day from i), n as (select product, day, count(distinct location) as k from x group by all), p as (select x.product, x.location, x.channel, x.start, max(k) > 1 as spills, count(case when y.start is not null then 1 end) > 0 as paired from x join n using (product, day) left join (select * from x) y on y.product = x.product and y.location = x.location and y.day = x.day and y.channel <> x.channel group by all)
    select i.product, i.location, i.channel, i.start, i."end", known, n_days, peak, case when spills then 'spillover' when paired then 'paired' else 'alone' end as kind from i join p using (product, location, channel, start)""", "demand_versions"))
def _(spark, d):
    """Runs of at least three known days: those that other places share on any day (spillover), else those that another channel of the place shares (paired)."""
    v = demand_versions(spark, d).groupBy(*SERIES, "day").agg(F.max("available").alias("known"), F.max_by("units", "version").alias("units"))
    return P.truth_windows(v, SERIES, "day", 3)


@query("ds29_forecast_projection", """with r as (select 'lineitem' as source_table, case when o_orderkey is null then 'order_missing' when l_shipdate < o_orderdate then 'shipped_before_ordered' when l_quantity <= 0 then 'quantity_sign' end as reason from lineitem left join orders on l_orderkey = o_orderkey
    union all select 'part', case when p_type is null then 'type_missing' when p_retailprice <= 0 then 'price_sign' end from part union all select 'supplier', case when n_nationkey is null then 'nation_missing' end from supplier left join nation on s_nationkey = n_nationkey), t as (select source_table, coalesce(reason, 'accepted') as reason, count(*) as n_rows from r group by all)
    select source_table, reason, n_rows, (select count(*) from t where reason <> 'accepted') = 0 as ready from t""")
def _(spark, d):
    """Only the tables and columns that forecasts need are curated; any rejected row blocks them all."""
    from asoflow.operators.curate import curate, profile

    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    s, n = table(spark, d, "supplier").select("s_nationkey"), table(spark, d, "nation").select("n_nationkey")
    parts = {
        "lineitem": (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left"), [(F.col("o_orderkey").isNull(), "order_missing"), (F.col("l_shipdate") < F.col("o_orderdate"), "shipped_before_ordered"), (F.col("l_quantity") <= 0, "quantity_sign")]),
        "part": (table(spark, d, "part").select("p_type", "p_retailprice"), [(F.col("p_type").isNull(), "type_missing"), (F.col("p_retailprice") <= 0, "price_sign")]),
        "supplier": (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left"), [(F.col("n_nationkey").isNull(), "nation_missing")]),
    }
    out = None
    for name, (rows, rules) in parts.items():
        own = profile(curate(rows, rules), name).select("source_table", "reason", "n_rows", "ready")
        out = own if out is None else out.union(own)
    return out.crossJoin(F.broadcast(out.agg(F.bool_and("ready").alias("all_ready")))).select("source_table", "reason", "n_rows", F.col("all_ready").alias("ready"))  # one row


@query("ds19_qualified_inputs", sql("""with e as (select location, day, channel = 'R' as back, count(*) as expected from series_day group by all), f as (select location, day, channel = 'R' as back, count(distinct product || channel) as facts from demand_versions where available <= day + case when channel = 'R' then 3 else 1 end group by all),
    g as (select location, day, bool_and(coalesce(facts, 0) >= expected) as whole, sum(expected) as expected, sum(coalesce(facts, 0)) as facts from e left join f using (location, day, back) group by all), k as (select product, location, channel, day, max_by(units, version) as units from demand_versions where available <= day + case when channel = 'R' then 3 else 1 end group by all)
    select s.product, s.location, s.channel, s.day, k.units, p.units as expected_units, round(k.units - p.units, 6) as residual, case when not g.whole then 'source_incomplete' when k.units is null then 'late_outcome' when p.units is null then 'insufficient_history' else 'ready' end as status from series_day s join g using (location, day) left join k using (product, location, channel, day) left join (select series_day.*, g.whole from series_day join g using (location, day)) p on p.product = s.product and p.location = s.location and p.channel = s.channel and p.day = s.day - 7 and p.whole""", "series_day", "demand_versions"))
def _(spark, d):
    """A place's day qualifies if all its series are there in time, sales after one day and returns after three; only qualified days are scored or serve as history."""
    from asoflow.operators.replay import day_gate

    key = [*SERIES, "day"]
    back, s = F.col("channel") == "R", series_day(spark, d)
    v = demand_versions(spark, d).where(F.col("available") <= F.date_add("day", F.when(back, 3).otherwise(1)))
    now = F.lit("9999-12-31").cast("date")
    declared = s.groupBy("location", "day", back.alias("back")).agg(F.count("*").alias("expected")).withColumn("known", F.col("day"))
    facts = v.select("location", "day", back.alias("back"), "product", "channel").distinct().withColumn("known", F.col("day"))
    gate = day_gate(declared, facts, facts.limit(0), ["location", "day", "back"], now)
    whole = gate.groupBy("location", "day").agg(F.bool_and(F.col("status") == "qualified").alias("whole"))
    known = v.groupBy(*key).agg(F.max_by("units", "version").alias("_u"))
    j = s.join(whole, ["location", "day"])
    past = j.where("whole").select(*SERIES, F.date_add("day", 7).alias("day"), F.col("units").alias("expected_units"))
    j = j.drop("units").join(known, key, "left").join(past, key, "left")
    status = F.when(~F.col("whole"), "source_incomplete").when(F.col("_u").isNull(), "late_outcome").when(F.col("expected_units").isNull(), "insufficient_history").otherwise("ready")
    return j.select(*key, F.col("_u").alias("units"), "expected_units", F.round(F.col("_u") - F.col("expected_units"), 6).alias("residual"), status.alias("status"))

