"""Queries on ledgers and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.operators import ledger as L
from asoflow.operators import panel as P
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import SERIES, demand_versions, ledger, series_day, span, weeks

KEY = [*SERIES, "day"]
_BAL = "b as (select *, sum(delta) over (partition by product, location, channel order by sequence) as balance from ledger)"
def every_day(spark, d, keyed):
    """The series of a table on all days of the data."""
    days = span(spark, d).select(F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return keyed.select(*SERIES).distinct().crossJoin(F.broadcast(days))  # the days of the data


def _origins(spark, d):
    return series_day(spark, d).select(*SERIES).distinct().crossJoin(F.broadcast(weeks(spark, d)))  # the Sundays of the data


_ORIGINS = "o as (select product, location, channel, origin from (select distinct product, location, channel from series_day) cross join weeks)"


@query("wn02_running_balance", sql(f"with {_BAL} select product, location, channel, sequence, kind, delta, balance from b", "ledger"))
def _(spark, d):
    return L.running_balance(ledger(spark, d), SERIES, "sequence").select(*SERIES, "sequence", "kind", "delta", "balance")


@query("ds04_verify_ledger", sql("""with x as (select product, location, channel, day, sequence, kind, case when kind = 'sale' and sequence % 97 = 0 then -delta else delta end as delta, case when kind = 'sale' and sequence % 101 = 0 then day - 1 else available end as available
    from ledger where not (kind = 'receipt' and sequence % 11 = 0) and not (kind = 'opening_stock' and location = 'ASIA')), b as (select *, sum(delta) over w as balance, row_number() over w as n, count(case when kind = 'opening_stock' then 1 end) over w as k, lag(day) over w as ahead from x window w as (partition by product, location, channel order by sequence)),
    r as (select *, case when n = 1 and kind <> 'opening_stock' then 'no_opening' when kind = 'opening_stock' and k > 1 then 'second_opening' when kind = 'sale' and delta >= 0 or kind = 'receipt' and delta <= 0 then 'wrong_sign' when available < day then 'known_before_day' when day < ahead then 'clock_regression' when balance < 0 then 'negative_balance' end as reason from b)
    select product, location, channel, sequence, reason from r where reason is not null""", "ledger"))
def _(spark, d):
    sale = F.col("kind") == "sale"
    moves = ledger(spark, d).where("not (kind = 'receipt' and sequence % 11 = 0) and not (kind = 'opening_stock' and location = 'ASIA')")  # a ledger with faults
    moves = moves.withColumn("delta", F.when(sale & (F.col("sequence") % 97 == 0), -F.col("delta")).otherwise(F.col("delta")))
    moves = moves.withColumn("available", F.when(sale & (F.col("sequence") % 101 == 0), F.date_sub("day", 1)).otherwise(F.col("available")))
    return L.ledger_violations(moves, SERIES, "sequence").select(*SERIES, "sequence", "reason")


@query("wn03_stock_day", sql(f"""with {_BAL}, m as (select *, balance - delta as before from b), g as (select product, location, channel, day, max_by(balance, sequence) as e, min_by(before, sequence) as s, min(balance) as low, count(case when before > 0 and balance <= 0 then 1 end) as onsets from m group by all),
    a as (select product, location, channel, day from (select distinct product, location, channel from ledger) cross join (select cast(unnest(generate_series(first_day::timestamp, last_day::timestamp, interval 1 day)) as date) as day from span)),
    u as (select product, location, channel, day, e, s, low, onsets, (product, location, channel, day) in (select (product, location, channel, day) from a) as asked from g union all select a.*, null, null, null, null, true from a anti join g using (product, location, channel, day)),
    c as (select *, last_value(e ignore nulls) over (partition by product, location, channel order by day rows unbounded preceding) as eb from u)
    select product, location, channel, day, eb as end_balance, least(coalesce(s, eb), coalesce(low, eb)) > 0 as in_stock, coalesce(onsets, 0) as onsets from c where asked""", "ledger"))
def _(spark, d):
    moves = ledger(spark, d)
    return L.stock_days(moves, every_day(spark, d, moves), SERIES, "sequence")


@query("wn04_daily_snapshot", sql(f"""select product, location, channel, origin as cutoff, sum(delta) as balance, count(*) as n_movements, max(sequence) as last_sequence, max(available) as clock from ledger join weeks on day <= origin and available <= origin group by all""", "ledger", "weeks"))
def _(spark, d):
    return L.daily_snapshot(ledger(spark, d), weeks(spark, d).withColumnRenamed("origin", "cutoff"), SERIES, "sequence")


@query("wn05_incident_label", sql(f"""with {_BAL}, m as (select *, balance - delta as before from b), o as (select product, location, channel, origin from (select distinct product, location, channel from ledger) cross join weeks),
    f as (select o.*, max_by(balance, sequence) filter (day <= origin) as start_balance, min(day) filter (day > origin and day <= origin + 7 and before > 0 and balance <= 0) as od from o left join m using (product, location, channel) group by all),
    s as (select *, case when start_balance is null then 'no_history' when start_balance <= 0 then 'already_out' when origin + 7 > (select last_day from span) then 'not_covered' else 'labelled' end as status from f)
    select product, location, channel, origin, start_balance, status, case when status = 'labelled' then cast(od is not null as bigint) end as label, case when status = 'labelled' then od end as out_day from s""", "ledger", "weeks"))
def _(spark, d):
    moves = ledger(spark, d)
    origins = moves.select(*SERIES).distinct().crossJoin(F.broadcast(weeks(spark, d)))  # the Sundays of the data
    return L.incident_labels(moves, origins, SERIES, "sequence", 7, F.lit(span(spark, d).first()["last_day"]))


@query("wn06_rolling_stats", sql("""select product, location, channel, day, """ + ", ".join(f"round(avg(units) over w{w}, 6) as mean_{w}, round(stddev_pop(units) over w{w}, 6) as std_{w}, count(units) over w{w} as n_{w}" for w in (7, 14, 28)) + """ from series_day
    window """ + ", ".join(f"w{w} as (partition by product, location, channel order by day range between interval {w - 1} days preceding and current row)" for w in (7, 14, 28)), "series_day"))
def _(spark, d):
    r = P.rolling(series_day(spark, d), SERIES, "day", "units", (7, 14, 28))
    return r.select(*KEY, *[F.round(f"{s}_{w}", 6).alias(f"{s}_{w}") for w in (7, 14, 28) for s in ("mean", "std")], "n_7", "n_14", "n_28")


@query("wn07_origin_lags", sql(f"with {_ORIGINS} select o.product, o.location, o.channel, origin, " + ", ".join(f"max(case when day = origin + 1 - {k} then units end) as lag_{k}" for k in (1, 7, 14, 28)) + " from o left join series_day s on s.product = o.product and s.location = o.location and s.channel = o.channel and day > origin - 28 and day <= origin group by all", "series_day", "weeks"))
def _(spark, d):
    return P.origin_lags(series_day(spark, d), _origins(spark, d), SERIES, "day", "units", (1, 7, 14, 28))


@query("wn08_islands", sql("""select product, location, channel, min(day) as start, max(day) as "end", count(*) as n_days, max(day) + 1 as known from (select *, day - cast(row_number() over (partition by product, location, channel order by day) as integer) as g from series_day) group by product, location, channel, g""", "series_day"))
def _(spark, d):
    return P.islands(series_day(spark, d).withColumn("known", F.date_add("day", 1)), SERIES, "day", "known")


@query("st04_panel_reindex", sql("""select y.day, count(*) as n_series, count(units) as n_known, sum(units) as units from (select distinct product, location, channel from series_day) k cross join (select cast(unnest(generate_series(first_day::timestamp, last_day::timestamp, interval 1 day)) as date) as day from span) y
    left join series_day s on s.product = k.product and s.location = k.location and s.channel = k.channel and s.day = y.day group by 1""", "series_day", "span"))
def _(spark, d):
    """Every series on every day of the data, by day: missing days are there, without units."""
    ends = span(spark, d).first()
    panel = P.reindex(series_day(spark, d), SERIES, str(ends["first_day"]), str(ends["last_day"]))
    return panel.groupBy("day").agg(F.count("*").alias("n_series"), F.count("units").alias("n_known"), F.sum("units").alias("units"))


@query("ag09_baselines", sql(f"""with {_ORIGINS} select o.product, o.location, o.channel, origin, max_by(units, day) as last_observed, round(avg(units), 6) as moving_average, median(units) filter (origin - day < 7) as median_7, max_by(units, day) filter ((origin - day) % 7 = 6) as seasonal, count(units) as known
    from o join series_day s on s.product = o.product and s.location = o.location and s.channel = o.channel and day > origin - 28 and day <= origin group by all""", "series_day", "weeks"))
def _(spark, d):
    b = P.empirical_baselines(series_day(spark, d), _origins(spark, d), SERIES, "day", "units")
    return b.withColumn("moving_average", F.round("moving_average", 6))


@query("ml01_baselines", sql(f"""with {_ORIGINS}, b as (select o.product, o.location, o.channel, origin, case when count(units) >= 3 then round(avg(units), 6) end as moving_average, max_by(units, day) as last_observed from o join series_day s on s.product = o.product and s.location = o.location and s.channel = o.channel and day > origin - 28 and day <= origin group by all)
    select b.*, h from b cross join (select unnest(range(1, 15)) as h)""", "series_day", "weeks"))
def _(spark, d):
    b = P.empirical_baselines(series_day(spark, d), _origins(spark, d), SERIES, "day", "units")
    b = b.select(*SERIES, "origin", F.when(F.col("known") >= 3, F.round("moving_average", 6)).alias("moving_average"), "last_observed")
    return P.horizons(b).drop("target")


_RES = "r as (select a.product, a.location, a.channel, a.day, a.units - b.units as residual, a.units, b.units as expected from series_day a join series_day b on b.product = a.product and b.location = a.location and b.channel = a.channel and b.day = a.day - 7)"


def _residuals(spark, d):
    from asoflow.operators.joins import lagged

    s = series_day(spark, d)
    return lagged(s, SERIES, "day", "units", 7, "expected").where("expected is not null").withColumn("residual", F.col("units") - F.col("expected"))


@query("ag10_robust_scale", sql(f"""with {_RES}, m as (select product, location, channel, median(residual) as md from r group by all) select r.product, r.location, r.channel, count(residual) as n, round(case when count(residual) >= 7 then greatest(1.0, median(abs(residual - md)) * 1.4826) end, 6) as scale from r join m on m.product = r.product and m.location = r.location and m.channel = r.channel group by all""", "series_day"))
def _(spark, d):
    return P.robust_scale(_residuals(spark, d), SERIES, "residual").withColumn("scale", F.round("scale", 6))


@query("wn18_count_residuals", sql(f"""with {_RES} select product, location, channel, day, round(case when count(*) over w >= 2 then sum(residual) over w / greatest(1.0, sqrt(sum(expected) over w)) end, 6) as residual_3, round(case when count(*) over v >= 4 then sum(residual) over v / greatest(1.0, sqrt(sum(expected) over v)) end, 6) as residual_7 from r
    window w as (partition by product, location, channel order by day range between interval 2 days preceding and current row), v as (partition by product, location, channel order by day range between interval 6 days preceding and current row)""", "series_day"))
def _(spark, d):
    r = _residuals(spark, d)
    c = {f"residual_{w}": F.round(P.count_residual(F.col("units"), F.col("expected"), P.over_days(SERIES, "day", w), k), 6) for w, k in ((3, 2), (7, 4))}
    return r.withColumns(c).select(*KEY, "residual_3", "residual_7")


@query("ag11_history_stats", sql(f"""with {_ORIGINS} select o.product, o.location, o.channel, origin, count(units) as known, 28 - count(units) as missing, round(avg(units), 6) as mean, round(stddev_pop(units), 6) as std from o left join series_day s on s.product = o.product and s.location = o.location and s.channel = o.channel and day > origin - 28 and day <= origin group by all""", "series_day", "weeks"))
def _(spark, d):
    o = _origins(spark, d)
    met = P.facts_of_origins(series_day(spark, d), o, SERIES, "day", range(28)).groupBy(*o.columns).agg(F.count("units").alias("known"), F.round(F.avg("units"), 6).alias("mean"), F.round(F.stddev_pop("units"), 6).alias("std"))
    out = o.join(met, o.columns, "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return out.withColumn("missing", 28 - F.col("known"))


@query("ds06_origins", sql("select origin, h, origin + cast(h as integer) as target from weeks cross join (select unnest(range(1, 15)) as h) where origin <= (select max(cast(o_orderdate as date)) from orders)", "weeks"))
def _(spark, d):
    from asoflow.sources.adapters import table

    last = table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    return P.horizons(weeks(spark, d).join(F.broadcast(last), F.col("origin") <= F.col("last")).drop("last"))


_ROLE = """case when day <= date '1998-12-31' - 15 then 'train' when day <= date '1998-12-31' then 'purged' when day <= date '1999-12-31' - 15 then 'tune' when day <= date '1999-12-31' then 'purged' when day <= date '2000-12-31' then 'test' else 'outside' end"""


@query("ds09_partitions", sql(f"select {_ROLE} as role, count(*) as n_rows, min(day) as first_day, max(day) as last_day, sum(units) as units from series_day group by 1", "series_day"))
def _(spark, d):
    m = P.membership(series_day(spark, d), "day", "1998-12-31", "1999-12-31", "2000-12-31", 15)
    return m.groupBy("role").agg(F.count("*").alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("units").alias("units"))


@query("ds08_forecast_split", sql(f"""with s as (select product, location, channel, day, {_ROLE} as role, max(version) filter (available <= day + 2) as v from series_day join demand_versions using (product, location, channel, day) group by all)
    select role, count(*) as n_members, count(case when v is not null and role <> 'purged' then 1 end) as n_eligible, count(case when v is null then 1 end) as n_late from s group by 1""", "series_day", "demand_versions"))
def _(spark, d):
    seen = demand_versions(spark, d).groupBy(*KEY).agg(F.max(F.when(F.col("available") <= F.date_add("day", 2), F.col("version"))).alias("v"))
    m = P.membership(seen, "day", "1998-12-31", "1999-12-31", "2000-12-31", 15)
    return m.groupBy("role").agg(F.count("*").alias("n_members"), F.count_if(F.expr("v is not null and role <> 'purged'")).alias("n_eligible"), F.count_if(F.expr("v is null")).alias("n_late"))


@query("ag26_membership_counts", sql(f"""select role, reason, count(*) as n from (select {_ROLE} as role, unnest(list_filter([case when units > 300 then 'high_volume' end, case when month(day) = 12 then 'december' end, case when units < 5 then 'low_volume' end], lambda x: x is not null)) as reason from series_day) group by all""", "series_day"))
def _(spark, d):
    from asoflow.functions.columns import all_reasons

    m = P.membership(series_day(spark, d), "day", "1998-12-31", "1999-12-31", "2000-12-31", 15)
    why = all_reasons([(F.col("units") > 300, "high_volume"), (F.month("day") == 12, "december"), (F.col("units") < 5, "low_volume")])
    return m.select("role", F.explode(why).alias("reason")).groupBy("role", "reason").agg(F.count("*").alias("n"))


@query("ds16_anomaly_inputs", sql(f"""with {_BAL}, days as (select cast(unnest(generate_series(first_day::timestamp, last_day::timestamp, interval 1 day)) as date) as day from span), k as (select distinct product, location, channel from demand_versions),
    t as (select product, location, channel, day, max_by(units, version) filter (available <= day + 2) as seen, max_by(units, version) filter (available <= day + 6) as before from demand_versions group by all),
    r as (select k.product, k.location, k.channel, days.day, a.seen as units, e.before as expected, a.seen - e.before as residual, a.product is not null as there from k cross join days left join t a on a.product = k.product and a.location = k.location and a.channel = k.channel and a.day = days.day left join t e on e.product = k.product and e.location = k.location and e.channel = k.channel and e.day = days.day - 7),
    m as (select product, location, channel, median(residual) as md from r where residual is not null and year(day) < 1999 group by all), s as (select r.product, r.location, r.channel, case when count(residual) >= 7 then greatest(1.0, median(abs(residual - md)) * 1.4826) end as scale from r join m using (product, location, channel) where residual is not null and year(day) < 1999 group by all),
    g as (select product, location, channel, day, min(balance) as low from b group by all)
    select r.product, r.location, r.channel, r.day, r.units, expected, residual, round(residual / scale, 6) as score, case when not there then 'missing_day' when r.units is null then 'late_outcome' when expected is null then 'no_expectation' when scale is null then 'insufficient_history' else 'ready' end as status,
    case when g.low is null then 'no_movement' when g.low <= 0 then 'constrained' else 'in_stock' end as stock from r left join s using (product, location, channel) left join g using (product, location, channel, day) where year(r.day) >= 1999""", "demand_versions", "ledger"))
def _(spark, d):
    """Scored days against the same weekday before, as known two days after the day and at the day's start; the scale comes from residuals before 1999."""
    v = demand_versions(spark, d)

    def known(days):  # the highest version that was there so many days after
        return F.max_by(F.when(F.col("available") <= F.date_add("day", days), F.col("units")), F.when(F.col("available") <= F.date_add("day", days), F.col("version")))

    facts = v.groupBy(*KEY).agg(known(2).alias("units"), known(6).alias("before"))
    full = every_day(spark, d, v).join(facts.select(*KEY, "units", F.lit(True).alias("there")), KEY, "left")
    past = facts.select(*SERIES, F.date_add("day", 7).alias("day"), F.col("before").alias("expected"))
    r = full.join(past, KEY, "left").withColumn("residual", F.col("units") - F.col("expected"))
    s = P.robust_scale(r.where("residual is not null and year(day) < 1999"), SERIES, "residual")
    low = L.running_balance(ledger(spark, d), SERIES, "sequence").groupBy(*KEY).agg(F.min("balance").alias("low"))
    j = r.where("year(day) >= 1999").join(s, SERIES, "left").join(low, KEY, "left")
    status = (
        F.when(F.col("there").isNull(), "missing_day").when(F.col("units").isNull(), "late_outcome").when(F.col("expected").isNull(), "no_expectation")
        .when(F.col("scale").isNull(), "insufficient_history").otherwise("ready")
    )
    stock = F.when(F.col("low").isNull(), "no_movement").when(F.col("low") <= 0, "constrained").otherwise("in_stock")
    return j.select(*KEY, "units", "expected", "residual", F.round(F.col("residual") / F.col("scale"), 6).alias("score"), status.alias("status"), stock.alias("stock"))


@query("ml07_seasonal_residual", sql(f"""with {_RES} select product, location, channel, max(round(greatest(abs(residual) / 50.0, abs(residual) / greatest(1.0, sqrt(expected))), 6)) as top_score, count(case when abs(residual) / 50.0 > 3 then 1 end) as n_alerts from r group by all""", "series_day"))
def _(spark, d):
    r = _residuals(spark, d)
    score = F.round(F.greatest(F.abs("residual") / 50.0, F.abs("residual") / F.greatest(F.lit(1.0), F.sqrt("expected"))), 6)
    return r.groupBy(*SERIES).agg(F.max(score).alias("top_score"), F.count_if(F.abs("residual") / 50.0 > 3).alias("n_alerts"))


@query("wn14_capacity_threshold", sql(f"""with {_RES}, k as (select product, abs(residual) as s, row_number() over (partition by product order by abs(residual)) as rn, count(*) over (partition by product) as n from r) select product, min(s) as threshold, max(n) as n, (select count(*) from r q where q.product = k.product and abs(q.residual) > min(k.s)) as n_alerts from k where rn = n - floor(n * 0.01) group by product""", "series_day"))
def _(spark, d):
    from asoflow.operators.metrics import capacity_threshold

    r = _residuals(spark, d).withColumn("s", F.abs("residual"))
    t = capacity_threshold(r, ["product"], "s", 0.01)
    return r.join(t, "product").groupBy("product", "threshold", "n").agg(F.count_if(F.expr("s > threshold")).alias("n_alerts"))
