"""Queries on serving views, composite datasets and batch scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflow.functions import columns as C
from asoflow.operators import joins as J
from asoflow.operators import panel as P
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import SERIES, demand_versions, forecasts, ledger, routes, scores, series_day, span, table, weeks

KEY = [*SERIES, "day"]
_DAYS = "days as (select cast(unnest(generate_series(first_day::timestamp, last_day::timestamp, interval 1 day)) as date) as day from span)"


def _every_day(spark, d):
    return span(spark, d).select(F.explode(F.sequence("first_day", "last_day")).alias("day"))


def _stock_days(spark, d):
    from asoflow.operators.ledger import stock_days

    moves = ledger(spark, d)
    days = moves.select(*SERIES).distinct().crossJoin(F.broadcast(_every_day(spark, d)))  # the days of the data
    return moves, stock_days(moves, days, SERIES, "sequence")


#: stock_days over all days of the data
_STOCK = """bal as (select *, sum(delta) over (partition by product, location, channel order by sequence) as balance from ledger), mv as (select *, balance - delta as before from bal), gd as (select product, location, channel, day, max_by(balance, sequence) as e, min_by(before, sequence) as s, min(balance) as low, count(case when before > 0 and balance <= 0 then 1 end) as onsets from mv group by all),
    stock_day as (select product, location, channel, day, eb as end_balance, least(coalesce(s, eb), coalesce(low, eb)) > 0 as in_stock, coalesce(onsets, 0) as onsets from (select k.*, days.day, g.s, g.low, g.onsets, last_value(g.e ignore nulls) over (partition by k.product, k.location, k.channel order by days.day rows unbounded preceding) as eb
    from (select distinct product, location, channel from ledger) k cross join (select day from days union select distinct day from ledger) days left join gd g on g.product = k.product and g.location = k.location and g.channel = k.channel and g.day = days.day) where day in (select day from days))"""


@query("wn15_latest_view", sql("select product, location, channel, h, origin, p from (select *, row_number() over (partition by product, location, channel, h order by origin desc) as r from forecasts) where r = 1 and p > 20", "forecasts"))
def _(spark, d):
    w = Window.partitionBy(*SERIES, "h").orderBy(F.desc("origin"))
    return forecasts(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1 and p > 20").select(*SERIES, "h", "origin", "p")


@query("wn16_paged_view", "select o_orderkey, o_totalprice, (select count(*) from orders where o_orderstatus = 'O') as n_total from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 50 offset 100")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    page = o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)
    return page.crossJoin(o.agg(F.count("*").alias("n_total")))


@query("so01_total_order", "select o_custkey, o_orderkey, cast(o_orderdate as date) as day, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), F.row_number().over(w).cast("long").alias("place"))


@query("st02_census", sql(f"""with k as (select distinct product, location, channel from series_day), {_DAYS} select product, location, channel, count(*) as n_expected, count(s.units) as n_there from k cross join days left join series_day s using (product, location, channel, day) group by all""", "series_day", "span"))
def _(spark, d):
    s = series_day(spark, d)
    full = s.select(*SERIES).distinct().crossJoin(F.broadcast(_every_day(spark, d))).join(s, KEY, "left")  # the days of the data
    return full.groupBy(*SERIES).agg(F.count("*").alias("n_expected"), F.count("units").alias("n_there"))


_WIN = """wa as (select product, location, channel, min(day) as start, max(day) as "end", max(day) + 1 as known from (select *, day - cast(row_number() over (partition by product, location, channel order by day) as integer) as g from series_day where units > 50) group by product, location, channel, g),
    wb as (select product, location, channel, min(day) as start, max(day) as "end", max(day) + 2 as known from (select *, day - cast(row_number() over (partition by product, location, channel order by day) as integer) as g from series_day where units < 200) group by product, location, channel, g)"""


@query("jn22_window_intersection", sql(f"""with {_WIN} select a.product, a.location, a.channel, greatest(a.start, b.start) as start, least(a."end", b."end") as "end", greatest(a.known, b.known) as known from wa a join wb b on a.product = b.product and a.location = b.location and a.channel = b.channel and a.start <= b."end" and b.start <= a."end" """, "series_day"))
def _(spark, d):
    s = series_day(spark, d)
    a = P.islands(s.where("units > 50").withColumn("known", F.date_add("day", 1)), SERIES, "day", "known")
    b = P.islands(s.where("units < 200").withColumn("known", F.date_add("day", 2)), SERIES, "day", "known")
    return J.window_intersection(a, b, SERIES)


@query("jn21_episode_match", sql(f"""with {_WIN}, e as (select *, row_number() over (partition by product, location, channel order by start) as episode_id from wa) select s.product, s.location, s.channel, s.day, min_by(episode_id, (e."end", episode_id)) as episode_id from series_day s join e on e.product = s.product and e.location = s.location and e.channel = s.channel and e.start <= s.day and s.day <= e."end" + 3 where units > 60 group by all""", "series_day"))
def _(spark, d):
    s = series_day(spark, d)
    e = P.islands(s.where("units > 50").withColumn("known", F.date_add("day", 1)), SERIES, "day", "known").drop("n_days", "known")
    e = e.withColumn("episode_id", F.row_number().over(Window.partitionBy(*SERIES).orderBy("start")).cast("long"))
    return J.episode_match(s.where("units > 60"), e, SERIES, KEY, 3)


@query("jn20_truth_census", sql(f"""with {_WIN}, t as (select w.*, s.units, l.units as before, cast(w.day as date) > (select last_day - 30 from span) as young from (select product, location, channel, cast(unnest(range(start, "end" + 1, interval 1 day)) as date) as day from wb where "end" - start >= 3) w left join series_day s using (product, location, channel, day)
    left join series_day l on l.product = w.product and l.location = w.location and l.channel = w.channel and l.day = w.day - 7), r as (select *, case when units is null then 'unknown' when young then 'immature' when before is null then 'insufficient' else 'evaluable' end as status from t)
    select status, count(*) as n_days, count(case when units > before then 1 end) as n_predicted, count(case when units > 60 then 1 end) as n_high from r group by 1""", "series_day", "span"))
def _(spark, d):
    s = series_day(spark, d)
    w = P.islands(s.where("units < 200").withColumn("known", F.date_add("day", 2)), SERIES, "day", "known").where(F.datediff("end", "start") >= 3)
    days = w.select(*SERIES, F.explode(F.sequence("start", "end")).alias("day"))
    return J.truth_census(days, J.lagged(s, SERIES, "day", "units", 7, "before"), KEY, F.date_sub(F.lit(span(spark, d).first()["last_day"]), 30))


@query("jn23_annotation_join", sql("""select s.product, s.location, s.channel, s.day, coalesce(case when s.day between make_date(year(s.day), 11, 20) and make_date(year(s.day), 12, 1) then 'black_week' end, case when month(s.day) = 12 then 'christmas' end, 'normal') as scenario from series_day s""", "series_day"))
def _(spark, d):
    years = span(spark, d).select(F.explode(F.sequence(F.year("first_day"), F.year("last_day"))).alias("y"))
    w = years.select(F.inline(F.array(F.struct(F.make_date("y", F.lit(11), F.lit(20)).alias("start"), F.make_date("y", F.lit(12), F.lit(1)).alias("end"), F.lit("black_week").alias("tag"), F.lit(0).alias("r")), F.struct(F.make_date("y", F.lit(12), F.lit(1)).alias("start"), F.make_date("y", F.lit(12), F.lit(31)).alias("end"), F.lit("christmas").alias("tag"), F.lit(1).alias("r")))))
    tags = w.select(F.explode(F.sequence("start", "end")).alias("day"), "tag", "r").groupBy("day").agg(F.min_by("tag", "r").alias("tag"))
    return series_day(spark, d).join(tags, "day", "left").select(*KEY, F.coalesce("tag", F.lit("normal")).alias("scenario"))


@query("jn24_promotion_exposure", sql("""with p as (select distinct product, location, cast(unnest(range(day, day + 3, interval 1 day)) as date) as active, day - 3 as known from series_day where units > 400), a as (select distinct product, location, day from series_day),
    t as (select p.product, p.location, p.active, r.stock, p.known from p join routes r on r.location = p.location and r.from_day <= p.active and p.active < r.to_day where exists (select 1 from a where a.product = p.product and a.location = p.location and a.day > p.active - 28 and a.day <= p.active)),
    x as (select distinct s.product, r.stock, s.day from series_day s join routes r on r.location = s.location and r.from_day <= s.day and s.day < r.to_day), e as (select distinct product, stock, cast(unnest(range(active - 7, active, interval 1 day)) as date) as day, known from t)
    select x.product, x.stock, x.day, count(e.day) > 0 as exposed from x left join e on e.product = x.product and e.stock = x.stock and e.day = x.day and e.known <= x.day group by all""", "series_day", "routes"))
def _(spark, d):
    """Promotions run three days from a day of high demand and are known three days ahead; they count where their location routes to the stock and the product was sold there in the last 28 days."""
    s, r = series_day(spark, d), routes(spark, d)
    promo = s.where("units > 400").select("product", "location", F.explode(F.expr("sequence(day, date_add(day, 2))")).alias("active"), F.date_sub("day", 3).alias("known"))
    sold = s.select("product", "location", F.explode(F.expr("sequence(day, date_add(day, 27))")).alias("active")).distinct()
    routed = J.on_day(promo.join(sold, ["product", "location", "active"], "left_semi"), r, "active")
    asked = J.on_day(s.select("product", "location", "day"), r, "day").select("product", "stock", "day").distinct()
    return J.promotion_exposure(asked, routed, 7)


@query("jn29_pinned_pair", sql("""with f as (select product, location, channel, origin, sum(p) as week from forecasts where h <= 7 group by all), b as (select product, location, channel, day as origin, max_by(bal, sequence) as bal from (select *, sum(delta) over (partition by product, location, channel order by sequence) as bal from ledger) group by all)
    select product, location, channel, origin, round(week, 4) as week, bal, round(case when week > 0 then bal / (week / 7) end, 4) as days_of_supply from f join b using (product, location, channel, origin)""", "forecasts", "ledger"))
def _(spark, d):
    from asoflow.operators.ledger import running_balance

    f = forecasts(spark, d).where("h <= 7").groupBy(*SERIES, "origin").agg(F.sum("p").alias("week"))
    b = running_balance(ledger(spark, d), SERIES, "sequence").groupBy(*SERIES, F.col("day").alias("origin")).agg(F.max_by("balance", "sequence").alias("bal"))
    return f.join(b, [*SERIES, "origin"]).select(*SERIES, "origin", F.round("week", 4).alias("week"), "bal", F.round(F.when(F.col("week") > 0, F.col("bal") / (F.col("week") / 7)), 4).alias("days_of_supply"))


@query("jn31_training_frame", sql("""select product, location, channel, day, units, coalesce(case when p_size > 25 then p_brand end, '__unknown__') as category from series_day left join (select p_type, max_by(p_brand, p_partkey) as p_brand, max_by(p_size, p_partkey) as p_size from part group by 1) on p_type = product where day < date '1998-01-01'""", "series_day"))
def _(spark, d):
    cat = table(spark, d, "part").groupBy(F.col("p_type").alias("product")).agg(F.max_by("p_brand", "p_partkey").alias("b"), F.max_by("p_size", "p_partkey").alias("s"))
    return series_day(spark, d).where("day < date'1998-01-01'").join(cat, "product", "left").select(*KEY, "units", F.coalesce(F.when(F.col("s") > 25, F.col("b")), F.lit("__unknown__")).alias("category"))


@query("ds01_curate", """with r as (select l_orderkey, l_linenumber, l_quantity, upper(trim(l_returnflag)) as flag, case when o_orderkey is null then 'order_missing' when l_shipdate < o_orderdate then 'shipped_before_ordered' when l_discount > 0.09 then 'discount_range' end as reason from lineitem left join (select * from orders where o_orderkey % 13 <> 0) on l_orderkey = o_orderkey)
    select coalesce(reason, 'accepted') as outcome, count(*) as n_rows, sum(l_quantity) as quantity, count(distinct flag) as n_flags from r group by 1""")
def _(spark, d):
    from asoflow.operators.curate import curate

    o = table(spark, d, "orders").where("o_orderkey % 13 <> 0").select("o_orderkey", "o_orderdate")
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = [(F.col("o_orderkey").isNull(), "order_missing"), (F.col("l_shipdate") < F.col("o_orderdate"), "shipped_before_ordered"), (F.col("l_discount") > 0.09, "discount_range")]
    found = curate(rows, rules, codes={"l_returnflag": True})
    return found.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_returnflag").alias("n_flags"))


@query("ds07_forecast_features", sql("""with o as (select product, location, channel, origin from (select distinct product, location, channel from series_day) cross join weeks),
    v as (select o.*, day, units, row_number() over (partition by o.product, o.location, o.channel, o.origin, day order by version desc) as r from o join demand_versions d on d.product = o.product and d.location = o.location and d.channel = o.channel and d.available <= o.origin + 1 and d.day > o.origin - 28 and d.day <= o.origin),
    f as (select product, location, channel, origin, count(*) as known, round(avg(units) filter (day > origin - 7), 6) as mean_7, round(avg(units), 6) as mean_28, max(units) filter (day = origin) as lag_1, max(units) filter (day = origin - 6) as lag_7 from v where r = 1 group by all)
    select o.product, o.location, o.channel, o.origin, coalesce(known, 0) as known, mean_7, mean_28, lag_1, lag_7, case when coalesce(known, 0) < 7 then 'insufficient_history' else 'ready' end as status, cast(isodow(o.origin + 1) - 1 as bigint) as weekday from o left join f using (product, location, channel, origin)""", "series_day", "demand_versions", "weeks"))
def _(spark, d):
    from asoflow.operators.datasets import forecast_features

    keys = series_day(spark, d).select(*SERIES).distinct()
    return forecast_features(demand_versions(spark, d), keys.crossJoin(F.broadcast(weeks(spark, d))), SERIES)  # the Sundays of the data


@query("ds12_stockout_features", sql(f"""with {_DAYS}, {_STOCK}, o as (select product, location, channel, origin from (select distinct product, location, channel from ledger) cross join weeks),
    ev as (select product, location, channel, greatest(day, available) as t, {{'s': sequence, 'b': balance, 'd': day}} as m, case when kind = 'receipt' then day end as rc, false as asked from mv union all select product, location, channel, origin, null, null, true from o),
    a as (select product, location, channel, t as origin, last.b as available_qty, last.d as moved_on, receipt from (select *, max(m) over w as last, max(rc) over w as receipt from ev window w as (partition by product, location, channel order by t range unbounded preceding)) where asked and last is not null),
    u as (select product, location, channel, day, -sum(delta) as u, max(available) as known from mv where kind = 'sale' group by all), hs as (select o.product, o.location, o.channel, o.origin, count(*) as n, sum(u) as s, sum(u * u) as q, count(case when t.in_stock then 1 end) as ni, sum(case when t.in_stock then u end) as si from (select *, unnest([day + cast(7 - isodow(day) as integer), day + cast(14 - isodow(day) as integer), day + cast(21 - isodow(day) as integer), day + cast(28 - isodow(day) as integer)]) as origin from u) u join o on u.product = o.product and u.location = o.location and u.channel = o.channel and u.origin = o.origin and u.known <= o.origin
    join stock_day t on t.product = o.product and t.location = o.location and t.channel = o.channel and t.day = u.day group by all),
    c as (select product, location, channel, day, sum(case when in_stock is not null then 1 else 0 end) over w as cd, sum(case when not in_stock then 1 else 0 end) over w as cc, sum(onsets) over w as co from stock_day window w as (partition by product, location, channel order by day rows unbounded preceding)),
    hd as (select o.*, coalesce(x.cd, 0) - coalesce(y.cd, 0) as nd, coalesce(x.cc, 0) - coalesce(y.cc, 0) as nc, coalesce(z.cd, 0) - coalesce(y.cd, 0) as np, coalesce(z.co, 0) - coalesce(y.co, 0) as no from o left join c x on x.product = o.product and x.location = o.location and x.channel = o.channel and x.day = origin left join c y on y.product = o.product and y.location = o.location and y.channel = o.channel and y.day = origin - 28
    left join c z on z.product = o.product and z.location = o.location and z.channel = o.channel and z.day = origin - 1),
    rp as (select product, location, channel, day, sum(delta) as q from mv where kind = 'receipt' group by all), du as (select product, location, channel, day - cast(isodow(day) as integer) as origin, sum(q) as due from rp group by all),
    pl as (select o.*, due, r.day as nxt from o left join du using (product, location, channel, origin) asof left join rp r on r.product = o.product and r.location = o.location and r.channel = o.channel and o.origin < r.day)
    select o.product, o.location, o.channel, o.origin, available_qty, o.origin - moved_on as snapshot_age_days, coalesce(n, 0) as history_known_days, 28 - coalesce(n, 0) as history_missing_days, round(s / n, 6) as observed_sales_mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0.0)), 4) as observed_sales_std, round(si / nullif(ni, 0), 6) as in_stock_sales_mean, coalesce(ni, 0) as history_in_stock_days,
    cast(nc as bigint) as history_constrained_days, cast(28 - nd as bigint) as history_inventory_unknown_days, case when np = 27 then cast(no as bigint) end as historical_stockout_onsets, round(available_qty * n / nullif(s, 0), 4) as days_of_supply_observed, round(available_qty * ni / nullif(si, 0), 4) as days_of_supply_in_stock, coalesce(due, 0.0) as due_within_7d_quantity, nxt - o.origin as next_expected_delivery_days, o.origin - receipt as last_receipt_days,
    case when available_qty is null then 'insufficient_data' when available_qty <= 0 then 'already_stockout' when coalesce(n, 0) < 7 then 'insufficient_data' else 'eligible' end as status, case when available_qty is null then 'inventory_unknown' when available_qty > 0 and coalesce(n, 0) < 7 then 'insufficient_sales_history' end as reason
    from o left join a using (product, location, channel, origin) left join hs using (product, location, channel, origin) left join hd using (product, location, channel, origin) left join pl using (product, location, channel, origin)""", "ledger", "weeks"))
def _(spark, d):
    from asoflow.operators.datasets import stockout_features

    moves, daily = _stock_days(spark, d)
    o = moves.select(*SERIES).distinct().crossJoin(F.broadcast(weeks(spark, d)))  # the Sundays of the data
    return stockout_features(moves, daily, o, SERIES, "sequence")


@query("ds14_upstream", sql("""with f as (select product, stock, origin, case when isodow(target) = 7 then cast(0 as decimal(18, 6)) else cast(p as decimal(18, 6)) end as q, isodow(target) = 7 as closed from forecasts x join routes r on r.location = x.location and from_day <= target and target < to_day where h <= 7)
    select product, stock, origin, count(*) as n_days, count(case when closed then 1 end) as n_closed, count(*) - count(q) as n_unknown, case when count(*) = count(q) then cast(sum(q) as double) end as week, case when count(*) = count(q) then 'ready' else 'insufficient' end as status from f group by all""", "forecasts", "routes"))
def _(spark, d):
    from asoflow.operators.datasets import upstream

    f = J.on_day(forecasts(spark, d).where("h <= 7"), routes(spark, d), "target")
    return upstream(f, ["product", "stock", "origin"], "p", F.dayofweek("target") == 1)  # closed on Sundays


@query("ds15_stockout_split", sql("""select role, reason, count(*) as n from (select case when day + 7 <= date '1999-06-30' then 'train' when day <= date '1999-06-30' then 'purged' when day + 7 <= date '2000-06-30' then 'tune' when day <= date '2000-06-30' then 'purged' when day <= date '2001-06-30' then 'test' else 'outside' end as role, case when day <= date '1999-06-30' and day + 7 > date '1999-06-30' or day <= date '2000-06-30' and day > date '1999-06-30' and day + 7 > date '2000-06-30' then 'label_crosses_boundary' else 'none' end as reason from series_day) group by all""", "series_day"))
def _(spark, d):
    s = P.membership(series_day(spark, d), "day", "1999-06-30", "2000-06-30", "2001-06-30", 7)
    return s.groupBy("role", F.when(F.col("role") == "purged", "label_crosses_boundary").otherwise("none").alias("reason")).agg(F.count("*").alias("n"))


@query("ds20_return_inputs", sql(f"""with k as (select distinct p_type as product from part), {_DAYS}, r as (select p_type as product, returned as day, sum(quantity) as q, count(*) as n from returned join part on p_partkey = part where returned + 2 <= (select last_day from span) group by all)
    select k.product, days.day, coalesce(q, 0.0) as quantity, coalesce(n, 0) as n_claims from k cross join days left join r on r.product = k.product and r.day = days.day""", "returned", "span"))
def _(spark, d):
    from asoflow.sources.adapters import returns

    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("product"))
    last = span(spark, d).select("last_day")
    r = returns(spark, d).join(F.broadcast(last), F.expr("date_add(returned, 2) <= last_day"))  # one row
    r = r.join(p, F.col("p_partkey") == F.col("part")).groupBy("product", F.col("returned").alias("day")).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n_claims"))
    days = p.select("product").distinct().crossJoin(F.broadcast(_every_day(spark, d)))  # the days of the data
    return days.join(r, ["product", "day"], "left").select("product", "day", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


@query("ds21_anomaly_membership", sql(f"""with k as (select distinct product, location, channel from series_day), {_DAYS}, x as (select case when days.day <= date '1998-12-31' - 15 then 'train' when days.day <= date '1998-12-31' then 'purged' when days.day <= date '1999-12-31' - 15 then 'tune' when days.day <= date '1999-12-31' then 'purged' when days.day <= date '2000-12-31' then 'test' else 'outside' end as role,
    case when s.units is null then 'gap' when v.version is null then 'late_outcome' when l.units is null then 'insufficient_history' else 'none' end as reason from k cross join days left join series_day s using (product, location, channel, day) left join (select product, location, channel, day, max(version) as version from demand_versions where available <= day + 2 group by all) v using (product, location, channel, day) left join series_day l on l.product = k.product and l.location = k.location and l.channel = k.channel and l.day = days.day - 7)
    select role, reason, case when role in ('purged', 'outside') then 'excluded' when reason <> 'none' then 'ineligible' else 'eligible' end as status, count(*) as n from x group by all""", "series_day", "demand_versions", "span"))
def _(spark, d):
    s = series_day(spark, d)
    full = s.select(*SERIES).distinct().crossJoin(F.broadcast(_every_day(spark, d))).join(s, KEY, "left")  # the days of the data
    v = demand_versions(spark, d).where("available <= date_add(day, 2)").groupBy(*KEY).agg(F.max("version").alias("version"))
    full = full.join(s.select(*SERIES, F.date_add("day", 7).alias("day"), F.col("units").alias("before")), KEY, "left").join(v, KEY, "left")
    reason = F.when(F.col("units").isNull(), "gap").when(F.col("version").isNull(), "late_outcome").when(F.col("before").isNull(), "insufficient_history").otherwise("none")
    m = P.membership(full, "day", "1998-12-31", "1999-12-31", "2000-12-31", 15).withColumn("reason", reason)
    status = F.when(F.col("role").isin("purged", "outside"), "excluded").when(F.col("reason") != "none", "ineligible").otherwise("eligible")
    return m.groupBy("role", "reason", status.alias("status")).agg(F.count("*").alias("n"))


@query("ds13_observed_units", sql("""select r.stock, s.day, case when count(case when s.units > 450 then 1 end) > 0 then null else sum(s.units) end as units, count(*) as n_pairs from series_day s join routes r on r.location = s.location and from_day <= s.day and s.day < to_day group by all""", "series_day", "routes"))
def _(spark, d):
    j = J.on_day(series_day(spark, d), routes(spark, d), "day")
    return j.groupBy("stock", "day").agg(F.when(F.count_if(F.expr("units > 450")) == 0, F.sum("units")).alias("units"), F.count("*").alias("n_pairs"))


@query("ds24_scenario_tags", sql(f"""with {_DAYS}, {_STOCK}, t as (select product, day, list_filter([case when units > 400 then 'demand_shock' end, case when month(day) in (11, 12) then 'promotion' end, case when not in_stock then 'inventory_constraint' end], lambda x: x is not null) as tags from series_day join stock_day using (product, location, channel, day)),
    p as (select product, unnest(list_concat(case when len(tags) = 0 then ['normal'] else tags end, case when len(tags) > 1 then [tags[1] || '+' || tags[2]] else [] end, case when len(tags) > 2 then [tags[1] || '+' || tags[3], tags[2] || '+' || tags[3]] else [] end)) as tag from t)
    select tag, count(*) as n, count(distinct product) as n_products from p group by 1""", "series_day", "ledger"))
def _(spark, d):
    s = series_day(spark, d).join(_stock_days(spark, d)[1].select(*KEY, "in_stock"), KEY)
    tags = C.all_reasons([(F.col("units") > 400, "demand_shock"), (F.month("day").isin(11, 12), "promotion"), (~F.col("in_stock"), "inventory_constraint")])
    return J.tags_and_overlaps(s.select("product", tags.alias("tags")), "tags", "normal").groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("product").alias("n_products"))


@query("ds25_window_tensor", sql("""with o as (select product, location, channel, origin from (select distinct product, location, channel from series_day) cross join weeks), x as (select o.*, cast(unnest(range(origin - 27, origin + 1, interval 1 day)) as date) as day from o)
    select x.product, x.location, x.channel, x.origin, flatten(list([coalesce(units, 0.0), case when units is null then 1.0 else 0.0 end] order by x.day)) as tensor from x left join series_day s using (product, location, channel, day) group by all""", "series_day", "weeks"))
def _(spark, d):
    s = series_day(spark, d)
    o = s.select(*SERIES).distinct().crossJoin(F.broadcast(weeks(spark, d)))  # the Sundays of the data
    return P.window_tensor(s, o, SERIES, "day", "units", 28)


@query("ds26_ready_inputs", sql("""with k as (select distinct product, location, channel from series_day), x as (select max(origin) as origin from forecasts), f as (select product, location, channel, h, p from forecasts where origin = (select origin from x)), u as (select location, sum(cast(p as decimal(18, 6))) as week, count(*) - count(p) as n_unknown from f where h <= 7 group by 1),
    c as (select p_type as product, max_by(p_brand, p_partkey) as category from part group by 1)
    select k.product, k.location, k.channel, x.origin, c.category, case when n_unknown = 0 then cast(week as double) end as upstream, case when f.p is null then 'insufficient_data' when n_unknown > 0 then 'upstream_unknown' else 'ready' end as status from k cross join x left join f on f.product = k.product and f.location = k.location and f.channel = k.channel and f.h = 1 left join u on u.location = k.location left join c on c.product = k.product""", "series_day", "forecasts"))
def _(spark, d):
    """All series at the last origin, whether or not anything is known of them."""
    from asoflow.operators.datasets import upstream

    all_ = forecasts(spark, d)
    last = all_.agg(F.max("origin").alias("origin"))
    f = all_.join(F.broadcast(last), "origin")  # one row
    u = upstream(f.where("h <= 7"), ["location"], "p", F.lit(False)).select("location", F.col("week").alias("upstream"), "n_unknown")
    c = table(spark, d, "part").groupBy(F.col("p_type").alias("product")).agg(F.max_by("p_brand", "p_partkey").alias("category"))
    k = series_day(spark, d).select(*SERIES).distinct().crossJoin(F.broadcast(last)).join(f.where("h = 1").select(*SERIES, "p"), SERIES, "left").join(u, "location", "left").join(c, "product", "left")
    status = F.when(F.col("p").isNull(), "insufficient_data").when(F.col("n_unknown") > 0, "upstream_unknown").otherwise("ready")
    return k.select(*SERIES, "origin", "category", "upstream", status.alias("status"))


@query("ds27_role_export", sql("""with r as (select product, location, channel, day, units, case when day <= date '1998-12-31' - 15 then 'train' when day <= date '1998-12-31' then 'purged' when day <= date '1999-12-31' - 15 then 'tune' when day <= date '1999-12-31' then 'purged' when day <= date '2000-12-31' then 'test' else 'outside' end as role from series_day)
    select r.role, r.product, r.location, r.channel, r.day, b.units as lag_7, case when r.role in ('train', 'tune') then r.units end as label from r left join series_day b on b.product = r.product and b.location = r.location and b.channel = r.channel and b.day = r.day - 7 where r.role in ('train', 'tune', 'test')""", "series_day"))
def _(spark, d):
    """Features are written per role, labels in a table of their own that has none of the test role; what is read back is joined."""
    from asoflow.sources.scratch import scratch
    from asoflow.sources.tables import read_roles, write_roles

    rows = P.membership(J.lagged(series_day(spark, d), SERIES, "day", "units", 7, "lag_7"), "day", "1998-12-31", "1999-12-31", "2000-12-31", 15).where("role in ('train', 'tune', 'test')")
    features, labels = scratch(spark), scratch(spark)
    write_roles(rows.select(*KEY, "lag_7", "role"), features)
    write_roles(rows.where("role <> 'test'").select(*KEY, F.col("units").alias("label"), "role"), labels)
    kinds = "product string, location string, channel string, day date, {} double, role string"
    return read_roles(spark, features, kinds.format("lag_7")).join(read_roles(spark, labels, kinds.format("label")), [*KEY, "role"], "left").select("role", *KEY, "lag_7", "label")


@query("ds28_final_report", sql("""with r as (select *, row_number() over (order by p desc, doc_id) <= (select ceil(round(count(*) * 0.3, 9)) from scores) as taken, case when p < 0.2 then 'short' when p < 0.5 then 'middle' else 'long' end as scenario from scores), g as (select 'all' as dimension, 'all' as value, taken, p, y from r union all select 'segment', segment, taken, p, y from r union all select 'scenario', scenario, taken, p, y from r),
    w as (select * from (values ('all', 'all'), ('segment', 'de'), ('segment', 'en'), ('segment', 'es'), ('segment', 'fr'), ('scenario', 'short'), ('scenario', 'middle'), ('scenario', 'long'), ('scenario', 'empty')) v(dimension, value)),
    m as (select dimension, value, count(*) as n, count(case when taken then 1 end) as n_taken, count(case when taken and y = 1 then 1 end) as tp, cast(sum(y) as bigint) as n_positive, avg((p - y) * (p - y)) as br, avg(y) * (1 - avg(y)) as cb from g group by all)
    select w.dimension, w.value, coalesce(n, 0) as n, coalesce(n_taken, 0) as n_taken, coalesce(tp, 0) as tp, round(tp / nullif(n_positive, 0), 6) as recall, round(br, 6) as brier, case when n is null or n_positive = 0 or n_positive = n then 'not_evaluable' when br >= cb then 'failed' else 'passed' end as gate from w left join m on m.dimension = w.dimension and m.value = w.value""", "scores"))
def _(spark, d):
    from asoflow.operators.metrics import capacity_queue, final_report

    queue = capacity_queue(scores(spark, d), "p", "doc_id", 0.3).withColumn("scenario", F.when(F.col("p") < 0.2, "short").when(F.col("p") < 0.5, "middle").otherwise("long"))
    wanted = [("all", "all"), *[("segment", x) for x in ("de", "en", "es", "fr")], *[("scenario", x) for x in ("short", "middle", "long", "empty")]]
    return final_report(queue, ["segment", "scenario"], wanted)


@query("ml15_batch_scoring", sql("""with f as (select s.doc_id, s.p, s.y, d.n_chars, d.source, ln(d.n_chars) - 7.0 as a from scores s join documents d using (doc_id)) select md5('run-1|' || doc_id) as score_id, doc_id, case when p is null then 'insufficient_data' when n_chars < 200 then 'already_short' else 'scored' end as status, case when n_chars < 200 then null when p < 0.2 then 'low' when p < 0.5 then 'medium' when p < 0.8 then 'high' else 'critical' end as band,
    case when n_chars >= 200 then round(p, 4) end as probability, case when n_chars < 200 then null when a < 0 then 'length:down' else 'length:up' end as factor from f""", "scores"))
def _(spark, d):
    s = scores(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    short, p = F.col("n_chars") < 200, F.col("p")
    return s.select(
        F.md5(F.concat(F.lit("run-1|"), F.col("doc_id").cast("string")).cast("binary")).alias("score_id"), "doc_id", F.when(p.isNull(), "insufficient_data").when(short, "already_short").otherwise("scored").alias("status"),
        F.when(~short, C.risk_band(p)).alias("band"), F.when(~short, F.round(p, 4)).alias("probability"), F.when(~short, F.when(F.ln("n_chars") - 7.0 < 0, "length:down").otherwise("length:up")).alias("factor"),
    )


@query("ml08_threshold_decision", sql("""with r as (select a.product, a.location, a.channel, a.day, abs(a.units - b.units) as s from series_day a join series_day b on b.product = a.product and b.location = a.location and b.channel = a.channel and b.day = a.day - 7), t as (select product, min(s) as threshold from (select product, s, row_number() over (partition by product order by s) as k, count(*) over (partition by product) as n from r where year(day) < 2000) where k = n - floor(n * 0.01) group by 1)
    select r.product, r.location, r.channel, r.day, case when s > threshold * 1.2 then 'high' when s > threshold then 'medium' else 'none' end as severity from r join t on t.product = r.product where year(day) >= 2000""", "series_day"))
def _(spark, d):
    from asoflow.operators.metrics import capacity_threshold

    r = J.lagged(series_day(spark, d), SERIES, "day", "units", 7, "e").where("e is not null").withColumn("s", F.abs(F.col("units") - F.col("e")))
    t = capacity_threshold(r.where("year(day) < 2000"), ["product"], "s", 0.01)
    sev = F.when(F.col("s") > F.col("threshold") * 1.2, "high").when(F.col("s") > F.col("threshold"), "medium").otherwise("none")
    return r.where("year(day) >= 2000").join(t, "product").select(*KEY, sev.alias("severity"))


@query("ag19_observation_metrics", sql("""select segment, count(case when p > 0.6 and y = 0 then 1 end) as n_true, count(case when p > 0.6 then 1 end) as n_alerts, round(1000.0 * count(case when p > 0.6 and y = 1 then 1 end) / nullif(count(case when y = 1 then 1 end), 0), 6) as false_per_1000, case when count(case when y = 0 then 1 end) < 8 then 'not_evaluable' else 'evaluable' end as status from scores group by 1""", "scores"))
def _(spark, d):
    alert = F.col("p") > 0.6
    return scores(spark, d).groupBy("segment").agg(F.count_if(alert & (F.col("y") == 0)).alias("n_true"), F.count_if(alert).alias("n_alerts"), F.round(F.try_divide(1000.0 * F.count_if(alert & (F.col("y") == 1)), F.count_if(F.col("y") == 1)), 6).alias("false_per_1000"), F.when(F.count_if(F.col("y") == 0) < 8, "not_evaluable").otherwise("evaluable").alias("status"))


@query("ag20_episode_metrics", sql(f"""with {_WIN}, e as (select *, row_number() over (partition by product, location, channel order by start) as episode_id, case when "end" - start >= 3 then 'long' else 'short' end as type, known > (select last_day from span) as young from wa), a as (select e.product, e.location, e.channel, e.episode_id, e.type, e.young, e.start, e.known, min(s.day) as first_alert, count(s.day) as n_alerts from e left join (select * from series_day where units > 120) s on s.product = e.product and s.location = e.location and s.channel = e.channel and s.day between e.start and e."end" group by all)
    select product, type, count(*) as n_all, count(case when young then 1 end) as n_excluded, count(case when not young then 1 end) as n_episodes, count(case when not young then first_alert end) as n_detected, round(count(case when not young then first_alert end) / nullif(count(case when not young then 1 end), 0), 6) as recall, cast(sum(case when not young then greatest(n_alerts - 1, 0) end) as bigint) as n_repeats, round(avg(case when not young then first_alert - start end), 6) as mean_delay, round(avg(case when not young then known - first_alert end), 6) as mean_lead from a group by rollup(product, type)""", "series_day", "span"))
def _(spark, d):
    s = series_day(spark, d)
    e = P.islands(s.where("units > 50").withColumn("known", F.date_add("day", 1)), SERIES, "day", "known").select(*SERIES, "start", "end", "known")
    e = e.withColumns({"type": F.when(F.datediff("end", "start") >= 3, "long").otherwise("short"), "young": F.col("known") > F.lit(span(spark, d).first()["last_day"])})
    return J.episode_metrics(e, s.where("units > 120"), SERIES, ["product", "type"])


@query("ag21_combine_cases", sql("""with c as (select coalesce(segment, 'none') as scenario, doc_id % 3 as seed, count(*) as n, count(case when y = 1 then 1 end) as n_positive, count(case when y = 0 then 1 end) as n_negative, count(case when p >= 0.5 and y = 1 then 1 end) as tp, count(case when p >= 0.5 then 1 end) as n_alerts from scores group by all), r as (select scenario, count(*) as n_cases, cast(sum(n) as bigint) as n, cast(sum(n_positive) as bigint) as n_positive, cast(sum(n_negative) as bigint) as n_negative, cast(sum(tp) as bigint) as tp, cast(sum(n_alerts) as bigint) as n_alerts from c group by rollup(scenario))
    select coalesce(scenario, 'all') as scenario, n_cases, n, n_positive, tp, n_alerts, round(tp / nullif(n_positive, 0), 6) as recall, round(tp / nullif(n_alerts, 0), 6) as "precision", n_positive + n_negative = n and tp <= least(n_positive, n_alerts) as reconciled,
    concat_ws(',', case when n < 50 then 'few_rows' end, case when tp / nullif(n_positive, 0) < 0.5 then 'recall' end, case when tp / nullif(n_alerts, 0) < 0.6 then 'precision' end) as failed from r""", "scores"))
def _(spark, d):
    y, alert = F.col("y"), F.col("p") >= 0.5
    cases = scores(spark, d).groupBy(F.coalesce("segment", F.lit("none")).alias("scenario"), (F.col("doc_id") % 3).alias("seed")).agg(
        F.count("*").alias("n"), F.count_if(y == 1).alias("n_positive"), F.count_if(y == 0).alias("n_negative"), F.count_if(alert & (y == 1)).alias("tp"), F.count_if(alert).alias("n_alerts"),
    )
    r = cases.rollup("scenario").agg(F.count("*").alias("n_cases"), *[F.sum(c).alias(c) for c in ("n", "n_positive", "n_negative", "tp", "n_alerts")]).withColumn("scenario", F.coalesce("scenario", F.lit("all")))
    recall, precision = F.try_divide("tp", "n_positive"), F.try_divide("tp", "n_alerts")
    rules = C.all_reasons([(F.col("n") < 50, "few_rows"), (recall < 0.5, "recall"), (precision < 0.6, "precision")])
    same = (F.col("n_positive") + F.col("n_negative") == F.col("n")) & (F.col("tp") <= F.least("n_positive", "n_alerts"))
    return r.select("scenario", "n_cases", "n", "n_positive", "tp", "n_alerts", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), same.alias("reconciled"), F.concat_ws(",", rules).alias("failed"))


@query("ml14_composition", sql("""with r as (select * from (values ('plain', 1.0, 0.0), ('low', 0.9, 0.0), ('high', 1.1, 0.0), ('shifted', 1.0, -5.0)) v(recipe, factor, shift)), t as (select channel, h, recipe, avg(abs(y - (factor * p + shift))) as mae, avg((y - (factor * p + shift)) * (y - (factor * p + shift))) as mse from forecasts cross join r where y is not null and p is not null and target < date '2000-01-01' group by all),
    a as (select channel, h, min_by(recipe, (round(mae, 9), recipe)) as median_head, min_by(recipe, (round(mse, 9), recipe)) as mean_head from t group by all)
    select f.channel, f.h, median_head, mean_head, count(*) as n, round(avg(x.factor * p + x.shift), 4) as median_forecast, round(avg(z.factor * p + z.shift), 4) as mean_forecast from forecasts f join a on a.channel = f.channel and a.h = f.h join r x on x.recipe = median_head join r z on z.recipe = mean_head where p is not null and target >= date '2000-01-01' group by all""", "forecasts"))
def _(spark, d):
    """Each head takes the recipe that served it best before 2000; what comes later is composed from them."""
    recipes = spark.createDataFrame([("plain", 1.0, 0.0), ("low", 0.9, 0.0), ("high", 1.1, 0.0), ("shifted", 1.0, -5.0)], "recipe string, factor double, shift double")
    f = forecasts(spark, d).where("p is not null")
    trials = f.where("y is not null and target < date'2000-01-01'").crossJoin(F.broadcast(recipes)).withColumn("e", F.col("y") - (F.col("factor") * F.col("p") + F.col("shift")))  # four recipes
    t = trials.groupBy("channel", "h", "recipe").agg(F.round(F.avg(F.abs("e")), 9).alias("mae"), F.round(F.avg(F.col("e") * F.col("e")), 9).alias("mse"))
    heads = t.groupBy("channel", "h").agg(*[F.min_by("recipe", F.struct(m, "recipe")).alias(name) for name, m in (("median_head", "mae"), ("mean_head", "mse"))])
    later = f.where("target >= date'2000-01-01'").join(heads, ["channel", "h"])
    for name in ("median", "mean"):
        own = recipes.select(F.col("recipe").alias(f"{name}_head"), F.col("factor").alias(f"_f{name}"), F.col("shift").alias(f"_s{name}"))
        later = later.join(F.broadcast(own), f"{name}_head")
    forecast = {name: F.round(F.avg(F.col(f"_f{name}") * F.col("p") + F.col(f"_s{name}")), 4).alias(f"{name}_forecast") for name in ("median", "mean")}
    return later.groupBy("channel", "h", "median_head", "mean_head").agg(F.count("*").alias("n"), *forecast.values())

