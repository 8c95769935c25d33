"""The forecast frame over the whole tables, and how its calendar, catalog and promotions follow from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.functions.columns import movable_days
from asoflow.operators import features as X
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import SERIES, cell_versions, demand_cells, plans, span, table
from asoflow.sources.scratch import written


def _inputs(spark, d):
    """What forecast_frame takes. The cells of series and days are written, for seven of its inputs come from them, and the lines are many more; of the plans those of the products' parts are made."""
    cells = written(demand_cells(spark, d))
    s = cells.select(*SERIES, "day", F.col("u2").alias("units"))
    ends = written(span(spark, d))  # one row
    assortment = s.groupBy(*SERIES).agg(F.min("day").alias("from_day"), F.date_add(F.max("day"), 29).alias("to_day"))
    parts = table(spark, d, "part").groupBy(F.col("p_type").alias("product")).agg(F.max("p_partkey").alias("part"), F.max_by("p_brand", "p_partkey").alias("brand"))
    catalog = s.groupBy("product").agg(F.min("day").alias("launch")).join(parts, "product").withColumn("category_id", F.substring_index("product", " ", 1))
    days = ends.select(F.explode(F.sequence("first_day", F.date_add("last_day", 14))).alias("day"))
    region = table(spark, d, "region").select(F.col("r_name").alias("location"), F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("country_code"), F.upper(F.substring("r_name", 1, 2)).alias("calendar_jurisdiction"))
    base = days.crossJoin(F.broadcast(region)).withColumns(movable_days(F.col("day")))  # five regions
    year = F.make_date(F.year("day"), F.lit(1), F.lit(1))
    first = base.withColumns({"version": F.lit(1), "known": F.date_sub(year, 60), "location_open": (F.weekday("day") < 6) & ~F.col("is_public_holiday")})
    again = base.where("month(day) = 12 and dayofmonth(day) between 15 and 24").withColumns({"version": F.lit(2), "known": F.make_date(F.year("day"), F.lit(11), F.lit(15)), "location_open": F.dayofmonth("day") < 24})
    seasons = days.crossJoin(catalog.select("category_id").distinct()).withColumn("is_category_season", F.month("day") % 4 == F.length("category_id") % 4)  # the days of the data times six categories
    months = ends.select(F.explode(F.expr("sequence(trunc(first_day, 'month'), add_months(trunc(last_day, 'month'), 0), interval 1 month)")).alias("m"))
    pairs = catalog.select("product").crossJoin(F.broadcast(months)).withColumn("k", (F.length("product") + F.month("m")) % 3).where("k < 2")
    promo = pairs.select(F.concat_ws("|", "product", "m").alias("promotion_id"), "product", F.lit(None).cast("string").alias("location"), F.when(F.col("k") == 0, "all").otherwise("A").alias("channel"), F.col("m").alias("from_day"), F.date_add("m", 10).alias("to_day"), "k", "m")
    terms = {"version": F.lit(1), "known": F.date_sub("m", 20), "status": F.lit("active"), "priority": F.col("k") + 1, "promotion_type": F.when(F.col("k") == 0, "percent").otherwise("bundle"), "discount_basis_points": (F.month("m") * 100).cast("long"), "minimum_quantity": F.col("k") + 1}
    one = promo.withColumns(terms)
    off = one.where("month(m) = 7").withColumns({"version": F.lit(2), "known": F.date_sub("m", 3), "status": F.lit("cancelled")})
    wide = one.where("month(m) % 2 = 0").withColumns({"promotion_id": F.concat("promotion_id", F.lit("|x")), "channel": F.lit("all"), "priority": F.lit(5), "to_day": F.date_add("m", 4), "promotion_type": F.lit("flash")})
    origins = ends.select("last_day", F.explode(F.expr("sequence(trunc(first_day, 'month'), last_day, interval 1 month)")).alias("m")).select(F.last_day("m").alias("origin"), "last_day").where("origin <= date_sub(last_day, 14)").select("origin")
    targets = s.select(*SERIES).distinct().crossJoin(F.broadcast(origins)).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(14)))).withColumn("target", F.expr("date_add(origin, h)"))  # the months of the data
    held = written(plans(spark, d).join(F.broadcast(catalog.select("part")), "part", "left_semi"))  # a part for each product
    return targets, cell_versions(cells), assortment, catalog, first.unionByName(again), seasons, held, one.unionByName(off).unionByName(wide).drop("k", "m")


_TOTALS = {c: "sum" for c in (*X.HISTORY, "target_weekday", "target_week_of_year", "target_month", "target_quarter", "planned_regular_price_minor_units", "planned_promotion_discount_basis_points", "planned_promotion_minimum_quantity", "history_active_days", "history_known_days")}
_TOTALS |= {c: "true" for c in (*(f"target_{c}" for c in X.CALENDAR[4:]), "planned_promotion_offered", "insufficient_history", "target_calendar_eligible", "ambiguous_price", "ambiguous_promotion")}
_TOTALS |= {c: "least" for c in (*X.CATEGORICAL, "currency", "planned_promotion_type")}

_SQL_TOTALS = ", ".join(f"round(cast(sum({c}) as double), 4) as {c}" if k == "sum" else f"count(case when {c} then 1 end) as {c}" if k == "true" else f"min({c}) || ' ' || max({c}) || ' ' || count({c}) as {c}" for c, k in _TOTALS.items())
_HIST = ", ".join([*(f"max(units) filter (age = {k - 1}) as origin_lag_{k}_units" for k in X.LAGS), *(f"avg(units) filter (age < {w}) as rolling_mean_{w}, stddev_pop(units) filter (age < {w}) as rolling_std_{w}, count(units) filter (age < {w}) as rolling_count_{w}" for w in X.WINDOWS)])


@query("ds07_feature_frame", sql(f"""with s as (select distinct product, location, channel from series_day), asm as (select product, location, channel, min(day) as from_day, max(day) + 29 as to_day from series_day group by all),
    cat as (select product, launch, part, brand, split_part(product, ' ', 1) as category_id from (select product, min(day) as launch from series_day group by 1) join (select p_type as product, max(p_partkey) as part, max_by(p_brand, p_partkey) as brand from part group by 1) using (product)),
    mon as (select cast(unnest(generate_series(date_trunc('month', first_day)::timestamp, date_trunc('month', last_day)::timestamp, interval 1 month)) as date) as m, last_day as ld from span), org as (select last_day(m) as origin from mon where last_day(m) <= ld - 14),
    tg as (select s.*, origin, h, origin + h as target from s cross join org cross join (select unnest(range(1, 15))::integer as h)), rw as (select tg.*, part, brand, category_id from tg join asm using (product, location, channel) join cat using (product) where from_day <= target and target < to_day and launch <= target),
    hv as (select o.product, o.location, o.channel, o.origin, o.origin - v.day as age, max_by(v.units, v.version) as units from (select s.*, origin from s cross join org) o join demand_versions v on v.product = o.product and v.location = o.location and v.channel = o.channel and v.day > o.origin - 28 and v.day <= o.origin and v.available <= o.origin
        join asm on asm.product = o.product and asm.location = o.location and asm.channel = o.channel and asm.from_day <= v.day and v.day < asm.to_day group by all),
    hf as (select product, location, channel, origin, {_HIST} from hv group by all), ha as (select product, location, channel, origin, greatest(0, least(origin, to_day - 1) - greatest(origin - 27, from_day) + 1) as history_active_days from s join asm using (product, location, channel) cross join org),
    dys as (select cast(unnest(generate_series(first_day::timestamp, (last_day + 14)::timestamp, interval 1 day)) as date) as day from span),
    ys as (select y, y % 19 as a, y // 100 as b, y % 100 as c from (select distinct year(day) as y from dys)), y2 as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from ys), y3 as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from y2),
    y4 as (select y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 as n from y3), ea as (select y, make_date(y, n // 31, n % 31 + 1) as easter from y4),
    fl as (select day, day in (easter, easter + 1) as is_easter, month(day) = 12 and day(day) in (25, 26) as is_christmas, (month(day) = 1 and day(day) = 1) or (month(day) = 5 and day(day) = 1) or (month(day) = 12 and day(day) in (25, 26)) or day = easter + 1 as is_public_holiday,
        month(day) = 11 and isodow(day) = 5 and day(day) between 23 and 29 as is_black_friday, month(day - 3) = 11 and isodow(day - 3) = 5 and day(day - 3) between 23 and 29 as is_cyber_monday from dys join ea on y = year(day)),
    cv as (select fl.*, r_name as location, 'C' || r_regionkey as country_code, upper(substr(r_name, 1, 2)) as calendar_jurisdiction, 1 as version, make_date(year(day), 1, 1) - 60 as known, isodow(day) < 7 and not is_public_holiday as location_open from fl cross join region
        union all select fl.*, r_name, 'C' || r_regionkey, upper(substr(r_name, 1, 2)), 2, make_date(year(day), 11, 15), day(day) < 24 from fl cross join region where month(day) = 12 and day(day) between 15 and 24),
    ca as (select cv.*, o.origin from (select distinct origin, target from rw) o join cv on cv.day = o.target and cv.known <= o.origin qualify row_number() over (partition by o.origin, cv.day, cv.location order by version desc) = 1),
    pr0 as (select rw.product, rw.location, rw.channel, rw.origin, rw.target, price_cents, rank() over (partition by rw.product, rw.location, rw.channel, rw.origin, rw.target order by case scope when 'global' then 0 when 'channel' then 1 when 'location' then 2 else 3 end desc, version desc) as rk
        from rw join plans p on p.part = rw.part and p.from_day <= target and target < p.to_day and known <= origin and (p.location is null or p.location = rw.location) and (p.channel = 'all' or p.channel = rw.channel)),
    pr as (select product, location, channel, origin, target, min(price_cents) as planned_regular_price_minor_units, count(*) > 1 as ambiguous_price from pr0 where rk = 1 group by all),
    pm0 as (select product, m, (length(product) + month(m)) % 3 as k from cat cross join mon where (length(product) + month(m)) % 3 < 2),
    pm as (select product || '|' || m as pid, product, case when k = 0 then 'all' else 'A' end as pchannel, m as start, m + 10 as stop, 1 as version, m - 20 as known, 'active' as status, k + 1 as priority, case when k = 0 then 'percent' else 'bundle' end as ptype, month(m) * 100 as bp, k + 1 as mq from pm0
        union all select product || '|' || m, product, case when k = 0 then 'all' else 'A' end, m, m + 10, 2, m - 3, 'cancelled', k + 1, case when k = 0 then 'percent' else 'bundle' end, month(m) * 100, k + 1 from pm0 where month(m) = 7
        union all select product || '|' || m || '|x', product, 'all', m, m + 4, 1, m - 20, 'active', 5, 'flash', month(m) * 100, k + 1 from pm0 where month(m) % 2 = 0),
    pk as (select rw.product, rw.location, rw.channel, rw.origin, rw.target, pm.* exclude (product) from rw join pm on pm.product = rw.product and start <= target and target < stop and known <= origin and pchannel in ('all', rw.channel) qualify row_number() over (partition by rw.product, rw.location, rw.channel, rw.origin, rw.target, pid order by version desc) = 1),
    pb as (select *, count(*) over (partition by product, location, channel, origin, target, priority) as tied, row_number() over (partition by product, location, channel, origin, target order by priority desc, pid desc) as place from pk where status = 'active'),
    fr as (select rw.origin, rw.h, hf.* exclude (product, location, channel, origin, rolling_count_7, rolling_count_14, rolling_count_28), coalesce(rolling_count_7, 0) as rolling_count_7, coalesce(rolling_count_14, 0) as rolling_count_14, coalesce(rolling_count_28, 0) as rolling_count_28, isodow(rw.target) - 1 as target_weekday, week(rw.target) as target_week_of_year, month(rw.target) as target_month, quarter(rw.target) as target_quarter, isodow(rw.target) >= 6 as target_is_weekend,
        ca.is_public_holiday as target_is_public_holiday, ca.is_easter as target_is_easter, ca.is_christmas as target_is_christmas, ca.is_black_friday as target_is_black_friday, ca.is_cyber_monday as target_is_cyber_monday, ca.location_open as target_location_open, month(rw.target) % 4 = length(rw.category_id) % 4 as target_is_category_season,
        rw.category_id, rw.brand, ca.country_code, ca.calendar_jurisdiction, rw.channel, planned_regular_price_minor_units, case when planned_regular_price_minor_units is not null then 'EUR' end as currency, pb.ptype is not null as planned_promotion_offered, pb.ptype as planned_promotion_type, pb.bp as planned_promotion_discount_basis_points, pb.mq as planned_promotion_minimum_quantity,
        history_active_days, coalesce(rolling_count_28, 0) as history_known_days, history_active_days < 28 or coalesce(rolling_count_28, 0) < 7 as insufficient_history, coalesce(ca.location_open, false) as target_calendar_eligible, coalesce(ambiguous_price, false) as ambiguous_price, coalesce(pb.tied > 1, false) as ambiguous_promotion
        from rw join ha using (product, location, channel, origin) left join hf using (product, location, channel, origin) left join ca on ca.origin = rw.origin and ca.day = rw.target and ca.location = rw.location left join pr using (product, location, channel, origin, target)
        left join pb on pb.place = 1 and pb.product = rw.product and pb.location = rw.location and pb.channel = rw.channel and pb.origin = rw.origin and pb.target = rw.target)
    select origin, h, count(*) as n_rows, {_SQL_TOTALS} from fr group by all""", "series_day", "demand_versions", "span", "plans"))
def _(spark, d):
    """The whole frame from every month's end, 14 days ahead, and its columns' totals by origin and horizon: sums of numbers, how many flags are true, least and greatest text and how many there are."""
    frame = X.forecast_frame(*_inputs(spark, d))
    totals = [F.round(F.sum(c).cast("double"), 4).alias(c) if k == "sum" else F.count_if(c).alias(c) if k == "true" else F.concat(F.min(c), F.lit(" "), F.max(c), F.lit(" "), F.count(c).cast("string")).alias(c) for c, k in _TOTALS.items()]
    return frame.groupBy("origin", "h").agg(F.count("*").alias("n_rows"), *totals)
