"""Queries on as-of reads and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.operators import joins as J
from asoflow.operators import versions as V
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import SERIES, demand_versions, ledger, lines, plans, returns, routes, series_day, table

KEY = [*SERIES, "day"]
_LATEST = """select product, location, channel, day, version, units, n > 1 as ambiguous from (select *, count(*) over (partition by product, location, channel, day, version) as n,
    max(version) over (partition by product, location, channel, day) as top from demand_versions {where}) where version = top"""


@query("jn05_asof_read", sql(_LATEST.format(where="where available <= date '1998-06-30'"), "demand_versions"))
def _(spark, d):
    return V.asof_read(demand_versions(spark, d), F.lit("1998-06-30").cast("date"), KEY).drop("available")


@query("wn01_latest_version", sql(_LATEST.format(where=""), "demand_versions"))
def _(spark, d):
    return V.latest_version(demand_versions(spark, d), KEY).drop("available")


@query("jn06_asof_multi", sql("""select origin, count(*) as n_rows, sum(units) as units, count(case when version = 2 then 1 end) as n_corrected from (
    select origin, version, units, row_number() over (partition by origin, product, location, channel, day order by version desc) as r from demand_versions
    join (select date '1998-01-31' + cast(i * 30 as integer) as origin from (select unnest(range(0, 12)) as i)) on available <= origin) where r = 1 group by 1""", "demand_versions"))
def _(spark, d):
    origins = spark.range(12).select(F.date_add(F.lit("1998-01-31").cast("date"), (F.col("id") * 30).cast("int")).alias("origin"))
    seen = V.asof_multi(demand_versions(spark, d), F.broadcast(origins), KEY)  # 12 origins
    return seen.groupBy("origin").agg(F.count("*").alias("n_rows"), F.sum("units").alias("units"), F.count_if(F.expr("version = 2")).alias("n_corrected"))


@query("jn01_require_reference", """select o_orderkey, case when c_custkey is null then 'customer_missing' end as reason from orders left join (select c_custkey from customer where c_custkey % 10 <> 0) on o_custkey = c_custkey""")
def _(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 10 <> 0")
    return J.require_reference(table(spark, d, "orders"), known, "o_custkey", "c_custkey", "customer_missing").select("o_orderkey", "reason")


_PARTS = "select l_orderkey, l_linenumber, l_partkey as part, day, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as copy, location, channel from lines"


def _part_lines(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return lines(spark, d).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), "day", F.row_number().over(order).alias("copy"), "location", "channel")


@query("jn02_effective_mapping", sql(f"""with f as ({_PARTS}), j as (select f.*, version, price_cents from f left join plans p on p.part = f.part and p.scope = 'global' and from_day <= day and day < to_day and known <= day),
    r as (select *, rank() over (partition by l_orderkey, l_linenumber, copy order by version desc nulls last) as rk from j)
    select l_orderkey, l_linenumber, copy, price_cents, case when version is null then 'missing' when count(*) over (partition by l_orderkey, l_linenumber, copy) > 1 then 'ambiguous' else 'mapped' end as status from r where rk = 1""", "plans", "lines"))
def _(spark, d):
    m = V.effective_mapping(_part_lines(spark, d), plans(spark, d).where("scope = 'global'").drop("scope", "location", "channel"), ["part"], "day", F.col("day"), ["l_orderkey", "l_linenumber", "copy"])
    return m.select("l_orderkey", "l_linenumber", "copy", F.col("_p_price_cents").alias("price_cents"), "status")


@query("jn07_plan_match", sql(f"""with f as ({_PARTS}), j as (select f.*, scope, version, price_cents, rank() over (partition by l_orderkey, l_linenumber, copy order by case scope when 'global' then 0 when 'channel' then 1 when 'location' then 2 else 3 end desc, version desc) as rk
    from f join plans p on p.part = f.part and from_day <= day and day < to_day and known <= day - 5 and (p.location is null or p.location = f.location) and (p.channel = 'all' or p.channel = f.channel))
    select l_orderkey, l_linenumber, copy, scope, version, price_cents, count(*) over (partition by l_orderkey, l_linenumber, copy) > 1 as ambiguous from j where rk = 1""", "plans", "lines"))
def _(spark, d):
    m = J.plan_match(_part_lines(spark, d), plans(spark, d), "part", "day", F.date_sub("day", 5), ["l_orderkey", "l_linenumber", "copy"])
    return m.select("l_orderkey", "l_linenumber", "copy", "scope", "version", "price_cents", "ambiguous")


@query("jn03_legacy_assignment", """select s_nationkey as store, count(distinct n_regionkey) as n_locations, case when count(distinct n_regionkey) = 1 then min(n_regionkey) end as location from supplier join nation on s_nationkey % 7 = n_nationkey % 7 group by 1""")
def _(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    one = F.countDistinct("n_regionkey")
    return s.join(n, F.col("s_nationkey") % 7 == F.col("n_nationkey") % 7).groupBy(F.col("s_nationkey").alias("store")).agg(one.alias("n_locations"), F.when(one == 1, F.min("n_regionkey")).alias("location"))


@query("jn04_single_reference", """select reason, count(*) as n_rows from (select case when n is null then 'line_missing' when n > 1 then 'line_repeated' when k is distinct from o_custkey then 'line_differs' end as reason from orders
    left join (select l_orderkey, count(*) as n, min(l_partkey) as k from lineitem group by 1) on l_orderkey = o_orderkey) group by 1""")
def _(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"))
    return J.single_match(table(spark, d, "orders"), refs, ["o_orderkey"], ["o_custkey"], "line").groupBy("reason").agg(F.count("*").alias("n_rows"))


@query("jn08_active_pairs", sql("""select distinct s.product, r.stock from series_day s join routes r on r.location = s.location and from_day <= s.day and s.day < to_day and known <= s.day where s.day = date '1998-03-02'""", "series_day", "routes"))
def _(spark, d):
    r = routes(spark, d).withColumnRenamed("location", "_l")
    s = series_day(spark, d).where("day = date'1998-03-02'")
    return s.join(r, (F.col("location") == F.col("_l")) & (F.col("from_day") <= F.col("day")) & (F.col("day") < F.col("to_day")) & (F.col("known") <= F.col("day"))).select("product", "stock").distinct()


@query("jn09_active_series", sql("""select distinct product, location, channel from series_day s where day = date '1998-03-02' and exists (select 1 from region where r_name = location and r_regionkey <> 2)
    and exists (select 1 from part where p_type = product and p_size > 45)""", "series_day"))
def _(spark, d):
    s = series_day(spark, d).where("day = date'1998-03-02'").select(*SERIES).distinct()
    s = s.join(table(spark, d, "region").where("r_regionkey <> 2"), F.col("r_name") == F.col("location"), "left_semi")
    return s.join(table(spark, d, "part").where("p_size > 45"), F.col("p_type") == F.col("product"), "left_semi")


@query("jn10_seasonal_lag", sql("select a.product, a.location, a.channel, a.day, a.units, b.units as lag7 from series_day a left join series_day b on b.product = a.product and b.location = a.location and b.channel = a.channel and b.day = a.day - 7", "series_day"))
def _(spark, d):
    return J.lagged(series_day(spark, d), SERIES, "day", "units", 7, "lag7")


@query("jn11_label_join", sql("""with m as (select distinct product, location, channel, day, case when month(day) % 2 = 0 then day + 1 else day + 5 end as cutoff from series_day),
    k as (select m.*, max_by({'v': version, 'u': case when units > 400 then null else units end}, version) filter (available <= cutoff) as b from m left join demand_versions v using (product, location, channel, day) group by all)
    select product, location, channel, day, b.u as label, case when b is null then 'not_known' when b.u is null then 'incomplete' else 'labelled' end as label_status from k""", "series_day", "demand_versions"))
def _(spark, d):
    m = series_day(spark, d).select(*KEY).withColumn("cutoff", F.when(F.month("day") % 2 == 0, F.date_add("day", 1)).otherwise(F.date_add("day", 5)))
    v = demand_versions(spark, d).withColumn("units", F.when(F.col("units") <= 400, F.col("units")))
    return V.label_join(m, v, KEY, "cutoff").drop("cutoff")


@query("jn12_score_join", sql("select count(*) as n, count(y) as n_labelled, count(p) as n_predicted, count(case when y is null then 1 end) as n_orphans, round(avg(abs(y - p)), 6) as mae from forecasts", "forecasts"))
def _(spark, d):
    from asoflow.sources.adapters import forecasts

    return forecasts(spark, d).agg(F.count("*").alias("n"), F.count("y").alias("n_labelled"), F.count("p").alias("n_predicted"), F.count_if(F.expr("y is null")).alias("n_orphans"), F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("mae"))


@query("jn13_version_chain", sql("""select reason, count(*) as n_rows from (select case when version <> coalesce(lag(version) over w + 1, 1) then 'version_gap' when available < lag(available) over w then 'availability_regression' end as reason
    from demand_versions window w as (partition by product, location, channel, day order by version)) where reason is not null group by 1""", "demand_versions"))
def _(spark, d):
    return V.version_chain_violations(demand_versions(spark, d), KEY).groupBy("reason").agg(F.count("*").alias("n_rows"))


@query("jn14_orphans", "select l_orderkey, count(*) as n_lines from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority <> '1-URGENT') group by 1")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'")
    return J.orphans(table(spark, d, "lineitem"), o, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query("jn15_same_keys", """with k as (select coalesce(a.k, b.k) as k, coalesce(na, 0) as na, coalesce(nb, 0) as nb from (select l_orderkey as k, count(*) as na from lineitem group by 1) a full join (select o_orderkey as k, count(*) as nb from orders group by 1) b on a.k = b.k)
    select count(case when na > 0 then 1 end) as n_a, count(case when nb > 0 then 1 end) as n_b, count(case when nb = 0 then 1 end) as only_a, count(case when na = 0 then 1 end) as only_b, count(case when na > 1 or nb > 1 then 1 end) as repeated from k""")
def _(spark, d):
    a, b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return J.key_set_difference(a, b, ["k"])


@query("jn16_issue_match", sql("""with f as (select product, location, channel, day, units as delta from series_day), g as (select product, location, channel, day, count(*) as n, min(-delta) as d from (select * from ledger where sequence % 50 <> 0 union all select * from ledger where sequence % 70 = 0) where kind = 'sale' group by all)
    select reason, count(*) as n_rows from (select case when n is null then 'movement_missing' when n > 1 then 'movement_repeated' when d <> f.delta then 'movement_differs' end as reason from f left join g using (product, location, channel, day)) group by 1""", "series_day", "ledger"))
def _(spark, d):
    facts = series_day(spark, d).withColumnRenamed("units", "delta")
    moves = ledger(spark, d)  # some movements are missing, some come twice
    moves = moves.where("sequence % 50 <> 0").union(moves.where("sequence % 70 = 0")).where("kind = 'sale'").withColumn("delta", -F.col("delta"))
    return J.single_match(facts, moves, KEY, ["delta"], "movement").groupBy("reason").agg(F.count("*").alias("n_rows"))


_ROUTE = """select s.product, s.location, s.channel, s.day, stock from series_day s left join routes r on r.location = s.location and from_day <= s.day and s.day < to_day and known <= s.day"""


@query("jn17_historical_route", sql(_ROUTE, "series_day", "routes"))
def _(spark, d):
    s = series_day(spark, d)
    return V.effective_mapping(s, routes(spark, d), ["location"], "day", F.col("day"), KEY).select(*KEY, F.col("_p_stock").alias("stock"))


@query("jn28_origin_route", sql("""select o.origin, r.location, max_by(stock, from_day) as stock, count(*) > 1 as ambiguous from routes r join (select date '1998-02-01' + cast(i * 90 as integer) as origin from (select unnest(range(0, 8)) as i)) o on from_day <= origin and origin < to_day and known <= origin group by all""", "routes"))
def _(spark, d):
    o = spark.range(8).select(F.date_add(F.lit("1998-02-01").cast("date"), (F.col("id") * 90).cast("int")).alias("origin"))
    r = routes(spark, d).join(F.broadcast(o), (F.col("from_day") <= F.col("origin")) & (F.col("origin") < F.col("to_day")) & (F.col("known") <= F.col("origin")))
    return r.groupBy("origin", "location").agg(F.max_by("stock", "from_day").alias("stock"), (F.count("*") > 1).alias("ambiguous"))


@query("jn18_supply_chain", """with p as (select l_partkey, l_suppkey, sum(l_quantity) as received, count(*) as n, min(l_extendedprice / l_quantity) as unit from lineitem group by all)
    select reason, count(*) as n_rows from (select case when s_suppkey is null then 'supplier_missing' when received < 60 then 'below_minimum' when received > p_size * 10 then 'received_more_than_planned' when s_acctbal < 0 then 'supplier_blocked' end as reason from p left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey) group by 1""")
def _(spark, d):
    from asoflow.functions.columns import first_reason

    p = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("received"))
    j = p.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    reason = first_reason([(F.col("s_suppkey").isNull(), "supplier_missing"), (F.col("received") < 60, "below_minimum"), (F.col("received") > F.col("p_size") * 10, "received_more_than_planned"), (F.col("s_acctbal") < 0, "supplier_blocked")])
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_rows"))


@query("jn19_return_causality", sql("""with c as (select order_id, line, returned, sold, quantity, row_number() over (partition by order_id, line order by returned, price_cents, part, quantity, sold) as claim_id from returned),
    s as (select l_orderkey as order_id, cast(l_linenumber as bigint) as line, sum(l_quantity) as total, min(cast(l_shipdate as date)) as first from lineitem where l_linestatus = 'F' group by all)
    select reason, count(*) as n_rows from (select case when total is null then 'no_sale' when returned < first then 'before_sale' when returned - first > 15 then 'after_window' when sum(quantity) over (partition by order_id, line order by returned, claim_id rows unbounded preceding) > total then 'more_than_sold' end as reason
    from c left join s using (order_id, line)) group by 1""", "returned"))
def _(spark, d):
    from pyspark.sql import Window

    c = returns(spark, d)
    c = c.withColumn("claim_id", F.row_number().over(Window.partitionBy("order_id", "line").orderBy("returned", "price_cents", "part", "quantity", "sold"))).withColumnRenamed("quantity", "claimed").drop("sold")
    s = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("quantity"), F.to_date("l_shipdate").alias("sold"))
    return J.return_violations(c, s, ["order_id", "line"], 15).groupBy("reason").agg(F.count("*").alias("n_rows"))


@query("jn25_denylist", "select doc_id from documents where source not in ('src1', 'src2')")
def _(spark, d):
    return J.orphans(table(spark, d, "documents"), spark.createDataFrame([("src1",), ("src2",)], "s string"), "source", "s").select("doc_id")


@query("jn30_ambiguous_keys", """select o_custkey as customer from (select o_custkey, max(month(o_orderdate)) as top, list(month(o_orderdate)) as months from orders where o_orderdate <= timestamp '1996-06-30' group by 1) where len(list_filter(months, lambda x: x = top)) > 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.month("o_orderdate").alias("version"), F.col("o_orderdate").alias("available"))
    return V.ambiguous_keys(o, F.lit("1996-06-30").cast("timestamp"), ["customer"])


@query("st01_multiset_difference", """select a.l_orderkey, a.l_linenumber, coalesce(a.n, 0) - coalesce(b.n, 0) as balance from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all) a left join (select l_orderkey, l_linenumber, count(*) as n from lineitem where l_returnflag <> 'A' group by all) b using (l_orderkey, l_linenumber) where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(spark, d):
    lines_ = table(spark, d, "lineitem")
    return J.multiset_difference(lines_, lines_.where("l_returnflag <> 'A'"), ["l_orderkey", "l_linenumber"])


@query("st05_recompute_equals", sql("""select a.location, count(*) as n_rows, count(case when a.units is distinct from b.units or a.version is distinct from b.version then 1 end) as n_different from (select product, location, channel, day, sum(l_quantity) as units, case when count(case when l_linestatus = 'F' then 1 end) in (0, count(*)) or sum(case when l_linestatus = 'F' then l_quantity end) = sum(l_quantity) then 1 else 2 end as version from lines group by all) a
    full join (select product, location, channel, day, max_by(units, version) as units, count(*) as version from demand_versions group by all) b using (product, location, channel, day) group by 1""", "lines", "demand_versions"))
def _(spark, d):
    """Every series day recomputed from the lines, units and number of versions, against the latest version of all days."""
    status, q = F.col("l_linestatus") == "F", F.col("l_quantity")
    shipped = F.count_if(status)
    whole = (shipped == 0) | (shipped == F.count("*")) | (F.sum(F.when(status, q)) == F.sum(q))
    a = lines(spark, d).groupBy(*KEY).agg(F.sum("l_quantity").alias("units"), F.when(whole, 1).otherwise(2).cast("long").alias("version"))
    b = demand_versions(spark, d).groupBy(*KEY).agg(F.max_by("units", "version").alias("units"), F.count("*").alias("version"))
    off = J.multiset_difference(a, b, [*KEY, "units", "version"]).select(*KEY).distinct().groupBy("location").agg(F.count("*").alias("n_different"))
    return a.groupBy("location").agg(F.count("*").alias("n_rows")).join(off, "location", "left").fillna(0, ["n_different"])


@query("jn27_snapshot_plus_tail", sql("""with b as (select *, sum(delta) over (partition by product, location, channel order by sequence) as balance from ledger), s as (select product, location, channel, day, max_by(balance, sequence) as balance from b where day < date '1998-06-01' and day(day) = 1 group by all),
    l as (select product, location, channel, max_by(balance, day) as base, max(day) as base_day from s where day <= date '1998-06-15' group by all)
    select l.product, l.location, l.channel, base + coalesce((select sum(delta) from ledger g where g.product = l.product and g.location = l.location and g.channel = l.channel and g.day <= date '1998-06-15' and available <= date '1998-06-15' and (g.day > base_day or available > base_day)), 0.0) as on_hand from l""", "ledger"))
def _(spark, d):
    from asoflow.operators.ledger import running_balance

    moves = ledger(spark, d)
    snaps = running_balance(moves, SERIES, "sequence").where("day < date'1998-06-01' and day(day) = 1").groupBy(*KEY).agg(F.max_by("balance", "sequence").alias("balance"))
    return J.snapshot_plus_tail(snaps, moves, SERIES, F.lit("1998-06-15").cast("date"))
