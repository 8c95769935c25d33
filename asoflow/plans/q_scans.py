"""Queries on declared tables and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.functions import columns as C
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources import tables as S
from asoflow.sources.adapters import SERIES, capture, lines, plans, scores, series_day, table


@query("src01_read_table", "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > 45")
def _(spark, d):
    found = table(spark, d, "lineitem")
    spec = S.TableSpec("lineitem", found.schema, ("l_orderkey", "l_linenumber"))
    return S.read_table(spark, f"{d}/lineitem.parquet", spec).where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_quantity")


@query("src02_partition_days", """select cast(o_orderdate as date) as expected_day, count(*) as n_rows from lineitem join orders on l_orderkey = o_orderkey
    where cast(o_orderdate as date) <> cast(l_shipdate as date) group by 1""")
def _(spark, d):
    found = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bad = S.partition_day_violations(found.withColumn("part_day", F.to_date("l_shipdate").cast("string")), "o_orderdate", "part_day")
    return bad.groupBy(F.col("expected_day").cast("date").alias("expected_day")).agg(F.count("*").alias("n_rows"))


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
_LINE_CELLS = "concat_ws(chr(31), " + ", ".join(f"coalesce('=' || cast({c} as varchar), '~')" for c in sorted(_LINE)) + ")"
_CELLS = "concat_ws(chr(31), coalesce('=' || cast(n_name as varchar), '~'), coalesce('=' || cast(n_nationkey as varchar), '~'), coalesce('=' || cast(n_regionkey as varchar), '~'))"


@query("src03_content_digest", f"""select count(*) as n_rows, cast(sum(cast(('0x' || substr(h, 1, 12))::bigint as hugeint)) as varchar) as digest_a,
    cast(sum(cast(('0x' || substr(h, 13, 12))::bigint as hugeint)) as varchar) as digest_b from (select sha256({_LINE_CELLS}) as h from lineitem)""")
def _(spark, d):
    return S.content_digest(table(spark, d, "lineitem").select(*_LINE))


@query("src04_field_ranges", """select 'l_shipdate' as field, min(cast(l_shipdate as date)) as first_day, max(cast(l_shipdate as date)) as last_day, count(l_shipdate) as n_values from lineitem""")
def _(spark, d):
    return S.field_ranges(table(spark, d, "lineitem"), ["l_shipdate"])


@query("src05_check_grain", """select l_orderkey, l_linenumber, count(*) as n_rows, 'duplicate_key' as reason from lineitem group by all having count(*) > 1""")
def _(spark, d):
    return S.grain_violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("src06_check_nonnull", """select 'user_id' as field, count(*) filter (user_id is null) as n_missing from events union all select 'event_type', count(*) filter (event_type is null or event_type = '') from events
    union all select 'props', count(*) filter (props is null or props = '') from events""")
def _(spark, d):
    return S.null_violations(table(spark, d, "events"), ["user_id", "event_type", "props"])


@query("src12_result_events", sql("""select sha256(product || '|' || location || '|' || channel) as partition_key, sha256('forecast|' || product || '|' || location || '|' || channel || '|' || cast(origin as varchar) || '|' || h) as event_id,
    'forecast' as kind, cast(target as varchar) as target_day, p from forecasts where p is not null""", "forecasts"))
def _(spark, d):
    from asoflow.sources.adapters import forecasts

    return S_result_events(forecasts(spark, d).where("p is not null"), "forecast", SERIES, ["origin", "h"]).select("partition_key", "event_id", "kind", F.col("target").cast("string").alias("target_day"), "p")


def S_result_events(df, kind, key, version):
    from asoflow.sources.events import result_events

    return result_events(df, kind, key, version)


@query("src13_corpus_scan", """select sha256(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')) as content_id, case when length(text) < 100 then 'too_short' when source = 'src3' then 'excluded_source' end as reason, count(*) as n_documents, min(doc_id) as first_id, count(distinct sha256(text)) as n_checksums from documents group by all""")
def _(spark, d):
    from asoflow.operators.text import corpus_scan

    return corpus_scan(table(spark, d, "documents"), "doc_id", "text", [(F.length("text") < 100, "too_short"), (F.col("source") == "src3", "excluded_source")])


@query("prj01_normalize", "select c_custkey, lower(trim(c_mktsegment)) as segment, upper(trim(c_name)) as name from customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", C.normalized_code(C.nfc(F.col("c_mktsegment"))).alias("segment"), C.normalized_code(F.col("c_name"), upper=True).alias("name"))


@query("prj02_domain_rules", """select reason, count(*) as n_rows from (select case when l_shipdate < o_orderdate then 'shipped_before_ordered' when l_quantity <= 0 then 'quantity_sign'
    when l_discount > 0.09 then 'discount_range' when l_returnflag not in ('A', 'N', 'R') then 'unknown_flag' end as reason from lineitem join orders on l_orderkey = o_orderkey) group by reason""")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    reason = C.first_reason([
        (F.col("l_shipdate") < F.col("o_orderdate"), "shipped_before_ordered"), (F.col("l_quantity") <= 0, "quantity_sign"),
        (F.col("l_discount") > 0.09, "discount_range"), (~F.col("l_returnflag").isin("A", "N", "R"), "unknown_flag"),
    ])
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_rows"))


@query("prj03_canonical_cell", """select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') as ordered, rtrim(rtrim(cast(cast(o_totalprice as decimal(18,4)) as varchar), '0'), '.') as total from orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.canonical_cell(F.col("o_orderdate"), "timestamp").alias("ordered"), S.canonical_cell(F.col("o_totalprice").cast("decimal(18,4)"), "decimal(18,4)").alias("total"))


@query("prj04_record_sha", f"select n_nationkey, sha256({_CELLS}) as record_sha256, '[' || n_nationkey || ']' as grain from nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.sha2(S.record_text(n), 256).alias("record_sha256"), F.to_json(F.array("n_nationkey")).alias("grain"))


@query("prj05_business_day", "select event_id, coalesce(case when event_type = 'click' then null else cast(ts as date) end, cast(ts as date) + 1) as day from events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("own", F.when(F.col("event_type") != "click", F.col("ts")))
    return e.select("event_id", F.coalesce(F.to_date("own"), F.date_add(F.to_date("ts"), 1)).alias("day"))


_TASK_ROWS = 1_000_000


@query("prj06_available_at", """select l_orderkey, l_linenumber, max(greatest(l_shipdate, o_orderdate)) as available_at from lineitem join orders on l_orderkey = o_orderkey group by all""")
def _(spark, d):
    """Lines are dealt by order over as many tasks as hold _TASK_ROWS each, so that no task's groups grow with the table."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // _TASK_ROWS))
    rows = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.greatest("l_shipdate", "o_orderdate")).alias("available_at"))


@query("prj07_calendar", """select distinct cast(o_orderdate as date) as day, cast(isodow(o_orderdate) - 1 as bigint) as weekday, cast(week(o_orderdate) as bigint) as iso_week, cast(month(o_orderdate) as bigint) as month, cast(quarter(o_orderdate) as bigint) as quarter, isodow(o_orderdate) >= 6 as is_weekend from orders""")
def _(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.withColumns(C.calendar(F.col("day")))


@query("prj08_minor_units", """select count(*) as n_rows, count(case when x = floor(x) then 1 end) as n_exact, cast(sum(case when x = floor(x) then cast(x as bigint) end) as bigint) as cents
    from (select cast(o_totalprice as decimal(30,8)) * 100 as x from orders)""")
def _(spark, d):
    cents = C.minor_units(F.col("o_totalprice"))
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count(cents).alias("n_exact"), F.sum(cents).alias("cents"))


@query("prj09_bins", sql("""select case when m is null then 'unknown' when m = 0 then 'zero' when m < 50 then 'low' when m < 150 then 'medium' else 'high' end as bin, count(*) as n_series from
    (select product, location, channel, avg(units) as m from series_day group by all) group by 1""", "series_day"))
def _(spark, d):
    means = series_day(spark, d).groupBy(*SERIES).agg(F.avg("units").alias("m"))
    return means.groupBy(C.volume_bin(F.col("m")).alias("bin")).agg(F.count("*").alias("n_series"))


@query("prj10_strict_json", """select case when k is null then 'missing_k' when k % 7 = 0 then 'out_of_contract' else 'accepted' end as reason, count(*) as n_rows from (select try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1""")
def _(spark, d):
    from asoflow.sources.events import decode_json

    e = decode_json(table(spark, d, "events"), "props", "k long")
    reason = F.coalesce("problem", F.when(F.col("body.k").isNull(), "missing_k").when(F.col("body.k") % 7 == 0, "out_of_contract").otherwise("accepted"))
    return e.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_rows"))


@query("prj11_uuid5", """with h as (select event_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_id::varchar)) as h from events)
    select event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::integer % 4 + 1] || h[18:20] || '-' || h[21:32] as uuid from h""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", C.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.col("event_id").cast("string")).alias("uuid"))


@query("prj12_interval_score", sql("""select segment, count(*) as n, round(avg(0.4 + 2.0 / (1.0 - 0.9) * (greatest(p - 0.2 - y, 0) + greatest(y - (p + 0.2), 0))), 6) as score from scores group by 1""", "scores"))
def _(spark, d):
    s = C.interval_score(F.col("y").cast("double"), F.col("p") - 0.2, F.col("p") + 0.2, 0.9)
    return scores(spark, d).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("score"))


@query("prj13_band", sql("""select doc_id, round(case when y = 1 then greatest(0.0, p - 0.25) end, 6) as low, round(case when y = 1 then p + 0.25 end, 6) as high from scores""", "scores"))
def _(spark, d):
    low, high = C.band(F.col("p"), F.when(F.col("y") == 1, 0.25))
    return scores(spark, d).select("doc_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("prj14_sigmoid", "select c_custkey, round(case when c_acctbal / 1000 >= 0 then 1 / (1 + exp(-c_acctbal / 1000)) else exp(c_acctbal / 1000) / (1 + exp(c_acctbal / 1000)) end, 6) as p from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(C.stable_sigmoid(F.col("c_acctbal") / 1000), 6).alias("p"))


@query("prj15_forest_score", """select p_partkey, round(pow(2.0, -(p_size / 5.0 + (case when n > 2 then 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1.0) / n when n = 2 then 1.0 else 0.0 end)) / (2 * (ln(255) + 0.5772156649015329) - 2 * 255.0 / 256)), 6) as score
    from (select p_partkey, p_size, p_partkey % 4 + 1 as n from part)""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(C.forest_score(F.col("p_size") / 5, F.col("p_partkey") % 4 + 1, 256), 6).alias("score"))


@query("prj16_freshness", """select o_orderkey, case when reason is null then 'current' when reason like '%missing' then 'unknown' else 'stale' end as status, reason from (select o_orderkey, case when o_orderstatus = 'P' then 'newer_unpublished'
    when date '2001-01-01' - o > 900 then 'too_old' when s is null then 'watermark_missing' when o - s > 20 then 'watermark_lag' when m is null then 'observation_missing' when o - m > 20 then 'observation_lag' end as reason
    from (select o_orderkey, o_orderstatus, cast(o_orderdate as date) as o, cast(max(l_shipdate) as date) as s, cast(min(l_shipdate) as date) as m from orders left join lineitem on l_orderkey = o_orderkey group by all))""")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("o")).agg(F.to_date(F.max("l_shipdate")).alias("s"), F.to_date(F.min("l_shipdate")).alias("m"))
    f = C.freshness(F.lit("2001-01-01").cast("date"), F.col("o"), F.col("s"), F.col("m"), F.col("o_orderstatus") == "P", 900, 20)
    return o.select("o_orderkey", f.alias("f")).select("o_orderkey", "f.*")


@query("prj17_factors", """select p_partkey, (case when p_size > 40 then 1 else 0 end) + (case when p_retailprice > 1500 then 1 else 0 end) + 1 as n_factors, case when p_size > 40 then 'large' when p_retailprice > 1500 then 'dear' else 'type' end as first_code from part""")
def _(spark, d):
    f = C.factors(large=F.when(F.col("p_size") > 40, F.col("p_size")), dear=F.when(F.col("p_retailprice") > 1500, F.col("p_retailprice")), type=F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.size(f).alias("n_factors"), f[0]["code"].alias("first_code"))


@query("prj18_impute_encode", """select p_partkey, coalesce(case when p_size % 3 <> 0 then p_size end, 25) as size, case when p_size % 3 = 0 then 1 else 0 end as size__missing,
    case when p_brand = 'Brand#11' then 1 else 0 end as brand_b11, case when p_brand <> 'Brand#11' then 1 else 0 end as brand__unknown from part""")
def _(spark, d):
    p = table(spark, d, "part")
    hot = C.one_hot(F.col("p_brand"), ["Brand#11"], "brand")
    cols = C.impute_encode(F.when(F.col("p_size") % 3 != 0, F.col("p_size")), F.lit(25), "size")
    return p.select("p_partkey", *[v.alias(k) for k, v in cols.items()], hot["brand_Brand#11"].alias("brand_b11"), hot["brand__unknown"].alias("brand__unknown"))


@query("prj19_unit_norm", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 6) as norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) - 1) < 1e-4 as is_unit from embeddings")
def _(spark, d):
    n = C.norm(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(n, 6).alias("norm"), (F.abs(n - 1) < 1e-4).alias("is_unit"))


@query("prj20_scope_filter", sql("select product, location, channel, day, units from series_day where location in ('ASIA', 'EUROPE') and channel = 'R' and day between date '1998-01-01' and date '1998-06-30'", "series_day"))
def _(spark, d):
    return series_day(spark, d).where("location in ('ASIA', 'EUROPE') and channel = 'R' and day between date'1998-01-01' and date'1998-06-30'")
