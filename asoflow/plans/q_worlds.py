"""Paired worlds, the day gate with all its statuses, and the greedy budget as a grouped map."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.operators import text as T
from asoflow.operators.qualification import qualification_gate, unattributed
from asoflow.operators.worlds import world_differences
from asoflow.plans.q_replay import _COS, _DIVERSE, _found
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import lines, span, table

_COLUMNS = "product, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, day"


def _worlds_sql(name: str, key: str, columns: str, a: str, b: str) -> str:
    return f"""select '{name}' as "table", key, cast(coalesce(sum(greatest(d, 0)), 0) as bigint) as adds, cast(coalesce(sum(greatest(-d, 0)), 0) as bigint) as removes, min(case when d <> 0 then day end) as first_day from (select {key} as key, day, {columns}, sum(s) as d from (select {columns}, 1 as s from ({b}) union all select {columns}, -1 from ({a})) group by all) group by key"""


_LINES_A = f"select {_COLUMNS} from lines"
_LINES_B = f"""select product, l_orderkey, l_linenumber, case when l_partkey % 17 = 0 and day > date '1999-03-01' then l_quantity + 1 else l_quantity end as l_quantity, l_extendedprice, l_returnflag, day from lines where not (l_partkey % 13 = 0 and day >= date '1998-06-01') union all select {_COLUMNS} from lines where l_partkey % 19 = 0 and l_linenumber = 1"""
_EVENTS_A = "select event_id, event_type, user_id, value, cast(ts as date) as day from events"
_EVENTS_B = _EVENTS_A + " where not (event_type like '%e%' and event_id % 211 = 0)"


@query("st01_paired_worlds", sql(f"{_worlds_sql('lines', 'product', _COLUMNS, _LINES_A, _LINES_B)} union all {_worlds_sql('events', 'event_type', 'event_id, event_type, user_id, value, day', _EVENTS_A, _EVENTS_B)}".replace("key, day, product, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, day", "key, " + _COLUMNS).replace("key, day, event_id, event_type, user_id, value, day", "key, event_id, event_type, user_id, value, day"), "lines"))
def _(spark, d):
    """The lines and events beside a world in which some are gone, changed or there twice: adds, removes and the first differing day of every product and event type."""
    columns = [c.strip() for c in _COLUMNS.split(",")]
    base = lines(spark, d)
    later = F.col("day") >= F.lit("1998-06-01").cast("date")
    changed = base.where(~((F.col("l_partkey") % 13 == 0) & later)).withColumn("l_quantity", F.when((F.col("l_partkey") % 17 == 0) & (F.col("day") > F.lit("1999-03-01").cast("date")), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    twice = base.where("l_partkey % 19 = 0 and l_linenumber = 1")
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.to_date("ts").alias("day"))
    a = {"lines": base.select(*columns), "events": events}
    b = {"lines": changed.select(*columns).union(twice.select(*columns)), "events": events.where("not (event_type like '%e%' and event_id % 211 = 0)")}
    return world_differences(a, b, {"lines": ("product", "day"), "events": ("event_type", "day")})


@query("ds18_qualified_days", sql("""with g as (select distinct p_type as product, cast(l_shipdate as date) as day from lineitem join part on p_partkey = l_partkey), asf as (select cast(unnest([first_day + 400, first_day + 1200, last_day - 200, last_day + 30]) as date) as as_of from span),
    dc as (select product, day, day + case when day(day) % 5 = 0 then 900 else 2 end as known, day(day) % 11 <> 3 as source_complete, case when isodow(day) = 7 then 'closed' else 'open' end as activity from g where (length(product) + day(day)) % 9 <> 0),
    rq as (select product, cast(l_shipdate as date) as day, 'sale' as kind, l_orderkey || '-' || l_linenumber as fact_id, true as own, l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, cast(l_shipdate as date) + cast(l_linenumber * 20 as integer) as available from lineitem join (select p_partkey, p_type as product from part) on p_partkey = l_partkey),
    fc as (select kind, fact_id, max(available) as available, max(l_quantity) as quantity, max(cast(l_extendedprice as decimal(18, 2))) as amount, bool_or(l_returnflag = 'R') as rejected from rq where l_orderkey % 97 <> 0 group by 1, 2), lo as (select min(day) as loose from rq where l_orderkey % 1009 = 5 and l_orderkey % 2 = 1),
    rr as (select distinct product, day, kind, fact_id, own from rq), kn as (select g.*, as_of, known, source_complete, activity, loose from g cross join asf left join dc using (product, day) cross join lo),
    sm as (select k.product, k.day, k.as_of, count(case when available is null or available > as_of then 1 end) as n_missing, min(case when available is null or available > as_of then kind || ':' || fact_id end) as first_missing, coalesce(sum(case when available <= as_of and not rejected then quantity end), 0) as u, coalesce(sum(case when available <= as_of then amount end), 0) as am, coalesce(sum(case when available <= as_of and rejected then quantity end), 0) as rj
        from kn k join rr using (product, day) left join fc using (kind, fact_id) group by all),
    st as (select *, case when known is null then 'no_declaration' when known > as_of then 'closure_unavailable' when not source_complete then 'source_incomplete' when activity = 'closed' then 'location_closed' when loose <= as_of and as_of > date '1998-12-31' and false then '' when loose <= as_of then 'dq_unattributed_quarantine' when n_missing > 0 then 'dq_missing_facts' else 'qualified' end as status from kn left join sm using (product, day, as_of))
    select as_of, status, count(*) as n_points, cast(sum(case when status = 'dq_missing_facts' then n_missing else 0 end) as bigint) as n_missing, min(case when status = 'dq_missing_facts' then first_missing end) as first_missing, round(cast(sum(case when status = 'qualified' then u end) as double), 2) as observed_units, round(cast(sum(case when status = 'qualified' then am end) as double), 2) as amount, round(cast(sum(case when status = 'qualified' then rj end) as double), 2) as rejected_units from st group by all""".replace(" when loose <= as_of and as_of > date '1998-12-31' and false then ''", ""), "span"))
def _(spark, d):
    """Every product's days at four moments, by status: some undeclared, closed late, incomplete or closed; lines as facts that arrive days later, a few never; and quarantined lines whose event belongs to another line."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("product"))
    rows = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("day", F.to_date("l_shipdate"))
    rows = rows.withColumns({"kind": F.lit("sale"), "fact_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "available": F.date_add("day", (F.col("l_linenumber") * 20).cast("int"))})
    grain = ["product", "day"]
    g = rows.select(*grain).distinct()
    moments = span(spark, d).select(F.explode(F.array(F.date_add("first_day", 400), F.date_add("first_day", 1200), F.date_sub("last_day", 200), F.date_add("last_day", 30))).alias("as_of"))
    dom = F.dayofmonth("day")
    days = g.where((F.length("product") + dom) % 9 != 0).select(*grain, F.date_add("day", F.when(dom % 5 == 0, 900).otherwise(2)).alias("known"), (dom % 11 != 3).alias("source_complete"), F.when(F.weekday("day") == 6, "closed").otherwise("open").alias("activity"))
    required = rows.select(*grain, "kind", "fact_id", F.lit(True).alias("own")).distinct()
    facts = rows.where("l_orderkey % 97 <> 0").groupBy("kind", "fact_id").agg(F.max("available").alias("available"), F.max("l_quantity").alias("quantity"), F.max(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"), F.bool_or(F.col("l_returnflag") == "R").alias("rejected"))
    parent = rows.select(F.concat(F.lit("e"), "fact_id").alias("event_id"), "fact_id")
    bad = rows.where("l_orderkey % 1009 = 5").select(F.when(F.col("l_orderkey") % 2 == 1, F.lit("e1-1")).otherwise(F.concat(F.lit("e"), "fact_id")).alias("event_id"), F.when(F.col("l_orderkey") % 2 == 1, F.concat(F.lit("x"), "fact_id")).otherwise(F.col("fact_id")).alias("fact_id"), F.col("day").alias("received"))
    points = qualification_gate(g.crossJoin(F.broadcast(moments)), days, required, facts, unattributed(bad, parent), grain)  # four moments
    total = {c: F.round(F.sum(c).cast("double"), 2).alias(c) for c in ("observed_units", "amount", "rejected_units")}
    return points.groupBy("as_of", "status").agg(F.count("*").alias("n_points"), F.sum("n_missing").alias("n_missing"), F.min("first_missing").alias("first_missing"), *total.values())


@query("ud03_grouped_map", f"with recursive {_COS}, {_DIVERSE}")
def _(spark, d):
    """tx09's selection as a grouped map: a query's hits, at most twelve, are one group."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("repository"))
    h = _found(spark, d, 12).join(labels, "id").withColumn("size", 100 + F.col("id") % 7 * 60)
    return T.greedy_budget(h, 0.0, 1000, "size", 5, 2)


@query("tx08_scoped_search", """with v as (select vec_id as id, vec_id % 7 as document, list_transform(embedding, lambda x: cast(x as double)) as v, case when vec_id % 3 > 0 then 's' || (vec_id % 4) end as scope, case when vec_id % 11 = 0 then 'retired' else 'active' end as status, date '2024-01-01' + cast(vec_id % 50 as integer) as from_day, case when vec_id % 5 = 0 then date '2024-02-01' end as to_day from embeddings),
    q as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v, 's' || (vec_id // 50 % 4) as scope, date '2024-01-20' + cast(vec_id // 50 % 30 as integer) as day from embeddings where vec_id % 50 = 0),
    c as (select q.id as query_id, v.id, v.document, round(list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v))), 6) as score from v join q on v.id <> q.id and v.status = 'active' and (v.scope is null or v.scope = q.scope) and v.from_day <= q.day and (v.to_day is null or q.day < v.to_day)),
    k as (select *, row_number() over (partition by query_id, document order by score desc, id) as d from c), r as (select query_id, id, document, score, row_number() over (partition by query_id order by score desc, id) as rank from k where d <= 2) select query_id, id, document, score, rank from r where rank <= 10""")
def _(spark, d):
    """tx08 with what a query may see: its scope's and public chunks that are active and in force on its day, filtered before they are ranked."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    scope = F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 4).cast("string")))
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int"))
    chunks = e.select("id", (F.col("id") % 7).alias("document"), "v", scope.alias("scope"), F.when(F.col("id") % 11 == 0, "retired").otherwise("active").alias("status"), start.alias("from_day"), F.when(F.col("id") % 5 == 0, F.lit("2024-02-01").cast("date")).alias("to_day"))
    turn = F.expr("id div 50")
    queries = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v", F.concat(F.lit("s"), (turn % 4).cast("string")).alias("scope"), F.date_add(F.lit("2024-01-20").cast("date"), (turn % 30).cast("int")).alias("day"))
    return T.cosine_search(chunks, queries, 10, 2, scoped=True)


@query("tx11_index_checksums", """with d as (select doc_id as id, sha256(coalesce(text, '')) as now from documents), v as (select id, case when id % 13 = 0 then sha256(now) else now end as was from d where id % 17 <> 3)
    select id, 'checksum' as reason from d join v using (id) where now <> was union all select id, 'no_vector' from d where id % 17 = 3 union all select id, 'dimension' from v where id % 29 = 1""")
def _(spark, d):
    """An index of all documents in which some have changed since, some have no vector and some one of the wrong length."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = docs.select("id", F.sha2("text", 256).alias("checksum"))
    vector = T.hash_embedding(F.col("text"))
    vectors = docs.where("id % 17 <> 3").select("id", F.when(F.col("id") % 29 == 1, F.slice(vector, 1, 7)).otherwise(vector).alias("v"), F.when(F.col("id") % 13 == 0, F.sha2(F.sha2("text", 256), 256)).otherwise(F.sha2("text", 256)).alias("checksum"))
    return T.index_violations(chunks, vectors, 8)


@query("jn03_legacy_stores", sql("""with f as (select distinct n_nationkey as store, l_returnflag as channel, cast(l_shipdate as date) as day from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey), y as (select cast(unnest(range(year(first_day), year(last_day) + 1)) as integer) as y from span),
    b as (select n_nationkey as store, unnest(['A', 'N', 'R']) as channel, y, n_nationkey, n_regionkey from nation cross join y), a as (select store, channel, 'L' || n_regionkey as location, make_date(y, 1, 1) as from_day, make_date(y + 1, 1, 1) as to_day, make_date(y, 1, 1) + case when y % 3 = 0 then 40 else -20 end as known from b where (n_nationkey + y) % 7 <> 0
        union all select store, channel, 'L' || ((n_regionkey + 1) % 5), make_date(y, 7, 1), make_date(y, 9, 1), make_date(y, 6, 1) from b where (n_nationkey + y) % 6 = 0 and channel <> 'N' union all select store, channel, 'L' || n_regionkey, make_date(y, 3, 1), make_date(y, 3, 20), make_date(y, 2, 1) from b),
    j as (select f.store, f.channel, f.day, count(distinct location) as n_locations, min(location) as location from f left join a on a.store = f.store and a.channel = f.channel and from_day <= f.day and f.day < to_day and known <= f.day group by all)
    select store, channel, day, n_locations, case when n_locations = 1 then location end as location, case n_locations when 0 then 'missing' when 1 then 'assigned' else 'ambiguous' end as status from j""", "span"))
def _(spark, d):
    """Every day of a nation's store and channel with its one location: assignments change by the year, some are known late, some overlap, and repeated ones agree."""
    from asoflow.operators.joins import legacy_assignment

    nation = table(spark, d, "nation")
    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    f = sold.select(F.col("s_nationkey").alias("store"), F.col("l_returnflag").alias("channel"), F.to_date("l_shipdate").alias("day")).distinct()
    years = span(spark, d).select(F.explode(F.sequence(F.year("first_day"), F.year("last_day"))).alias("y"))
    b = nation.crossJoin(F.broadcast(years)).select(F.col("n_nationkey").alias("store"), "n_regionkey", "y", F.explode(F.array(*map(F.lit, "ANR"))).alias("channel"))  # nations times years

    def held(rows, region, start, end, known):
        return rows.select("store", "channel", F.concat(F.lit("L"), region.cast("string")).alias("location"), start.alias("from_day"), end.alias("to_day"), known.alias("known"))

    def day(month, year=None):
        return F.make_date(F.col("y") if year is None else year, F.lit(month), F.lit(1))

    region = F.col("n_regionkey")
    yearly = held(b.where("(store + y) % 7 <> 0"), region, day(1), day(1, F.col("y") + 1), F.date_add(day(1), F.when(F.col("y") % 3 == 0, 40).otherwise(-20)))
    summer = held(b.where("(store + y) % 6 = 0 and channel <> 'N'"), (region + 1) % 5, day(7), day(9), day(6))
    again = held(b, region, day(3), F.date_add(day(3), 19), day(2))
    return legacy_assignment(f, yearly.union(summer).union(again), ["store", "channel"], "day", F.col("day"), ["store", "channel", "day"])


_SCORED = """sc as (select d.doc_id, coalesce(d.lang, 'none') as segment, round(1 - 1 / (1 + exp(-(ln(greatest(n_chars, 1)) - 7.0))), 3) as s, quality = 0 as bad from documents d left join labels using (doc_id)),
    cu as (select segment, count(*) as n, cast(floor(round(count(*) * 0.1, 9)) as bigint) as allowed_alerts, cast(floor(round(count(*) * 0.02, 9)) as bigint) as allowed_high, list(s order by s) as l from (select segment, s from sc where doc_id % 2 = 0 union all select '*', s from sc where doc_id % 2 = 0) group by 1),
    ct as (select segment, n, allowed_alerts, allowed_high, case when n >= 20 then l[n - allowed_alerts] end as threshold, case when n >= 20 then l[n - allowed_high] end as high_threshold from cu)"""


def _scored(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    p = 1 / (1 + F.exp(-(F.ln(F.greatest("n_chars", F.lit(1))) - 7.0)))
    return docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("segment"), F.round(1 - p, 3).alias("s"), (F.col("quality") == 0).alias("bad"))


def _cuts(rows):
    from asoflow.operators.metrics import capacity_cuts

    half = rows.where("doc_id % 2 = 0")
    return capacity_cuts(half, ["segment"], "s", 0.1, 0.02, 20).unionByName(capacity_cuts(half, [], "s", 0.1, 0.02, 20).withColumn("segment", F.lit("*")))


@query("wn14_capacity_cuts", f"with {_SCORED} select ct.*, (select count(*) from sc where doc_id % 2 = 1 and (ct.segment = '*' or sc.segment = ct.segment) and s > threshold) as n_alerts, (select count(*) from sc where doc_id % 2 = 1 and (ct.segment = '*' or sc.segment = ct.segment) and s > high_threshold) as n_high from ct")
def _(spark, d):
    """Cuts for alerts and for high severity, of each language and as a census over all, fitted on half of the documents, and how many of the other half exceed them."""
    rows = _scored(spark, d)
    cuts = _cuts(rows)
    other = rows.where("doc_id % 2 = 1").select("s", F.explode(F.array("segment", F.lit("*"))).alias("segment"))
    met = other.join(cuts.select("segment", "threshold", "high_threshold"), "segment").groupBy("segment").agg(F.count_if(F.expr("s > threshold")).alias("n_alerts"), F.count_if(F.expr("s > high_threshold")).alias("n_high"))
    return cuts.join(met, "segment", "left").fillna(0, ["n_alerts", "n_high"])


@query("ag19_observation_report", f"""with {_SCORED}, j as (select sc.segment, s, s > threshold as alert, s > high_threshold as high, bad from sc join ct on ct.segment = sc.segment where doc_id % 2 = 1),
    g as (select segment, count(*) as n_total, count(bad) as n_evaluable, count(case when alert and bad is not null then 1 end) as pa, count(case when bad then 1 end) as pt, count(case when alert and bad then 1 end) as tp, count(case when high and bad is not null then 1 end) as hi, count(case when high and bad then 1 end) as ht from j group by 1),
    t as (select segment, s, sum(bad::integer) as t, count(*) as n from j where bad is not null group by all), u as (select *, sum(t) over w as ct, sum(n) over w as cn from t window w as (partition by segment order by s desc rows unbounded preceding)), a as (select segment, case when sum(t) > 0 and sum(t) < sum(n) then round(sum(t * ct / cn) / sum(t), 6) end as ap from u group by 1),
    m as (select segment, n_total, n_evaluable, unnest([{{'metric': 'precision', 'a': tp, 'b': pa, 'k': 1, 'unit': 'ratio', 'why': 'no_positive_predictions'}}, {{'metric': 'recall', 'a': tp, 'b': pt, 'k': 1, 'unit': 'ratio', 'why': 'no_truth_positives'}}, {{'metric': 'false_alerts_per_1000', 'a': pa - tp, 'b': n_evaluable - pt, 'k': 1000, 'unit': 'alerts_per_1000_clean_observations', 'why': 'no_evaluable_clean_observations'}}, {{'metric': 'high_severity_precision', 'a': ht, 'b': hi, 'k': 1, 'unit': 'ratio', 'why': 'no_high_severity_predictions'}}], recursive := true) from g)
    select segment, n_total, n_evaluable, round(n_evaluable / n_total, 6) as coverage, metric, round(k * a / nullif(b, 0), 6) as value, unit, cast(a as bigint) as numerator, cast(b as bigint) as denominator, case when b = 0 then why end as reason, case when b = 0 then 'not_evaluable' else 'evaluable' end as status from m
    union all select g.segment, n_total, n_evaluable, round(n_evaluable / n_total, 6), 'average_precision', ap, 'ratio', null, null, case when ap is null then 'both_truth_classes_required' end, case when ap is null then 'not_evaluable' else 'evaluable' end from g left join a using (segment)""")
def _(spark, d):
    """Alerts on the other half of the documents, held against their labels: each metric with numerator, denominator, coverage and status."""
    from asoflow.operators.metrics import observation_report

    rows = _scored(spark, d)
    judged = rows.where("doc_id % 2 = 1").join(_cuts(rows).select("segment", "threshold", "high_threshold"), "segment")
    judged = judged.withColumns({"alert": F.col("s") > F.col("threshold"), "high": F.col("s") > F.col("high_threshold")})
    return observation_report(judged, ["segment"], "alert", "high", "bad", "s")
