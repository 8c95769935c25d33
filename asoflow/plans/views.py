"""The adapters once more, as common table expressions for the SQL twins."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), """select l.*, p_type as product, r_name as location, l_returnflag as channel, cast(l_shipdate as date) as day
        from lineitem l join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
        join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "series_day": (("lines",), "select product, location, channel, day, sum(l_quantity) as units from lines group by all"),
    "demand_cells": (("lines",), """select product, location, channel, day, sum(case when l_linestatus = 'F' then l_quantity end) as u1, sum(l_quantity) as u2 from lines group by all"""),
    "demand_versions": (("demand_cells",), """select product, location, channel, day, cast(1 as bigint) as version, u1 as units, day + 1 as available from demand_cells where u1 is not null
        union all select product, location, channel, day, cast(2 as bigint), u2, day + 3 from demand_cells where u1 is null or u1 <> u2"""),
    "span": ((), "select min(cast(l_shipdate as date)) as first_day, max(cast(l_shipdate as date)) as last_day from lineitem"),
    "weeks": (("span",), "select cast(unnest(generate_series(date_trunc('week', first_day) + interval 6 day, last_day::timestamp, interval 7 day)) as date) as origin from span"),
    "plan_base": (("span",), """select p_partkey as part, k, p_size % 5 as m5, p_retailprice, r_name, ['A', 'N', 'R'][(p_partkey + k) % 3 + 1] as one, unnest(list_distinct(['global', ['global', 'channel', 'location', 'location_channel'][p_size % 4 + 1]])) as scope,
        from_day, cast(from_day + interval 3 month as date) as to_day
        from part cross join (select cast(unnest(q) as date) as from_day, generate_subscripts(q, 1) - 1 as k from (select generate_series(date_trunc('quarter', first_day)::timestamp, last_day::timestamp, interval 3 month) as q from span)) join region on r_regionkey = (p_partkey + k) % 5"""),
    "plans": (("plan_base",), """select part, scope, case when scope like 'location%' then r_name end as location, case when scope like '%channel' then one else 'all' end as channel, from_day, to_day, cast(v as bigint) as version, from_day + (case when v = 2 then 30 else -10 end) as known,
        cast(round(p_retailprice * (100 + k), 0) + (case when v = 2 then 500 else 0 end) - length(scope) as bigint) as price_cents
        from plan_base, (select unnest([1, 2]) as v) where v = 1 or m5 = 0"""),
    "routes": (("span",), """select r_name as location, 'W' || cast((r_regionkey + year) % 5 as varchar) as stock, make_date(year, 1, 1) as from_day, make_date(year + 1, 1, 1) as to_day,
        cast(1 as bigint) as version, make_date(year, 1, 1) - 20 as known from region, (select cast(unnest(range(year(first_day), year(last_day + 60) + 1)) as bigint) as year from span)"""),
    "ledger_ends": (("span",), "select cast(date_trunc('week', first_day) as date) as start, (last_day - cast(date_trunc('week', first_day) as date)) // 7 as last_week from span"),
    "ledger_sales": (("series_day", "ledger_ends"), "select *, (day - start) // 7 as week from series_day cross join ledger_ends"),
    "ledger_weekly": (("ledger_sales",), """select product, location, channel, start, last_week, week, coalesce(sold, 0.0) as sold, week // 4 as block
        from (select product, location, channel, start, last_week, unnest(range(0, last_week + 1)) as week from (select distinct product, location, channel, start, last_week from ledger_sales))
        left join (select product, location, channel, week, sum(units) as sold from ledger_sales group by all) using (product, location, channel, week)"""),
    "ledger_tops": (("ledger_weekly",), """select *, lag(top) over (partition by product, location, channel order by block) as before
        from (select product, location, channel, start, block, max(sold) as top from ledger_weekly group by all)"""),
    "ledger": (("ledger_tops",), """select *, cast(row_number() over (partition by product, location, channel order by day, kind_rank) as bigint) as sequence, day + (case when kind = 'sale' then 1 else 0 end) as available from (
        select product, location, channel, start as day, 0 as kind_rank, 'opening_stock' as kind, top as delta from ledger_tops where block = 0
        union all select product, location, channel, start + cast(block * 28 as integer), 2, 'inventory_adjustment', top - before from ledger_tops where block > 0 and top <> before
        union all select product, location, channel, start + cast((week + 1) * 7 as integer), 1, 'receipt', sold from ledger_weekly where week < last_week and sold > 0
        union all select product, location, channel, day, 3, 'sale', -units from ledger_sales)"""),
    "returned": ((), """select l_orderkey as order_id, cast(l_linenumber as bigint) as line, cast(l_shipdate as date) as sold, cast(l_shipdate as date) + l_linenumber * 3 as returned,
        l_partkey as part, l_quantity as quantity, cast(round(l_extendedprice * 100, 0) as bigint) as price_cents from lineitem where l_returnflag = 'R'"""),
    "capture_rows": ((), """select event_id, ts, user_id || '|' || event_type || '|' || cast(cast(ts as date) as varchar) as grain, value, 0 as copy from events
        union all select event_id, ts, user_id || '|' || event_type || '|' || cast(cast(ts as date) as varchar), value, 1 from events where event_id % 37 = 0
        union all select event_id, ts, user_id || '|' || event_type || '|' || cast(cast(ts as date) as varchar), value + 1, 2 from events where event_id % 41 = 0"""),
    "capture": (("capture_rows",), """select cast(row_number() over (order by cast(ts as date), ts, event_id, copy) - 1 as bigint) as "offset", event_id, ts, cast(ts as date) as day, grain, value,
        sha256(event_id || '|' || grain || '|' || cast(cast(round(value * 100, 0) as bigint) as varchar)) as body, cast(ts as date) - 1 as watermark from capture_rows"""),
    "scores": ((), """select doc_id, lang as segment, round(1 / (1 + exp(-(ln(n_chars) - 7.0))), 4) as p, cast(quality as bigint) as y from documents join labels using (doc_id)"""),
    "forecasts": (("series_day", "weeks"), """select m.product, m.location, m.channel, origin, h, origin + cast(h as integer) as target, case when known >= 3 then round(yhat, 6) end as p, a.units as y
        from (select product, location, channel, origin, avg(units) as yhat, count(*) as known from series_day join weeks on day <= origin and day > origin - 28 where origin <= (select last_day - 14 from span) group by all) m
        cross join (select unnest(range(1, 15)) as h) left join series_day a on a.product = m.product and a.location = m.location and a.channel = m.channel and a.day = origin + cast(h as integer)"""),
}


def sql(text: str, *names: str) -> str:
    """The text after the views that it names, with those they need."""
    wanted: dict[str, str] = {}

    def need(name: str) -> None:
        before, body = VIEWS[name]
        for b in before:
            need(b)
        wanted.setdefault(name, body)

    for n in names:
        need(n)
    head = ", ".join(f"{n} as ({body})" for n, body in wanted.items())
    text = text.strip()
    if not head:
        return text
    return f"with {head}, {text[5:].strip()}" if text.lower().startswith("with ") else f"with {head} {text}"
