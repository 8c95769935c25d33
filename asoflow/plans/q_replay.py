"""Queries on event replay, text and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.operators import replay as R
from asoflow.operators import text as T
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.adapters import capture, table

_ST = """st as (select *, coalesce(rep, case when b > 1 then case when value = bf then 'duplicate_business' else 'business_conflict' end end, 'accepted') as status from (
    select *, row_number() over (partition by grain, rep is null order by "offset") as b, first_value(value) over (partition by grain, rep is null order by "offset") as bf from (
    select *, case when k > 1 then case when body = fb then 'duplicate_event' else 'event_conflict' end end as rep from (select *, row_number() over w as k, first_value(body) over w as fb from capture window w as (partition by event_id order by "offset")))))"""


@query("wn12_dedupe_events", sql(f'with {_ST} select "offset", event_id, status from st', "capture"))
def _(spark, d):
    return R.classify_deliveries(capture(spark, d)).select("offset", "event_id", "status")


@query("sm09_accounting", sql(f"""with {_ST} select count(*) as delivered, count(case when status = 'accepted' then 1 end) as accepted, count(case when status = 'duplicate_event' then 1 end) as duplicate_event, count(case when status = 'event_conflict' then 1 end) as event_conflict,
    count(case when status = 'duplicate_business' then 1 end) as duplicate_business, count(case when status = 'business_conflict' then 1 end) as business_conflict, true as balanced from st""", "capture"))
def _(spark, d):
    return R.accounting(R.classify_deliveries(capture(spark, d)))


@query("sm08_quarantine", sql(f"""with {_ST} select "offset", status as reason, body as body_sha256 from st where status in ('event_conflict', 'business_conflict')""", "capture"))
def _(spark, d):
    bad = R.classify_deliveries(capture(spark, d)).where("status in ('event_conflict', 'business_conflict')")
    return bad.select("offset", F.col("status").alias("reason"), F.col("body").alias("body_sha256"))


@query("wn09_timing_status", sql("""with r as (select *, cast("offset" % 4 as integer) as part, ts - to_hours(cast(event_id % 3 * 20 as integer)) as moment from capture) select "offset", case when cast(moment as date) <= max(watermark) over (partition by part order by "offset" rows unbounded preceding) then 'late'
    when moment < max(moment) over (partition by part order by "offset" rows between unbounded preceding and 1 preceding) then 'out_of_order' else 'on_time' end as timing from r""", "capture"))
def _(spark, d):
    c = capture(spark, d).withColumns({"part": F.col("offset") % 4, "at": F.col("ts") - F.make_dt_interval(F.lit(0), (F.col("event_id") % 3 * 20).cast("int"))})
    return R.timing_status(c, ["part"], "at", "watermark").select("offset", "timing")


@query("wn10_revisions", sql(f"""with {_ST}, a as (select * from st where status = 'accepted') select "offset", user_type, count(*) over w as revision, round(sum(value) over w, 4) as total, lag("offset") over (partition by user_type order by "offset") as previous_offset from (select *, split_part(grain, '|', 1) || split_part(grain, '|', 2) as user_type from a)
    window w as (partition by user_type order by "offset" rows unbounded preceding)""", "capture"))
def _(spark, d):
    a = R.classify_deliveries(capture(spark, d)).where("status = 'accepted'").withColumn("user_type", F.concat(F.split("grain", r"\|")[0], F.split("grain", r"\|")[1]))
    return R.aggregate_revisions(a, ["user_type"], "value").select("offset", "user_type", "revision", F.round("total", 4).alias("total"), "previous_offset")


@query("wn11_aggregates_as_of", sql(f"""with {_ST} select user_type, count(*) as revision, round(sum(value), 4) as total from (select *, split_part(grain, '|', 1) as user_type from st where status = 'accepted') where day <= date '2024-01-15' group by 1""", "capture"))
def _(spark, d):
    a = R.classify_deliveries(capture(spark, d)).where("status = 'accepted'").withColumn("user_type", F.split("grain", r"\|")[0])
    out = R.aggregates_as_of(R.aggregate_revisions(a, ["user_type"], "value"), ["user_type"], F.lit("2024-01-15").cast("date"), "day")
    return out.withColumn("total", F.round("total", 4))


@query("ag01_grain_totals", sql("""select grain, count(*) as n, cast(sum(cast(round(value * 100, 0) as bigint)) as bigint) as cents, count(distinct event_id) as n_events, list_sort(list(distinct event_id % 5)) as residues from capture group by 1""", "capture"))
def _(spark, d):
    return capture(spark, d).groupBy("grain").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100, 0).cast("long")).alias("cents"), F.countDistinct("event_id").alias("n_events"), F.sort_array(F.collect_set(F.col("event_id") % 5)).alias("residues"))


@query("ag27_coverage_report", sql(f"""with {_ST} select e.event_type, count(*) as expected, count(s.event_id) as accepted, count(*) - count(s.event_id) as missing from events e left join (select event_id from st where status = 'accepted') s using (event_id) group by 1""", "capture"))
def _(spark, d):
    a = R.classify_deliveries(capture(spark, d)).where("status = 'accepted'").select("event_id", F.lit(1).alias("there"))
    e = table(spark, d, "events").join(a, "event_id", "left").groupBy("event_type")
    return e.agg(F.count("*").alias("expected"), F.count("there").alias("accepted"), F.count_if(F.expr("there is null")).alias("missing"))


@query("ag28_table_profile", sql(f"with {_ST} select status as reason, count(*) as n, count(*) filter (status = 'accepted') = count(*) as ready from st group by 1", "capture"))
def _(spark, d):
    s = R.classify_deliveries(capture(spark, d))
    return s.groupBy(F.col("status").alias("reason")).agg(F.count("*").alias("n"), (F.count_if(F.expr("status = 'accepted'")) == F.count("*")).alias("ready"))


@query("ds18_day_gate", sql(f"""with {_ST}, f as (select day, event_type, count(*) as n from (select *, split_part(grain, '|', 2) as event_type from st) where status = 'accepted' and day <= date '2024-01-20' group by all), q as (select day, split_part(grain, '|', 2) as event_type, count(*) as n from st where status = 'event_conflict' and split_part(grain, '|', 1)::bigint % 5 = 0 and day <= date '2024-01-20' group by all),
    e as (select cast(ts as date) as day, event_type, count(*) as expected from events where cast(ts as date) <= date '2024-01-20' and extract('day' from ts) % 2 = 0 group by all)
    select day, event_type, expected, coalesce(f.n, 0) as n_facts, coalesce(q.n, 0) as n_quarantined, case when expected is null then 'no_declaration' when coalesce(q.n, 0) > 0 then 'quarantined' when coalesce(f.n, 0) < expected then 'missing_facts' else 'qualified' end as status from e full join f using (day, event_type) full join q using (day, event_type)""", "capture"))
def _(spark, d):
    s = R.classify_deliveries(capture(spark, d)).withColumn("parts", F.split("grain", r"\|")).withColumns({"event_type": F.col("parts")[1], "known": F.col("day")})
    declared = table(spark, d, "events").where("day(ts) % 2 = 0").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("expected"), F.max(F.to_date("ts")).alias("known"))
    bad = s.where((F.col("status") == "event_conflict") & (F.col("parts")[0].cast("long") % 5 == 0))
    return R.day_gate(declared, s.where("status = 'accepted'"), bad, ["day", "event_type"], F.lit("2024-01-20").cast("date"))


@query("ds17_day_declarations", "select cast(ts as date) as day, event_type, count(*) as expected, min(event_id) as first_id, max(event_id) as last_id, cast(ts as date) + 1 as known from events group by all")
def _(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("expected"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).withColumn("known", F.date_add("day", 1))


@query("jn26_canonical_match", sql("""select case when e.event_id is null then 'foreign_event' when e.value <> c.value then 'payload_conflict' else 'matched' end as result, count(*) as n from capture c left join (select * from events where event_id % 11 <> 0) e using (event_id) group by 1""", "capture"))
def _(spark, d):
    parent = table(spark, d, "events").where("event_id % 11 <> 0").select("event_id", F.col("value").alias("own"))
    result = F.when(F.col("own").isNull(), "foreign_event").when(F.col("own") != F.col("value"), "payload_conflict").otherwise("matched")
    return capture(spark, d).join(parent, "event_id", "left").groupBy(result.alias("result")).agg(F.count("*").alias("n"))


@query("st03_union_facts", sql("select kind, count(*) as n, round(sum(value), 4) as total from (select 'sale' as kind, l_quantity as value from lineitem where l_returnflag <> 'R' union all select 'return', -quantity from returned) group by 1", "returned"))
def _(spark, d):
    from asoflow.sources.adapters import returns

    s = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.lit("sale").alias("kind"), F.col("l_quantity").alias("value"))
    r = returns(spark, d).select(F.lit("return").alias("kind"), (-F.col("quantity")).alias("value"))
    return s.unionByName(r).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Markdown lines as blocks with their paths
_BLOCKS = r"""l as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) as n from documents),
    f as (select *, regexp_matches(line, '^\s*(```|~~~)') as fence, sum(case when regexp_matches(line, '^\s*(```|~~~)') then 1 else 0 end) over (partition by doc_id order by n) as k from l), c as (select *, fence or k % 2 = 1 as code from f),
    t as (select *, case when code then 'code' when regexp_matches(line, '^#{1,6}\s') then 'heading' when trim(line) = '' or regexp_matches(trim(line), '^(<!--.*-->|(-\s*){3,}|(\*\s*){3,}|(_\s*){3,})$') then 'gap' else 'text' end as kind, case when not code then length(regexp_extract(line, '^(#{1,6})\s', 1)) end as level from c),
    b as (select *, sum(case when before is null or before <> kind or kind = 'heading' then 1 else 0 end) over (partition by doc_id order by n) as block from (select *, lag(kind) over (partition by doc_id order by n) as before from t)),
    h as (select *, """ + ", ".join(f"max(case when kind = 'heading' and level = {k} then {{'n': n, 't': regexp_replace(line, '^#+\\s+', '')}} end) over w as h{k}, max(case when kind = 'heading' and level < {k} then n end) over w as r{k}" for k in range(1, 7)) + r""" from b window w as (partition by doc_id order by n rows unbounded preceding)),
    p as (select *, concat_ws(' > ', """ + ", ".join(f"case when r{k} is null or h{k}.n > r{k} then h{k}.t end" for k in range(1, 7)) + """) as path from h)"""


def _cut(source: str, keys: str, limit: int = 1200) -> str:
    """Recursive tables pc of a source's pieces: keys, k (from 1), part. The largest n with at most limit bytes is found bit by bit."""
    bits = [0, *(1 << b for b in range(limit.bit_length() - 1, -1, -1))]
    most = f"list_reduce({bits}, lambda a, b: case when a + b <= length(h) and strlen(left(h, a + b)) <= {limit} then a + b else a end)"
    tail = "length(left(h, n0)) - length(regexp_extract(left(h, n0), '[^{0}]*$')) - 1"
    return f"""pc as (select {keys}, 0 as k, null::varchar as part, trim(coalesce(text, ''), chr(10)) as rest from {source} union all
    select {keys}, k + case when part <> '' then 1 else 0 end, part, rest from (select {keys}, k, trim(case when whole then r else left(r, cut) end, chr(10)) as part, case when whole then '' else ltrim(substr(r, cut + 1), ' ' || chr(10)) end as rest
    from (select *, case when nl > 0 then nl when sp > 0 then sp else greatest(1, n0) end as cut from (select *, {tail.format(chr(92) + 'n')} as nl, {tail.format(' ')} as sp from (select *, {most} as n0
    from (select {keys}, k, rest as r, left(rest, {limit}) as h, strlen(rest) <= {limit} as whole from pc where rest <> ''))))))"""


@query("tx03_chunk_table", f"""with recursive {_BLOCKS}, bl as (select doc_id, block, case kind when 'code' then 'fence' else 'paragraph' end as kind, max_by(path, n) as path, string_agg(line, chr(10) order by n) as text from p where kind in ('code', 'text') group by all),
    {_cut("bl", "doc_id, block, kind, path")}, ch as (select doc_id, kind, path, part, sha256(part) as checksum, min((block, k)) as first, count(*) as n_occurrences from pc where part <> '' group by doc_id, kind, path, part)
    select doc_id, sha256(concat_ws(chr(31), doc_id::varchar, path, kind, checksum)) as chunk_id, row_number() over (partition by doc_id order by first) - 1 as chunk_index, kind, path, checksum, cast(ceil(strlen(part) / 4.0) as bigint) as tokens, cast(n_occurrences as integer) as n_occurrences, cast(first[1] as bigint) as first_block from ch""")
def _(spark, d):
    c = T.chunk_table(table(spark, d, "documents"), "doc_id", "text", 1200)
    return c.select("doc_id", "chunk_id", "chunk_index", "kind", "path", "checksum", "tokens", F.size("occurrences").alias("n_occurrences"), F.col("occurrences")[0]["block"].cast("long").alias("first_block"))


@query("wn19_chunk_ordinals", """with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents), g as (select doc_id, sha256(text) as checksum, list(n order by n) as occurrences, max(strlen(text)) as n_bytes, min(n) as first from l where length(trim(text)) > 0 group by all)
    select doc_id, checksum, occurrences, n_bytes, cast(ceil(n_bytes / 4) as bigint) as tokens, row_number() over (partition by doc_id order by first) - 1 as ordinal from g""")
def _(spark, d):
    return T.chunk_ordinals(table(spark, d, "documents"), "doc_id", "text")


@query("tx04_exact_duplicates", "select sha256(text) as checksum, count(*) as n_documents, min(doc_id) as first_id, count(distinct source) as n_source, count(distinct lang) as n_lang from documents group by 1 having count(*) > 1")
def _(spark, d):
    return T.exact_duplicates(table(spark, d, "documents"), "doc_id", "text", ["source", "lang"])


@query("tx05_near_duplicates", """with recursive w as (select doc_id, regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]+') as w from documents), s as (select doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s from w where len(w) >= 12),
    r as (select min(doc_id) as id, s from s group by s), x as (select id, len(s) as n, unnest(s) as g from r), p as (select a.id as a, b.id as b from x a join x b on a.g = b.g and a.id < b.id and b.n >= 0.8 * a.n and a.n >= 0.8 * b.n group by all having 18000 * count(*) >= 8000 * (any_value(a.n) + any_value(b.n))),
    e as (select a, b from p union select b, a from p), k as (select id, id as c from r union select e.b, k.c from k join e on e.a = k.id), m as (select id, min(c) as c from k group by 1)
    select s.doc_id as id, r.id as class_id, m.c as component_id from s join r on r.s = s.s join m on m.id = r.id""")
def _(spark, d):
    return T.near_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("tx07_embedding_cache", """with c as (select conv_id, turn, sha256(text) as checksum, text from conversations), e as (select checksum, min(text) as text, count(*) as n from c group by 1)
    select conv_id, turn, c.checksum, n as n_shared, list_transform(range(0, 2), lambda i: round(cast(('0x' || substr(sha256(i || ':' || e.text), 1, 8))::bigint as double) / 2147483648.0 - 1, 6)) as raw from c join e using (checksum)""")
def _(spark, d):
    """Every distinct text is embedded once and joined back to all its turns."""
    from asoflow.functions.columns import signed_round

    c = table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("checksum"), "text")
    return T.embedded_once(c, "checksum", "text", lambda x: F.transform(T.hash_numbers(x, 2), lambda y: signed_round(y, 6)), "raw").select("conv_id", "turn", "checksum", "n_shared", "raw")


_COS = """v as (select vec_id as id, vec_id % 7 as document, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), q as (select * from v where id % 50 = 0),
    c as (select q.id as query_id, v.id, v.document, round(list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v))), 6) as score from v join q on v.id <> q.id),
    k as (select *, row_number() over (partition by query_id, document order by score desc, id) as d from c), r as (select query_id, id, document, score, row_number() over (partition by query_id order by score desc, id) as rank from k where d <= 2)"""


def _found(spark, d, k):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("document"), F.col("embedding").alias("v"))
    return T.cosine_search(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), k, 2)


@query("tx08_cosine_search", f"with {_COS} select query_id, id, document, score, rank from r where rank <= 10")
def _(spark, d):
    return _found(spark, d, 10)


_DIVERSE = """h as (select r.*, e.label as repository, 100 + r.id % 7 * 60 as size from r join embeddings e on e.vec_id = r.id where rank <= 12 and score >= 0.0), n as (select *, row_number() over (partition by query_id, repository order by score desc, id) as rr, row_number() over (partition by query_id, document order by score desc, id) as dd from h),
    t as (select *, case when rr = 1 then 0 when dd = 1 and max(case when rr = 1 then 1 else 0 end) over (partition by query_id, document) = 0 then 1 else 2 end as tier from n), o as (select *, row_number() over (partition by query_id order by tier, score desc, id) as place from t),
    f as (select query_id, 0 as place, 0 as used, []::bigint[] as docs, false as fits, null::bigint as id, null::integer as tier from (select distinct query_id from o) union all
    select f.query_id, o.place, case when g then f.used + o.size else f.used end, case when g then list_append(f.docs, o.document) else f.docs end, g, o.id, o.tier from f join (select * from o) o on o.query_id = f.query_id and o.place = f.place + 1 cross join lateral (select f.used + o.size <= 1000 and len(f.docs) < 5 and len(list_filter(f.docs, lambda x: x = o.document)) < 2 as g))
    select query_id, id, tier, cast(used as bigint) as used from f where fits"""


@query("tx09_diversify", f"with recursive {_COS}, {_DIVERSE}")
def _(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("repository"))
    h = _found(spark, d, 12).join(labels, "id").withColumn("size", 100 + F.col("id") % 7 * 60)
    return T.diversify(h, 0.0, 1000, "size", 5, 2)


@query("tx10_retrieval_metrics", f"""with {_COS}, g as (select label, count(*) as n from embeddings group by 1), cases as (select q.id as query_id, e.label as wanted, (e.label + 1) % 10 as forbidden, g.n - 1 as n_wanted, q.id % 100 = 0 as critical from q join embeddings e on e.vec_id = q.id join g on g.label = e.label),
    m as (select cases.query_id, n_wanted, critical, count(case when c.label = wanted then 1 end) as found, coalesce(1 / min(case when c.label = wanted then rank end), 0.0) as rr, count(case when c.label = forbidden then 1 end) as banned, count(r.id) as cited, count(c.label) as bound from cases left join (select * from r where rank <= 5) r on r.query_id = cases.query_id left join (select * from embeddings where vec_id % 41 <> 0) c on c.vec_id = r.id group by all)
    select count(*) as n_queries, round(avg(found / nullif(n_wanted, 0)), 6) as recall, round(avg(rr), 6) as mrr, count(case when banned = 0 then 1 end) as n_clean, round(sum(bound) / sum(cited), 6) as citation_rate, count(case when banned = 0 and cited = bound and found > 0 then 1 end) as n_passed, round(count(case when critical and banned = 0 and cited = bound and found > 0 then 1 end) / nullif(count(case when critical then 1 end), 0), 6) as critical_pass_rate from m""")
def _(spark, d):
    """A query wants the vectors of its own label and may not get those of the next; some chunks are gone, so that citations to them don't stand."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"))
    sizes = e.groupBy("grp").agg((F.count("*") - 1).alias("n_wanted"))
    cases = e.where("id % 50 = 0").join(sizes, "grp").select(F.col("id").alias("query_id"), F.col("grp").alias("wanted"), ((F.col("grp") + 1) % 10).alias("forbidden"), "n_wanted", (F.col("id") % 100 == 0).alias("critical"))
    return T.retrieval_metrics(_found(spark, d, 5), cases, e.where("id % 41 <> 0"))


@query("tx11_index_validation", "select vec_id as id, 'no_chunk' as reason from embeddings where vec_id not in (select doc_id from documents where doc_id % 3 <> 0) union all select doc_id, 'no_vector' from documents where doc_id % 3 <> 0 and doc_id not in (select vec_id from embeddings)")
def _(spark, d):
    chunks = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))
    return T.index_violations(chunks, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 64)


@query("tx01_markdown_blocks", f"""with {_BLOCKS}
    select doc_id, cast(block as bigint) as block, kind, max_by(path, n) as path, sha256(string_agg(line, chr(10) order by n)) as checksum from p where kind in ('code', 'text') group by doc_id, block, kind""")
def _(spark, d):
    return T.markdown_blocks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "block", "kind", "path", F.sha2("text", 256).alias("checksum"))


_PIECES = f"""with recursive {_cut("documents", "doc_id")} select doc_id, cast(k - 1 as integer) as piece, strlen(part) as n_bytes, sha256(part) as checksum from pc where part <> ''"""


@query("tx02_bounded_pieces", _PIECES)
def _(spark, d):
    p = T.pieces(table(spark, d, "documents"), ["doc_id"], "text", 1200)
    return p.select("doc_id", "piece", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("checksum"))


@query("tx06_hash_embedding", """with n as (select doc_id, list_transform(range(0, 8), lambda i: cast(('0x' || substr(sha256(i || ':' || text), 1, 8))::bigint as double) / 2147483648.0 - 1) as v from documents), u as (select doc_id, case when v[1] is null then v else list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) end as v from n)
    select doc_id, case when v[1] is not null then round(sqrt(list_dot_product(v, v)), 6) end as norm, list_transform(v, lambda x: round(x, 6)) as v from u""")
def _(spark, d):
    from asoflow.functions.columns import norm, signed_round

    v = table(spark, d, "documents").select("doc_id", T.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(norm(F.col("v")), 6).alias("norm"), F.transform("v", lambda x: signed_round(x, 6)).alias("v"))


@query("ud01_nfkc_casefold")
def _(spark, d):
    from asoflow.functions.columns import nfkc_casefold

    return table(spark, d, "documents").select("doc_id", F.sha2(nfkc_casefold(F.col("text")), 256).alias("checksum"))


@query("ud02_chunk_text", _PIECES)
def _(spark, d):
    """The pieces of every text by a table function, in SQL."""
    spark.udtf.register("chunk_text", T.chunk_text)
    text = "select doc_id, p.piece, octet_length(p.text) as n_bytes, sha2(p.text, 256) as checksum from {docs} as t, lateral chunk_text(coalesce(t.text, ''), 1200) p"
    return spark.sql(text, docs=table(spark, d, "documents"))


@query("so02_bounded_limits", "select name, budget, n_rows, case when n_rows > budget then 'over_budget' else 'within' end as status from (select 'orders' as name, count(*) as n_rows from orders union all select 'nation', count(*) from nation union all select 'documents', count(*) from documents) cross join (select unnest([25, 1000, 100000000])::bigint as budget)")
def _(spark, d):
    """Row budgets: reading one row more than allowed tells whether a table keeps it; a table that doesn't is refused, not cut."""
    rows = []
    for name in ("orders", "nation", "documents"):
        for budget in (25, 1000, 100_000_000):
            try:
                rows.append((name, budget, T.within_budget(table(spark, d, name), budget).count(), "within"))
            except ValueError:
                rows.append((name, budget, table(spark, d, name).count(), "over_budget"))
    return spark.createDataFrame(rows, "name string, budget long, n_rows long, status string")
