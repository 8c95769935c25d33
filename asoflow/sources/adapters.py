"""Retail views over the star-schema tables: series, versions, plans, routes, ledger, returns, events, scores, forecasts, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = ["product", "location", "channel"]
_TASK_PARTS = 10_000  # of which a task makes the plans
_SENT_SUPPLIERS = 1_000_000  # with their regions, about 50 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with product type, region and day. The dimensions are small against the lines; their sizes decide how they are joined. Places are
    counted for it: Spark takes the product of three tables' sizes for that of their join, and would shuffle the lines by supplier."""
    line, part, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    places = F.broadcast(places) if supplier.count() <= _SENT_SUPPLIERS else places
    return (
        line.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(places.select("s_suppkey", "r_name", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumns({"product": F.col("p_type"), "location": F.col("r_name"), "channel": F.col("l_returnflag"), "day": F.to_date("l_shipdate")})
    )


def series_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by series and day; days without lines are missing, not zero."""
    return lines(spark, sf_dir).groupBy(*SERIES, "day").agg(F.sum("l_quantity").alias("units"))


def demand_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of shipped lines (u1) and of all lines (u2) by series and day: what series_day and demand_versions are made of."""
    known = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")))
    return lines(spark, sf_dir).groupBy(*SERIES, "day").agg(known.alias("u1"), F.sum("l_quantity").alias("u2"))


def demand_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a day's demand: shipped lines known the next day, all lines after three days where that differs."""
    return cell_versions(demand_cells(spark, sf_dir))


def cell_versions(cells: DataFrame) -> DataFrame:
    """demand_versions from demand_cells."""
    first = F.when(F.col("u1").isNotNull(), F.struct(F.lit(1).cast("long").alias("version"), F.col("u1").alias("units"), F.date_add("day", 1).alias("available")))
    second = F.when(F.col("u1").isNull() | (F.col("u1") != F.col("u2")), F.struct(F.lit(2).cast("long").alias("version"), F.col("u2").alias("units"), F.date_add("day", 3).alias("available")))
    return cells.select(*SERIES, "day", F.inline(F.filter(F.array(first, second), lambda x: x.isNotNull())))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the first and last day of shipment."""
    return table(spark, sf_dir, "lineitem").agg(F.min(F.to_date("l_shipdate")).alias("first_day"), F.max(F.to_date("l_shipdate")).alias("last_day"))


def weeks(spark: SparkSession, sf_dir: str, ahead: int = 0) -> DataFrame:
    """All Sundays of the data as origins, at least `ahead` days before its end: a short list."""
    sundays = F.expr(f"sequence(date_add(trunc(first_day, 'week'), 6), date_sub(last_day, {ahead}), interval 7 days)")
    return span(spark, sf_dir).where(F.expr(f"date_add(trunc(first_day, 'week'), 6) <= date_sub(last_day, {ahead})")).select(F.explode(sundays).alias("origin"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price plans of all parts by quarter of the data, half-open intervals: one for all places and channels and, for three quarters
    of the parts, one for a channel, a location (the region's name) or both; a second version known 30 days later for some. Parts are dealt
    first: a part has dozens of plans, and a file of few megabytes would leave them all to one task."""
    part, region = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    part = part.select("p_partkey", "p_size", "p_retailprice").repartition(max(1, -(-part.count() // _TASK_PARTS)), "p_partkey")
    quarters = span(spark, sf_dir).select(F.posexplode(F.expr("sequence(trunc(first_day, 'quarter'), last_day, interval 3 months)")).alias("k", "from_day"))
    base = part.select(F.col("p_partkey").alias("part"), "p_size", "p_retailprice").crossJoin(F.broadcast(quarters))  # quarters of the data
    base = base.join(F.broadcast(region), (F.col("part") + F.col("k")) % 5 == F.col("r_regionkey"))  # five regions
    narrow = F.element_at(F.array(*map(F.lit, ("global", "channel", "location", "location_channel"))), (F.col("p_size") % 4 + 1).cast("int"))
    base = base.select(
        "part", "k", (F.col("p_size") % 5).alias("m5"), "p_retailprice", "from_day", F.add_months("from_day", 3).alias("to_day"), "r_name",
        F.element_at(F.array(*map(F.lit, "ANR")), ((F.col("part") + F.col("k")) % 3 + 1).cast("int")).alias("one"), F.explode(F.array_distinct(F.array(F.lit("global"), narrow))).alias("scope"),
    )
    versions = base.select("*", F.explode(F.when(F.col("m5") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("v")).withColumn("version", F.col("v").cast("long"))
    return versions.select(
        "part", "scope", F.when(F.col("scope").startswith("location"), F.col("r_name")).alias("location"), F.when(F.col("scope").endswith("channel"), F.col("one")).otherwise("all").alias("channel"),
        "from_day", "to_day", "version", F.date_add("from_day", F.when(F.col("version") == 2, 30).otherwise(-10)).alias("known"),
        (F.round(F.col("p_retailprice") * (100 + F.col("k")), 0) + F.when(F.col("version") == 2, 500).otherwise(0) - F.length("scope")).cast("long").alias("price_cents"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location's stock location, changing with the year, for all years of the data and the two months after it."""
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("location"), F.col("r_regionkey").cast("long").alias("key"))
    ends = span(spark, sf_dir).select(F.explode(F.sequence(F.year("first_day"), F.year(F.date_add("last_day", 60)))).alias("year"))
    years = region.crossJoin(F.broadcast(ends))  # the years of the data
    return years.select(
        "location", F.concat(F.lit("W"), ((F.col("key") + F.col("year")) % 5).cast("string")).alias("stock"),
        F.make_date("year", F.lit(1), F.lit(1)).alias("from_day"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).alias("to_day"),
        F.lit(1).cast("long").alias("version"), F.date_sub(F.make_date("year", F.lit(1), F.lit(1)), 20).alias("known"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock movements by series over all weeks of the data: an opening, weekly receipts, block adjustments and daily sales.

    kind_rank orders movements of one day; the balance at a week's start is the largest weekly
    sale of its 28-day block, so it never goes below zero and touches it.
    """
    ends = span(spark, sf_dir).select(F.trunc("first_day", "week").alias("start"), F.floor(F.datediff("last_day", F.trunc("first_day", "week")) / 7).alias("last_week"))
    sales = series_day(spark, sf_dir).crossJoin(F.broadcast(ends))  # one row
    sales = sales.withColumn("week", F.floor(F.datediff("day", "start") / 7)).withColumn("block", F.floor(F.col("week") / 4))
    weeks_ = sales.select(*SERIES, "start", "last_week").distinct().withColumn("week", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_week"))))
    weekly = weeks_.join(sales.groupBy(*SERIES, "week").agg(F.sum("units").alias("sold")), [*SERIES, "week"], "left").withColumn("sold", F.coalesce("sold", F.lit(0.0))).withColumn("block", F.floor(F.col("week") / 4))
    tops = weekly.groupBy(*SERIES, "start", "block").agg(F.max("sold").alias("top"))
    by = Window.partitionBy(*SERIES)
    tops = tops.withColumn("before", F.lag("top").over(by.orderBy("block")))
    at_block = F.date_add("start", (F.col("block") * 28).cast("int"))
    opening = tops.where("block = 0").select(*SERIES, F.col("start").alias("day"), F.lit(0).alias("kind_rank"), F.lit("opening_stock").alias("kind"), F.col("top").alias("delta"))
    adjust = tops.where("block > 0 and top <> before").select(*SERIES, at_block.alias("day"), F.lit(2).alias("kind_rank"), F.lit("inventory_adjustment").alias("kind"), (F.col("top") - F.col("before")).alias("delta"))
    receipts = weekly.where("week < last_week and sold > 0").select(*SERIES, F.date_add("start", ((F.col("week") + 1) * 7).cast("int")).alias("day"), F.lit(1).alias("kind_rank"), F.lit("receipt").alias("kind"), F.col("sold").alias("delta"))
    sold = sales.select(*SERIES, "day", F.lit(3).alias("kind_rank"), F.lit("sale").alias("kind"), (-F.col("units")).alias("delta"))
    rows = opening.union(receipts).union(adjust).union(sold)
    seq = F.row_number().over(by.orderBy("day", "kind_rank")).cast("long")
    return rows.withColumn("sequence", seq).withColumn("available", F.date_add("day", F.when(F.col("kind") == "sale", 1).otherwise(0)))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims for lines flagged R, returned some days after shipment."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return line.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.to_date("l_shipdate").alias("sold"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") * 3).alias("returned"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100, 0).cast("long").alias("price_cents"),
    )


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of events in order: every 37th sent twice, every 41st sent again with another value, and a progress record at each midnight.

    The order is total over the capture, whose unit is one topic partition; offsets are dealt
    per day from the days' counts, so that no task orders more than a day.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")).alias("grain"), F.col("value"))
    again = e.where("event_id % 37 = 0").select("*", F.lit(1).alias("copy")).union(e.where("event_id % 41 = 0").select("event_id", "ts", "grain", (F.col("value") + 1).alias("value"), F.lit(2).alias("copy")))
    rows = e.select("*", F.lit(0).alias("copy")).union(again).withColumn("day", F.to_date("ts"))
    counts = rows.groupBy("day").agg(F.count("*").alias("c"))
    counts = counts.select("day", (F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")).alias("skip"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id", "copy")) - 1
    rows = rows.withColumn("place", place).join(F.broadcast(counts), "day")  # a row per day
    return rows.select((F.col("skip") + F.col("place")).cast("long").alias("offset"), "event_id", "ts", "day", "grain", "value", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "grain", F.round(F.col("value") * 100, 0).cast("long").cast("string")), 256).alias("body"), F.date_sub("day", 1).alias("watermark"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed logistic of document length as probability of quality; segment is the language."""
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(x, "doc_id").select("doc_id", F.col("lang").alias("segment"), F.round(1 / (1 + F.exp(-(F.ln("n_chars") - 7.0))), 4).alias("p"), F.col("quality").cast("long").alias("y"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average of the known days among the last 28 as forecast for 14 horizons, from all Sundays up to 14 days before the end, with the outcome. A day's units go to the four Sundays whose windows hold it."""
    day = series_day(spark, sf_dir)
    last = span(spark, sf_dir).select(F.date_sub("last_day", 14).alias("last"))
    sunday = F.date_add("day", (8 - F.dayofweek("day")) % 7)
    past = day.select(*SERIES, "units", F.explode(F.array(*[F.date_add(sunday, 7 * k) for k in range(4)])).alias("origin")).join(F.broadcast(last), F.col("origin") <= F.col("last"))  # one row
    mean = past.groupBy(*SERIES, "origin").agg(F.avg("units").alias("yhat"), F.count("*").alias("known"))
    ahead = mean.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(14)))).withColumn("target", F.expr("date_add(origin, h)"))
    actual = day.select(*SERIES, F.col("day").alias("target"), F.col("units").alias("y"))
    return ahead.join(actual, [*SERIES, "target"], "left").select(*SERIES, "origin", F.col("h").cast("long").alias("h"), "target", F.when(F.col("known") >= 3, F.round("yhat", 6)).alias("p"), "y")
