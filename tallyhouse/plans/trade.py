"""Coverage, spans, joins and reconciliation over the orders tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions import text as X
from tallyhouse.operators import matching, snapshots, spans
from tallyhouse.plans.base import Registered, query
from tallyhouse.sources.tables import table

QUERIES: dict[str, Registered] = {}


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, start, end): from the order's day to its last shipping day, null if that lies before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("start"))
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("last"))
    joined = o.join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", "o_custkey", "start", spans.guarded_end(F.col("start"), F.col("last")).alias("end"))


_SPANS = 'WITH s AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS "start", CASE WHEN max(CAST(l_shipdate AS DATE)) >= CAST(o_orderdate AS DATE) THEN max(CAST(l_shipdate AS DATE)) END AS "end" FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)'


@query(QUERIES, _SPANS + ' SELECT o_orderkey, "start" AS start_day, "end" AS end_day, coalesce("end" - "start" + 1, 1) AS n_days FROM s')
def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _order_spans(spark, sf_dir)
    return s.select("o_orderkey", F.col("start").alias("start_day"), F.col("end").alias("end_day"), F.coalesce(F.datediff("end", "start") + 1, F.lit(1)).cast("bigint").alias("n_days"))


@query(QUERIES, _SPANS + ', d AS (SELECT o_orderkey, unnest(CASE WHEN coalesce("end", "start") - "start" + 1 <= 14 THEN generate_series("start"::TIMESTAMP, coalesce("end", "start")::TIMESTAMP, INTERVAL 1 DAY) ELSE ["start"::TIMESTAMP] END)::DATE AS day FROM s) SELECT day, count(*) AS n FROM d GROUP BY 1')
def orders_by_covered_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders per day; spans over 14 days count on their first day."""
    s = _order_spans(spark, sf_dir)
    return s.select(F.explode(spans.covered_days(F.col("start"), F.col("end"))).alias("day")).groupBy("day").agg(F.count("*").alias("n"))


@query(QUERIES, _SPANS + ', p AS (SELECT o_custkey, "start", coalesce("end", "start") AS e FROM s), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY "start", e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), n AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY "start", e ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT o_custkey, min("start") AS start_day, max(e) AS end_day, count(*) AS n_spans FROM n GROUP BY o_custkey, run')
def merged_order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a customer's orders, joined over gaps of up to a week."""
    s = _order_spans(spark, sf_dir).select("o_custkey", "start", F.coalesce("end", "start").alias("end"))
    return spans.merged(s, ["o_custkey"], "start", "end", 7)


@query(QUERIES, _SPANS + ', t AS (SELECT max("start") - 30 AS today FROM s) SELECT o_orderkey, "start" AS start_day, "end" AS end_day FROM s, t WHERE "start" < today AND "end" >= today AND "end" - "start" + 1 >= 4 ORDER BY "end", o_orderkey LIMIT 12')
def ongoing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begun before today, not over, four days or more; those that end soonest."""
    s = _order_spans(spark, sf_dir)
    today = F.broadcast(s.agg(F.date_sub(F.max("start"), 30).alias("today")))
    on = s.join(today, (F.col("start") < F.col("today")) & (F.col("end") >= F.col("today"))).where(F.datediff("end", "start") + 1 >= 4)
    return on.orderBy("end", "o_orderkey").limit(12).select("o_orderkey", F.col("start").alias("start_day"), F.col("end").alias("end_day"))


@query(QUERIES, "WITH w AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS week FROM orders), s AS (SELECT DISTINCT c_mktsegment AS segment FROM customer), n AS (SELECT c_mktsegment AS segment, date_trunc('week', o_orderdate)::DATE AS week, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT s.segment, w.week, coalesce(n.n, 0) AS n, CASE WHEN coalesce(n.n, 0) = 0 THEN 'empty' WHEN n.n < 6 THEN 'thin' ELSE 'ok' END AS status FROM s CROSS JOIN w LEFT JOIN n ON n.segment = s.segment AND n.week = w.week")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by weeks, zeros included, against a floor of six orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    n = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment", "week").agg(F.count("*").alias("n"))
    weeks = o.agg(F.array_sort(F.collect_set("week")).alias("weeks"))  # a few hundred days at most
    grid = c.select("segment").distinct().join(F.broadcast(weeks), F.lit(True)).select("segment", F.explode("weeks").alias("week"))
    full = grid.join(n, ["segment", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return full.withColumn("status", F.when(F.col("n") == 0, "empty").when(F.col("n") < 6, "thin").otherwise("ok"))


@query(QUERIES, "SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS supply, count(o_orderkey) AS demand, round(count(o_orderkey) / count(DISTINCT c_custkey)::DOUBLE, 4) AS per_supply FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) >= 50")
def demand_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    g = c.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("segment").agg(F.count("*").alias("supply"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("demand"))
    return g.where("demand >= 50").withColumn("per_supply", F.round(F.try_divide("demand", "supply"), 4))


@query(QUERIES, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query(QUERIES, "SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 365 DAY)")
def orders_shipped_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL '365' DAY")
    return o.join(line, (F.col("l_orderkey") == F.col("o_orderkey")) & late, "left_semi").select("o_orderkey", "o_orderpriority")


@query(QUERIES, "WITH a AS (SELECT l_orderkey AS k, min(CAST(l_shipdate AS DATE)) AS d, min(l_linestatus) AS s FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS s FROM orders), w AS (SELECT min(d) AS lo, max(d) AS hi FROM b) SELECT coalesce(a.k, b.k) AS k, a.d AS listed_day, b.d AS feed_day, CASE WHEN a.d IS NULL THEN 'missing' WHEN lo IS NULL OR a.d < lo OR a.d > hi THEN 'unknown' WHEN b.d IS NULL THEN 'phantom' WHEN a.d <> b.d THEN 'retime' WHEN a.s IS DISTINCT FROM b.s THEN 'changed' ELSE 'ok' END AS verdict FROM a FULL JOIN b ON a.k = b.k CROSS JOIN w")
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as listings against all orders as the feed; a small test has phantoms."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(F.to_date("l_shipdate")).alias("d"), F.min("l_linestatus").alias("s"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("s"))
    return matching.reconcile(a, b, "k", "d", "s")


_LAT, _LNG = "(CAST(44.5 AS DOUBLE) + CAST(c_custkey % 97 AS DOUBLE) / CAST(97 AS DOUBLE))", "(CAST(-93.8 AS DOUBLE) + CAST(c_custkey % 89 AS DOUBLE) / CAST(89 AS DOUBLE))"
#: Fixed values of this fixture: 16 centroids on a grid.
_CENTRES = [(i, f"hood-{i:02d}", 44.55 + 0.25 * (i // 4), -93.75 + 0.25 * (i % 4), 12.0 + i) for i in range(16)]
_VALUES = ", ".join(f"({i}, '{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {r!r}::DOUBLE)" for i, n, a, b, r in _CENTRES)


@query(QUERIES, f"WITH p AS (SELECT c_custkey, {_LAT}::DOUBLE AS lat, {_LNG}::DOUBLE AS lng FROM customer), c(position, centre, clat, clng, radius) AS (VALUES {_VALUES}), d AS (SELECT p.c_custkey, position, centre, radius, 2 * 6371.0 * asin(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clng - lng) / 2), 2))) AS km FROM p, c), n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, position) AS rn FROM d WHERE km <= radius) SELECT p.c_custkey, n.centre, round(n.km, 6) AS km FROM p LEFT JOIN n ON n.c_custkey = p.c_custkey AND rn = 1")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived points against centroids with radii of their own."""
    p = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"cast({_LAT} AS double)").alias("lat"), F.expr(f"cast({_LNG} AS double)").alias("lng"))
    return matching.nearest(p, spark.createDataFrame(_CENTRES, "position int, centre string, lat double, lng double, radius_km double"), "c_custkey")


@query(QUERIES, "SELECT n_regionkey AS region, string_agg(n_name, '; ' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1")
def listed_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names"), F.count("*").alias("n"))


@query(QUERIES, "WITH g AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2) SELECT nation, segment, n FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, first) AS rn FROM g) WHERE rn = 1")
def usual_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent segment of each nation, the one seen first of equals."""
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    return g.groupBy("nation").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "segment")).alias("b")).select("nation", F.col("b.segment").alias("segment"), (-F.col("b.m")).alias("n"))


@query(QUERIES, "SELECT c_mktsegment AS segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM customer GROUP BY 1")
def segment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query(QUERIES, "SELECT p_partkey, substr(sha256(p_name || '|' || replace(lower(p_brand), '#', '') || '|1995-01-01'), 1, 32) AS listing_key, CASE p_partkey % 8 WHEN 0 THEN 'Free' WHEN 1 THEN '$$' WHEN 2 THEN 'Free' WHEN 3 THEN '$' WHEN 4 THEN '$$$' WHEN 5 THEN '$$' WHEN 6 THEN 'Free' ELSE CASE WHEN p_retailprice < 20 THEN '$' WHEN p_retailprice < 75 THEN '$$' ELSE '$$$' END END AS tier FROM part")
def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing keys of parts, and the tiers of price texts of every kind."""
    p = table(spark, sf_dir, "part")
    texts = [F.lit(x) for x in ("free entry", "", "$0", "$15-$80", "$75.00", "donation", "0.00")]
    price = F.coalesce(F.get(F.array(*texts), (F.col("p_partkey") % 8).cast("int")), F.format_string("$%.2f", "p_retailprice"))
    return p.select("p_partkey", X.listing_key(F.col("p_name"), F.col("p_brand"), F.lit("1995-01-01").cast("date")).alias("listing_key"), X.price_tier(price).alias("tier"))


@query(QUERIES, "SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, round(avg(c_acctbal), 4) AS balance FROM customer GROUP BY 1")
def content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@query(QUERIES, "SELECT o_orderkey, o_orderstatus AS before, 'X' AS after FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AND o_orderstatus <> 'X'")
def cancel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of a status change by key list."""
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return snapshots.change_status(table(spark, sf_dir, "orders"), keys, "o_orderkey", "o_orderstatus", "X")[1]


@query(QUERIES, "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY 1")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_totalprice")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
