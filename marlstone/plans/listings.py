"""Queries on listings: optional filters, joins to dimensions, flags, pages, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import geo
from marlstone.functions import text as tx
from marlstone.operators import filters, joins, paging, rollup
from marlstone.plans.registry import query
from marlstone.sources.tables import by_key, table


@query("""
WITH page AS (
  SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day, c_name, n_name
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus = 'O' AND o_totalprice >= 100000
  ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 25)
SELECT page.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items FROM page""")
def order_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A page of filtered orders with their customer and nation; items are counted for the page's orders only."""
    orders = filters.all_given(
        table(spark, sf, "orders"),
        [filters.optional("O", F.col("o_orderstatus") == "O"), filters.optional(100000, F.col("o_totalprice") >= 100000), filters.optional("", F.col("o_orderpriority") == "")],
    )
    rows = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    keys = paging.order_by({"price": F.col("o_totalprice"), "date": F.col("o_orderdate")}, "price", True, "date", F.col("o_orderkey"))
    found = paging.page(rows, keys, 50, 25).select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"), "c_name", "n_name")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    counted = items.join(F.broadcast(found.select("o_orderkey")), "o_orderkey", "left_semi")  # a page has 50 rows
    return rollup.with_child_counts(found, counted, ["o_orderkey"], n_items=F.count(F.lit(1)))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Two filters are given; an empty text and the id 0 are not."""
    given = [
        filters.optional("F", F.col("o_orderstatus") == "F"),
        filters.optional("", F.col("o_orderpriority") == ""),
        filters.optional(0, F.col("o_custkey") == 0),
        filters.optional(250000, F.col("o_totalprice") > 250000),
    ]
    return filters.all_given(table(spark, sf, "orders"), given).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE left(o_orderpriority, 2) = '1-'")
def prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.startswith("o_orderpriority", F.lit("1-"))).select("o_orderkey", "o_orderpriority")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return by_key(table(spark, sf, "customer"), "c_custkey", 42)


@query("SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) WHERE d >= '1997-01-01' AND d <= '1997-06-30'")
def string_date_range(spark: SparkSession, sf: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 10 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf, "orders").where(filters.day_range(F.col("o_orderdate"), "1997-01-01", "1997-06-30")).select("o_orderkey", day.alias("d"))
    return rows.where(filters.text_range(F.col("d"), "1997-01-01", "1997-06-30"))


@query("SELECT s_suppkey, status FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'available' ELSE 'awarded' END AS status FROM supplier) WHERE coalesce(status, 'available') = 'available'")
def availability_guard(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("s_suppkey") % 3 == 1, "available").when(F.col("s_suppkey") % 3 == 2, "awarded")
    rows = table(spark, sf, "supplier").select("s_suppkey", status.alias("status"))
    return rows.where(filters.available(F.col("status"), include_all=False))


def _big_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))


def _slim_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def flag_exists(spark: SparkSession, sf: str) -> DataFrame:
    return filters.with_flag(_slim_orders(spark, sf), _big_items(spark, sf), ["o_orderkey"], True)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def flag_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    return filters.with_flag(_slim_orders(spark, sf), _big_items(spark, sf), ["o_orderkey"], False)


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45) AS has_big FROM orders")
def flag_column(spark: SparkSession, sf: str) -> DataFrame:
    marked = _big_items(spark, sf).distinct().withColumn("has_big", F.lit(True))
    return _slim_orders(spark, sf).join(marked, "o_orderkey", "left").select("o_orderkey", F.coalesce("has_big", F.lit(False)).alias("has_big"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (1, 3, 5, 8, 13, 21, 34)")
def in_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_custkey").isin([1, 3, 5, 8, 13, 21, 34])).select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON nullif(s_nationkey, 7) = n_nationkey")
def left_dim(spark: SparkSession, sf: str) -> DataFrame:
    key = F.nullif("s_nationkey", F.lit(7))
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), key == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


@query("SELECT s_suppkey, n_name FROM (SELECT s_suppkey, nullif(s_nationkey, 4) AS k FROM supplier) a JOIN (SELECT n_name, nullif(n_nationkey, 4) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def null_safe_join(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(4)).alias("k"))
    b = table(spark, sf, "nation").select("n_name", F.nullif("n_nationkey", F.lit(4)).alias("k"))
    return joins.null_safe(a, b, ["k"]).select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_replace(c_name, '[^0-9]', '', 'g') = regexp_replace(s_name, '[^0-9]', '', 'g')")
def derived_key_join(spark: SparkSession, sf: str) -> DataFrame:
    return joins.on_derived_key(table(spark, sf, "customer"), table(spark, sf, "supplier"), tx.digits(F.col("c_name")), tx.digits(F.col("s_name"))).select("c_custkey", "s_suppkey")


@query("""
SELECT o.k AS client, o_orderkey, event_id FROM
  (SELECT o_custkey AS k, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 30 + 1 END AS day FROM orders) o
  JOIN (SELECT user_id AS k, event_id, extract('day' FROM ts) AS day FROM events) e
  ON o.k = e.k AND (o.day IS NULL OR o.day = e.day)""")
def optional_key_join(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("client"), "o_orderkey", F.when(k % 3 > 0, (k % 30 + 1).cast("int")).alias("day"))
    right = table(spark, sf, "events").select(F.col("user_id").alias("client"), "event_id", F.dayofmonth("ts").alias("day"))
    return joins.with_optional_key(left, right, ["client"], "day").select("client", "o_orderkey", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 80")
def sorted_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return paging.page(rows, paging.order_by({"price": F.col("o_totalprice")}, "no such field", True, "price", F.col("o_orderkey")), 40, 80)


@query("SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) ORDER BY seg ASC NULLS LAST, c_custkey LIMIT 30 OFFSET 1180")
def nulls_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return paging.page(rows, paging.order_by({"seg": F.col("seg")}, "seg", False, "seg", F.col("c_custkey")), 30, 1180)


@query("""
SELECT c_custkey, n_orders FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer)
ORDER BY n_orders DESC NULLS LAST, c_custkey LIMIT 20""")
def computed_sort_page(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    rows = rollup.with_child_counts(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"], n_orders=F.count(F.lit(1)))
    return paging.page(rows, paging.order_by({"n": F.col("n_orders")}, "n", True, "n", F.col("c_custkey")), 20)


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def total(spark: SparkSession, sf: str) -> DataFrame:
    return paging.total(table(spark, sf, "orders").where("o_orderstatus = 'O'"))


@query("SELECT n_nationkey, n_customers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) ORDER BY n_customers DESC, n_nationkey LIMIT 1")
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    return paging.page(rows, [F.desc("n_customers"), F.asc("n_nationkey")], 1)


_PLACE = "CASE WHEN {k} % 7 > 0 THEN CAST({k} * 37 % 160 AS DOUBLE) - 80 END AS lat, CAST({k} * 53 % 340 AS DOUBLE) - 170 AS lon"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    lat = F.when(k % 7 > 0, (k * 37 % 160).cast("double") - 80)
    return table(spark, sf, "supplier").select("s_suppkey", lat.alias("lat"), ((k * 53 % 340).cast("double") - 170).alias("lon"))


@query(f"""
SELECT s_suppkey, CASE WHEN lat IS NOT NULL THEN round(2 * 6371.0088 * asin(sqrt(least(1.0,
    sin(radians(40.4 - lat) / 2) * sin(radians(40.4 - lat) / 2)
    + cos(radians(lat)) * cos(radians(40.4)) * sin(radians(-3.7 - lon) / 2) * sin(radians(-3.7 - lon) / 2)))), 2) END AS km
FROM (SELECT s_suppkey, {_PLACE.format(k='s_suppkey')} FROM supplier)""")
def geo_distance(spark: SparkSession, sf: str) -> DataFrame:
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(40.4), F.lit(-3.7))
    return _places(spark, sf).select("s_suppkey", km.alias("km"))


@query(f"""
SELECT s_suppkey, lat FROM (SELECT s_suppkey, {_PLACE.format(k='s_suppkey')} FROM supplier)
ORDER BY lat IS NULL, (lat - 40.5) * (lat - 40.5) + (lon + 3.5) * (lon + 3.5) DESC, s_suppkey LIMIT 95""")
def geo_null_last(spark: SparkSession, sf: str) -> DataFrame:
    square = geo.planar_square(F.col("lat"), F.col("lon"), F.lit(40.5), F.lit(-3.5))
    keys = paging.nearest(F.col("lat"), square, F.asc("s_suppkey"), descending=True)
    return paging.page(_places(spark, sf), keys, 95).select("s_suppkey", "lat")


@query("SELECT o_orderkey, min(l_partkey) AS first_part, min(strftime(l_shipdate, '%Y-%m-%d')) AS first_ship FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def collapsed_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Least child attributes beside each parent, without multiplying parents first."""
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return rollup.with_child_counts(table(spark, sf, "orders").select("o_orderkey"), items, ["o_orderkey"], first_part=F.min("l_partkey"), first_ship=F.min(F.date_format("l_shipdate", "yyyy-MM-dd")))


@query(f"""
SELECT s_suppkey, km FROM (SELECT s_suppkey, CASE WHEN lat IS NOT NULL THEN round(2 * 6371.0088 * asin(sqrt(least(1.0,
    sin(radians(-33.9 - lat) / 2) * sin(radians(-33.9 - lat) / 2)
    + cos(radians(lat)) * cos(radians(-33.9)) * sin(radians(18.4 - lon) / 2) * sin(radians(18.4 - lon) / 2)))), 0) END AS km
  FROM (SELECT s_suppkey, {_PLACE.format(k='s_suppkey')} FROM supplier))
ORDER BY km DESC NULLS FIRST, s_suppkey DESC LIMIT 25 OFFSET 5""")
def exact_distance_page(spark: SparkSession, sf: str) -> DataFrame:
    """The whole order reversed: unknown places first, ties by key downwards."""
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(-33.9), F.lit(18.4), decimals=0)
    return paging.page(_places(spark, sf).select("s_suppkey", km.alias("km")), [F.desc_nulls_first("km"), F.desc("s_suppkey")], 25, 5)


@query(f"""
SELECT s_suppkey, CASE WHEN lat IS NOT NULL THEN printf('geo:%.6f,%.6f', lat, lon) END AS map_url,
  CASE WHEN lat IS NOT NULL THEN 'route:' || CASE WHEN from_lat IS NOT NULL THEN printf('%.6f,%.6f;', from_lat, from_lon) ELSE '' END || printf('%.6f,%.6f', lat, lon) END AS route_url,
  CASE WHEN lat IS NOT NULL AND from_lat IS NOT NULL THEN round(2 * 6371.0088 * asin(sqrt(least(1.0,
    sin(radians(from_lat - lat) / 2) * sin(radians(from_lat - lat) / 2)
    + cos(radians(lat)) * cos(radians(from_lat)) * sin(radians(from_lon - lon) / 2) * sin(radians(from_lon - lon) / 2)))), 2) END AS distance_km
FROM (SELECT s_suppkey, {_PLACE.format(k='s_suppkey')}, CASE WHEN s_suppkey % 5 > 0 THEN 51.25::DOUBLE END AS from_lat, 4.5::DOUBLE AS from_lon FROM supplier)""")
def geo_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Map link, way and distance of every place; every fifth has no origin."""
    origin = F.when(F.col("s_suppkey") % 5 > 0, 51.25)
    return geo.enriched(_places(spark, sf), "lat", "lon", origin, F.lit(4.5)).select("s_suppkey", "map_url", "route_url", "distance_km")


@query("""
SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus), '') AS statuses, count(o_orderkey) AS n_orders, max(o_totalprice) AS largest
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n_orders DESC, c_custkey LIMIT 20""")
def profile_sections(spark: SparkSession, sf: str) -> DataFrame:
    """One section of a profile for many subjects at once."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    people = table(spark, sf, "customer").select("c_custkey")
    rows = rollup.with_child_counts(people, orders, ["c_custkey"], n_orders=F.count(F.lit(1)), largest=F.max("o_totalprice"), statuses=F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ""))
    found = paging.page(rows, [F.desc("n_orders"), F.asc("c_custkey")], 20)
    return found.select("c_custkey", F.coalesce("statuses", F.lit("")).alias("statuses"), "n_orders", "largest")


_DEEP = [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", False)]


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 40 OFFSET 11000")
def deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A far page by counted ranges of the keys; the first key has five values."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return paging.deep_page(orders, _DEEP, limit=40, offset=11_000, enough=500)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE (o_orderpriority < '3-MEDIUM') OR (o_orderpriority = '3-MEDIUM' AND (o_totalprice > 100000 OR o_totalprice = 100000 AND o_orderkey > 77)) ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 40")
def page_after(spark: SparkSession, sf: str) -> DataFrame:
    """The page behind a known last row."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return paging.page_after(orders, _DEEP, ("3-MEDIUM", 100_000.0, 77), limit=40)
