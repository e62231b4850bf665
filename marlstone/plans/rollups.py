"""Queries on aggregates: child counts, tallies, unions aggregated again, latest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import filters, rollup, segments
from marlstone.plans.registry import query
from marlstone.sources.shared import written
from marlstone.sources.tables import table


@query("SELECT o_orderkey, count(l_orderkey) AS n_items, CAST(sum(l_quantity) AS DECIMAL(18,2)) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def child_counts(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    quantity = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,2)")
    return rollup.with_child_counts(table(spark, sf, "orders").select("o_orderkey"), items, ["o_orderkey"], n_items=F.count(F.lit(1)), quantity=quantity)


@query("""
SELECT n_nationkey,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers,
  (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS best_supplier
FROM nation""")
def child_counts_many(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select("n_nationkey")
    customers = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    suppliers = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    rows = rollup.with_child_counts(nations, customers, ["n_nationkey"], n_customers=F.count(F.lit(1)))
    return rollup.with_child_counts(rows, suppliers, ["n_nationkey"], n_suppliers=F.count(F.lit(1)), best_supplier=F.max("s_acctbal"))


@query("SELECT r_name, n_name, count(*) AS n, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are counted by key before the small dimensions are joined."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("best"))
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return counts.join(places, "n_nationkey").groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_high FROM events GROUP BY 1")
def conditional_sum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("n_high"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Two distinct counts; each is small per type, so Spark's expansion stays cheap."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("SELECT p_brand, arg_min(p_name, p_partkey) AS label FROM part WHERE p_brand IS NOT NULL AND p_brand <> '' GROUP BY 1")
def distinct_options(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.options(table(spark, sf, "part"), "p_brand", F.col("p_name"), F.col("p_partkey"))


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '' ORDER BY 1")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderpriority").where("o_orderpriority is not null and o_orderpriority <> ''")
    return rows.distinct().orderBy("o_orderpriority")


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P
FROM orders GROUP BY 1""")
def status_tally(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.tally(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"], ["o_orderpriority"])


_UNION = """
  SELECT c_nationkey AS nation, 'customer' AS kind, count(*) AS n_customer, 0 AS n_supplier, max(c_name) AS last_name FROM customer GROUP BY 1
  UNION ALL
  SELECT s_nationkey, 'supplier', 0, count(*), max(s_name) FROM supplier WHERE s_suppkey % 4 > 0 GROUP BY 1"""


def _kinds(spark: SparkSession, sf: str) -> list[DataFrame]:
    customers = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_customer"), F.max("c_name").alias("last_name"))
    suppliers = table(spark, sf, "supplier").where("s_suppkey % 4 > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_supplier"), F.max("s_name").alias("last_name"))
    return [customers.withColumn("kind", F.lit("customer")), suppliers.withColumn("kind", F.lit("supplier"))]


@query(f"SELECT nation, CAST(sum(n_customer) AS BIGINT) AS n_customer, CAST(sum(n_supplier) AS BIGINT) AS n_supplier, max(last_name) AS last_name FROM ({_UNION}) GROUP BY 1")
def union_reagg(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.union_reaggregate(_kinds(spark, sf), ["nation"], ["n_customer", "n_supplier"], ["last_name"])


@query(f"SELECT nation, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ({_UNION}) GROUP BY 1")
def source_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.union_reaggregate(_kinds(spark, sf), ["nation"], [], [], kind="kind").select("nation", "kinds")


@query("""
SELECT n_orders, n_open, last_order, n_events, n_errors FROM
  (SELECT count(*) AS n_orders, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_open, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_order FROM orders WHERE o_custkey = 7)
  CROSS JOIN (SELECT count(*) AS n_events, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_errors FROM events WHERE user_id = 7)""")
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Two one-row aggregates side by side."""
    orders = table(spark, sf, "orders").where("o_custkey = 7").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_order"))
    events = table(spark, sf, "events").where("user_id = 7").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return orders.crossJoin(events)


@query("""
SELECT c_custkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a >= b THEN a ELSE b END AS latest FROM customer
LEFT JOIN (SELECT o_custkey, max(strftime(o_orderdate, '%Y-%m-%d')) AS a FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, max(strftime(ts, '%Y-%m-%d')) AS b FROM events GROUP BY 1) ON user_id = c_custkey""")
def nullable_max(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("a"))
    b = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("b"))
    rows = table(spark, sf, "customer").select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left")
    return rows.select("c_custkey", rollup.latest_of(F.col("a"), F.col("b")).alias("latest"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.greatest_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("""
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 > 0 THEN ts END DESC NULLS LAST, event_id DESC) AS rn
  FROM events WHERE event_type = 'purchase') WHERE rn = 1""")
def latest_success(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase of each user; unfinished ones come last."""
    rows = table(spark, sf, "events").where("event_type = 'purchase'").withColumn("finished", F.when(F.col("event_id") % 5 > 0, F.col("ts")))
    return rollup.first_per_key(rows, ["user_id"], [F.desc_nulls_last("finished"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def rolling_count(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-2 * 86_400_000_000, 0)
    return table(spark, sf, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n_recent"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') = (SELECT max(strftime(o_orderdate, '%Y-%m-%d')) FROM orders WHERE o_orderstatus = 'O')")
def latest_date_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    last = orders.where("o_orderstatus = 'O'").agg(F.max("o_orderdate")).first()[0]  # one value, so that the filter reaches the scan
    day = last.date().isoformat() if last else None
    return orders.where(filters.day_range(F.col("o_orderdate"), day, day) if day else F.lit(False)).select("o_orderkey", "o_custkey")


@query("""
SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ';' ORDER BY o_orderkey), '') AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1""")
def nested_children(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey")
    children = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = rollup.nested(parents, children, ["c_custkey"], ["o_orderkey", "o_orderstatus"], "orders")
    flat = F.array_join(F.transform("orders", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), ";")
    return rows.select("c_custkey", flat.alias("orders"))


_KEY = "trim(regexp_replace(lower(c_name), '[^a-z0-9-]+', ' ', 'g'))"


@query(f"""
WITH people AS (SELECT c_custkey, {_KEY} AS key, c_name AS display FROM customer WHERE lower(c_name) LIKE '%r 0000001%' OR {_KEY} LIKE '%r 0000001%')
SELECT key, display, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_won) AS BIGINT) AS n_won, CAST(sum(coalesce(n_types, 0)) AS BIGINT) AS n_types, max(latest) AS latest, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (
  SELECT key, display, 'order' AS kind, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_won, NULL::BIGINT AS n_types, max(strftime(o_orderdate, '%Y-%m-%d')) AS latest
  FROM people JOIN orders ON o_custkey = c_custkey GROUP BY ALL
  UNION ALL
  SELECT key, display, 'event', count(*), count(*) FILTER (event_type = 'purchase'), count(DISTINCT event_type), max(strftime(ts, '%Y-%m-%d'))
  FROM people JOIN events ON user_id = c_custkey GROUP BY ALL)
GROUP BY 1, 2 ORDER BY n DESC, display LIMIT 20""")
def person_search(spark: SparkSession, sf: str) -> DataFrame:
    """People whose name or search key holds a text, with partial counts of two sources united and aggregated again, best first."""
    name, key = F.col("c_name"), tx.key_strict(F.col("c_name"))
    people = table(spark, sf, "customer").where(tx.any_contains_folded([name, key], "R 0000001")).select("c_custkey", key.alias("key"), name.alias("display"))

    def part(rows: DataFrame, kind: str, at: str, **more: Column) -> DataFrame:
        counts = rows.join(people, "c_custkey").groupBy("key", "display").agg(F.count(F.lit(1)).alias("n"), F.max(F.date_format(at, "yyyy-MM-dd")).alias("latest"), *(c.alias(n) for n, c in more.items()))
        return counts.withColumn("kind", F.lit(kind))

    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    events = table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey")
    parts = [
        part(orders, "order", "o_orderdate", n_won=F.count_if(F.col("o_orderstatus") == "F")),
        part(events, "event", "ts", n_won=F.count_if(F.col("event_type") == "purchase"), n_types=F.count_distinct("event_type")),
    ]
    found = rollup.union_reaggregate(parts, ["key", "display"], ["n", "n_won", "n_types"], ["latest"], kind="kind")
    return found.orderBy(F.desc("n"), "display").limit(20)


@query(f"""
WITH person AS (SELECT c_custkey, c_name FROM customer WHERE {_KEY} = 'customer 000000007'),
placed AS (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN person ON o_custkey = c_custkey),
seen AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events JOIN person ON user_id = c_custkey)
SELECT 'person' AS section, NULL::BIGINT AS ref, (SELECT max(day) FROM (SELECT day FROM placed UNION ALL SELECT day FROM seen)) AS day,
  (SELECT c_name FROM (SELECT c_name, count(*) AS n FROM person GROUP BY 1) ORDER BY n DESC, c_name LIMIT 1) AS detail, (SELECT count(*) FROM placed) + (SELECT count(*) FROM seen) AS n_rows WHERE EXISTS (SELECT 1 FROM person)
UNION ALL SELECT 'orders', o_orderkey, day, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) FROM placed
UNION ALL SELECT 'items', l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), CAST(l_partkey AS VARCHAR), NULL FROM lineitem JOIN placed ON l_orderkey = o_orderkey
UNION ALL SELECT 'events', event_id, day, event_type, NULL FROM seen""")
def full_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile_of(spark, sf, "Customer 000000007")


def profile_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """All that is known of the people of a name's key: (section, ref, day, detail, n_rows).

    The section `person` has the display name (the most frequent, then the first), the
    last day and the number of rows; `orders`, `items` and `events` have a row for each.
    No rows for a name that nobody has. What several sections need of a person is read
    once, into written tables.
    """
    person = written(table(spark, sf, "customer").where(tx.key_strict(F.col("c_name")) == tx.key_strict(F.lit(name))).select("c_custkey", "c_name"), "person")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    placed = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").join(person, "c_custkey").select(F.col("o_orderkey").alias("ref"), day("o_orderdate"), F.col("o_orderstatus").alias("detail"))
    placed = written(placed, "placed")
    seen = table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey").join(person, "c_custkey").select(F.col("event_id").alias("ref"), day("ts"), F.col("event_type").alias("detail"))
    seen = written(seen, "seen")
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "ref").join(placed.select("ref"), "ref").select("ref", day("l_shipdate"), F.col("l_partkey").cast("string").alias("detail"))
    items = written(items, "items")
    orders = rollup.with_child_counts(placed, items, ["ref"], n_rows=F.count(F.lit(1)))
    # names and rows are counted apart and added: one row each, so that the person's is there without rows, too
    named = person.groupBy("c_name").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("c_name", F.struct(-F.col("n"), "c_name")).alias("detail"), F.lit(0).cast("long").alias("n_rows"))
    counted = placed.select("day").unionByName(seen.select("day")).agg(F.max("day").alias("day"), F.count(F.lit(1)).alias("n_rows"))
    summary = named.unionByName(counted, allowMissingColumns=True).agg(F.max("detail").alias("detail"), F.max("day").alias("day"), F.sum("n_rows").alias("n_rows")).where("detail is not null")
    parts = {"person": summary, "orders": orders, "items": items, "events": seen}
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("section", F.lit(s)) for s, df in parts.items()))
    return united.select("section", "ref", "day", "detail", "n_rows")


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations")
def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.col("role").alias("line"))
    told = segments.with_next(rows, "conv_id", "next_role").withColumn("n_turns", F.count(F.lit(1)).over(W.partitionBy("conv_id")))
    return told.select("conv_id", F.col("line_no").alias("turn"), F.col("line").alias("role"), "next_role", "n_turns")
