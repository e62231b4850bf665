"""Queries on state: upserts, incremental work, sync outcomes, matching, lifecycle, events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import digests, identity, matching, resolve, state
from marlstone.plans.registry import query
from marlstone.sources import shared, sinks, versions
from marlstone.sources.tables import table
from marlstone.streaming import admission, outbox

AS_OF = "2024-02-01"


@query("SELECT sha256(text) AS sha, count(*) AS n, CAST(max(strlen(text)) AS BIGINT) AS size, substr(sha256(text), 1, 12) AS short FROM documents GROUP BY 1, 4")
def hash_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("size"))
    return rows.withColumn("short", F.substring("sha", 1, 12))


@query("""
WITH links AS (SELECT doc_id % 3 AS run, source || '/' || CAST(n_chars % 40 AS VARCHAR) AS url, doc_id AS pos, doc_id % 11 > 0 AS downloadable, CASE WHEN doc_id % 7 > 0 THEN sha256(text) END AS sha FROM documents),
known AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 4 = 0)
SELECT pos, url, CASE WHEN NOT downloadable THEN 'not_downloadable' WHEN turn > 1 THEN 'duplicate' WHEN l.sha IS NULL THEN 'error' WHEN k.sha IS NOT NULL THEN 'known' ELSE 'new' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY run, url ORDER BY pos) AS turn FROM links) l LEFT JOIN known k ON l.sha = k.sha""")
def sync_outcome(spark: SparkSession, sf: str) -> DataFrame:
    docs, k = table(spark, sf, "documents"), F.col("doc_id")
    sha = F.sha2("text", 256)
    url = F.concat("source", F.lit("/"), (F.col("n_chars") % 40).cast("string"))
    links = docs.select((k % 3).alias("run"), url.alias("url"), k.alias("pos"), (k % 11 > 0).alias("downloadable"), F.when(k % 7 > 0, sha).alias("sha"))
    return state.sync_outcomes(links, docs.where(k % 4 == 0).select(sha.alias("sha"))).select("pos", "url", "outcome")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0 AND CASE WHEN quality = 1 THEN 'v2' ELSE 'v1' END = 'v2')")
def incremental_todo(spark: SparkSession, sf: str) -> DataFrame:
    """A label stands for a run: not toxic means success, its quality tells the version."""
    runs = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, "success").otherwise("failed").alias("status"), F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("version"))
    return state.todo(table(spark, sf, "documents").select("doc_id", "source"), runs, ["doc_id"], "version", "v2")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance,
       CASE WHEN s_suppkey % 2 = 0 THEN '2024-01-01' ELSE '2024-02-01' END AS created,
       CASE WHEN s_suppkey % 3 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS updated
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Even keys are old, multiples of three new."""
    supplier, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    old = supplier.where(k % 2 == 0).select("s_suppkey", F.col("s_acctbal").alias("balance"), F.lit("2024-01-01").alias("created"), F.lit("2024-01-01").alias("updated"))
    new = supplier.where(k % 3 == 0).select("s_suppkey", (F.col("s_acctbal") + 1).alias("balance"), F.lit(AS_OF).alias("created"), F.lit(AS_OF).alias("updated"))
    return state.upsert(old, new, ["s_suppkey"], keep=["created"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    supplier, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    old = supplier.where(k % 2 == 0).select("s_suppkey", F.lit("old").alias("origin"))
    new = supplier.where(k % 3 == 0).select("s_suppkey", F.lit("new").alias("origin"))
    return state.insert_absent(old, new.unionByName(new), ["s_suppkey"])


@query("""
SELECT l_orderkey, l_partkey, l_quantity, 'old' AS origin FROM lineitem WHERE l_orderkey % 5 > 0
UNION ALL SELECT DISTINCT l_orderkey, l_partkey, 0.0, 'new' FROM lineitem WHERE l_orderkey % 5 = 0""")
def replace_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.lit("old").alias("origin"))
    new = items.where("l_orderkey % 5 = 0").select("l_orderkey", "l_partkey").distinct().select("*", F.lit(0.0).alias("l_quantity"), F.lit("new").alias("origin"))
    return state.replace_by_parent(items, new, ["l_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def unlink(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 0")
    return state.unlink(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '2023-12-01' ELSE '2024-02-01' END END AS since FROM customer")
def sticky_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    old = F.when(F.col("c_custkey") % 2 == 0, "2023-12-01")
    return table(spark, sf, "customer").select("c_custkey", state.sticky(old, F.lit(AS_OF), F.col("c_acctbal") < 0).alias("since"))


_MATCH = """
WITH wanted AS (SELECT o_orderkey AS id, o_custkey % 25 AS src, o_orderkey % 60 AS code, o_custkey % 5 AS center, o_orderpriority AS spec FROM orders),
pairs AS (SELECT id, s_suppkey AS offer, center = s_suppkey % 5 AS h1, spec = CASE WHEN s_suppkey % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END AS h2
  FROM wanted JOIN supplier ON src = s_nationkey AND code % 3 = s_suppkey % 3),
p0 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_first FROM pairs),
p1 AS (SELECT * FROM (SELECT *, bool_or(h1) OVER (PARTITION BY id) AS any1 FROM p0) WHERE h1 OR NOT any1),
p2 AS (SELECT * FROM (SELECT *, bool_or(h2) OVER (PARTITION BY id) AS any2 FROM p1) WHERE h2 OR NOT any2),
told AS (SELECT id, max(n_first) AS n_first, count(*) AS n_left, min(offer) AS offer FROM p2 GROUP BY 1)
"""


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    wanted = table(spark, sf, "orders").select(k.alias("id"), (F.col("o_custkey") % 25).cast("int").alias("src"), (k % 60 % 3).alias("code"), (F.col("o_custkey") % 5).alias("center"), F.col("o_orderpriority").alias("spec"))
    s = F.col("s_suppkey")
    offers = table(spark, sf, "supplier").select(s.alias("offer"), F.col("s_nationkey").alias("src"), (s % 3).alias("code"), (s % 5).alias("at"), F.when(s % 2 == 0, "5-LOW").otherwise("1-URGENT").alias("kind"))
    # offers that no step tells apart go as one, so an order meets ten pairs at most, however many offers there are
    alike = offers.groupBy("src", "code", "at", "kind").agg(F.min("offer").alias("offer"), F.count(F.lit(1)).alias("alike"))
    pairs = wanted.join(alike, ["src", "code"])
    return matching.matched(wanted, pairs, "id", "offer", [F.col("center") == F.col("at"), F.col("spec") == F.col("kind")], F.col("alike"))


@query(_MATCH + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_left IS NULL THEN 'no_match' WHEN n_first = 1 THEN 'exact' WHEN n_left = 1 THEN 'refined' ELSE 'ambiguous' END AS status FROM wanted LEFT JOIN told USING (id)) GROUP BY 1")
def match_status(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_MATCH + "SELECT id, offer FROM told WHERE n_left = 1")
def match_links(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).where("offer is not null").select("id", "offer")


_LIFE = """
WITH items AS (SELECT p_partkey AS code, p_size % 10 AS src, CASE WHEN p_partkey % 6 = 0 THEN 'awarded' ELSE 'available' END AS status,
    CASE WHEN p_partkey % 4 = 0 THEN '2023-11-05' END AS missing_since, CASE WHEN p_partkey % 6 = 0 THEN CAST(99 AS BIGINT) END AS closed_by FROM part),
awards AS (SELECT l_partkey AS code, min(l_orderkey) AS closing FROM lineitem WHERE l_quantity >= 50 GROUP BY 1),
visible AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_quantity <= 2),
looked AS (SELECT range AS src FROM range(0, 8)),
life AS (SELECT i.code, i.src,
    CASE WHEN a.code IS NOT NULL THEN 'awarded' WHEN v.code IS NOT NULL THEN 'available' WHEN k.src IS NOT NULL THEN 'not_visible' ELSE status END AS status,
    CASE WHEN a.code IS NOT NULL OR (v.code IS NULL AND k.src IS NOT NULL) THEN coalesce(missing_since, '2024-02-01') WHEN v.code IS NOT NULL THEN NULL ELSE missing_since END AS missing_since,
    CASE WHEN a.code IS NOT NULL THEN closing WHEN v.code IS NOT NULL OR k.src IS NOT NULL THEN NULL ELSE closed_by END AS closed_by
  FROM items i LEFT JOIN awards a ON a.code = i.code LEFT JOIN visible v ON v.code = i.code LEFT JOIN looked k ON k.src = i.src)
"""


def _life(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    items = table(spark, sf, "part").select(
        k.alias("code"),
        (F.col("p_size") % 10).cast("long").alias("src"),
        F.when(k % 6 == 0, "awarded").otherwise("available").alias("status"),
        F.when(k % 4 == 0, "2023-11-05").alias("missing_since"),
        F.when(k % 6 == 0, F.lit(99).cast("long")).alias("closed_by"),
    )
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "code")
    awards = lines.where("l_quantity >= 50").select("code", F.col("l_orderkey").alias("closing"))
    return state.lifecycle(items, awards, lines.where("l_quantity <= 2"), spark.range(8).toDF("src"), "code", "src", F.lit(AS_OF))


@query(_LIFE + "SELECT * FROM life")
def lifecycle_status(spark: SparkSession, sf: str) -> DataFrame:
    return _life(spark, sf)


@query(_LIFE + "SELECT count(*) AS n, count(*) FILTER (status = 'awarded') AS n_awarded, count(*) FILTER (status = 'available') AS n_available, count(*) FILTER (status = 'not_visible') AS n_not_visible, count(missing_since) AS n_missing FROM life")
def lifecycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    by_status = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("awarded", "available", "not_visible")]
    return _life(spark, sf).agg(F.count(F.lit(1)).alias("n"), *by_status, F.count("missing_since").alias("n_missing"))


@query("""
WITH history AS (SELECT o_custkey AS k, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'awarded' WHEN 'O' THEN 'pending' ELSE 'other' END AS status, o_orderdate AS day,
    coalesce(n, 0) AS n_assigned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_custkey % 3 > 0),
award AS (SELECT k, arg_max(id, row(day, id)) AS award_id FROM history WHERE status = 'awarded' AND n_assigned > 0 GROUP BY 1),
newest AS (SELECT k, arg_max(status, row(day, id)) AS status, arg_max(id, row(day, id)) AS id FROM history GROUP BY 1),
tried AS (SELECT user_id AS k, bool_or(event_type = 'purchase') AS selected FROM events GROUP BY 1)
SELECT c_custkey AS k,
  CASE WHEN award_id IS NOT NULL THEN 'awarded' WHEN status = 'pending' THEN 'pending' WHEN selected THEN 'selected_candidate' WHEN selected IS NOT NULL THEN 'candidate' ELSE 'no_data' END AS outcome,
  coalesce(award_id, CASE WHEN status = 'pending' THEN id END) AS decided_by
FROM customer LEFT JOIN award ON award.k = c_custkey LEFT JOIN newest ON newest.k = c_custkey LEFT JOIN tried ON tried.k = c_custkey""")
def outcome_resolver(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "awarded").when(F.col("o_orderstatus") == "O", "pending").otherwise("other")
    assigned = table(spark, sf, "lineitem").where("l_quantity >= 49").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf, "orders").where("o_custkey % 3 > 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("at"))
    history = orders.join(assigned, "id", "left").withColumn("n_assigned", F.coalesce("n", F.lit(0)))
    tried = table(spark, sf, "events").select(F.col("user_id").alias("k"), (F.col("event_type") == "purchase").alias("selected"))
    return resolve.outcomes(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), history, tried, "k", "awarded", ["awarded", "pending"])


def _tree_sql(name: str, rows: str, group: str, size: int, fan: int, levels: int) -> str:
    """The hash tree of (group, id, content) rows: {name}_blocks, and {name}_root with a row a group."""
    block = "CAST(floor({0} / {1}) AS BIGINT)"
    levels_sql = [f"""
{name}_blocks AS (SELECT {group}, {block.format("id", f"{size}.0")} AS block_no, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids,
  sha256(string_agg(id || ':' || sha256(content), ',' ORDER BY id)) AS digest FROM (SELECT DISTINCT {group}, id, content FROM ({rows})) GROUP BY 1, 2)"""]
    below = f"{name}_blocks"
    for k in range(levels):
        levels_sql.append(f"{name}_{k} AS (SELECT {group}, {block.format('block_no', f'{fan}.0')} AS block_no, sum(n) AS n, sha256(string_agg(digest, ',' ORDER BY block_no)) AS digest FROM {below} GROUP BY 1, 2)")
        below = f"{name}_{k}"
    levels_sql.append(f"{name}_root AS (SELECT {group}, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, ',' ORDER BY block_no)) AS digest FROM {below} GROUP BY 1)")
    return ",\n".join(levels_sql)


_CATEGORY = "CASE WHEN source IN ('src1', 'src2') THEN source || '_' || lang WHEN source = 'src3' THEN 'third' END"
_EVENT_ROWS = f"SELECT {_CATEGORY} AS category, doc_id AS id, '' AS content FROM documents WHERE {_CATEGORY} IS NOT NULL"


@query(f"""
WITH {_tree_sql("e", _EVENT_ROWS, "category", 64, 8, 2)}
SELECT category || ':' || r.digest AS event_key, category, r.n, CAST(r.n AS VARCHAR) || CASE WHEN r.n = 1 THEN ' new document' ELSE ' new documents' END AS body, block_no, ids
FROM e_root r JOIN e_blocks USING (category)""")
def event_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their ids, block by block."""
    category = F.when(F.col("source").isin("src1", "src2"), F.concat_ws("_", "source", "lang")).when(F.col("source") == "src3", "third")
    return state.event_batches(table(spark, sf, "documents"), category, "doc_id", ("new document", "new documents"), fan=8, levels=2)


@query("SELECT event_key, created FROM (SELECT CAST(event_id AS VARCHAR) AS event_key, strftime(ts, '%Y-%m-%d') AS created, event_type FROM events) WHERE event_type = 'error' ORDER BY created, event_key LIMIT 50")
def outbox_pending(spark: SparkSession, sf: str) -> DataFrame:
    outbox = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_key"), F.date_format("ts", "yyyy-MM-dd").alias("created"), F.when(F.col("event_type") == "error", "pending").otherwise("sent").alias("status"))
    return state.pending(outbox, 50).select("event_key", "created")


@query("""
WITH RECURSIVE requests AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT user_id, event_id, rn, TRUE AS admitted, [us] AS taken FROM requests WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, len(recent) < 3, CASE WHEN len(recent) < 3 THEN list_append(recent, us) ELSE recent END
  FROM (SELECT r.user_id, r.event_id, r.rn, r.us, list_filter(w.taken, lambda x: x > r.us - 86400000000) AS recent FROM walk w JOIN requests r ON r.user_id = w.user_id AND r.rn = w.rn + 1))
SELECT event_id, user_id, admitted FROM walk""")
def sliding_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Exact admission is recursive: a refused request doesn't count."""
    requests = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return admission.admit(requests, "user_id", "ts", "event_id", limit=3, seconds=86_400).select("event_id", "user_id", "admitted")


@query("""
SELECT o_orderkey AS run, o_custkey % 25 AS source, CASE WHEN n IS NULL THEN 'running' WHEN n_bad > 0 THEN 'failed' ELSE 'success' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS started, finished, coalesce(n, 0) AS n_seen, CAST(coalesce(n_new, 0) AS BIGINT) AS n_new, CASE WHEN n_bad > 0 THEN 'returned: ' || n_bad END AS error
FROM orders LEFT JOIN (SELECT l_orderkey, max(strftime(l_shipdate, '%Y-%m-%d')) AS finished, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS n_new, count(*) FILTER (l_returnflag = 'R') AS n_bad
  FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """An order stands for a started run, its items for what the run met; a returned one makes it fail."""
    started = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 25).alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started"))
    bad = F.count_if(F.col("l_returnflag") == "R")
    met = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(
        F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("finished"),
        F.count(F.lit(1)).alias("n_seen"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_new"),
        F.when(bad > 0, F.concat(F.lit("returned: "), bad.cast("string"))).alias("error"),
    )
    return state.run_log(started, met, ["run"])


#: What the known state lacks or has otherwise: src1 is gone now, src2 and src3 had every other twenty of ids only, of src4 some texts had another first letter.
_NOW = "SELECT source, doc_id AS id, text AS content FROM documents WHERE source <> 'src1'"
_BEFORE = "SELECT source, doc_id AS id, CASE WHEN source = 'src4' AND doc_id % 300 = 4 THEN '#' || substr(text, 2) ELSE text END AS content FROM documents WHERE source NOT IN ('src2', 'src3') OR doc_id // 20 % 2 = 0"
_STATES = f"""
WITH {_tree_sql("w", _NOW, "source", 64, 8, 2)},
{_tree_sql("b", _BEFORE, "source", 64, 8, 2)}
"""


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the known state and of the present one, by the documents' texts."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    known = F.when((F.col("source") == "src4") & (F.col("doc_id") % 300 == 4), F.concat(F.lit("#"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text"))
    before = docs.where("source not in ('src2', 'src3') or doc_id div 20 % 2 = 0")
    return digests.blocks(before, ["source"], "doc_id", known), digests.blocks(docs.where("source <> 'src1'"), ["source"], "doc_id", F.col("text"))


@query(_STATES + "SELECT source, CASE WHEN w.digest IS NULL THEN 'failed' WHEN w.digest = b.digest THEN 'unchanged' ELSE 'imported' END AS status FROM b_root b LEFT JOIN w_root w USING (source)")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    """A source whose content is the known one needs no import; one without content failed.

    Contents are compared by the roots of hash trees, so no task holds a source.
    """
    before, now = (digests.tree(x, ["source"], 8, 2)[-1].select("source", F.col("digest").alias(n)) for x, n in zip(_states(spark, sf), ("before", "now")))
    status = F.when(F.col("now").isNull(), "failed").when(F.col("now") == F.col("before"), "unchanged").otherwise("imported")
    return before.join(now, "source", "left").select("source", status.alias("status"))


@query(_STATES + """
SELECT source, block_no, CASE WHEN b.digest IS NULL THEN 'added' WHEN w.digest IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM b_blocks WHERE source IN (SELECT source FROM w_root)) b FULL JOIN (SELECT * FROM w_blocks WHERE source IN (SELECT source FROM b_root)) w USING (source, block_no) WHERE b.digest IS DISTINCT FROM w.digest""")
def changed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Which spans of ids an import has to read again."""
    before, now = _states(spark, sf)
    return digests.changed_blocks(before, now, ["source"], 8, 2)


@query("SELECT event_id, CAST(to_json({'event_id': event_id, 'user_id': user_id, 'value': value}) AS VARCHAR) AS payload FROM events")
def json_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their payload as JSON text."""
    return sinks.with_json(table(spark, sf, "events"), ["event_id", "user_id", "value"]).select("event_id", "payload")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS r_name FROM region UNION ALL SELECT 99, 'added'")
def seeded_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """A small dimension brought up to date from literal rows."""
    seed = spark.createDataFrame([(1, "renamed"), (99, "added")], "r_regionkey int, r_name string")
    return state.upsert(table(spark, sf, "region"), seed, ["r_regionkey"])


@query("""
SELECT 1 AS version, o_orderkey, o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END FROM orders
UNION ALL SELECT 3, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END FROM orders WHERE o_orderstatus <> 'P'""")
def committed_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two changes of the orders, and every version as it was committed: some rows replaced, then those of a status gone."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = versions.VersionedTable(spark, shared.new_path(spark, "orders"), ["o_orderkey"], buckets=8)
    kept.overwrite(orders)
    kept.replace_keys(orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice")))
    kept.delete_keys(orders.where("o_orderstatus = 'P'"))
    each = [kept.read(n).select(F.lit(n).alias("version"), "*") for n in kept.versions()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""
WITH old AS (SELECT c_custkey * 2 AS id, c_name FROM customer WHERE c_custkey % 3 = 0)
SELECT (SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY c_name) AS id, c_name, c_nationkey FROM customer WHERE c_name NOT IN (SELECT c_name FROM old)""")
def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that an insert by natural key gives: they go on from the greatest without a gap."""
    customer = table(spark, sf, "customer")
    old = customer.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("id"), "c_name")
    new = customer.select("c_name", "c_nationkey")
    return identity.insert_returning_ids(old, new.unionByName(new), ["c_name"], "id")


_NOTES = "CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'sent' ELSE 'seen' END"
_LEASE, _DELAY, _TRIES = 86_400, 21_600, 3
_CLAIMED = f"""CASE WHEN status = 'claimed' AND mark <= {{0}} THEN
    CASE WHEN tried + ({{0}} - mark) // {_LEASE + _DELAY} >= {_TRIES} THEN {{{{'status': 'failed', 'tried': {_TRIES}, 'mark': CAST(0 AS BIGINT)}}}}
      WHEN ({{0}} - mark) % {_LEASE + _DELAY} >= {_DELAY} THEN {{{{'status': 'claimed', 'tried': tried + ({{0}} - mark) // {_LEASE + _DELAY} + 1, 'mark': mark + (({{0}} - mark) // {_LEASE + _DELAY} + 1) * {_LEASE + _DELAY}}}}}
      ELSE {{{{'status': 'waiting', 'tried': tried + ({{0}} - mark) // {_LEASE + _DELAY}, 'mark': mark + ({{0}} - mark) // {_LEASE + _DELAY} * {_LEASE + _DELAY} + {_DELAY}}}}} END
  ELSE {{{{'status': status, 'tried': tried, 'mark': mark}}}} END"""


def _passed_sql(rows: str, now: str) -> str:
    """rows of (id, rn, sec, kind, status, tried, mark) with what time alone does up to now as p: a wait that ends is a claim, and leases run out by whole rounds."""
    begun = f"SELECT * REPLACE (CASE WHEN status = 'waiting' AND mark <= {now} THEN 'claimed' ELSE status END AS status, CASE WHEN status = 'waiting' AND mark <= {now} THEN tried + 1 ELSE tried END AS tried, CASE WHEN status = 'waiting' AND mark <= {now} THEN mark + {_LEASE} ELSE mark END AS mark) FROM ({rows})"
    return f"SELECT id, rn, sec, kind, {_CLAIMED.format(now).replace('{{', '{').replace('}}', '}')} AS p FROM ({begun})"


_END = "epoch(TIMESTAMP '2024-03-01')"


@query(f"""
WITH RECURSIVE records AS (SELECT user_id AS id, {_NOTES} AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events WHERE ts <= TIMESTAMP '2024-03-01'),
walk AS (
  SELECT id, rn, CASE WHEN kind = 'new' THEN 'claimed' END AS status, CAST(CASE WHEN kind = 'new' THEN 1 END AS BIGINT) AS tried, CASE WHEN kind = 'new' THEN sec + {_LEASE} END AS mark FROM records WHERE rn = 1
  UNION ALL
  SELECT id, rn,
    CASE WHEN p.status IS NULL THEN CASE WHEN kind = 'new' THEN 'claimed' END WHEN p.status IN ('claimed', 'waiting') AND kind = 'sent' THEN 'sent'
      WHEN p.status = 'claimed' AND kind = 'failed' THEN CASE WHEN p.tried >= {_TRIES} THEN 'failed' ELSE 'waiting' END ELSE p.status END,
    CASE WHEN p.status IS NULL THEN CASE WHEN kind = 'new' THEN 1 END ELSE p.tried END,
    CASE WHEN p.status IS NULL THEN CASE WHEN kind = 'new' THEN sec + {_LEASE} END WHEN p.status = 'claimed' AND kind = 'failed' THEN sec + {_DELAY} ELSE p.mark END
  FROM ({_passed_sql("SELECT r.id, r.rn, r.sec, r.kind, w.status, w.tried, w.mark FROM walk w JOIN records r ON r.id = w.id AND r.rn = w.rn + 1", "sec")}))
SELECT id AS user_id, p.status AS status, CAST(p.tried AS INTEGER) AS attempts FROM ({_passed_sql(f"SELECT id, rn, CAST({_END} AS BIGINT) AS sec, '' AS kind, status, tried, mark FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1", "sec")}) WHERE p.status IS NOT NULL""")
def outbox_states(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each user's event: a signup makes it, errors and purchases are what senders say, other rows nothing."""
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "sent").otherwise("seen")
    records = table(spark, sf, "events").select("user_id", "event_id", "ts", kind.alias("kind"))
    end = int(datetime(2024, 3, 1, tzinfo=timezone.utc).timestamp())
    return outbox.states(records, "user_id", "kind", "ts", "event_id", outbox.Terms(_LEASE, _DELAY, _TRIES), end)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN TRUE WHEN c_custkey % 5 = 0 THEN FALSE ELSE c_custkey % 3 > 0 END AS active,
  CASE WHEN c_custkey % 10 = 0 THEN '2024-03-01' WHEN c_custkey % 5 = 0 AND c_custkey % 3 > 0 THEN '2024-02-01' ELSE '2024-01-01' END AS updated FROM customer WHERE c_custkey % 7 > 0""")
def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as subscriptions: some end, some of these come back, some are deleted for good."""
    customer, k = table(spark, sf, "customer"), F.col("c_custkey")
    old = customer.select("c_custkey", (k % 3 > 0).alias("active"), F.lit("2024-01-01").alias("updated"))
    ended = state.deactivate(old, customer.where(k % 5 == 0), ["c_custkey"], "active", "updated", F.lit(AS_OF))
    back = customer.where(k % 10 == 0).select("c_custkey", F.lit(True).alias("active"), F.lit("2024-03-01").alias("updated"))
    return state.remove(state.upsert(ended, back, ["c_custkey"]), customer.where(k % 7 == 0), ["c_custkey"])
