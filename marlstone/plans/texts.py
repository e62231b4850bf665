"""Queries on text folding, search and scalar parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import identity, rules, search
from marlstone.plans.registry import query
from marlstone.sources import shared
from marlstone.sources.tables import table

#: Fold in SQL.
_FOLD = r"trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[\s\p{{Z}}]+', ' ', 'g'))"


def _fold(column: str) -> str:
    return _FOLD.format(column)


@query(f"SELECT doc_id, {_fold('text')} AS folded FROM documents")
def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, upper(replace({_fold('text')}, 'ß', 'ss')) AS key FROM documents")
def fold_key_upper(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.key_upper(F.col("text")).alias("key"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace({_fold('text')}, '[^a-z0-9-]+', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS key FROM documents")
def fold_key_strict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.key_strict(F.col("text")).alias("key"))


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN upper(c_mktsegment) END AS key FROM customer")
def key_or_null(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", tx.key_or_null(name).alias("key"))


@query(f"SELECT doc_id, lang FROM documents WHERE {_fold('text')} LIKE '%cion_de%'")
def folded_substring(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(tx.contains_folded(F.col("text"), "CIÓN_de ")).select("doc_id", "lang")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def folded_equality(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(tx.equals_folded(F.col("c_mktsegment"), " Búilding ")).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(nullif(p_brand, 'Brand#1')) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def multi_or_search(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    brand = F.nullif("p_brand", F.lit("Brand#1"))
    return parts.where(tx.any_contains_folded([F.col("p_name"), brand, F.col("p_type")], "RÍNG")).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_'")
def raw_like(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_brand").like("Brand#1_")).select("p_partkey", "p_brand")


@query("""
SELECT p_partkey,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_retailprice END AS price,
       CASE WHEN lower(trim(p_type)) IN ('', 'nan', 'none', '<na>', 'economy') THEN NULL ELSE trim(p_type) END AS kind
FROM part""")
def numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Decimal commas back to numbers; what isn't one is null."""
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = F.when(F.col("p_partkey") % 3 == 0, "x").when(F.col("p_partkey") % 3 == 1, F.replace(price, F.lit("."), F.lit(",")))
    return table(spark, sf, "part").select("p_partkey", tx.decimal_comma(raw).alias("price"), tx.null_if_blank(F.col("p_type"), "economy").alias("kind"))


@query("SELECT o_orderkey, CASE WHEN length(k) < 5 THEN lpad(k, 5, '0') ELSE k END AS code FROM (SELECT o_orderkey, CAST(o_orderkey * 7 AS VARCHAR) AS k FROM orders)")
def zero_pad(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat((F.col("o_orderkey") * 7).cast("string"), F.lit(".0"))
    return table(spark, sf, "orders").select("o_orderkey", tx.zero_padded(code, 5).alias("code"))


@query("""
SELECT o_orderkey,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
       strftime(o_orderdate, '%Y-%m-%d') AS found
FROM orders""")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    """Day-first dates to ISO text, the 31st of February to null, and a date inside text."""
    raw = F.when(F.col("o_orderkey") % 5 == 0, "31/02/1999").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    inside = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or 2099-01-01"))
    return table(spark, sf, "orders").select("o_orderkey", tx.day_first_date(raw).alias("iso"), tx.first_date(inside).alias("found"))


@query("""
SELECT s_suppkey,
       CASE WHEN s_nationkey = 0 THEN (CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END)
            WHEN s_suppkey % 2 = 0 THEN n_name || ' ' || r_name
            ELSE s_name || ', ' || n_name || ' ' || r_name END AS address
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def address(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    street = F.when(F.col("s_suppkey") % 2 != 0, F.col("s_name"))
    nation, region = (F.when(F.col("s_nationkey") != 0, F.col(c)) for c in ("n_name", "r_name"))
    return rows.select("s_suppkey", tx.address([street], [nation, region]).alias("address"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN p_brand WHEN p_size % 4 = 2 THEN p_brand || ' - ' || p_name END AS label FROM part")
def label(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("p_size") % 4
    code = F.when(turn.isin(1, 2), F.col("p_brand")).otherwise("")
    name = F.when(turn.isin(0, 2), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", tx.label(code, name).alias("label"))


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'Clicked' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' event' END AS label
FROM events""")
def code_map(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("event_type") == "click", "click").otherwise(F.concat("event_type", F.lit("_EVENT")))
    return table(spark, sf, "events").select("event_id", tx.code_label(code, {"click": "Clicked"}).alias("label"))


@query("""
SELECT c_custkey,
       split_part(n, ' ', 1) AS first,
       CASE WHEN len(string_split(n, ' ')) > 2 THEN array_to_string(list_slice(string_split(n, ' '), 2, len(string_split(n, ' ')) - 1), ' ') END AS middle,
       CASE WHEN len(string_split(n, ' ')) > 1 THEN list_extract(string_split(n, ' '), -1) END AS last,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS inside,
       c_mktsegment AS before, CAST(c_custkey AS VARCHAR) AS after,
       c_name AS cut
FROM (SELECT *, trim(concat_ws(' ', c_name, CASE WHEN c_custkey % 3 > 0 THEN 'mid' END, CASE WHEN c_custkey % 3 > 1 THEN c_mktsegment END)) AS n FROM customer)""")
def name_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Names to parts, the last bracket, the last separator, and the cut at the first of several marks."""
    k = F.col("c_custkey")
    name = F.concat_ws("  ", "c_name", F.when(k % 3 > 0, "mid"), F.when(k % 3 > 1, F.col("c_mktsegment")))
    first, middle, last = tx.name_parts(name)
    bracket = F.when(k % 2 == 0, F.concat(F.lit("a (x) b ("), F.col("c_nationkey").cast("string"), F.lit(") c"))).otherwise("none")
    before, after = tx.right_split(F.concat("c_mktsegment", F.lit(" - "), k.cast("string")), " - ")
    cut = tx.cut_at_first(F.concat("c_name", F.lit(" tel 5, mail x")), ["mail", "tel"])
    return table(spark, sf, "customer").select("c_custkey", first.alias("first"), middle.alias("middle"), last.alias("last"), tx.last_parenthesised(bracket).alias("inside"), before.alias("before"), after.alias("after"), cut.alias("cut"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 AS is_even FROM events")
def json_metric(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("is_even"))


@query("SELECT event_id, event_id % 3 = 0 AS is_number, strftime(ts, '%d/%m/%Y') AS shown FROM events")
def tokens_and_display(spark: SparkSession, sf: str) -> DataFrame:
    token = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("'"), F.col("event_id").cast("string"), F.lit(",5'"))).otherwise("1a")
    return table(spark, sf, "events").select("event_id", tx.quoted_number(token).alias("is_number"), F.date_format("ts", "dd/MM/yyyy").alias("shown"))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """A folded search of several columns by their grams."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    index = search.build(parts, shared.new_path(spark, "grams"), "p_partkey", ["p_name", "p_brand", "p_type"], gram_parts=16, row_parts=8)
    return index.search("RÍNG")


@query(f"SELECT doc_id, n_chars FROM documents WHERE {_fold('text')} LIKE '%right%res_rv%'")
def indexed_text_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of whole texts with wildcards between its literal runs."""
    index = search.build(table(spark, sf, "documents").select("doc_id", "text", "n_chars"), shared.new_path(spark, "grams"), "doc_id", ["text"], gram_parts=16, row_parts=8)
    return index.search("Right%RES_RV").select("doc_id", "n_chars")


@query(r"""
WITH named AS (SELECT DISTINCT p_brand || ' / ' || (p_partkey % 130) AS option FROM part),
runs AS (SELECT option, list_transform(regexp_extract_all(option, '([0-9]+|[^0-9]+)'), lambda x: regexp_replace(x, '^0+([0-9])', '\1')) AS runs FROM named),
keyed AS (SELECT option, array_to_string(list_transform(runs, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(x) AS VARCHAR), 4, '0') || x ELSE x END), '') AS key FROM runs)
SELECT option, key, lag(option) OVER (ORDER BY key, option) AS before FROM keyed""")
def natural_options(spark: SparkSession, sf: str) -> DataFrame:
    """Options with numbers in their names, each with the one before it: 9 comes before 10."""
    option = F.concat("p_brand", F.lit(" / "), (F.col("p_partkey") % 130).cast("string"))
    named = table(spark, sf, "part").select(option.alias("option")).distinct()
    keyed = identity.numbered(named.withColumn("key", tx.natural_key(F.col("option"))), ["key", "option"], "at")
    before = keyed.select((F.col("at") + 1).alias("at"), F.col("option").alias("before"))
    return keyed.join(before, "at", "left").select("option", "key", "before")


_SPELT = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') WHEN 2 THEN replace(upper(p_name), 'A', 'Ä') ELSE p_name END"


@query(f"SELECT strip_accents(lower(name)) AS label, count(*) AS n, count(DISTINCT name) AS n_spellings FROM (SELECT {_SPELT} AS name FROM part) GROUP BY 1")
def alike_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Names that differ in case and accents only are one group, by collation."""
    name = F.col("p_name")
    spelt = F.when(F.col("p_partkey") % 4 == 0, F.upper(name)).when(F.col("p_partkey") % 4 == 1, F.replace(name, F.lit("e"), F.lit("é"))).when(F.col("p_partkey") % 4 == 2, F.replace(F.upper(name), F.lit("A"), F.lit("Ä"))).otherwise(name)
    rows = table(spark, sf, "part").select(spelt.alias("name"))
    groups = rows.groupBy(tx.alike(F.col("name")).alias("key")).agg(F.min(tx.fold(F.col("name"))).alias("label"), F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("n_spellings"))
    return groups.select("label", "n", "n_spellings")


_NAMED = "CASE WHEN o_orderkey % 4 = 0 THEN 'list_' || strftime(o_orderdate, '%Y_%m') || '.pdf' WHEN o_orderkey % 4 = 1 THEN 'list_2024_13.pdf' ELSE 'doc.pdf' END"
_PREVIEW = "CASE WHEN o_orderkey % 3 = 0 THEN 'signed on 31/2/2024 or 1/3/2024' WHEN o_orderkey % 3 = 1 THEN 'no day' ELSE 'of ' || strftime(o_orderdate, '%-d/%-m/%Y') || '.' END"


@query(f"""
WITH given AS (SELECT o_orderkey, {_NAMED} AS name, {_PREVIEW} AS preview, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') END AS published FROM orders),
read AS (SELECT o_orderkey, regexp_extract(name, '_((?:19|20)[0-9][0-9]_(?:0[1-9]|1[0-2]))[.]', 1) AS m, regexp_extract(preview, '([0-9]+/[0-9]+/[0-9]+)', 1) AS p, coalesce(published, '') AS t FROM given)
SELECT o_orderkey, CASE WHEN m <> '' THEN 'name' WHEN p <> '' THEN 'preview' WHEN t <> '' THEN 'publication' END AS origin, CASE WHEN m <> '' THEN m WHEN p <> '' THEN p WHEN t <> '' THEN t END AS text,
  CASE WHEN m <> '' THEN replace(m, '_', '-') || '-01' WHEN p <> '' THEN strftime(try_strptime(p, '%d/%m/%Y'), '%Y-%m-%d') WHEN t <> '' THEN strftime(try_strptime(t, '%d/%m/%Y'), '%Y-%m-%d') END AS iso FROM read""")
def inferred_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A date from the first place that has one: the month in a file's name, the first date of a text, what was published; one that doesn't exist keeps its text."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.when(k % 4 == 0, F.concat(F.lit("list_"), F.date_format(day, "yyyy_MM"), F.lit(".pdf"))).when(k % 4 == 1, "list_2024_13.pdf").otherwise("doc.pdf")
    preview = F.when(k % 3 == 0, "signed on 31/2/2024 or 1/3/2024").when(k % 3 == 1, "no day").otherwise(F.concat(F.lit("of "), F.date_format(day, "d/M/yyyy"), F.lit(".")))
    rows = table(spark, sf, "orders").select("o_orderkey", name.alias("name"), preview.alias("preview"), F.when(k % 5 > 0, F.date_format(day, "d/M/yyyy")).alias("published"))
    month, first, published = tx.month_in_name(F.col("name")), tx.first_day_first(F.col("preview")), F.col("published")
    told = rules.inferred(
        [
            ("name", month, F.concat(F.translate(month, "_", "-"), F.lit("-01"))),
            ("preview", first, tx.padded_day_first(first)),
            ("publication", published, tx.padded_day_first(published)),
        ]
    )
    return rows.select("o_orderkey", told.alias("d")).select("o_orderkey", "d.origin", "d.text", F.col("d.value").alias("iso"))
