"""Queries on documents and pages: rules, line streams, links, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.functions import urls
from marlstone.operators import automaton, dispatch, lines, peel, reach, rules, segments
from marlstone.plans.registry import query
from marlstone.sources import shared
from marlstone.sources.tables import table


@query("SELECT page_id, regexp_replace(url, '[;?#].*$', '') AS url FROM pages")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


@query("""SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) WHERE NOT regexp_matches(link, '^(?:$|#|javascript:|mailto:|tel:)')""")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("link"))


@query(r"""
SELECT page_id,
  regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(url, '[;?#].*$', ''), '^[a-z]+://[^/]*(/.*)?$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '__' || substr(sha256(html), 1, 12) || '.html' AS file,
  regexp_matches(lower(regexp_replace(url, '[;?#].*$', '')), '\.(?:html|pdf)$') AS downloadable
FROM pages""")
def filename(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    name = urls.versioned_name(urls.path(url), F.sha2("html", 256), ".html")
    return table(spark, sf, "pages").select("page_id", name.alias("file"), urls.has_extension(url, "html", "pdf").alias("downloadable"))


@query("""
SELECT page_id, link, CASE WHEN regexp_matches(link, '^[a-z]+:') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '^[a-z]+:') || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || link ELSE regexp_extract(url, '^[a-z]+://[^/?#]*(?:/[^?#]*/|/)?') || link END AS target
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) WHERE NOT regexp_matches(link, '^(?:$|#|javascript:|mailto:|tel:)')""")
def absolute_links(spark: SparkSession, sf: str) -> DataFrame:
    """Relative links against their page."""
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(urls.links(F.col("html"))).alias("link"))
    return rows.select("page_id", "link", urls.absolute(F.col("url"), F.col("link")).alias("target"))


@query("""
WITH found AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages),
parts AS (SELECT page_id, link, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[2:] AS segments FROM found)
SELECT page_id, link, site || '/' || array_to_string(list_concat(segments[:-2], [substr(link, 2)]), '/') AS beside, site || '/' || array_to_string(list_concat(segments[:-3], [substr(link, 2)]), '/') AS above FROM parts""")
def dotted_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links from their page's own folder, and from the folder above, by dot segments."""
    rows = table(spark, sf, "pages").select("page_id", "url", F.explode(urls.links(F.col("html"))).alias("link")).where(F.startswith("link", F.lit("/")))
    to = lambda dots: urls.absolute(F.col("url"), F.concat(F.lit(dots), F.col("link")))
    return rows.select("page_id", "link", to(".").alias("beside"), to("./x/../..").alias("above"))


@query("""
WITH RECURSIVE links AS (SELECT n_nationkey AS source, (n_nationkey * 3 + 1) % 25 AS target FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation WHERE n_regionkey = 1),
walk AS (SELECT 0 AS node, 0 AS depth UNION SELECT target, depth + 1 FROM walk JOIN links ON source = node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def bounded_reach(spark: SparkSession, sf: str) -> DataFrame:
    nations, k = table(spark, sf, "nation"), F.col("n_nationkey")
    links = nations.select(k.alias("source"), ((k * 3 + 1) % 25).alias("target")).unionByName(nations.where("n_regionkey = 1").select(k.alias("source"), ((k + 7) % 25).alias("target")))
    return reach.reachable(links, nations.where("n_nationkey = 0").select("n_nationkey"), 4)


_F = "lower(text)"


@query(f"""
SELECT doc_id, CASE WHEN contains({_F}, 'license') OR contains({_F}, 'rights reserved') THEN 'legal'
  WHEN contains(text, '@') AND regexp_matches(text, '[0-9]') THEN 'contact'
  WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'foreign' ELSE 'unknown' END AS family
FROM documents""")
def rule_cascade(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower("text")
    family = rules.first_match(
        [
            (rules.has_any(text, ["license", "rights reserved"]), "legal"),
            (rules.has_any(F.col("text"), ["@"]) & F.col("text").rlike("[0-9]"), "contact"),
            (F.col("n_chars") < 200, "short"),
            (F.col("lang") != "en", "foreign"),
        ],
        "unknown",
    )
    return table(spark, sf, "documents").select("doc_id", family.alias("family"))


_MARKS = ["the ", " of ", " and ", "tion", " der ", " que "]


@query(f"SELECT doc_id, n, n >= 3 AS enough FROM (SELECT doc_id, {' + '.join(f'CAST(contains({_F}, {m!r}) AS INTEGER)' for m in _MARKS)} AS n FROM documents)")
def marker_threshold(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", rules.count_markers(text, _MARKS).alias("n"), rules.at_least(text, _MARKS, 3).alias("enough"))


@query(f"SELECT doc_id, NOT (contains({_F}, 'license')) AND (contains({_F}, ' the ') OR contains({_F}, ' der ')) AS relevant, source || ' ' || substr(strip_accents({_F}), 1, 50) AS evidence FROM documents")
def relevance(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower("text")
    proof = rules.evidence(rules.first_given(F.lit(""), F.col("source")), F.substring(tx.strip_accents(text), 1, 50))
    return table(spark, sf, "documents").select("doc_id", rules.relevant(text, ["license"], [" the ", " der "]).alias("relevant"), proof.alias("evidence"))


_LINES = "lines AS (SELECT doc_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"
_HEAD = "length(line) < 80"
_FRAME = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _is_head(line: Column) -> Column:
    return F.length(line) < 80


@query(f"""
WITH {_LINES}, marked AS (SELECT *, CAST(sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) {_FRAME} AS BIGINT) AS block_no FROM lines)
SELECT doc_id, block_no, count(*) AS n_lines, string_agg(line, ' ' ORDER BY line_no) AS row_text FROM marked GROUP BY 1, 2""")
def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return lines.block_texts(lines.in_blocks(table(spark, sf, "documents"), "doc_id", "text", _is_head), "doc_id")


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, last_value(CASE WHEN {_HEAD} THEN line END IGNORE NULLS) {_FRAME} AS heading FROM lines")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return lines.carry_forward(table(spark, sf, "documents"), "doc_id", "text", _is_head, lambda x: x, "heading").select("doc_id", "line_no", "heading")


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM lines) WHERE {_HEAD} AND length(next_line) >= 80")
def lookahead(spark: SparkSession, sf: str) -> DataFrame:
    return lines.with_next(table(spark, sf, "documents"), "doc_id", "text", lambda x, after: _is_head(x) & (F.length(after) >= 80)).select("doc_id", "line_no")


@query(f"""
WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM (SELECT *, max(CASE WHEN contains(lower(line), 'stupid') THEN 1 ELSE 0 END) {_FRAME} AS is_open FROM lines)
WHERE is_open = 1 AND NOT contains(lower(line), 'stupid')""")
def gate(spark: SparkSession, sf: str) -> DataFrame:
    return lines.gated(table(spark, sf, "documents"), "doc_id", "text", lambda x: F.contains(F.lower(x), F.lit("stupid"))).select("doc_id", "line_no")


@query(f"""
WITH {_LINES}, headed AS (SELECT *, CASE WHEN {_HEAD} THEN left(line, 1) END AS h FROM lines),
carried AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM headed)
SELECT doc_id, CAST(count(*) FILTER (h IS NOT NULL AND h IS DISTINCT FROM prev) AS BIGINT) AS n_blocks FROM carried GROUP BY 1""")
def repeated_headings(spark: SparkSession, sf: str) -> DataFrame:
    """A heading that is repeated goes on with its block."""
    n_blocks = lines.heading_changes(F.split("text", "\n"), _is_head, lambda x: F.substring(x, 1, 1))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", n_blocks.cast("long").alias("n_blocks"))


@query(f"""
WITH {_LINES}, marked AS (SELECT *, CAST(sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) {_FRAME} AS BIGINT) AS block_no FROM lines)
SELECT doc_id, block_no, arg_max(trim(line), line_no) FILTER (regexp_matches(trim(line), '^[^.]+[.]$')) AS status,
  arg_min(line, line_no) FILTER (contains(line, '@')) AS contact, arg_min(line, line_no) FILTER (regexp_matches(line, '[0-9]') AND NOT contains(line, '@')) AS numbered
FROM marked WHERE block_no > 0 GROUP BY 1, 2""")
def block_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Of each block the last line that is one whole sentence, and the first lines with an address and with a number."""
    found = lines.in_blocks(table(spark, sf, "documents"), "doc_id", "text", _is_head).where("block_no > 0")
    kinds = {"contact": lambda x: F.contains(x, F.lit("@")), "numbered": lambda x: x.rlike("[0-9]") & ~F.contains(x, F.lit("@"))}
    return lines.block_fields(found, ["doc_id", "block_no"], "status", F.trim, lambda x: F.trim(x).rlike("^[^.]+[.]$"), kinds)


@query(r"""
SELECT doc_id, user_name, host FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]+)[.]([0-9]+)@', 1)) AS user_name, unnest(regexp_extract_all(text, '([a-z]+)[.]([0-9]+)@', 2)) AS host FROM documents)""")
def regex_rows(spark: SparkSession, sf: str) -> DataFrame:
    return segments.regex_rows(table(spark, sf, "documents"), "doc_id", F.col("text"), "([a-z]+)[.]([0-9]+)@", ["user_name", "host"]).drop("row_no")


@query("SELECT doc_id, 'pdf-rules v3 / ' || CASE WHEN n_chars >= 1000 THEN 'long' ELSE 'short' END AS provenance FROM documents")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    signal = F.when(F.col("n_chars") >= 1000, "long").otherwise("short")
    return table(spark, sf, "documents").select("doc_id", F.format_string("%s v%d / %s", F.lit("pdf-rules"), F.lit(3), signal).alias("provenance"))


def _grammar() -> automaton.Automaton:
    """Rows begin with a line of middle length and go on over long ones; noise between them is left out; short lines are headings, which end a row and are carried, as the beginning of a long line outside of rows is."""
    step = automaton.Step
    return automaton.Automaton(
        classes={
            "blank": lambda x: F.trim(x) == "",
            "noise": lambda x: F.contains(x, F.lit("@")) | F.contains(x, F.lit("|")),
            "heading": lambda x: F.length(x) < 30,
            "start": lambda x: F.length(x) < 100,
        },
        table={
            (automaton.ANY, "blank"): step("outside", "end"),
            (automaton.ANY, "noise"): step(automaton.SAME),
            (automaton.ANY, "heading"): step("outside", "end", set={"heading": lambda x: x}, clear=("note",)),
            (automaton.ANY, "start"): step("inside", "begin"),
            ("inside", automaton.OTHER): step("inside", "extend"),
            ("outside", automaton.OTHER): step("outside", set={"note": lambda x: F.substring(x, 1, 10)}),
        },
        states=("outside", "inside"),
        fields=("heading", "note"),
    )


@query(f"""
WITH {_LINES},
told AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN contains(line, '@') OR contains(line, '|') THEN 'noise' WHEN length(line) < 30 THEN 'heading' WHEN length(line) < 100 THEN 'start' ELSE 'other' END AS kind FROM lines),
clean AS (SELECT *, last_value(CASE WHEN kind <> 'other' THEN kind END IGNORE NULLS) {_FRAME} AS bound, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) {_FRAME} AS row_no,
  sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) {_FRAME} AS part, last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) {_FRAME} AS heading FROM told WHERE kind <> 'noise'),
noted AS (SELECT *, last_value(CASE WHEN kind = 'other' AND bound IS DISTINCT FROM 'start' THEN left(line, 10) END IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS note FROM clean)
SELECT doc_id, CAST(row_no - 1 AS INTEGER) AS row_no, CAST(min(line_no) AS INTEGER) AS first_line, CAST(count(*) AS INTEGER) AS n_lines, string_agg(line, ' ' ORDER BY line_no) AS row_text,
  any_value(heading) AS heading, arg_min(note, line_no) FILTER (kind = 'start') AS note
FROM noted WHERE bound = 'start' GROUP BY doc_id, row_no""")
def grammar_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of several lines with what headings carry into them, by one fold a document."""
    return automaton.parsed(table(spark, sf, "documents"), "doc_id", "text", _grammar())


_PEELED = """
peeled AS (SELECT doc_id, line_no, list_reverse(string_split(line, ' ')) AS b FROM lines),
ended AS (SELECT *, CASE WHEN regexp_matches(b[1], '[.]$') THEN 1 ELSE 0 END AS e FROM peeled),
shorts AS (SELECT *, coalesce(nullif(list_position(list_transform(b[e + 1:], lambda x: regexp_matches(x, '^[a-z]{1,3}$')), FALSE), 0), len(b) - e + 1) - 1 AS s FROM ended),
worded AS (SELECT *, least(2, coalesce(nullif(list_position(list_transform(b[e + s + 1:], lambda x: regexp_matches(x, '^[a-zß-ÿ]+$')), FALSE), 0), len(b) - e - s + 1) - 1) AS w FROM shorts)
"""


@query(rf"""
WITH {_LINES}, {_PEELED}
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(array_to_string(list_reverse(b[e + s + w + 1:]), ' '), '') AS name, CAST(s AS INTEGER) AS n_short, coalesce(b[e + 1:e + s][1], '') AS total, coalesce(array_to_string(list_reverse(b[e + s + 1:e + s + w]), ' '), '') AS words, w >= 1 AS ok FROM worded""")
def peeled_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Lines taken apart from the right: a token that ends the sentence, short words, of which the last counts, up to two other words; the rest is the name."""
    acceptors = [
        peel.Acceptor("end", lambda x: x.rlike("[.]$"), most=1),
        peel.Acceptor("short", lambda x: x.rlike("^[a-z]{1,3}$")),
        peel.Acceptor("words", lambda x: x.rlike("^[a-zß-ÿ]+$"), least=1, most=2),
    ]
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    told = rows.select("doc_id", "line_no", peel.peeled(F.split("line", " "), acceptors, "name").alias("p"))
    return told.select("doc_id", "line_no", F.array_join("p.name", " ").alias("name"), F.size("p.short").alias("n_short"), F.coalesce(F.try_element_at("p.short", F.lit(-1)), F.lit("")).alias("total"), F.array_join("p.words", " ").alias("words"), "p.ok")


@query(r"""
WITH found AS (SELECT doc_id, lang, n_chars, len(regexp_extract_all(text, '[a-z]+[.][0-9]+@[a-z.]+')) AS n_mail, len(regexp_extract_all(text, '[A-Z]{6,}')) AS n_loud, len(regexp_extract_all(text, '[0-9]{3,}')) AS n_numbers FROM documents),
told AS (SELECT 0 AS place, 'mail' AS parser, n_mail AS n FROM found UNION ALL SELECT 1, 'loud', n_loud FROM found WHERE lang = 'de' UNION ALL SELECT 2, 'numbers', n_numbers FROM found WHERE n_chars > 500)
SELECT place, parser, count(*) AS taken, count(*) FILTER (n > 0) AS success, count(*) FILTER (n = 0) AS empty, CAST(sum(n) AS BIGINT) AS rows FROM told GROUP BY 1, 2""")
def parser_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Three parsers in one job; the tallies are counted as their rows are written."""
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    parsers = [
        dispatch.Parser("mail", F.lit(True), every("[a-z]+[.][0-9]+@[a-z.]+"), feeds=True),
        dispatch.Parser("loud", F.col("lang") == "de", every("[A-Z]{6,}")),
        dispatch.Parser("numbers", F.col("n_chars") > 500, every("[0-9]{3,}")),
    ]
    tallies, _ = dispatch.dispatch(table(spark, sf, "documents"), "doc_id", parsers, lambda rows: rows.write.parquet(shared.new_path(spark, "parsed")))
    rows = [(i, p, t.taken, t.success, t.empty, t.rows) for i, (p, t) in enumerate(tallies.items())]
    return spark.createDataFrame(rows, "place int, parser string, taken long, success long, empty long, rows long")


@query(r"""
WITH RECURSIVE site AS (SELECT contains(url, '?') AS is_seed, regexp_replace(url, '[;?#].*$', '') AS page, regexp_extract(url, '([a-z]+[.][a-z]+)(?:/|$|[?#])', 1) AS domain, html FROM pages),
assets AS (SELECT page, domain || link AS asset FROM (SELECT page, domain, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM site) WHERE starts_with(link, '/')),
links AS (SELECT page AS source, asset AS target FROM assets UNION SELECT asset, page FROM assets),
walk AS (SELECT DISTINCT page AS node, 0 AS depth FROM site WHERE is_seed UNION SELECT target, depth + 1 FROM walk JOIN links ON source = node WHERE depth < 6)
SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def page_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that those with a query in their URL lead to over what they link to: pages of one domain that link to one path meet there."""
    url = F.col("url")
    domain = F.regexp_extract(url, "([a-z]+[.][a-z]+)(?:/|$|[?#])", 1)
    pages = table(spark, sf, "pages").select(F.contains(url, F.lit("?")).alias("is_seed"), urls.canonical(url).alias("page"), domain.alias("domain"), "html")
    found = pages.select("page", "domain", F.explode(urls.links(F.col("html"))).alias("link")).where(F.startswith("link", F.lit("/")))
    assets = found.select("page", F.concat("domain", "link").alias("asset"))
    links = assets.select(F.col("page").alias("source"), F.col("asset").alias("target")).unionByName(assets.select(F.col("asset").alias("source"), F.col("page").alias("target")))
    return reach.reachable_far(links, pages.where("is_seed").select("page"), 6)
