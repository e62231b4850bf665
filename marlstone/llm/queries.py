"""The registered corpus queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import compress_quality, decontam, langid, line_templates, packing, pii, quality_rules, resampling, sharding, simhash, substring_dedup, toxicity, whitening
from marlstone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle_words=4, distance=4)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), folds=4, held_out=2, calibration=3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096, tokenizer="word_bpe_49k.json", end_id=1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.8)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), min_words=10, max_repeat_percent=20)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_units(table(spark, sf_dir, "documents"), min_words=12)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held_out=1, threshold=0.7)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"), min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0, threshold=0.3)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, buckets=10_000, longest=1, min_words=20, seed=2024)


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_line_templates": op9_line_templates,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_sharding": op12_sharding,
    "op13_resampling": op13_resampling,
}

_MASKED = """
raw AS (SELECT doc_id, unnest(range(0, len(parts))) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
masked AS (SELECT doc_id, pos, lower(array_to_string(list_transform(string_split(trim(regexp_replace(line, '[ \\t-\\r]+', ' ', 'g')), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ')) AS line FROM raw)
"""


def _level(k: int) -> str:
    """One level of the tree: its templates in told{k}, and in open{k + 1} what goes on."""
    return f"""
held{k} AS (SELECT node, spot, token, sum(n) AS weight FROM (SELECT node, n, unnest(range(0, len(toks))) AS spot, unnest(toks) AS token FROM open{k}) GROUP BY ALL),
tops{k} AS (SELECT node, spot, arg_max(token, weight) AS token, max(weight) AS weight, sum(weight) AS node_n FROM held{k} GROUP BY 1, 2),
nodes{k} AS (SELECT node, max(node_n) AS node_n, count(*) AS size, count(*) FILTER (weight >= node_n * 0.6) AS shared, arg_min(spot, (-weight, spot)) FILTER (weight < node_n AND weight >= 5) AS split FROM tops{k} GROUP BY 1),
same{k} AS (SELECT line, count(*) AS same FROM (SELECT line, node, unnest(range(0, len(toks))) AS spot, unnest(toks) AS token FROM open{k}) JOIN tops{k} USING (node, spot, token) WHERE weight >= node_n * 0.6 GROUP BY 1),
told{k} AS (SELECT o.*, node_n, split, shared >= size * 0.7 AS is_template, shared >= size * 0.7 AND coalesce(same, 0) >= size * 0.7 AS member FROM open{k} o JOIN nodes{k} USING (node) LEFT JOIN same{k} USING (line)),
open{k + 1} AS (SELECT CASE WHEN is_template THEN t.node || '/rest' ELSE t.node || '/' || split || ':' || coalesce(h.token, '') END AS node, line, toks, n, first_doc
  FROM told{k} t LEFT JOIN held{k} h ON h.node = t.node AND h.spot = t.split AND h.token = t.toks[t.split + 1] AND h.weight >= 5 WHERE NOT member AND (is_template OR split IS NOT NULL))"""


_LEVELS = 4

ORACLE_SQL: dict[str, str] = {
    "op6_substring_dedup": """
WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents),
each AS (SELECT doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS unit FROM parts),
placed AS (SELECT doc_id, unit, CAST(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(unit) - 1 AS BIGINT) AS start FROM each),
units AS (SELECT doc_id, start, start + length(unit) AS "end", trim(regexp_replace(lower(unit), '[ \\t-\\r]+', ' ', 'g')) AS norm FROM placed),
ranked AS (SELECT *, row_number() OVER w AS turn, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
  FROM units WHERE norm <> '' AND len(string_split(norm, ' ')) >= 12 WINDOW w AS (PARTITION BY norm ORDER BY doc_id, start))
SELECT doc_id, start, "end", kept_doc_id, kept_start FROM ranked WHERE turn > 1""",
    "op9_line_templates": f"""
WITH {_MASKED},
lines AS (SELECT DISTINCT doc_id, line, string_split(line, ' ') AS toks FROM masked WHERE trim(replace(line, '<*>', '')) <> ''),
counts AS (SELECT line, any_value(toks) AS toks, CAST(len(any_value(toks)) AS VARCHAR) || ' ' || array_to_string(any_value(toks)[1:3], ' ') AS leaf, count(*) AS n, min(doc_id) AS first_doc FROM lines GROUP BY line),
open0 AS (SELECT leaf AS node, line, toks, n, first_doc FROM (SELECT *, sum(n) OVER w AS leaf_n, count(*) OVER w AS kinds FROM counts WINDOW w AS (PARTITION BY leaf)) WHERE leaf_n >= 5 AND kinds > 1),
{",".join(map(_level, range(_LEVELS)))},
alike AS ({" UNION ALL ".join(f"SELECT {k} || node AS node, line, n, first_doc FROM told{k} WHERE member AND node_n >= 5" for k in range(_LEVELS))}),
wide AS (SELECT node, min(first_doc) AS first_doc FROM alike JOIN lines USING (line) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
general AS (SELECT line, wide.first_doc FROM alike JOIN wide USING (node)),
told AS (SELECT line, coalesce(g.first_doc, c.first_doc) AS first_doc FROM counts c LEFT JOIN general g USING (line) WHERE c.n >= 5 OR g.first_doc IS NOT NULL),
marked AS (SELECT raw.doc_id, raw.pos, raw.line, told.line IS NOT NULL AND raw.doc_id <> told.first_doc AS gone FROM raw JOIN masked ON raw.doc_id = masked.doc_id AND raw.pos = masked.pos LEFT JOIN told ON told.line = masked.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5 FROM marked GROUP BY doc_id""",
    "op13_resampling": r"""
WITH steps AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) t(i))),
found AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM found),
spelt AS (SELECT DISTINCT word, hex(word) AS h FROM words),
bytes AS (SELECT word, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM spelt),
coded AS (SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, steps),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN coded USING (word) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts),
sums AS (SELECT id, count(*) AS n, sum(gain) AS total FROM words JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / CAST(n AS DOUBLE)), 0) AS BIGINT) AS weight FROM documents LEFT JOIN sums ON id = doc_id),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranks r ON r.doc_id = s.doc_id""",
}
