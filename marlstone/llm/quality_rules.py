"""Quality rules in Spark's own functions: base counts, and divergence from what a language looks like.

Every language of the corpus gets two reference histograms from all its documents:
of character classes, and of its most common words. A document's histograms are
compared to those of its language by Jensen-Shannon divergence (the square of the
distance, in bits); a null or unseen language is compared to the whole corpus. Short
documents aren't judged, as their histograms say little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import ASCII_SPACE, let, stash

#: Characters of a class, and the one that stands for all of them where they are counted.
CLASSES = {"upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), "digit": ("0123456789", "0"), "sentence": (".,;:?!'\"()-", "."), "symbol": ("#*$%&|<>", "#"), "blank": (" \t\n\x0b\f\r", " ")}
_FROM = "".join(chars for chars, _ in CLASSES.values())
_TO = "".join(sign * len(chars) for chars, sign in CLASSES.values())
#: The reference of documents whose language is null or has none.
ANY = ""
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, ASCII_SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more in the text, the first included."""

    def hashes(w: Column) -> Column:
        def windows(h: Column) -> Column:
            each = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
            return F.slice(each, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

        return let(F.transform(w, lambda x: F.xxhash64(x)), windows)

    def positions(h: Column) -> Column:
        """Sorted starts of windows that occur twice or more."""
        paired = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(paired, lambda p: F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def total(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(positions(h), covered)).otherwise(0)

    return let(let(words, hashes), total).cast("long")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for every row of docs: its text, counts, and character classes as c_<name>.

    A null text is an empty one, with all counts zero; null ids and languages pass
    through. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"), F.translate("text", _FROM, _TO).alias("signs"), F.length("text").alias("chars"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    signs = {k: (F.col("chars") - F.length(F.replace("signs", F.lit(sign), F.lit("")))).cast("long").alias(f"c_{k}") for k, (_, sign) in CLASSES.items()}
    rows = rows.select(
        "doc_id",
        "lang",
        "text",
        F.size("words").cast("long").alias("n_words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *signs.values(),
        F.when(F.octet_length("text") == F.col("chars"), 0).otherwise(F.length(F.regexp_replace("text", r"[\x00-\x7F]+", ""))).cast("long").alias("c_accent"),
        F.col("chars").cast("long").alias("chars"),
    )
    rows = rows.withColumn("word_chars", F.col("chars") - F.col("c_blank"))
    known = reduce(Column.__add__, (F.col(c) for c in CLASS_COLUMNS[:-1]))
    return rows.withColumn("c_other", F.greatest(F.lit(0), F.col("word_chars") - known))


CLASS_COLUMNS = [f"c_{k}" for k in (*(k for k in CLASSES if k != "blank"), "accent", "other")]


def plain_words(text: Column) -> Column:
    """Words in lower case; punctuation and symbols end a word."""
    ends = "".join(CLASSES[k][0] for k in ("sentence", "symbol", "blank"))
    return F.array_remove(F.split(F.translate(F.lower(text), ends, " " * len(ends)), " "), "")


def word_references(docs: DataFrame, common: int) -> dict[str, list[str]]:
    """The most common words of all texts of each language, and of all texts under ANY."""
    words = docs.select(F.coalesce("lang", F.lit(ANY)).alias("lang"), F.explode(plain_words(F.coalesce("text", F.lit("")))).alias("word"))
    counts = stash(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("lang"), "word", "n")
    both = counts.where(F.col("lang") != ANY).unionByName(pooled).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(1024)))

    def top(df: DataFrame, *keys: str) -> DataFrame:
        """The `common` first of a key."""
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
        return df.withColumn("rank", rank).where(F.col("rank") <= common)

    # first of parts of a language, so that no task ranks all its words
    listed = top(top(both, "lang", "part"), "lang").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"))
    return {r["lang"]: [t["word"] for t in r["top"]] for r in listed.collect()}  # `common` words a language


def shares(counts: DataFrame, common: int) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """Of each language, and of all texts under ANY: shares of the character classes, and of its common words."""
    n_words = [F.sum(F.coalesce(F.get("common", F.lit(i)), F.lit(0))).alias(f"w_{i}") for i in range(common)]
    sums = counts.groupBy("reference").agg(*(F.sum(c).alias(c) for c in CLASS_COLUMNS), F.sum("n_words").alias("n_words"), *n_words)
    pooled = counts.agg(*(F.sum(c).alias(c) for c in CLASS_COLUMNS), F.sum("n_words").alias("n_words"), *(F.lit(0).alias(f"w_{i}") for i in range(common)))
    classes, words = {}, {}
    for r in sums.unionByName(pooled.withColumn("reference", F.lit(None).cast("string"))).collect():  # a row a language
        total = max(1, sum(r[c] or 0 for c in CLASS_COLUMNS))
        key = ANY if r["reference"] is None else r["reference"]
        if key not in classes or r["reference"] is None:
            classes[key] = [(r[c] or 0) / total for c in CLASS_COLUMNS]
        if r["reference"] is not None:
            words[key] = [r[f"w_{i}"] / max(1, r["n_words"]) for i in range(common)]
    return classes, words


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of shares that each sum to one."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    each = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def _with_rest(shares: Column) -> Column:
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))))


def _of_language(values: dict[str, list], empty: Column) -> Column:
    """The list of the row's reference; a constant map, as references are few and short."""
    if not values:
        return empty
    by_lang = F.create_map(*(x for lang, value in values.items() for x in (F.lit(lang), F.array(*map(F.lit, value)) if value else empty)))
    return F.coalesce(F.try_element_at(by_lang, F.col("reference")), empty)


def judge(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, guard_words: int = 40, max_class_divergence: float = 0.10, max_word_divergence: float = 0.10, chance: float = 3.0, common: int = 32) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_divergence, word_divergence).

    A row for every row of docs. kept is false if the base rules fail or if the text has
    guard_words or more and one of its divergences is above its bound; for words, a text of
    n words may stray by chance / n more. Null texts count
    as empty and fail the base rules; repeated rows and null ids are each judged. An
    empty table gives an empty result.
    """
    listed = word_references(docs, common)
    texts = F.expr("cast(array() as array<string>)")
    reference = F.when(F.coalesce("lang", F.lit(ANY)).isin(list(listed)), F.coalesce("lang", F.lit(ANY))).otherwise(ANY)
    counts = base_counts(docs).withColumn("reference", reference)

    def counted(words: Column) -> Column:
        """Of each common word how often it is there."""
        return F.transform(_of_language(listed, texts), lambda w: F.size(words) - F.size(F.array_remove(words, w)))

    known = sorted({w for words in listed.values() for w in words})
    common_counts = let(F.filter(plain_words(F.col("text")), lambda w: w.isin(known)), counted)
    counts = stash(counts.withColumn("common", common_counts).drop("text"), "quality-counts")
    classes, words = shares(counts, common)
    numbers = F.expr("cast(array() as array<double>)")
    total = F.greatest(F.lit(1), reduce(Column.__add__, map(F.col, CLASS_COLUMNS))).cast("double")
    own = F.array(*(F.col(c) / total for c in CLASS_COLUMNS))
    own_words = F.transform("common", lambda n: n / F.greatest(F.lit(1), F.col("n_words")))
    usual_words = F.slice(_of_language(words, numbers), 1, F.greatest(F.size("common"), F.lit(0)))
    judged = counts.withColumns(
        {
            "class_divergence": divergence(own, _of_language(classes, numbers)),
            "word_divergence": divergence(_with_rest(own_words), _with_rest(usual_words)),
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        }
    )
    strange = (F.col("class_divergence") > max_class_divergence) | (F.col("word_divergence") > max_word_divergence + chance / F.greatest(F.lit(1), F.col("n_words")))
    kept = ~F.col("base_failed") & ~((F.col("n_words") >= guard_words) & F.coalesce(strange, F.lit(False)))
    return judged.select("doc_id", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_divergence", "word_divergence")
