"""Line deduplication by a log-template tree, in Spark's own functions.

Lines are compared in lower case; their tokens with digits become variables. The tree
has a fixed depth: the number of tokens, then the leading tokens lead to a leaf. A leaf
may hold several templates. Where most lines of a node share most of their tokens,
these are its template, the other positions variable fields, and the lines that have
enough of it leave the node; other nodes are split by the tokens at the position of
the commonest token, for a fixed number of levels. A line that no template takes
stands for itself. Lines whose template recurs in many documents are dropped from all
but the earliest of them.

Lines are counted as hashes first; only what lies in leaves that recur is looked at
token by token, and each different line of a leaf once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import HOT_KEYS, join_hot, let, stash

VARIABLE = "<*>"
#: What a text may have that masking changes; most texts have nothing of it and pass as they are.
_TO_MASK = r"[0-9\t\x0B\f\r]|\x20\x20|\x20\n|\n\x20|^\x20|\x20$"
_BLANKS = r"[\x20\t\x0B\f\r]+"
_EDGES = r"(?<![^\n])\x20|\x20(?![^\n])"
#: A token that has a digit; it is tried at the beginning of tokens only.
_HAS_DIGIT = r"(?<![^\x20\n])[^\x20\n0-9]*+[0-9][^\x20\n]*+"


def masked_lines(text: Column) -> Column:
    """The lines of a text in lower case, with single blanks, none at the ends, and variables for tokens with digits."""
    plain = F.regexp_replace(F.regexp_replace(text, _BLANKS, " "), _EDGES, "")
    masked = F.when(text.rlike(_TO_MASK), F.regexp_replace(plain, _HAS_DIGIT, VARIABLE)).otherwise(text)
    return F.split(F.lower(masked), "\n")


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _line_hashes(text: Column, depth: int, min_tokens: int) -> Column:
    """Array of (line, pos, leaf, first) of the lines that count; first marks the first of equal lines."""

    def hashed(masked: Column, pos: Column) -> Column:
        worded = F.replace(F.replace(masked, F.lit(VARIABLE), F.lit("")), F.lit(" "), F.lit("")) != ""
        n = _tokens(masked)
        leaf = F.when(worded & (n >= min_tokens), F.xxhash64(n, F.substring_index(masked, " ", depth)))
        return F.struct(F.xxhash64(masked).alias("line"), pos.alias("pos"), leaf.alias("leaf"))

    def told(each: Column) -> Column:
        first = lambda x, i: F.coalesce(F.get(each, i - 1)["line"] != x["line"], F.lit(True))
        return F.transform(each, lambda x, i: F.struct(x["line"].alias("line"), x["pos"].alias("pos"), x["leaf"].alias("leaf"), first(x, i).alias("first")))

    return let(F.array_sort(F.filter(F.transform(masked_lines(text), hashed), lambda x: x["leaf"].isNotNull())), told)


def _templates(lines: DataFrame, min_docs: int, similarity: float, constant: float, levels: int) -> DataFrame:
    """(line, template) of the lines that a template of their leaf takes; lines has leaf, line, n and tokens."""
    live = lines.select(F.col("leaf").alias("node"), "line", "n", "tokens")
    found = []
    for level in range(levels + 1):
        live = stash(live, "open-lines")
        total = live.count()
        if not total:
            break
        held = live.select("node", "n", F.posexplode("tokens").alias("at", "token")).groupBy("node", "at", "token")
        held = stash(held.agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows")), "node-tokens")
        tops = held.groupBy("node", "at").agg(F.max(F.struct("weight", "token")).alias("top"), F.sum("weight").alias("node_n"), F.sum("rows").alias("rows"))
        weight = F.col("top.weight")
        shared = F.when(weight >= F.col("node_n") * constant, F.struct("at", F.col("top.token").alias("token")))
        widest = F.when((weight < F.col("node_n")) & (weight >= min_docs), F.struct((-weight).alias("w"), "at"))
        nodes = tops.groupBy("node").agg(F.max("node_n").alias("node_n"), F.max("rows").alias("rows"), F.count(F.lit(1)).alias("size"), F.collect_list(shared).alias("shared"), F.min(widest).alias("split"))
        rows = join_hot(live, nodes, ["node"], "rows", total)
        least = F.col("size") * similarity
        is_template = F.size("shared") >= least
        same = F.size(F.filter("shared", lambda t: F.get("tokens", t["at"]) == t["token"]))
        rows = rows.select("node", "line", "n", "tokens", "node_n", is_template.alias("is_template"), (is_template & (same >= least)).alias("member"), F.col("split.at").alias("at"))
        rows = stash(rows, "told-lines")
        found.append(rows.where(F.col("member") & (F.col("node_n") >= min_docs)).select("line", "node"))
        if level == levels:
            break
        rest = rows.where("is_template and not member").select(F.xxhash64("node", F.lit(-1)).alias("node"), "line", "n", "tokens")
        parted = rows.where("not is_template and at is not null").withColumn("token", F.expr("get(tokens, at)"))
        usual = held.where(F.col("weight") >= min_docs).select("node", "at", "token", "rows", F.lit(True).alias("usual"))
        parted = join_hot(parted, usual, ["node", "at", "token"], "rows", total, how="left")
        token = F.when(F.col("usual"), F.col("token"))
        live = rest.unionByName(parted.select(F.xxhash64("node", "at", token).alias("node"), "line", "n", "tokens"))
    if not found:
        return lines.select("line", F.col("leaf").alias("template")).limit(0)
    return reduce(DataFrame.unionByName, found).withColumnRenamed("node", "template")


def recurring_lines(docs: DataFrame, occurrences: DataFrame, min_docs: int, similarity: float, constant: float, levels: int) -> DataFrame:
    """(line, template, first_doc, n): hashes of the masked lines to drop, of their templates, and in how many documents the line is.

    docs has doc_id and text, occurrences doc_id, leaf and line once a document; neither
    has a null id or text. Without occurrences there is nothing to drop.
    """
    n_occurrences = occurrences.count()
    counts = stash(occurrences.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")), "line-counts")
    whole = counts.where(F.col("n") >= min_docs).select("line", F.col("line").alias("template"), "first_doc", "n")

    # leaves that recur, by lines that may not
    leaves = counts.groupBy("leaf").agg(F.sum("n").alias("leaf_n"), F.count(F.lit(1)).alias("kinds"))
    leaves = leaves.where((F.col("leaf_n") >= min_docs) & (F.col("kinds") > 1))
    open_lines = stash(join_hot(counts, leaves.select("leaf", "kinds"), ["leaf"], "kinds", counts.count()), "rare-lines")

    # the tokens of their lines, each different line once, out of its first document
    first = docs.join(open_lines.select(F.col("first_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = first.select("doc_id", F.explode(F.array_distinct(masked_lines(F.col("text")))).alias("masked")).select("doc_id", "masked", F.xxhash64("masked").alias("line"))
    each = texts.join(open_lines.withColumnRenamed("first_doc", "doc_id"), ["doc_id", "line"]).dropDuplicates(["line"])
    each = each.select("leaf", "line", "n", F.transform(F.split("masked", " "), lambda t: F.xxhash64(t)).alias("tokens"))
    alike = stash(_templates(each, min_docs, similarity, constant, levels).join(open_lines.select("line", "n", "first_doc"), "line"), "alike-lines")

    # a template with a recurring line recurs; of the others documents are counted
    kinds = alike.groupBy("template").agg(F.max("n").alias("most"), F.min("first_doc").alias("first_doc"), F.count(F.lit(1)).alias("rows"))
    rare = alike.where(F.col("n") < min_docs).select("line", "template", "n")
    hot = F.broadcast(counts.where((F.col("n") >= min_docs) & (F.col("n") > F.lit(n_occurrences / HOT_KEYS))).select("line"))
    spread = rare.join(occurrences.select("line", "doc_id").join(hot, "line", "left_anti"), "line").groupBy("template").agg(F.count_distinct("doc_id").alias("n_docs"))
    wide = stash(kinds.join(spread, "template", "left").where((F.col("most") >= min_docs) | (F.col("n_docs") >= min_docs)).select("template", "first_doc", "rows"), "wide-templates")
    general = join_hot(alike.select("line", "template", "n"), wide, ["template"], "rows", alike.count())
    general = stash(general.select("line", "template", "first_doc", "n"), "general-lines")
    return whole.join(general.select("line"), "line", "left_anti").unionByName(general)


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, depth: int = 3, similarity: float = 0.7, constant: float = 0.6, min_tokens: int = 1, levels: int = 3, counts: bool = True) -> DataFrame:
    """docs with the text of the lines that stay, and with counts n_lines and n_dropped of every row.

    A template recurs if at least min_docs documents have it. Lines of fewer tokens than
    min_tokens, blank lines and lines of nothing but variables always stay, as do the
    lines of the template's earliest document. Null texts stay null. Rows with a null id
    are left as they are; a row that repeats an id may count as another document. All
    other columns pass through, whatever their names, but for n_lines and n_dropped,
    which counts replace; an empty table gives an empty result.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = docs.toDF(*names.values()).withColumn("text", F.col(names["text"])).withColumn("doc_id", F.col(names["doc_id"]).cast("long"))
    # positions of lines are those of a text, so a row is known by its id and its text
    whole = whole.withColumn("row", F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.xxhash64("doc_id", "text")))
    rows = whole.where("row is not null").select("doc_id", "row", "text")
    lines = rows.select("doc_id", "row", F.inline(_line_hashes(F.col("text"), depth, min_tokens)))
    occurrences = stash(lines, "line-hashes")
    told = stash(recurring_lines(rows, occurrences.where("first").select("doc_id", "leaf", "line"), min_docs, similarity, constant, levels), "recurring")
    gone = join_hot(occurrences.select("doc_id", "row", "line", "pos"), told.select("line", "first_doc", "n"), ["line"], "n", occurrences.count()).where("doc_id <> first_doc")
    drops = gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("drop"))  # lines of one document

    def between(k: Column) -> Column:
        """The lines between two that are dropped."""
        after = F.coalesce(F.get("drop", k - 1), F.lit(-1))
        return F.slice("lines", after + 2, F.coalesce(F.get("drop", k), F.size("lines")) - after - 1)

    # rows without an id or a text pass by, or the join would deal them all to one task
    known = whole.where("row is not null").join(drops, ["doc_id", "row"], "left")
    joined = known.unionByName(whole.where("row is null").withColumn("drop", F.lit(None).cast("array<int>"))).withColumn("lines", F.split("text", "\n"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("drop")), between))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")
    counted = {"n_lines": n_lines, "n_dropped": n_dropped} if counts else {}
    passed = [(text if c == "text" else F.col(n)).alias(c) for c, n in names.items() if c not in counted]
    return joined.select(*passed, *(x.alias(c) for c, x in counted.items()))
