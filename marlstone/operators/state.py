"""State as functions of tables: old rows and new rows in, next rows out.

Plain Parquet has no UPDATE or MERGE; each function returns the table to write instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import digests


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of the same key; columns in keep stay as they were first.

    Of several new rows of a key the one whose other columns, in their order, are the
    greatest wins. Null keys match nothing and are added.
    """
    kept = keep or []
    others = [c for c in new.columns if c not in keys]
    if others:
        best = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__best"))
        new = best.select(*(F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in new.columns))
    else:
        new = new.dropDuplicates(keys)
    first = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in kept))
    fresh = new.join(first, keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns))
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(fresh)


def deactivate(old: DataFrame, gone: DataFrame, keys: list[str], flag: str, updated: str | None = None, as_of: Column | None = None) -> DataFrame:
    """old with flag false for the keys of gone, and updated as_of where that changed something; an upsert with the flag true makes them active again."""
    told = old.join(gone.select(*keys).distinct().withColumn("__gone", F.lit(True)), keys, "left")
    ends = F.col("__gone").isNotNull() & F.coalesce(F.col(flag), F.lit(True))
    changes = {flag: F.when(F.col("__gone").isNotNull(), False).otherwise(F.col(flag))}
    if updated:
        changes[updated] = F.when(ends, as_of).otherwise(F.col(updated))
    return told.withColumns(changes).select(*old.columns)


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of gone's keys; null keys are no keys and stay."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti").select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key isn't there; of equal new keys any one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_by_parent(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All old rows of the parents that new has rows for give way to the new rows."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new)


def unlink(rows: DataFrame, deleted: DataFrame, link: str, key: str) -> DataFrame:
    """Links to deleted rows become null."""
    gone = deleted.select(F.col(key).alias("__gone")).distinct()
    return rows.join(gone, rows[link] == F.col("__gone"), "left").withColumn(link, F.when(F.col("__gone").isNull(), F.col(link))).drop("__gone")


def todo(work: DataFrame, runs: DataFrame, keys: list[str], version: str, wanted: str) -> DataFrame:
    """Work without a successful run of the wanted version; another version means to do it again."""
    done = runs.where((F.col("status") == "success") & (F.col(version) == wanted)).select(*keys)
    return work.join(done, keys, "left_anti")


def run_log(started: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """started with the columns of finished and a status: running, failed (error isn't null) or success.

    finished has `finished`, `error` and counters named n_; of several endings of a run
    the latest counts (of equal ones that with the greatest other columns). Counters of
    a running run are 0. An ending without a start isn't a run.
    """
    others = ["finished", *(c for c in finished.columns if c not in (*keys, "finished"))]
    last = finished.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__end"))
    status = F.when(F.col("__end").isNull(), "running").when(F.col("__end.error").isNotNull(), "failed").otherwise("success")
    ends = [(F.coalesce(f"__end.{c}", F.lit(0)) if c.startswith("n_") else F.col(f"__end.{c}")).alias(c) for c in others]
    return started.join(last, keys, "left").select(*started.columns, status.alias("status"), *ends)


def sticky(old: Column, as_of: Column, condition: Column) -> Column:
    """The time a condition was first seen: kept while it holds, null when it doesn't."""
    return F.when(condition, F.coalesce(old, as_of))


def sync_outcomes(links: DataFrame, known: DataFrame, run: str = "run", url: str = "url", position: str = "pos") -> DataFrame:
    """links with one outcome each: not_downloadable, duplicate, error, known or new.

    Whatever its outcome, the first link to a URL in a run makes later ones duplicates.
    links has downloadable (boolean) and sha (null where the download failed).
    """
    turn = F.row_number().over(Window.partitionBy(run, url).orderBy(position))
    there = known.select("sha").distinct().withColumn("__known", F.lit(True))
    rows = links.withColumn("__turn", turn).join(there, "sha", "left")
    outcome = (
        F.when(~F.col("downloadable"), "not_downloadable").when(F.col("__turn") > 1, "duplicate").when(F.col("sha").isNull(), "error").when(F.col("__known"), "known").otherwise("new")
    )
    return rows.withColumn("outcome", outcome).drop("__turn", "__known")


def lifecycle(items: DataFrame, awards: DataFrame, visible: DataFrame, observed: DataFrame, key: str, source: str, as_of: Column) -> DataFrame:
    """Availability of items, each decided at once: awarded, else available, else not_visible, else unchanged.

    awards has key and closing (the least counts), visible the keys that are seen now,
    observed the sources that were looked at successfully; items of other sources keep
    their state. A first time missing or closed is kept, so a second run with the same
    as_of changes nothing.
    """
    closing = awards.groupBy(key).agg(F.min("closing").alias("__closing"))
    seen = visible.select(key).distinct().withColumn("__seen", F.lit(True))
    looked = observed.select(source).distinct().withColumn("__looked", F.lit(True))
    rows = items.join(closing, key, "left").join(seen, key, "left").join(looked, source, "left")
    awarded, is_seen, missing = F.col("__closing").isNotNull(), F.col("__seen").isNotNull(), F.col("__looked").isNotNull()
    status = F.when(awarded, "awarded").when(is_seen, "available").when(missing, "not_visible").otherwise(F.col("status"))
    since = F.when(awarded | (~is_seen & missing), F.coalesce("missing_since", as_of)).when(is_seen, None).otherwise(F.col("missing_since"))
    closed_by = F.when(awarded, F.col("__closing")).when(is_seen | missing, None).otherwise(F.col("closed_by"))
    return rows.withColumns({"status": status, "missing_since": since, "closed_by": closed_by}).select(*items.columns)


def event_batches(docs: DataFrame, category: Column, key: str, titles: tuple[str, str], size: int = 64, fan: int = 64, levels: int = 3) -> DataFrame:
    """One event for each category that isn't null, its ids in blocks: (event_key, category, n, body, block_no, ids).

    ids has those of a block, by number, joined by commas; an event has as many rows as
    blocks, and no task gathers a category's ids. The key holds the category and the root
    of a hash tree over its integer ids, so a replay makes the same event, in whatever
    order the ids come, and other ids another one.
    """
    rows = docs.select(category.alias("category"), F.col(key).alias("id")).where("category is not null")
    bottom = digests.blocks(rows, ["category"], "id", F.lit(""), size)
    root = digests.tree(bottom, ["category"], fan, levels)[-1]
    body = F.concat_ws(" ", F.col("n").cast("string"), F.when(F.col("n") == 1, titles[0]).otherwise(titles[1]))
    events = root.select(F.concat_ws(":", "category", "digest").alias("event_key"), "category", "n", body.alias("body"))
    return events.join(bottom.select("category", "block_no", "ids"), "category").select("event_key", "category", "n", "body", "block_no", "ids")


def pending(outbox: DataFrame, limit: int) -> DataFrame:
    """The oldest events still to send."""
    return outbox.where("status = 'pending'").orderBy("created", "event_key").limit(limit)
