"""Stable pages: allow-listed orders, explicit null placement, a unique last key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_by(allowed: dict[str, Column], field: str | None, descending: bool, default: str, tie_breaker: Column, nulls_last: bool = True) -> list[Column]:
    """Sort keys for a requested field; one that isn't allowed falls back to the default."""
    key = allowed.get(field or default, allowed[default])
    if descending:
        first = key.desc_nulls_last() if nulls_last else key.desc_nulls_first()
    else:
        first = key.asc_nulls_last() if nulls_last else key.asc_nulls_first()
    return [first, tie_breaker.asc()]


def page(df: DataFrame, keys: list[Column], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page in the order of keys; Spark plans it as a top-k of limit + offset rows."""
    if not 0 < limit <= most or offset < 0:
        raise ValueError(f"limit must be from 1 to {most}, offset 0 at least")
    return df.orderBy(*keys).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def envelope(df: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> dict:
    """What a listing returns: the page's rows, and how many there are in all."""
    return {"items": page(df, keys, limit, offset).collect(), "total": df.count(), "limit": limit, "offset": offset}


def nearest(lat: Column, distance: Column, *then: Column, descending: bool = False) -> list[Column]:
    """By distance, with rows that lack coordinates last in either direction."""
    return [lat.isNull().asc(), distance.desc() if descending else distance.asc(), *then]


Order = list[tuple[str, bool]]


def _sort_keys(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def _bounds(rows: DataFrame, key: str, n: int, ranges: int) -> list:
    """About `ranges` values of key that part a sample of the rows evenly, in Spark's order."""
    found = rows.where(F.col(key).isNotNull()).select(key).sample(min(1.0, 20 * ranges / max(n, 1)), seed=7).orderBy(key).collect()
    values = [r[0] for r in found[:: max(1, len(found) // ranges)]]
    return list(dict.fromkeys(values))


def _narrowed(rows: DataFrame, key: str, down: bool, skip: int, limit: int, n: int, ranges: int) -> tuple[DataFrame, int, int, bool]:
    """The rows of the ranges of key that hold the page, how many of them to skip, how many there are, and whether they all have one value."""
    bounds = _bounds(rows, key, n, ranges)
    if not bounds:
        return rows, skip, n, True  # nothing but nulls
    c, kind = F.col(key), rows.schema[key].dataType
    at = [F.lit(b).cast(kind) for b in bounds]
    first = [(c > b) if down else (c < b) for b in at]  # comes before all of the bound's rows
    upto = [(c >= b) if down else (c <= b) for b in at]
    counts = rows.agg(*(F.count_if(x).alias(f"a{i}") for i, x in enumerate(first)), *(F.count_if(x).alias(f"b{i}") for i, x in enumerate(upto))).first()
    cuts = sorted({(counts[f"{s}{i}"], s == "b", i) for s in "ab" for i in range(len(bounds))})
    low = max((x for x in cuts if x[0] <= skip), default=None)
    high = min((x for x in cuts if x[0] >= skip + limit), default=None)
    window = rows
    if low:
        window = window.where(((c < at[low[2]]) if down else (c > at[low[2]])) | c.isNull() if low[1] else ((c <= at[low[2]]) if down else (c >= at[low[2]])) | c.isNull())
    if high:
        window = window.where(upto[high[2]] if high[1] else first[high[2]])
    before = low[0] if low else 0
    alone = bool(high) and any(counts[f"a{i}"] == before and counts[f"b{i}"] == high[0] for i in range(len(bounds)))
    return window, skip - before, (high[0] if high else n) - before, alone


def deep_page(df: DataFrame, order: Order, limit: int, offset: int, enough: int = 20_000, ranges: int = 64, most: int = 1000) -> DataFrame:
    """The page that orderBy, offset and limit give, for offsets that no task should hold: (column, descending) keys, nulls last, the last key unique.

    Values of a sample part the first key into ranges, and one pass counts how many rows
    come before each. Only the ranges that the page lies in are read again; if they are
    one value, the next key parts them further, until no more than `enough` rows are
    left to sort. Every pass reads one column, and what is known filters the scan.
    """
    if not 0 < limit <= most or offset < 0:
        raise ValueError(f"limit must be from 1 to {most}, offset 0 at least")
    rows, skip = df, offset
    n = df.count()
    for key, down in order:
        alone = False
        while n > enough + limit and skip < n and not alone:
            window, skip, left, alone = _narrowed(rows, key, down, skip, limit, n, ranges)
            rows, stuck, n = window, left == n, left
            if stuck and not alone:
                return _sorted_page(rows, order, limit, skip)  # the sample parts it no further
        if not alone:
            break
    return _sorted_page(rows, order, limit, skip)


def _sorted_page(rows: DataFrame, order: Order, limit: int, skip: int) -> DataFrame:
    return rows.orderBy(*_sort_keys(order)).offset(skip).limit(limit)


def page_after(df: DataFrame, order: Order, last: tuple, limit: int, most: int = 1000) -> DataFrame:
    """The page behind a row of which last has the keys: what a reader who goes on needs, at the cost of a first page."""
    if not 0 < limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    beyond, equal = F.lit(False), F.lit(True)
    for (key, down), value in zip(order, last, strict=True):
        c, v = F.col(key), F.lit(value).cast(df.schema[key].dataType)
        if value is not None:
            beyond = beyond | (equal & (((c < v) if down else (c > v)) | c.isNull()))
        equal = equal & c.eqNullSafe(v)
    return df.where(beyond).orderBy(*_sort_keys(order)).limit(limit)
