"""Line streams within their row: a text's lines are an array, and what they inherit needs no shuffle.

The functions of `segments` do the same for lines that come as rows of a table. A null
text has no lines and so no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.automaton import let

Test = Callable[[Column], Column]


def positions(lines: Column, test: Test) -> Column:
    """Places, from 0, of the lines that pass; a test that is null fails."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def blocks(lines: Column, is_start: Test) -> Column:
    """Array of (block_no, start, lines): block 0 is what comes before the first start, if anything does."""

    def cut(lines: Column) -> Column:
        bounds = F.concat(F.array(F.lit(0)), positions(lines, is_start), F.array(F.size(lines)))

        def of(bounds: Column) -> Column:
            span = lambda k: F.slice(lines, F.get(bounds, k) + 1, F.get(bounds, k + 1) - F.get(bounds, k))
            each = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: F.struct(k.alias("block_no"), F.get(bounds, k).alias("start"), span(k).alias("lines")))
            return F.filter(each, lambda b: F.size(b["lines"]) > 0)

        return let(bounds, of)

    return let(lines, cut)


def in_blocks(docs: DataFrame, key: str, text: str, is_start: Test) -> DataFrame:
    """(key, block_no, start, lines): a row for each block of a text's lines."""
    rows = docs.select(key, F.explode(blocks(F.split(text, "\n"), is_start)).alias("__b"))
    return rows.select(key, F.col("__b.block_no").cast("long").alias("block_no"), "__b.start", "__b.lines")


def block_texts(found: DataFrame, key: str) -> DataFrame:
    """(key, block_no, n_lines, row_text) of the rows of in_blocks."""
    return found.select(key, "block_no", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", " ").alias("row_text"))


def carry_forward(docs: DataFrame, key: str, text: str, is_heading: Test, heading: Test, name: str) -> DataFrame:
    """(key, line_no, line, name): the last heading at or before each line; null before the first."""
    found = in_blocks(docs, key, text, is_heading)
    carried = F.when(F.col("block_no") > 0, heading(F.get("lines", F.lit(0))))
    rows = found.select(key, "start", carried.alias(name), F.posexplode("lines").alias("__at", "line"))
    return rows.select(key, (F.col("start") + F.col("__at")).alias("line_no"), "line", name)


def with_next(docs: DataFrame, key: str, text: str, wanted: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, line_no, line, next_line) of the lines that pass a test of themselves and the next; the last one's next is null."""

    def told(lines: Column) -> Column:
        each = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.get(lines, i + 1).alias("next_line")))
        return F.filter(each, lambda r: wanted(r["line"], r["next_line"]))

    return docs.select(key, F.inline(let(F.split(text, "\n"), told)))


def gated(docs: DataFrame, key: str, text: str, opens: Test) -> DataFrame:
    """(key, line_no, line): lines after the first that opens the gate, without those that open it again."""

    def behind(lines: Column) -> Column:
        first = F.get(positions(lines, opens), F.lit(0))
        each = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
        rest = let(first, lambda p: F.when(p.isNotNull(), F.slice(each, p + 2, F.greatest(F.size(lines) - p - 1, F.lit(0)))))
        return F.filter(rest, lambda r: ~F.coalesce(opens(r["line"]), F.lit(False)))

    return docs.select(key, F.inline(let(F.split(text, "\n"), behind)))


def heading_changes(lines: Column, is_heading: Test, heading: Test) -> Column:
    """How many headings differ from the heading before, so that one repeated on a new page goes on with its block."""
    met = F.filter(F.transform(lines, lambda x: F.when(is_heading(x), heading(x))), lambda h: h.isNotNull())
    return let(met, lambda m: F.size(F.filter(F.transform(m, lambda h, i: ~h.eqNullSafe(F.get(m, i - 1))), lambda new: new)))


def block_fields(found: DataFrame, keys: list[str], name: str, value: Test, matches: Test, kinds: dict[str, Test]) -> DataFrame:
    """(keys, name, kinds) of the rows of in_blocks: the value of a block's last line that matches, and the first line of each kind. Null where no line does."""

    def passing(test: Test) -> Column:
        return F.filter("lines", lambda x: F.coalesce(test(x), F.lit(False)))

    last = value(F.try_element_at(passing(matches), F.lit(-1)))
    firsts = [F.get(passing(test), F.lit(0)).alias(kind) for kind, test in kinds.items()]
    return found.select(*keys, last.alias(name), *firsts)
