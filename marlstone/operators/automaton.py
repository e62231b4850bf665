"""Row grammars of line streams: a table of transitions over classes of lines, run as one fold a document.

A text is one row, so what its lines inherit from those before them needs no shuffle and
no window: the lines are an array, and a fold over it carries the state, the fields that
headings set, and the row that is open. Rows may take several lines, skip noise between
them, and have what the headings said when they began.

The fold goes block by block, and each block's rows are one array, so a text of very many
lines isn't copied once a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that are folded before their rows are put aside.
BLOCK = 128
#: What a transition may do with its line: begin a row, go on with the open one, end it, or leave it out. A line that ends a row isn't part of it.
ACTIONS = ("begin", "extend", "end", "skip")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row; within a lambda Spark computes an expression anew for each element."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class Step:
    """What a line of a class does in a state."""

    to: str
    action: str = "skip"
    set: dict[str, Callable[[Column], Column]] = field(default_factory=dict)  # fields that the line gives
    clear: tuple[str, ...] = ()  # fields that it makes null


@dataclass(frozen=True)
class Automaton:
    """classes are tried in their order, and a line that is of none is of class `other`.

    table has a step for (state, class); a pair that it lacks takes that of (ANY, class),
    and a line without a step leaves all as it is. The first state is that of a text's
    beginning. A row is open until one begins, a step ends it, or the text does.
    """

    classes: dict[str, Callable[[Column], Column]]
    table: dict[tuple[str, str], Step]
    states: tuple[str, ...]
    fields: tuple[str, ...] = ()

    def __post_init__(self):
        for (state, kind), step in self.table.items():
            if state not in (*self.states, ANY) or step.to not in (*self.states, SAME) or kind not in (*self.classes, OTHER) or step.action not in ACTIONS:
                raise ValueError(f"no such state, class or action: {state}, {kind}, {step}")
            if not {*step.set, *step.clear} <= {*self.fields}:
                raise ValueError(f"no such field: {step}")

    def _steps(self) -> list[tuple[int, int, Step]]:
        kinds = [*self.classes, OTHER]
        out = []
        for s, state in enumerate(self.states):
            for k, kind in enumerate(kinds):
                step = self.table.get((state, kind), self.table.get((ANY, kind)))
                if step:
                    out.append((s, k, step))
        return out

    def _kind(self, line: Column) -> Column:
        kind = F.lit(len(self.classes))
        for k, test in reversed([*enumerate(self.classes.values())]):
            kind = F.when(test(line), F.lit(k)).otherwise(kind)
        return kind

    def rows(self, lines: Column) -> Column:
        """Array of (first, n_lines, lines, fields...): the rows of an array of lines, first counted from 0. Null for null."""
        steps = self._steps()
        at = {s: i for i, s in enumerate(self.states)}

        def field_value(name: str, acc: Column, line: Column, code: Column) -> Column:
            value = acc[name]
            for i, (_, _, step) in enumerate(steps):
                if name in step.set:
                    value = F.when(code == i, step.set[name](line).cast("string")).otherwise(value)
                elif name in step.clear:
                    value = F.when(code == i, F.lit(None).cast("string")).otherwise(value)
            return value

        def one_of(code: Column, test: Callable[[Step], bool]) -> Column:
            return code.isin(*(i for i, (_, _, step) in enumerate(steps) if test(step)) or (-1,))

        open_type = "struct<first:int,lines:array<string>" + "".join(f",{f}:string" for f in self.fields) + ">"
        none = F.lit(None).cast(open_type)

        def advance(acc: Column, x: Column) -> Column:
            """x is (pos, line, kind)."""
            line = x["line"]
            code = F.lit(-1)
            for i, (s, k, _) in enumerate(steps):
                code = F.when((acc["state"] == s) & (x["kind"] == k), F.lit(i)).otherwise(code)

            def told(code: Column) -> Column:
                state = acc["state"]
                for i, (_, _, step) in enumerate(steps):
                    if step.to != SAME:
                        state = F.when(code == i, F.lit(at[step.to])).otherwise(state)
                fields = {f: field_value(f, acc, line, code) for f in self.fields}
                begins, extends = one_of(code, lambda s: s.action == "begin"), one_of(code, lambda s: s.action == "extend")
                ends = one_of(code, lambda s: s.action in ("begin", "end"))
                fresh = F.struct(x["pos"].alias("first"), F.array(line).alias("lines"), *(fields[f].alias(f) for f in self.fields))
                longer = F.struct(acc["open"]["first"].alias("first"), F.concat(acc["open"]["lines"], F.array(line)).alias("lines"), *(acc["open"][f].alias(f) for f in self.fields))
                row = F.when(begins, fresh).when(extends & acc["open"].isNotNull(), longer).when(ends, none).otherwise(acc["open"])
                done = F.when(ends & acc["open"].isNotNull(), F.concat(acc["rows"], F.array(acc["open"]))).otherwise(acc["rows"])
                return F.struct(state.alias("state"), *(fields[f].alias(f) for f in self.fields), row.alias("open"), done.alias("rows"))

            return let(code, told)

        empty = F.array().cast(f"array<{open_type}>")

        def over(lines: Column) -> Column:
            marked = F.transform(lines, lambda line, pos: F.struct(pos.alias("pos"), line.alias("line"), self._kind(line).alias("kind")))
            return let(marked, blocks)

        def blocks(marked: Column) -> Column:
            carried = [F.lit(None).cast("string").alias(f) for f in self.fields]
            start = F.struct(F.lit(0).alias("state"), *carried, none.alias("open"), F.array().cast(f"array<array<{open_type}>>").alias("rows"))

            def block(acc: Column, b: Column) -> Column:
                inner = F.struct(acc["state"].alias("state"), *(acc[f].alias(f) for f in self.fields), acc["open"].alias("open"), empty.alias("rows"))
                after = F.aggregate(F.slice(marked, b * BLOCK + 1, F.lit(BLOCK)), inner, advance)
                return let(after, lambda r: F.struct(r["state"].alias("state"), *(r[f].alias(f) for f in self.fields), r["open"].alias("open"), F.concat(acc["rows"], F.array(r["rows"])).alias("rows")))

            whole = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(marked) - 1) / BLOCK).cast("int")), start, block)
            last = lambda r: F.concat(F.flatten(r["rows"]), F.when(r["open"].isNotNull(), F.array(r["open"])).otherwise(empty))
            return F.when(F.size(marked) > 0, let(whole, last)).otherwise(empty)

        return F.when(lines.isNotNull(), let(lines, over))


ANY = "*"
SAME = "="
OTHER = "other"


def parsed(docs: DataFrame, key: str, text: str, grammar: Automaton, join: str = " ") -> DataFrame:
    """(key, row_no, first_line, n_lines, row_text, fields...): the rows of every text, in order, from 0. A null text has none."""
    rows = docs.select(F.col(key), F.posexplode(grammar.rows(F.split(text, "\n"))).alias("row_no", "__row"))
    r = F.col("__row")
    return rows.select(key, "row_no", r["first"].alias("first_line"), F.size(r["lines"]).alias("n_lines"), F.array_join(r["lines"], join).alias("row_text"), *(r[f].alias(f) for f in grammar.fields))
