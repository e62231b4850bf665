"""Peeling tokens from the right: typed acceptors take their tokens one after the other, what is left is the name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.operators.automaton import let


@dataclass(frozen=True)
class Acceptor:
    """Takes tokens that pass, as many as stand together, `most` at most; a line that has fewer than `least` of them isn't ok."""

    name: str
    test: Callable[[Column], Column]
    least: int = 0
    most: int | None = None


def number(token: Column) -> Column:
    """Whether a token is a number, with point or comma; quotes around it don't count."""
    return token.rlike(r"^[\"']?[+-]?[0-9]+([.,][0-9]+)?[\"']?$")


def peeled(tokens: Column, acceptors: list[Acceptor], rest: str = "rest") -> Column:
    """Struct of an array of tokens for each acceptor, in the order of the line, of what is left, and of ok.

    The last acceptor's tokens stand leftmost. An acceptor that finds none leaves an
    empty array and the next one goes on at the same place. A null token passes no test;
    null for null.
    """

    def take(k: int, back: Column, at: Column, taken: list[tuple[Column, Column]]) -> Column:
        if k == len(acceptors):
            of = lambda p, n: F.reverse(F.slice(back, p + 1, n))
            fields = [of(p, n).alias(a.name) for a, (p, n) in zip(acceptors, taken)]
            ok = F.lit(True)
            for a, (_, n) in zip(acceptors, taken):
                ok = ok & (n >= a.least)
            return F.struct(*fields, of(at, F.size(back) - at).alias(rest), ok.alias("ok"))
        a = acceptors[k]
        left = F.slice(back, at + 1, F.size(back) - at)
        stop = F.array_position(F.transform(left, lambda x: F.coalesce(a.test(x), F.lit(False))), False).cast("int")
        run = let(stop, lambda s: F.when(s > 0, s - 1).otherwise(F.size(back) - at))
        run = F.least(run, F.lit(a.most)) if a.most is not None else run
        return let(run, lambda n: take(k + 1, back, at + n, [*taken, (at, n)]))

    return F.when(tokens.isNotNull(), let(F.reverse(tokens), lambda back: take(0, back, F.lit(0), [])))
