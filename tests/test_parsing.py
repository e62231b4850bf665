import random
import re

from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import dispatch, peel, reach, rules

SF = "/root/testdata/sf0.001"


def plain(tokens, acceptors):
    """(name -> tokens), rest, ok by hand; acceptors: (name, test, least, most)."""
    at, out, ok = len(tokens), {}, True
    for name, test, least, most in acceptors:
        n = 0
        while at - n > 0 and tokens[at - n - 1] is not None and test(tokens[at - n - 1]) and (most is None or n < most):
            n += 1
        out[name] = tokens[at - n : at]
        at -= n
        ok = ok and n >= least
    return out, tokens[:at], ok


def test_peeled_tokens(spark):
    r = random.Random(1)
    words = ["Smith", "Ann", "12", "3,5", "7.25", "A*", "yes", "no", '"8"', None, "x"]
    lines = [[r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 6, 40]))] for _ in range(300)]
    is_number, flag, star = (lambda x: re.fullmatch(r"[\"']?[+-]?[0-9]+([.,][0-9]+)?[\"']?", x) is not None), (lambda x: x in ("yes", "no")), (lambda x: x.endswith("*"))
    acceptors = [peel.Acceptor("flag", lambda x: x.isin("yes", "no"), most=1), peel.Acceptor("numbers", peel.number, least=1), peel.Acceptor("star", lambda x: x.endswith("*"), most=2)]
    df = spark.createDataFrame([*enumerate(lines), (900, None)], "id int, t array<string>")
    found = {x["id"]: x["p"] for x in df.select("id", peel.peeled(F.col("t"), acceptors, "name").alias("p")).collect()}
    assert found.pop(900) is None
    for i, line in enumerate(lines):
        want, rest, ok = plain(line, [("flag", flag, 0, 1), ("numbers", is_number, 1, None), ("star", star, 0, 2)])
        p = found[i]
        assert {k: p[k] for k in want} == want and p["name"] == rest and p["ok"] == ok


def test_a_row_is_taken_apart_again(spark):
    """Name, numbers and flag of an item, put together and peeled."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    line = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.format_string("%.2f", "p_retailprice"), F.when(F.col("p_partkey") % 2 == 0, "yes").otherwise("no"))
    acceptors = [peel.Acceptor("flag", lambda x: x.isin("yes", "no"), least=1, most=1), peel.Acceptor("total", peel.number, least=1, most=1), peel.Acceptor("size", peel.number, least=1, most=1)]
    rows = part.select("*", peel.peeled(F.split(line, " "), acceptors, "name").alias("p"))
    good = (F.array_join("p.name", " ") == F.col("p_name")) & (F.col("p.size")[0].cast("int") == F.col("p_size")) & (F.abs(F.col("p.total")[0].cast("double") - F.col("p_retailprice")) < 0.006) & F.col("p.ok")
    assert rows.where(good).count() == part.count() > 0


def dispatched(spark, texts, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    every = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    parsers = [dispatch.Parser("digits", F.col("t").contains("#"), every("[0-9]+"), feeds=True), dispatch.Parser("capitals", F.lit(True), every("[A-Z]+"))]
    ran = []
    tallies = dispatch.with_followup(docs, "id", parsers, lambda rows: rows.write.parquet(str(tmp_path / "out")), lambda: ran.append(1))
    return tallies, ran, sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_dispatch_counts_and_follows_up(spark, tmp_path):
    tallies, ran, rows = dispatched(spark, ["# 1 22 A", "# none", "3 B C", None], tmp_path)
    assert tallies == {"digits": dispatch.Tally(2, 1, 1, 2), "capitals": dispatch.Tally(4, 2, 2, 3)}
    assert ran == [1] and rows == [(0, "capitals", 0, "A"), (0, "digits", 0, "1"), (0, "digits", 1, "22"), (2, "capitals", 0, "B"), (2, "capitals", 1, "C")]


def test_no_follow_up_without_a_success(spark, tmp_path):
    tallies, ran, rows = dispatched(spark, ["# none", "A 1"], tmp_path)
    assert not ran and tallies["digits"] == dispatch.Tally(1, 0, 1, 0) and rows == [(1, "capitals", 0, "A")]


def test_dispatch_of_nothing(spark, tmp_path):
    tallies, ran, rows = dispatched(spark, [], tmp_path)
    assert not ran and not rows and tallies["capitals"] == dispatch.Tally(0, 0, 0, 0)


def test_far_reach_equals_the_near_form(spark):
    r = random.Random(4)
    links = spark.createDataFrame([(r.randrange(60), r.randrange(60)) for _ in range(80)] + [(None, 1), (1, None)], "source int, target int")
    seeds = spark.createDataFrame([(0,), (7,), (None,)], "n int")
    got = sorted(map(tuple, reach.reachable_far(links, seeds, 5).collect()))
    assert got == sorted(map(tuple, reach.reachable(links, seeds.where("n is not null"), 5).collect()))
    assert [tuple(x) for x in reach.reachable_far(links, seeds.limit(0), 5).collect()] == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "source int, target int")
    far = reach.reachable_far(chain, spark.createDataFrame([(0,)], "n int"), 50)
    assert sorted(map(tuple, far.collect())) == [(i, i) for i in range(13)]


def test_natural_order(spark):
    want = ["", "a", "a0", "a1", "a2", "a10", "a10b2", "a10b10", "b1", "b007", "b08", "b100", "é2"]
    df = spark.createDataFrame([(x,) for x in reversed([*want, None])], "s string")
    assert [r["s"] for r in df.orderBy(tx.natural_key(F.col("s")).asc_nulls_last()).collect()] == [*want, None]
    keys = df.select(tx.natural_key(F.lit("x007")), tx.natural_key(F.lit("x7")), tx.natural_key(F.lit("x000"))).first()
    assert keys[0] == keys[1] == "x00017" and keys[2] == "x00010"


def test_alike_keys(spark):
    df = spark.createDataFrame([("Ángel",), ("angel",), ("ANGEL",), ("Strasse",), ("straße",), ("angle",), (None,)], "s string")
    got = sorted((r["n"] for r in df.groupBy(tx.alike(F.col("s")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    assert got == [3, 2, 1, 1]
    assert df.where(tx.alike(F.col("s")) == "ÁNGEL").count() == 3


def test_the_first_place_with_a_date_counts(spark):
    rows = [("list_2024_03.pdf", "on 1/2/2024", None), ("list_2024_13.pdf", "on 31/2/2024 or 1/2/2024", "5/6/2024"), ("x", "123/4/2024", "5/6/2024"), (None, None, "soon"), (None, None, None), ("a2024-12", "", "")]
    df = spark.createDataFrame(rows, "name string, body string, said string")
    month, first = tx.month_in_name(F.col("name")), tx.first_day_first(F.col("body"))
    told = rules.inferred([("name", month, month), ("body", first, tx.padded_day_first(first)), ("said", F.col("said"), tx.padded_day_first(F.col("said")))])
    assert [tuple(r["d"]) if r["d"] else None for r in df.select(told.alias("d")).collect()] == [
        ("name", "2024_03", "2024_03"), ("body", "31/2/2024", None), ("said", "5/6/2024", "2024-06-05"), ("said", "soon", None), None, ("name", "2024-12", "2024-12"),
    ]
