"""Scalar expressions on nulls, accents, wildcards and malformed input."""

import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import geo, urls
from marlstone.functions import text as tx


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_fold(spark):
    cases = {None: "", "": "", "  A  b\t\nC ": "a b c", "ÑANDÚ Çedilla": "nandu cedilla", "straße": "straße", "a b": "a b", "é": "e", "plain": "plain"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want string")
    assert all(r["got"] == r["want"] and r["again"] == r["want"] for r in rows.select("want", tx.fold(F.col("s")).alias("got"), tx.fold(tx.fold(F.col("s"))).alias("again")).collect())


def test_accent_table_drops_accents_only():
    source, target = tx.accent_table()
    assert len(target) < len(source) and all(unicodedata.normalize("NFD", a)[0] == b for a, b in zip(source, target))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aáÀñ ßX_%\t1-", max_size=12), min_size=1, max_size=20))
def test_keys_are_stable(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for key in (tx.fold, tx.key_strict):
        assert all(r[0] == r[1] for r in rows.select(key(F.col("s")), key(key(F.col("s")))).collect())


def test_keys(spark):
    got = one(spark, up=tx.key_upper(F.lit(" müller  Straße ")), strict=tx.key_strict(F.lit("O'Neil-Ñ, J.")), none=tx.key_or_null(F.lit(None).cast("string")))
    assert got == {"up": "MULLER STRASSE", "strict": "o neil-n j", "none": None}


def test_wildcards_stay_wildcards(spark):
    rows = spark.createDataFrame([("Máquina 10%",), ("maquinista",), (None,)], "s string")
    assert rows.where(tx.contains_folded(F.col("s"), "QUI_A")).count() == 1
    assert rows.where(tx.any_contains_folded([F.col("s"), F.lit(None).cast("string")], "quin")).count() == 2


def test_parsers(spark):
    got = one(
        spark,
        comma=tx.decimal_comma(F.lit(" 1,5 ")),
        bad=tx.decimal_comma(F.lit("x")),
        empty=tx.decimal_comma(F.lit("")),
        pad=tx.zero_padded(F.lit("123.0"), 8),
        over=tx.zero_padded(F.lit("123456789"), 8),
        day=tx.day_first_date(F.lit("05/02/2024")),
        no_day=tx.day_first_date(F.lit("31/02/2024")),
        nan=tx.null_if_blank(F.lit(" NaN ")),
        bracket=tx.last_parenthesised(F.lit("a (b) c (d)")),
        none=tx.last_parenthesised(F.lit("a")),
        number=tx.quoted_number(F.lit("'1,5'")),
        one=tx.tally_label(F.lit(1), "event", "events"),
        code=tx.code_label(F.lit("OLD_CODE"), {"x": "y"}),
    )
    assert got == {"comma": 1.5, "bad": None, "empty": None, "pad": "00000123", "over": "123456789", "day": "2024-02-05", "no_day": None, "nan": None, "bracket": "d", "none": None, "number": True, "one": "1 event", "code": "Old code"}


def test_name_and_split(spark):
    rows = spark.createDataFrame([("ana",), ("ana  ruiz",), ("ana maria de ruiz",)], "s string")
    assert [tuple(r) for r in rows.select(*tx.name_parts(F.col("s"))).collect()] == [("ana", None, None), ("ana", None, "ruiz"), ("ana", "maria de", "ruiz")]
    got = one(spark, a=tx.right_split(F.lit("x - y - z"), " - ")[0], b=tx.right_split(F.lit("x - y - z"), " - ")[1], c=tx.right_split(F.lit("x"), " - ")[0], d=tx.right_split(F.lit("x"), " - ")[1])
    assert got == {"a": "x - y", "b": "z", "c": "x", "d": None}


def test_distance(spark):
    def km(a, b, c, d):
        return one(spark, km=geo.haversine_km(*(F.lit(x).cast("double") for x in (a, b, c, d))))["km"]

    assert km(40, -3, 40, -3) == 0 and km(None, 1, 2, 3) is None
    assert km(0, 0, 0, 180) == pytest.approx(math.pi * geo.EARTH_KM, abs=0.01)
    assert one(spark, link=geo.map_link(F.lit(None).cast("double"), F.lit(1.0)))["link"] is None


def test_urls(spark):
    got = one(
        spark,
        plain=urls.canonical(F.lit("https://a.b/c;x?y#z")),
        pdf=urls.has_extension(F.lit("https://a.b/c.PDF?x=1"), "pdf"),
        host=urls.has_extension(F.lit("https://a.pdf"), "pdf"),
        links=urls.links(F.lit('<a href="/x">1</a><a href="#t">2</a><a href="mailto:q">3</a><a href="">4</a>')),
        slug=urls.slug(F.lit("/A b--C.d/")),
    )
    assert got == {"plain": "https://a.b/c", "pdf": True, "host": False, "links": ["/x"], "slug": "a-b-c-d"}


def test_references_are_resolved(spark):
    """The examples of section 5.4 of RFC 3986, and some of empty paths."""
    base = "http://a/b/c/d;p?q"
    want = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
        "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
        "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
        "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
        "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
        "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g#s/../x": "http://a/b/c/g#s/../x",
        "http:g": "http:g",
    }
    rows = [(base, k, v) for k, v in want.items()] + [("http://a", "g", "http://a/g"), ("http://a?q", "", "http://a?q"), (None, "g", None), ("http://a", None, None)]
    df = spark.createDataFrame(rows, "base string, link string, want string").repartition(2)
    assert df.where(~urls.absolute(F.col("base"), F.col("link")).eqNullSafe(F.col("want"))).collect() == []
