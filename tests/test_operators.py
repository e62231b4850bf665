"""Operators on ties, nulls, replays and shuffled rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from marlstone.functions import geo
from marlstone.operators import filters, joins, matching, paging, reach, resolve, rollup, rules, segments, state
from marlstone.plans import rollups


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "id int, k string"), spark.createDataFrame([(1, True), (1, None), (2, False)], "id int, flag boolean")


def test_filters(spark, parents):
    p, c = parents
    assert filters.all_given(p, [None, filters.optional(0, F.col("id") == 0), filters.optional("", F.col("k") == "")]).count() == 3
    assert [filters.with_flag(p, c, ["id"], w).count() for w in (None, True, False)] == [3, 2, 1]
    assert p.where(filters.text_range(F.col("k"), "a", None)).count() == 2 and p.where(filters.text_range(F.col("k"), None, None)).count() == 3
    with pytest.raises(ValueError):
        filters.require(" x ", 2)


def test_pages_add_up_to_the_whole(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(23)], "id int, k int")
    for descending in (False, True):
        keys = paging.order_by({"k": F.col("k")}, "k", descending, "k", F.col("id"))
        parts = [r for at in range(0, 30, 5) for r in paging.page(df, keys, 5, at).collect()]
        assert parts == df.orderBy(*keys).collect() and parts[-1]["k"] is None
    assert paging.page(df, [F.asc("id")], 5, 100).count() == 0
    assert paging.envelope(df, [F.asc("id")], 2)["total"] == 23
    with pytest.raises(ValueError):
        paging.page(df, [F.asc("id")], 0)


def test_nearest_puts_unknown_places_last(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 5.0)], "id int, lat double")
    for descending, want in ((False, [2, 3, 1]), (True, [3, 2, 1])):
        assert [r["id"] for r in df.orderBy(*paging.nearest(F.col("lat"), F.abs("lat"), F.asc("id"), descending=descending)).collect()] == want


def test_joins(spark):
    a = spark.createDataFrame([(1, None, "C-1"), (2, "x", "C-02"), (3, "y", "--")], "id int, g string, code string")
    b = spark.createDataFrame([(10, None, "1"), (20, "x", "02"), (30, "z", "")], "bid int, g string, num string")
    assert rows(joins.null_safe(a, b, ["g"]), "id", "bid") == [(1, 10), (2, 20)]
    assert rows(joins.on_derived_key(a.drop("g"), b, F.regexp_replace("code", "[^0-9]", ""), F.col("num")), "id", "bid") == [(1, 10), (2, 20)]
    left = spark.createDataFrame([(1, "k", "d1"), (2, "k", None)], "id int, k string, d string")
    right = spark.createDataFrame([(7, "k", "d1"), (8, "k", "d2"), (9, "k", None)], "rid int, k string, d string")
    assert rows(joins.with_optional_key(left, right, ["k"], "d"), "id", "rid") == [(1, 7), (2, 7), (2, 8), (2, 9)]


def test_rollups(spark, parents):
    p, c = parents
    assert rows(rollup.with_child_counts(p, c, ["id"], n_all=F.count(F.lit(1))), "id", "n_all") == [(0, 0), (1, 2), (2, 1)]
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 5), ("b", 4, None)], "k string, id int, at int")
    best = rows(rollup.greatest_per_key(df, ["k"], ["at", "id"], []), "k", "id")
    assert best == rows(rollup.first_per_key(df, ["k"], [F.desc_nulls_last("at"), F.desc("id")]), "k", "id") == [("a", 3), ("b", 4)]
    parts = [spark.createDataFrame([("x", 1)], "k string, n int"), spark.createDataFrame([("x", 9), ("y", 9)], "k string, m int")]
    assert rows(rollup.union_reaggregate(parts, ["k"], ["n"], ["m"])) == [("x", 1, 9), ("y", 0, 9)]
    assert [len(r["kids"]) for r in rollup.nested(p, c, ["id"], ["flag"], "kids").orderBy("id").collect()] == [0, 2, 1]


def narrow_plainly(pairs, steps):
    out = {}
    for key in {p["id"] for p in pairs}:
        left = [p for p in pairs if p["id"] == key]
        n = len(left)
        for step in steps:
            left = [p for p in left if step(p)] or left
        out[key] = ("exact" if n == 1 else "refined" if len(left) == 1 else "ambiguous", left[0]["offer"] if len(left) == 1 else None)
    return out


def test_matching_in_any_row_order(spark):
    pairs = [{"id": i, "offer": 10 * i + o, "a": o == i % 3, "b": None if o == 1 else o == 2} for i in range(12) for o in range(i % 4)]
    want = narrow_plainly(pairs, [lambda p: p["a"], lambda p: bool(p["b"])])
    wanted = spark.range(12).toDF("id")
    for order in (pairs, pairs[::-1]):
        df = spark.createDataFrame([tuple(p.values()) for p in order], "id long, offer long, a boolean, b boolean").repartition(3)
        got = {r["id"]: (r["status"], r["offer"]) for r in matching.matched(wanted, df, "id", "offer", [F.col("a"), F.col("b")]).collect()}
        assert got == want | {i: ("no_match", None) for i in range(12) if i % 4 == 0}


def test_state(spark):
    old = spark.createDataFrame([(1, "o", "c1"), (2, "o", "c2")], "id int, v string, created string")
    new = spark.createDataFrame([(2, "n", "c9"), (3, "n", "c9")], "id int, v string, created string")
    once = state.upsert(old, new, ["id"], keep=["created"])
    assert rows(once) == [(1, "o", "c1"), (2, "n", "c2"), (3, "n", "c9")] == rows(state.upsert(once, new, ["id"], keep=["created"]))
    assert rows(state.insert_absent(old, new.unionByName(new), ["id"]), "id", "v") == [(1, "o"), (2, "o"), (3, "n")]
    assert rows(state.replace_by_parent(old, new.where("id = 2"), ["id"]), "id", "v") == [(1, "o"), (2, "n")]
    assert rows(state.unlink(spark.createDataFrame([(1, 2), (2, 3)], "a int, link int"), new.where("id = 3"), "link", "id")) == [(1, 2), (2, None)]
    runs = spark.createDataFrame([(1, "v1", "success"), (2, "v2", "failed"), (3, "v2", "success")], "id int, version string, status string")
    assert rows(state.todo(spark.range(1, 5).toDF("id"), runs, ["id"], "version", "v2")) == [(1,), (2,), (4,)]


def test_sync_outcomes(spark):
    links = [(1, 1, "u", True, None), (1, 2, "u", True, "h"), (1, 3, "v", False, None), (1, 4, "v", True, "h"), (1, 5, "w", True, "k"), (2, 6, "w", True, "n")]
    df = spark.createDataFrame(links, "run int, pos int, url string, downloadable boolean, sha string")
    got = state.sync_outcomes(df, spark.createDataFrame([("k",), ("k",)], "sha string"))
    assert [r["outcome"] for r in got.orderBy("pos").collect()] == ["error", "duplicate", "not_downloadable", "duplicate", "known", "new"]


def test_lifecycle_is_total_and_idempotent(spark):
    combos = list(itertools.product([0, 1], repeat=3))
    items = spark.createDataFrame([(i, 1 if c[2] else 2, "available", None, None) for i, c in enumerate(combos)], "code int, src int, status string, missing_since string, closed_by long")
    awards = spark.createDataFrame([(i, 7) for i, c in enumerate(combos) if c[0]] + [(i, 5) for i, c in enumerate(combos) if c[0]], "code int, closing long")
    seen = spark.createDataFrame([(i,) for i, c in enumerate(combos) if c[1]], "code int")
    looked = spark.createDataFrame([(1,)], "src int")
    step = lambda df, day: state.lifecycle(df, awards, seen, looked, "code", "src", F.lit(day))
    first = step(items, "d1")
    for r in first.collect():
        awarded, visible, observed = combos[r["code"]]
        assert r["status"] == ("awarded" if awarded else "available" if visible else "not_visible" if observed else "available")
        assert r["closed_by"] == (5 if awarded else None) and (r["missing_since"] == "d1") == bool(awarded or (not visible and observed))
    assert rows(first) == rows(step(first, "d2"))


def test_outcomes(spark):
    history = [(1, 1, "awarded", 1, 2), (1, 2, "pending", 9, 0), (2, 3, "awarded", 1, 0), (3, 4, "odd", 1, 0), (4, 5, "pending", 1, 0)]
    h = spark.createDataFrame(history, "k int, id int, status string, at int, n_assigned int")
    c = spark.createDataFrame([(2, True), (2, False), (3, False)], "k int, selected boolean")
    got = resolve.outcomes(spark.range(1, 6).select(F.col("id").cast("int").alias("k")), h, c, "k", "awarded", ["awarded", "pending"])
    assert rows(got) == [(1, "awarded", 1), (2, "selected_candidate", None), (3, "candidate", None), (4, "pending", 5), (5, "no_data", None)]


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (2, None), (3, "e"), (3, "e")], "id int, v string")
    assert rows(state.upsert(old, new, ["id"])) == [(1, "a"), (2, "d"), (3, "e")]


def test_event_batches_replay(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "id int, c string")
    first = state.event_batches(docs, F.col("c"), "id", ("new", "new ones"))
    assert rows(first, "category", "body", "block_no", "ids") == [("x", "2 new ones", 0, "1,3"), ("y", "1 new", 0, "2")]
    other = state.event_batches(docs.replace(3, 5, "id"), F.col("c"), "id", ("new", "new ones"))
    assert first.join(other, "event_key").count() == 1
    assert state.insert_absent(first, state.event_batches(docs, F.col("c"), "id", ("new", "new ones")), ["event_key"]).count() == 2


def test_event_ids_come_in_blocks(spark):
    docs = spark.range(-100, 1000).withColumn("c", F.lit("x"))
    found = state.event_batches(docs.unionByName(docs), F.col("c"), "id", ("new", "new ones"), size=64).collect()
    assert len({r["event_key"] for r in found}) == 1 and {r["n"] for r in found} == {1100}
    ids = [int(i) for r in sorted(found, key=lambda r: r["block_no"]) for i in r["ids"].split(",")]
    assert ids == list(range(-100, 1000)) and max(len(r["ids"].split(",")) for r in found) == 64


def test_rules(spark):
    df = spark.createDataFrame([("alpha beta",), ("beta",), (None,)], "t string")
    t = F.col("t")
    assert [r[0] for r in df.select(rules.first_match([(rules.has_any(t, ["alpha"]), "A"), (rules.has_any(t, ["beta"]), "B")], "none")).collect()] == ["A", "B", "none"]
    assert [r[0] for r in df.select(rules.at_least(t, ["alpha", "beta", "gamma"], 2)).collect()][:2] == [True, False]
    assert [r[0] for r in df.select(rules.relevant(F.coalesce(t, F.lit("")), ["alpha"], ["beta"])).collect()] == [False, True, False]


TEXT = "noise\nHEAD one\nrow 1 a\n  more\nrow 2 b\nHEAD two\nHEAD two\nrow 3 c"


def test_segments(spark):
    lines = segments.lines(spark.createDataFrame([(1, TEXT), (2, ""), (3, "only")], "id int, text string"), "id", "text")
    head = F.col("line").startswith("HEAD")
    carried = segments.carry_forward(lines, "id", head, F.col("line"), "heading").where("id = 1").orderBy("line_no").collect()
    assert [r["heading"] for r in carried] == [None, *["HEAD one"] * 4, *["HEAD two"] * 3]
    told = segments.gated(segments.numbered_blocks(lines, "id", F.col("line").startswith("row")), "id", head).where("block_no > 0")
    got = segments.block_texts(told.where(~head), "id").orderBy("block_no").collect()
    assert [r["row_text"] for r in got] == ["row 1 a   more", "row 2 b", "row 3 c"]
    headed = lines.withColumn("h", F.when(head, F.col("line")))
    starts = headed.withColumn("new", segments.changed_from_previous(headed, "id", "h")).where("new").count()
    assert starts == 2
    assert segments.with_next(lines, "id").where("id = 3").first()["next_line"] is None
    found = segments.regex_rows(spark.createDataFrame([(1, "a=1;b=2")], "id int, t string"), "id", F.col("t"), "([a-z])=([0-9])(?:;|$)", ["k", "v"])
    assert rows(found) == [(1, 0, "a", "1"), (1, 1, "b", "2")]


def test_reach_over_a_cycle(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)], "source int, target int")
    got = {r["node"]: r["depth"] for r in reach.reachable(links, spark.createDataFrame([(0,)], "n int"), 3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_run_log(spark):
    started = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "run int, source string")
    ends = [(1, "d1", None, 3), (1, "d2", "broken", 4), (2, "d1", None, None), (9, "d1", None, 1), (None, "d1", None, 1)]
    finished = spark.createDataFrame(ends, "run int, finished string, error string, n_new int")
    got = {r["source"]: (r["status"], r["finished"], r["error"], r["n_new"]) for r in state.run_log(started, finished, ["run"]).collect()}
    assert got == {"a": ("failed", "d2", "broken", 4), "b": ("success", "d1", None, 0), "c": ("running", None, None, 0), "d": ("running", None, None, 0)}


def test_block_fields_look_backward_for_the_status_and_forward_for_each_kind(spark):
    lines = [(1, 1, 0, "A."), (1, 1, 1, "7 x"), (1, 1, 2, "B."), (1, 1, 3, "8 y"), (1, 1, 4, None), (1, 2, 5, "none")]
    rows_ = spark.createDataFrame(lines, "doc int, block int, line_no int, line string").repartition(3)
    got = rows(segments.block_fields(rows_, ["doc", "block"], "status", F.col("line"), F.col("line").rlike("[.]$"), {"numbered": F.col("line").rlike("^[0-9]")}))
    assert got == [(1, 1, "B.", "7 x"), (1, 2, None, None)]


def test_geo_enrichment_is_null_where_a_place_or_an_origin_is_unknown(spark):
    df = spark.createDataFrame([(1, 1.5, 2.0, 1.5, 2.0), (2, None, 2.0, 0.0, 0.0), (3, 1.5, 2.0, None, 0.0)], "id int, lat double, lon double, a double, b double")
    got = rows(geo.enriched(df, "lat", "lon", F.col("a"), F.col("b")), "id", "map_url", "route_url", "distance_km")
    here = "1.500000,2.000000"
    assert got == [(1, f"geo:{here}", f"route:{here};{here}", 0.0), (2, None, None, None), (3, f"geo:{here}", f"route:{here}", None)]


def test_a_profile_of_nobody_has_no_rows(spark):
    assert rollups.profile_of(spark, "/root/testdata/sf0.001", "nobody").count() == 0


def test_subscriptions_end_and_go(spark):
    old = spark.createDataFrame([(1, True, "d0"), (2, False, "d0"), (3, None, "d0"), (None, True, "d0")], "id int, active boolean, updated string")
    gone = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,), (9,)], "id int")
    ended = state.deactivate(old, gone, ["id"], "active", "updated", F.lit("d1"))
    assert sorted(map(tuple, ended.where("id is not null").collect())) == [(1, False, "d1"), (2, False, "d0"), (3, False, "d1")]
    assert rows(ended.where("id is null")) == [(None, True, "d0")]
    assert [r["id"] for r in state.remove(ended, gone, ["id"]).collect()] == [None]
