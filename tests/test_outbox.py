import random
import time

import pytest

from marlstone.streaming.outbox import Terms, outbox_stream, states

SCHEMA = "k string, kind string, at timestamp, turn long"
T0 = 1_700_000_000
TERMS = Terms(lease=60, delay=300, attempts=3)


def records(spark, rows):
    return spark.createDataFrame([(k, kind, T0 + t, i) for i, (k, kind, t) in enumerate(rows)], "k string, kind string, at long, turn long").selectExpr("k", "kind", "timestamp_seconds(at) as at", "turn")


def found(df):
    return {r["k"]: (r["status"], r["attempts"]) for r in df.collect()}


def test_states(spark):
    rows = [
        ("sent", "new", 0), ("sent", "sent", 10), ("sent", "new", 20), ("sent", "failed", 30),
        ("again", "new", 0), ("again", "failed", 5), ("again", "new", 6), ("again", "sent", 320),
        ("lost", "new", 0),
        ("waits", "new", 900), ("waits", "failed", 910),
        ("up", "new", 0), ("up", "failed", 1), ("up", "failed", 302), ("up", "failed", 603), ("up", "sent", 700),
        ("early", "sent", 0), ("early", "new", 995), (None, "new", 0),
        ("future", "new", 5000),
    ]
    got = found(states(records(spark, rows), "k", "kind", "at", "turn", TERMS, T0 + 1000))
    assert got == {"sent": ("sent", 1), "again": ("sent", 2), "lost": ("failed", 3), "waits": ("waiting", 1), "up": ("failed", 3), "early": ("claimed", 1)}
    assert found(states(records(spark, rows).limit(0), "k", "kind", "at", "turn", TERMS, T0)) == {}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drained(spark, path, batches, name, terms, **how):
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = outbox_stream(stream, "k", "kind", "at", "turn", terms, lanes=2, **how)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted((r["event_key"], r["at"] - T0, r["status"], r["attempts"]) for r in spark.sql(f"select * from {name}").collect())


def test_a_duplicate_in_a_later_batch_and_a_sender_that_fails_once(spark, rocks, tmp_path):
    batches = [
        records(spark, [("a", "new", 0), ("b", "new", 1), ("a", "new", 2)]),
        records(spark, [("a", "sent", 10), ("b", "failed", 12)]),
        records(spark, [("a", "new", 20), ("c", "new", 400)]),  # the watermark lets b's wait end
        records(spark, [("b", "sent", 330), ("c", "sent", 410), ("z", "new", 2000)]),
        records(spark, [("z", "sent", 2001)]),
    ]
    got = drained(spark, str(tmp_path / "in"), batches, "outbox_a", TERMS)
    assert got == [("a", 0, "claimed", 1), ("a", 10, "sent", 1), ("b", 1, "claimed", 1), ("b", 312, "claimed", 2), ("b", 330, "sent", 2), ("c", 400, "claimed", 1), ("c", 410, "sent", 1), ("z", 2000, "claimed", 1), ("z", 2001, "sent", 1)]


def test_the_stream_ends_in_the_states_of_the_table(spark, rocks, tmp_path):
    """Random records in several batches, each later than the one before; lost senders too. What was last given of an event is its state, or it waits."""
    r = random.Random(3)
    rows = sorted(((f"e{r.randrange(25)}", r.choice(["new", "new", "failed", "sent"]), r.randrange(3000)) for _ in range(160)), key=lambda x: x[2])
    rows += [("end", "new", 9000), ("end", "sent", 9001)]
    all_rows = records(spark, rows).cache()
    cuts = [0, 40, 90, 130, 160, 161, 162]
    batches = [all_rows.where(f"turn >= {a} and turn < {b}") for a, b in zip(cuts, cuts[1:])]
    got = drained(spark, str(tmp_path / "in"), batches, "outbox_b", TERMS, remember=100_000)
    last = {}
    for k, at, status, tried in sorted(got, key=lambda x: (x[1], x[3])):
        last[k] = (status, tried)
    assert len(got) == len(set(got)) and last == found(states(all_rows, "k", "kind", "at", "turn", TERMS, T0 + 8999 + 2))
    assert {s for s, _ in last.values()} == {"sent", "failed"}
