import hashlib
import pathlib
import threading
from concurrent.futures import ThreadPoolExecutor

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import ODD, documents, prose
from marlstone.llm import decontam, langid, queries
from marlstone.llm.common import stash, swept, table
from test_packing import check
from test_simhash import plain_components, plain_distinct

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage's output is what a version that looks at everything makes of its input."""
    docs = table(spark, SF, "documents")
    kept = {"raw": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF), name)
        assert docs.columns == kept["raw"].columns and docs.dtypes == kept["raw"].dtypes
        kept[name] = docs
    rows = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in kept.items()}

    model = langid.fit_on_folds(kept["raw"], folds=4, held_out=2, calibration=3)
    nats, n = model.entropies(list(rows["raw"].values()))
    accepted = set()
    for (doc, text), own, size in zip(rows["raw"].items(), nats, n):
        median, most = model.expected[model.langs[own.argmin()]]
        share = langid.np.exp(-(own - own.min()) * min(size, 32))
        fits = 1 / (1 + langid.np.exp(8 * ((own.min() - median) / (most[langid.length_class(langid.np.array([size]))[0]] - median) - 1)))
        if any(map(str.isalpha, text)) and share.max() / share.sum() * fits >= 0.5:
            accepted.add(doc)
    assert set(rows["language"]) == accepted

    con = duckdb.connect()
    kept["language"].toPandas().to_parquet(tmp_path / "documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = dict(con.execute(f'SELECT doc_id, text_md5 FROM ({queries.ORACLE_SQL["op9_line_templates"]})').fetchall())
    assert {d: hashlib.md5(t.encode()).hexdigest() for d, t in rows["lines"].items()} == want

    fps = {d: (plain_distinct(t, 1), plain_distinct(t, 2)) for d, t in rows["lines"].items()}
    ids = sorted(fps)
    near = lambda a, b, k: (fps[a][0] ^ fps[b][0]).bit_count() <= k and (fps[a][1] ^ fps[b][1]).bit_count() <= 12
    least, whole = (plain_components([(a, b) for a in ids for b in ids if a < b and near(a, b, k)], ids) for k in (4, 8))
    assert set(whole.values()) <= set(rows["near_duplicates"]) <= set(least.values()) and len(whole) > len(set(whole.values()))

    items = {r["item_id"]: decontam.tokens(r["text"]) for r in table(spark, SF, "benchmark").collect()}
    hit = set()
    for doc, text in rows["near_duplicates"].items():
        toks = decontam.tokens(text)
        if any(sum(t[2] for t in decontam.tile(toks, item, min(5, len(item)))) >= 0.8 * len(item) for item in items.values() if len(item)):
            hit.add(doc)
    assert hit and set(rows["benchmark"]) == set(rows["near_duplicates"]) - hit

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    check(list(rows["benchmark"].items()), packed.collect(), Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 4096)


def test_stage_tables_are_removed(spark, tmp_path):
    docs = documents(spark, [(i, prose(i, 20)) for i in range(8)])
    with swept(spark) as keep:
        inner = stash(docs, "inner")
        outer = keep(inner.where("doc_id > 3"), "outer")
    assert outer.count() == 4
    folder = spark.conf.get("spark.checkpoint.dir")
    left = [p.name for p in __import__("pathlib").Path(folder.removeprefix("file:")).glob("marlstone/*")]
    assert any(p.startswith("outer-") for p in left) and not any(p.startswith("inner-") for p in left)


def left_tables(spark):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {p.name.split("-")[0] for p in folder.glob("marlstone/*")}


def test_tables_of_other_work_stay(spark):
    """Two threads, one of which fails: each sweeps its own tables, and no others."""
    docs = documents(spark, [(i, prose(i, 20)) for i in range(8)])
    before = stash(docs, "earlier")
    at_once = threading.Barrier(2)

    def work(name, fails):
        with swept(spark):
            inner = stash(docs, f"{name}inner")
            at_once.wait(60)
            if fails:
                raise RuntimeError(name)
            at_once.wait(60)
            return inner.count()

    def failing():
        try:
            with pytest.raises(RuntimeError):
                work("failing", True)
        finally:
            at_once.wait(60)

    with ThreadPoolExecutor(2) as pool:
        other = pool.submit(failing)
        assert pool.submit(work, "fine", False).result() == 8
        other.result()
    assert before.count() == 8
    assert not {"failinginner", "fineinner"} & left_tables(spark) and "earlier" in left_tables(spark)


def test_nested_sweeps(spark):
    docs = documents(spark, [(1, "a")])
    with swept(spark):
        with swept(spark) as keep:
            kept = keep(docs, "nestedkept")
        assert kept.count() == 1
    assert "nestedkept" not in left_tables(spark)


def test_input_columns_pass_through_whatever_their_names(spark):
    rows = [(i, "Read More Here\n" + prose(i, 60)) for i in range(12)]
    docs = documents(spark, rows).withColumn("n_lines", F.concat(F.lit("z"), F.col("doc_id").cast("string"))).withColumn("n_dropped", F.lit(True)).withColumn("drop", F.lit(7))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stash(stage(spark, kept, SF), name)
        assert kept.dtypes == docs.dtypes
    found = kept.collect()
    assert found and all(r["n_lines"] == f"z{r['doc_id']}" and r["n_dropped"] is True and r["drop"] == 7 for r in found)
    assert sum("Read More" in r["text"] for r in found) <= 1


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from marlstone.llm.common import shared_folder

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    for master, fine in (("local[4]", True), ("local", True), ("spark://host:7077", False), ("yarn", False)):
        session = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
        if fine:
            assert shared_folder(session)
        else:
            with pytest.raises(ValueError):
                shared_folder(session)


def test_run_gives_packed_sequences(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    assert found and all(r["offset"] + r["length"] <= 4096 for r in found)


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, *((i, prose(i, 60)) for i in range(10, 40))])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF), "odd")
        assert docs.count()
    nothing = documents(spark, ODD).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
