from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from marlstone.sources.versions import Conflict, VersionedTable

SCHEMA = "id long, parent long, v string"


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), ["parent"], buckets=4)


def test_every_version_stays_readable(spark, table):
    first = [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d")]
    table.overwrite(rows(spark, *first))
    table.replace_keys(rows(spark, (9, 1, "z")))
    table.append(rows(spark, (10, 5, "new")))
    table.delete_keys(rows(spark, (0, 2, None)))
    assert table.versions() == [1, 2, 3, 4]
    assert found(table.read(1).na.fill(-1)) == sorted((i, -1 if p is None else p, v) for i, p, v in first)
    assert found(table.read(2).where("parent = 1")) == [(9, 1, "z")]
    assert found(table.read().where("parent is not null")) == [(9, 1, "z"), (10, 5, "new")]
    assert found(table.read(3).where("parent = 2")) == [(3, 2, "c")]
    with pytest.raises(ValueError):
        table.read(5)


def test_a_change_of_some_keys_leaves_other_buckets_files(spark, table):
    table.overwrite(spark.range(40).selectExpr("id", "id as parent", "'x' as v"))
    before = table.version()
    after = table.replace_keys(rows(spark, (1, 1, "y")))
    assert sum(before.files[b] != after.files.get(b) for b in before.files) == 1
    assert table.read().where("v = 'y'").count() == 1 and table.read().count() == 40


def test_a_failure_between_staging_and_commit_changes_nothing(spark, table, monkeypatch):
    table.overwrite(rows(spark, (1, 1, "a")))

    def broken(*_):
        raise RuntimeError("the writer is lost")

    monkeypatch.setattr(table, "commit", broken)
    with pytest.raises(RuntimeError):
        table.replace_keys(rows(spark, (2, 1, "b")))
    monkeypatch.undo()
    assert table.versions() == [1] and found(table.read()) == [(1, 1, "a")]
    assert len(table.sweep(keep=1, older_than_seconds=0)) == 1  # the files of the failed change
    assert found(table.read()) == [(1, 1, "a")]


def test_of_two_writers_from_one_version_one_wins(spark, table):
    table.overwrite(rows(spark, (1, 1, "a")))
    table.append(rows(spark, (2, 2, "b")), expected=1)
    with pytest.raises(Conflict):
        table.append(rows(spark, (3, 3, "c")), expected=1)
    assert table.read().count() == 2


def test_writers_at_the_same_moment(spark, tmp_path):
    """All pass the check of the version, as none is there yet; the create lets one through."""
    tables = [VersionedTable(spark, str(tmp_path / "t"), ["parent"], buckets=2) for _ in range(6)]
    staged = [t.stage(rows(spark, (i, i, "x"))) for i, t in enumerate(tables)]

    def commit(i):
        try:
            return tables[i].commit(0, "overwrite", rows(spark).schema, staged[i]).number
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(commit, range(6)))
    assert sorted(x for x in made if x) == [1]
    assert found(tables[0].read()) == [(made.index(1), made.index(1), "x")]


def test_page_and_total_are_of_one_version(spark, table):
    table.overwrite(spark.range(30).selectExpr("id", "id as parent", "'x' as v"))
    v = table.version().number
    table.append(spark.range(30, 60).selectExpr("id", "id as parent", "'x' as v"))
    page = table.page([F.col("id").asc()], limit=5, offset=20, number=v)
    assert page["total"] == 30 and [r["id"] for r in page["items"]] == [20, 21, 22, 23, 24] and page["version"] == 1
    assert table.page([F.col("id").asc()], limit=5, where=F.col("id") >= 40)["total"] == 20


def test_old_versions_are_swept(spark, table):
    for i in range(3):
        table.overwrite(rows(spark, (i, i, "x")))
    table.sweep(keep=1, older_than_seconds=0)
    assert table.versions() == [3] and found(table.read()) == [(2, 2, "x")]


def test_empty_tables(spark, table):
    assert table.version() is None
    with pytest.raises(ValueError):
        table.read()
    table.overwrite(rows(spark))
    assert table.read().count() == 0 and table.read().columns == ["id", "parent", "v"]
    table.replace_keys(rows(spark))
    table.append(rows(spark, (1, 1, "a")))
    assert found(table.read()) == [(1, 1, "a")]


def test_without_keys_rows_are_only_added(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.overwrite(rows(spark, (1, 1, "a")))
    t.append(rows(spark, (1, 1, "a")))
    assert t.read().count() == 2
    with pytest.raises(ValueError):
        t.replace_keys(rows(spark, (1, 1, "a")))
