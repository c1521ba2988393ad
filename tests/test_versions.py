"""Stored tables by partition: what is rewritten, conflicts between writers, old versions, merge policies."""

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import merge as M
from lumenfold.operators.versions import Conflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", 1) for i in range(100)], "id long, name string, version long")
    return VersionedTable(spark, f"file://{tmp_path}/table").create(rows, ["id"], 8)


def files(table):
    return set(table.read().inputFiles())


def place(table, i):
    return table.touched(table.spark.createDataFrame([(i,)], "id long"))[0]


def test_only_touched_partitions_are_written(spark, table):
    before = files(table)
    rows = spark.createDataFrame([(3, "new"), (200, None)], "id long, name string")
    assert table.merge(rows, lambda old, new: M.fill_merge(old, new, ["id"])) == 2
    places = {place(table, 3), place(table, 200)}
    same = {f for f in before if f.split("/p=")[1].split("/")[0] not in places}
    assert same and same <= files(table) and not (before - same) & files(table)
    got = {r.id: (r.name, r.version) for r in table.read().collect()}
    assert len(got) == 101 and got[3] == ("new", 2) and got[200] == (None, 1) and got[4] == ("n4", 1)
    assert table.read(1).count() == 100 and table.read(1).where("id = 3").first().name == "n3"


def test_policies_give_what_they_give_on_whole_tables(spark, table):
    key = lambda df: sorted(map(tuple, df.collect()))
    rows = spark.createDataFrame([(i, f"x{i % 3}", 5) for i in range(90, 110)], "id long, name string, version long")
    for policy in (M.overwrite, M.insert_ignore, lambda old, new, keys: M.replace_children(old, new, *keys)):
        want = key(policy(table.read(), rows, ["id"]))
        table.merge(rows, lambda old, new, policy=policy: policy(old, new, ["id"]))
        assert key(table.read()) == want
    want = key(M.delete_where_in(table.read(), rows.select("id"), ["id"]))
    table.merge(rows.select("id"), lambda old, gone: M.delete_where_in(old, gone, ["id"]))
    assert key(table.read()) == want


def test_second_writer_is_refused(spark, table):
    other = VersionedTable(spark, table.path)
    one = spark.createDataFrame([(7, "mine", 1)], "id long, name string, version long")

    def slow(old):
        other.merge(one.withColumn("name", F.lit("theirs")), lambda a, b: M.overwrite(a, b, ["id"]))
        return M.overwrite(old, one, ["id"])

    with pytest.raises(Conflict):
        table.update(one, slow)
    assert table.versions() == [1, 2] and table.read().where("id = 7").first().name == "theirs"
    with pytest.raises(Conflict):
        VersionedTable(spark, table.path).create(one, ["id"])
    assert table.read().count() == 100


def test_writers_of_different_partitions_both_go_on(spark, table):
    other = next(i for i in range(100) if place(table, i) != place(table, 7))
    row = lambda i, name: spark.createDataFrame([(i, name, 1)], "id long, name string, version long")

    def slow(old):
        VersionedTable(spark, table.path).merge(row(other, "theirs"), lambda a, b: M.overwrite(a, b, ["id"]))
        return M.overwrite(old, row(7, "mine"), ["id"])

    assert table.update(row(7, "x"), slow) == 3
    got = {r.id: r.name for r in table.read().collect()}
    assert (got[7], got[other], len(got)) == ("mine", "theirs", 100)


def test_rows_may_not_leave_their_partitions(spark, table):
    with pytest.raises(ValueError):
        table.update(spark.createDataFrame([(7,)], "id long"), lambda old: old.withColumn("id", F.col("id") + 1000))
    assert table.versions() == [1] and table.update(table.read().where("false"), lambda old: old) == 1


def test_emptied_partitions_and_old_versions_go(spark, table):
    everything = table.read().select("id")
    table.update(everything.where("id < 50"), lambda old: old.where("id >= 50"))
    gone = table.update(everything, lambda old: old.where("false"))
    assert table.read().count() == 0 and table.read(gone - 1).count() == 50
    table.replace(spark.createDataFrame([(1, "a", 1)], "id long, name string, version long"))
    assert table.vacuum(1) > 0 and table.versions() == [gone + 1] and table.read().count() == 1
    with pytest.raises(LookupError):
        table.read(1)
    with pytest.raises(LookupError):
        VersionedTable(spark, table.path + "-none").read()
