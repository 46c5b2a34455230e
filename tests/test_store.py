"""The result store: whole batches, the first result of a key, and reruns that read only what they need."""

import os
from pathlib import Path

import pytest
from plan_shape import nodes
from pyspark.sql import functions as F

from evisift.operators.dedupe import payload_key
from evisift.sources.store import ResultStore


def keys(spark, values):
    return spark.createDataFrame([(str(v),) for v in values], "key string")


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "store"), "answer string, score int", buckets=16)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key string, answer string, score int")


def test_an_empty_store_has_nothing(spark, store):
    assert store.batches() == [] and store.results().collect() == [] and store.results(keys(spark, "ab")).collect() == []
    assert {r.key for r in store.missing(keys(spark, "aab")).collect()} == {"a", "b"}


def test_a_second_run_asks_for_nothing_new(spark, store):
    wanted = keys(spark, range(40))
    first = store.missing(wanted)
    assert first.count() == 40
    store.append(first.select("key", F.concat(F.lit("to "), "key").alias("answer"), F.lit(1).alias("score")))
    assert store.missing(wanted).count() == 0
    assert {r.key for r in store.missing(keys(spark, [3, 39, 40, 41])).collect()} == {"40", "41"}
    assert {(r.key, r.answer) for r in store.results(keys(spark, [3, 99])).collect()} == {("3", "to 3")}


def test_the_first_result_of_a_key_counts(spark, store):
    store.append(rows(spark, [("a", "one", 1), ("b", "one", 1)]))
    store.append(rows(spark, [("b", "two", 2), ("c", None, None), (None, "x", 0)]))
    assert sorted(map(tuple, store.results().collect())) == [("a", "one", 1), ("b", "one", 1), ("c", None, None)]
    assert len(store.batches()) == 2


def test_a_batch_without_its_marker_is_not_seen(spark, store):
    store.append(rows(spark, [("a", "one", 1)]))
    path = store.append(rows(spark, [("b", "two", 2)]))
    local = path.removeprefix("file:")
    os.remove(f"{local}/_SUCCESS")  # as if the job had died before its commit
    assert {r.key for r in store.results().collect()} == {"a"}
    assert {r.key for r in store.missing(keys(spark, "ab")).collect()} == {"b"}
    open(f"{local}/_SUCCESS", "w").close()
    assert {r.key for r in store.results().collect()} == {"a", "b"}


def test_an_append_that_fails_leaves_nothing(spark, store):
    bad = rows(spark, [("a", "one", 1)]).withColumn("score", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.append(bad)
    assert store.batches() == [] and store.results().collect() == []


def test_only_the_buckets_of_the_wanted_keys_are_read(spark, store):
    store.append(rows(spark, [(str(i), "x", i) for i in range(200)]))
    found = store.table(keys(spark, [7]))
    assert {r.key for r in found.collect()} >= {"7"} and found.count() < 60
    scans = [n for n in nodes(found) if "FileScan" in n.toString()]
    assert scans and all("PartitionFilters: [" in s.toString() and "bucket" in s.toString() for s in scans)
    # files of other buckets may even be unreadable
    bucket = keys(spark, [7]).select(store._bucket()).first()[0]
    folder = store.batches()[0].removeprefix("file:")
    for name in os.listdir(folder):
        if name.startswith("bucket=") and name != f"bucket={bucket}":
            for file in os.listdir(f"{folder}/{name}"):
                if not file.startswith("."):
                    Path(f"{folder}/{name}/{file}").write_bytes(b"no parquet")
                else:
                    Path(f"{folder}/{name}/{file}").write_bytes(b"")
    assert [r.answer for r in store.results(keys(spark, [7])).collect()] == ["x"]


def test_compacting_keeps_every_first_result(spark, store, tmp_path):
    for k in range(4):
        store.append(rows(spark, [(str(i), f"batch {k}", k) for i in range(k * 10, k * 10 + 15)]))
    new = store.compacted(str(tmp_path / "compact"))
    assert len(new.batches()) == 1
    assert sorted(map(tuple, new.results().collect())) == sorted(map(tuple, store.results().collect()))


def test_keys_of_requests(spark, store):
    asked = spark.createDataFrame([("ann", 1), ("bob", None), ("ann", 1)], "name string, page int")
    wanted = asked.withColumn("key", payload_key("name", "page"))
    store.append(store.missing(wanted).filter("name = 'ann'").select("key", F.col("name").alias("answer"), F.col("page").alias("score")))
    assert [r.name for r in store.missing(wanted).collect()] == ["bob"]
