"""The audit store opens no more files than it needs; the keyed state reads only new writes and equals the full computation."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from guardlake.sources import audit_store, keyed_state

DAY_US = 86_400_000_000


def events(spark, n=600, days=6):
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") * (days * DAY_US // n)).alias("us"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("long").alias("session_id"),
        F.date_format(F.timestamp_micros(F.col("id") * (days * DAY_US // n)), "yyyy-MM-dd").alias("event_date"))


def filled(spark, tmp_path):
    rows, path = events(spark), f"file://{tmp_path}/store"
    for half in (0, 1):
        audit_store.append(rows.filter(F.col("event_id") % 2 == half), path, "session_id", parts=8)
    return rows, audit_store.stored(spark, path, rows), spark.read.parquet(f"{path}/dates")


def files_of(df):
    """Files that the scans of the physical plan are left with after partitions are pruned."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).getClass().getSimpleName() == "FileSourceScanExec"]
    return [str(f.filePath()) for s in scans for f in s.selectedPartitions().toPartitionArray()]


def test_lookup_opens_parts_of_its_keys_only(spark, tmp_path):
    rows, store, _ = filled(spark, tmp_path)
    assert sorted(map(tuple, store.drop("part").select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    wanted = spark.createDataFrame([(7,), (7,), (None,)], "session_id long")
    got = audit_store.lookup(store, wanted.filter("session_id = 7"), "session_id", parts=8)
    assert {r.event_id for r in got.collect()} == {r.event_id for r in rows.filter("session_id = 7").collect()}
    assert 0 < len(files_of(got)) < len(files_of(store)) / 4
    seven = spark.range(1).select(F.lit(7).cast("long").alias("session_id")).select(audit_store.part_of("session_id", 8)).head()[0]
    assert {f.split("/part=")[1].split("/")[0] for f in files_of(got)} == {str(seven)}
    assert audit_store.lookup(store, wanted.limit(0), "session_id", parts=8).count() == 0


def test_newest_opens_the_last_dates_only(spark, tmp_path):
    rows, store, dates = filled(spark, tmp_path)
    got = audit_store.newest(store, dates, 120)
    assert [r.event_id for r in got.collect()] == list(range(599, 479, -1))
    assert len({f.split("event_date=")[1].split("/")[0] for f in files_of(got)}) == 2
    assert audit_store.newest(store, dates, 10_000).count() == 600
    assert audit_store.newest(store, dates.limit(0), 5).count() == 0


def a_state(tmp_path, parts=4):
    schema = "k string, v string, at long, id long"
    return schema, keyed_state.State(f"file://{tmp_path}/state", ("k",), "v", ("at", "id"), _parse_datatype_string(schema), parts)


def test_state_equals_the_full_computation(spark, tmp_path):
    schema, state = a_state(tmp_path)
    rng, writes, folded = random.Random(3), [], []
    keyed_state.create(spark, state)
    for batch in range(4):
        new = [(rng.choice([None, "hot", "hot", *"abcdefghij"]), rng.choice(["x", "y", None]), rng.randrange(50), batch * 100 + i) for i in range(40)]
        writes += new
        keyed_state.append(spark.createDataFrame(new, schema), state, batch)
        if batch == 2:  # a batch that is written again
            keyed_state.append(spark.createDataFrame(new, schema), state, batch)
        want = {}
        for k, v, at, i in writes:
            if k not in want or (at, i) > want[k][1:]:
                want[k] = (v, at, i)
        for _ in range(2):  # before and after the compaction
            got = keyed_state.read(spark, state).collect()
            assert {r.k: (r.v, r.at, r.id) for r in got} == want and len(got) == len(want)
            folded.append(keyed_state.compact(spark, state, batch, share=1.5))
    assert folded[0] and any(not f for f in folded)


def test_compaction_leaves_other_parts_alone(spark, tmp_path):
    schema, state = a_state(tmp_path, parts=8)
    keyed_state.create(spark, state)
    keyed_state.append(spark.createDataFrame([(f"k{i}", "old", 1, i) for i in range(80)], schema), state, 0)
    assert len(keyed_state.compact(spark, state, 0)) == 8
    keyed_state.append(spark.createDataFrame([("k3", "new", 2, 900)] + [("k3", "late", 0, 901)], schema), state, 1)
    assert keyed_state.compact(spark, state, 1, share=0.9) == []  # one delta row beside some ten
    assert keyed_state.read(spark, state).filter("k = 'k3'").head().v == "new"
    assert len(keyed_state.compact(spark, state, 1, share=0.0)) == 1
    base = spark.read.parquet(f"{state.path}/base")
    assert base.filter("generation = 2").select("part").distinct().count() == 1
    assert keyed_state.read(spark, state).count() == 80


def test_a_compaction_that_failed_changes_nothing(spark, tmp_path):
    schema, state = a_state(tmp_path)
    keyed_state.create(spark, state)
    keyed_state.append(spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 2)], schema), state, 0)
    # files of a generation that the list does not name
    spark.createDataFrame([("a", "wrong", 99, 99, 0), ("b", "wrong", 99, 99, 1)], schema + ", part int").write.partitionBy("part").parquet(f"{state.path}/base/generation=1")
    assert {r.v for r in keyed_state.read(spark, state).collect()} == {"1"}
    keyed_state.compact(spark, state, 0)
    assert {r.v for r in keyed_state.read(spark, state).collect()} == {"1"}


def test_empty_state(spark, tmp_path):
    schema, state = a_state(tmp_path)
    keyed_state.create(spark, state)
    keyed_state.append(spark.createDataFrame([], schema), state, 0)
    assert keyed_state.read(spark, state).count() == 0 and keyed_state.compact(spark, state, 0) == []
