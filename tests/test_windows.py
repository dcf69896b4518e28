import pytest
from pyspark.sql import functions as F

from sinogrid.operators import routing, windows
from sinogrid.operators.blocked import Running, block_of, keyed_rank, running
from tests import model


@pytest.mark.parametrize("length,step", [(6, 4), (4, 4), (1, 1), (3, 7), (8, 3), (19, 1), (5, 5)])
def test_windows_equal_simulation(spark, length, step):
    n = 60
    rows = spark.range(n).selectExpr("id % 2 AS row_id", "id AS seq")
    out = windows.count_windows(rows, length, step, ["row_id"], ["seq"], block_of(F.col("seq"), 7))
    for key in (0, 1):
        want = model.fired_windows([s for s in range(n) if s % 2 == key], length, step)
        got = {}
        for r in out.where(F.col("row_id") == key).collect():
            got.setdefault(r["pass"], []).append(r.seq)
        assert [sorted(got[k]) for k in sorted(got)] == want


def test_hot_key_is_split_over_blocks(spark):
    """A key with nearly all rows is numbered in blocks, exactly."""
    rows = spark.range(20000).selectExpr("IF(id % 50 = 0, id, 0) AS row_id", "id AS seq")
    ranked = keyed_rank(rows, ["row_id"], ["seq"], block_of(F.col("seq"), 512), out="rn", total="n")
    hot = ranked.where("row_id = 0").agg(F.min("rn"), F.max("rn"), F.count_distinct("rn"), F.max("n")).first()
    assert tuple(hot) == (1, 19601, 19601, 19601)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "_blk" in plan.split("hashpartitioning")[1]


@pytest.mark.parametrize("width", [1, 3, 1000, None])
def test_running_values_do_not_depend_on_blocks(spark, width):
    rows = spark.range(200).selectExpr("id % 3 AS k", "id AS seq", "(id * 37) % 101 AS v")
    outs = {"top": Running(F.col("v"), "max", own_row=False), "low": Running(F.col("v"), "min"),
            "sum": Running(F.col("v"), "sum")}
    block = None if width is None else block_of(F.col("seq"), width)
    got = running(rows, ["k"], ["seq"], block, outs).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.seq):
        before = seen.setdefault(r.k, [])
        assert r.top == (max(before) if before else None)
        before.append(r.v)
        assert (r.low, r["sum"]) == (min(before), sum(before))


def test_ranges_split_a_hot_key_with_equal_times(spark):
    """One key with nearly all rows, all at the same time: only the last order column differs."""
    rows = spark.range(8000).selectExpr("IF(id % 40 = 0, id, 0) AS row_id", "1 AS ts", "id AS event_id").repartition(4)
    ranked = keyed_rank(rows, ["row_id"], ["ts", "event_id"], out="rn")
    hot = ranked.where("row_id = 0")
    assert [r.rn for r in hot.orderBy("event_id").collect()] == list(range(1, 7802))
    from sinogrid.operators.blocked import range_blocks

    sizes = [r["count"] for r in range_blocks(rows, ["ts", "event_id"]).groupBy("_blk").count().collect()]
    assert max(sizes) < 3000 and len(sizes) >= 8


@pytest.mark.parametrize("most", [8, 500])
def test_ranges_follow_the_order(spark, monkeypatch, most):
    """Nulls, times that few or many rows share, and more borders than one level of comparisons holds."""
    from sinogrid.operators import blocked

    monkeypatch.setattr(blocked, "LEAST_BLOCKS", most)
    rows = spark.range(20000).selectExpr(
        "IF(id % 50 = 0, NULL, timestamp_micros(cast(IF(id % 3 = 0, 5000, id * id % 9973) * 1000000 AS BIGINT))) AS ts", "cast(id * 7 % 20011 AS INT) AS event_id")
    got = [(r.ts is not None, r.ts, r.event_id, r._blk) for r in blocked.range_blocks(rows, ["ts", "event_id"]).collect()]
    blocks = [b for *_, b in sorted(got, key=lambda r: (r[0], r[1] or 0, r[2]))]
    assert blocks == sorted(blocks) and len(set(blocks)) > 0.7 * most
    with pytest.raises(TypeError):
        blocked.range_blocks(rows.selectExpr("cast(event_id AS STRING) AS name"), ["name"])


def test_numbering_writes_nothing(spark):
    import os

    from sinogrid import scratch

    def files():
        return {n for n in os.listdir(scratch.shared_folder(spark))} if os.path.isdir(scratch.shared_folder(spark)) else set()

    before = files()
    rows = spark.range(1000).selectExpr("id % 3 AS row_id", "id AS ts", "id AS event_id")
    assert keyed_rank(rows, ["row_id"], ["ts", "event_id"], out="rn").where("row_id = 1").agg(F.max("rn")).first()[0] == 333
    assert files() == before


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_interleave_does_not_depend_on_partitions(spark, parts):
    kv = spark.range(9000).selectExpr("id AS seq", "concat('key', id % 7) AS key").repartition(parts)
    out = routing.with_interleave(kv, 3, block_width=256).where(
        routing.hash_target(F.col("key"), 3) == 0).orderBy("seq").collect()
    assert len(out) > 2000
    assert [r.sink_id for r in out] == [(i // 1000) % 2 + 1 for i in range(len(out))]


def test_single_target(spark):
    kv = spark.range(10).selectExpr("id AS seq", "concat('key', id) AS key")
    for fn in (routing.with_interleave, routing.with_shift_zero):
        assert {r.sink_id for r in fn(kv, 1).collect()} == {0}


def test_split_targets_keep_rows_with_their_target(spark):
    kv = spark.range(1000).selectExpr("id AS seq", "concat('key', id % 3) AS key", "1 AS val")
    placed = routing.place(routing.with_shift_zero(kv, 4), 4, splits=3)
    assert placed.rdd.getNumPartitions() == 12
    off = placed.where(F.floor(F.spark_partition_id() / 3) != F.col("sink_id"))
    assert off.count() == 0 and placed.count() == 1000


def test_positions_in_subsets_are_counted(spark):
    """A row id with one frame more, one with a gap and a frame that comes twice."""
    from sinogrid.sources.frames import ordered_subset

    ids = {0: list(range(41)), 1: [n for n in range(40) if n != 7] + [12], None: [3, 1, 2]}
    rows = spark.createDataFrame([(row, i) for row, some in ids.items() for i in some], "row_id BIGINT, idx BIGINT")
    got = ordered_subset(rows, 40).collect()
    for row, some in ids.items():
        want = sorted(some, key=lambda i: (i % 3, i))
        assert [r.idx for r in sorted((r for r in got if r.row_id == row), key=lambda r: r.position)] == want
        assert sorted(r.position for r in got if r.row_id == row) == list(range(len(some)))
