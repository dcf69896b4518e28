"""The delta table: what a batch writes, reads, takes over and removes."""

import os

from pyspark.sql import functions as F

from sinogrid.config import TomoConfig
from sinogrid.operators import sirt
from sinogrid.plans.reconstruct import sirt_reconstruct
from sinogrid.sources import views
from sinogrid.streaming import tomography
from sinogrid.streaming.store import DeltaTable

SCHEMA = "k BIGINT, part BIGINT, v STRING"


def rows(spark, keys, v):
    return spark.createDataFrame([(k, p, f"{v}{k}") for k in keys for p in (0, 1)], SCHEMA)


def held(df):
    return {(r.k, r.part): r.v for r in df.collect()}


def want(**values):
    return {(int(k[1:]), p): f"{v}{k[1:]}" for k, v in values.items() for p in (0, 1)}


def written(path):
    return sorted(os.listdir(path))


def test_batches_replace_only_their_keys(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path), "t", SCHEMA, ["k"])
    assert held(table.read(-1)) == {}
    table.write(rows(spark, [1, 2, 3], "a"), 0)
    table.write(rows(spark, [2], "b"), 1)
    table.tidy(1)
    assert held(table.read(1)) == want(k1="a", k2="b", k3="a")
    # the idle keys lie where they were written
    assert {(r.k, r["at"]) for r in table.manifest(1).collect()} == {(1, 0), (2, 1), (3, 0)}
    assert spark.read.parquet(f"{tmp_path}/t/delta/batch=1").select("k").distinct().count() == 1
    assert held(table.read(1, spark.createDataFrame([(2,)], "k BIGINT"))) == want(k2="b")


def test_repeated_batch_and_keys_that_go(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path), "t", SCHEMA, ["k"])
    table.write(rows(spark, [1, 2], "a"), 0)
    for _ in range(2):
        table.write(rows(spark, [3], "b"), 1, spark.createDataFrame([(1,)], "k BIGINT"))
    assert held(table.read(1)) == want(k2="a", k3="b")
    assert held(table.read(0)) == want(k1="a", k2="a")
    table.tidy(1)
    table.write(rows(spark, [2, 3], "c"), 2)
    table.tidy(2)
    assert held(table.read(2)) == want(k2="c", k3="c")
    assert written(f"{tmp_path}/t/delta") == ["batch=2"] and written(f"{tmp_path}/t/manifest") == ["batch=2"]


def test_folders_stay_few(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path), "t", SCHEMA, ["k"], most=3)
    for batch in range(9):
        table.write(rows(spark, [batch], "a"), batch)
        table.tidy(batch)
        assert len(written(f"{tmp_path}/t/delta")) <= 3
    assert held(table.read(8)) == want(**{f"k{k}": "a" for k in range(9)})


def test_idle_row_ids_are_not_rewritten(spark, data, tmp_path):
    """Only the images of the row ids in a batch are written; the result is that of one run."""
    cfg = TomoConfig(window_length=8, window_step=4, write_freq=1, tile=16, num_sinograms=10)
    source = views.frames(spark, data).where("seq <= 12").select("row_id", "seq", "theta", "center", "ray")
    job = tomography.Reconstruction(spark, str(tmp_path), cfg)
    job.process(source.where("seq <= 4"), 0)
    job.process(source.where("seq > 4 AND row_id < 3"), 1)
    images = lambda batch: {r.row_id for r in spark.read.parquet(f"{tmp_path}/image/delta/batch={batch}").select("row_id").distinct().collect()}
    assert images(0) == set(range(10)) and images(1) == {0, 1, 2}
    waits = spark.read.parquet(f"{tmp_path}/open/delta/batch=1").select("row_id").distinct().count()
    assert waits == 3
    job.process(source.where("seq > 4 AND row_id >= 3"), 2)
    assert images(2) == set(range(3, 10))
    pixels = lambda df: {(r.row_id, r.iteration, r.pix): round(r.val, 9) for r in sirt.image_pixels(df, 64, 16).collect()}
    assert pixels(job.iterations()) == pixels(sirt_reconstruct(source, cfg).emitted())
    assert job.waiting().manifest(2).isEmpty()
