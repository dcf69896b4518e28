import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinogrid.config import KvConfig, TomoConfig
from sinogrid.operators import calibrate, sirt, windows
from sinogrid.operators.blocked import block_of
from sinogrid.plans import kv_jobs
from sinogrid.plans.reconstruct import sirt_reconstruct
from sinogrid.sinks import kv_lines
from sinogrid.streaming import kv as stream_kv
from sinogrid.streaming import tomography
from sinogrid.streaming.windows import fired_windows, start_count_windows, stateful_count_windows
from sinogrid.sources import views

FRAME = "row_id BIGINT, seq BIGINT, theta DOUBLE, center DOUBLE, ray ARRAY<DOUBLE>"


def write_parts(df, folder, cuts, column="seq"):
    """One file per range of `column`, named in order."""
    low = None
    for i, high in enumerate([*cuts, None]):
        part = df
        if low is not None:
            part = part.where(F.col(column) > low)
        if high is not None:
            part = part.where(F.col(column) <= high)
        part.coalesce(1).write.mode("append").parquet(folder)
        low = high


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("job", kv_jobs.JOBS)
def test_kv_stream_equals_batch(spark, data, tmp_path, job):
    kv = views.kv(spark, data)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(kv, folder, [300, 650])
    cfg = KvConfig(sinkParallelism=3)
    query = stream_kv.start(spark, job, cfg, out, str(tmp_path / "cp"), stream_of(spark, folder, kv.schema), True)
    query.awaitTermination()
    got = rows_of(stream_kv.read_output(spark, job, out).select("key", "val", "checksum"))
    assert got == rows_of(kv_lines(kv_jobs.route(kv, job, 3)))


def test_interleave_counts_across_batches(spark, tmp_path):
    kv = spark.range(9000).selectExpr("id AS seq", "concat('key', id % 7) AS key", "cast(id % 10 AS INT) AS val")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(kv, folder, [2500, 6100])
    cfg = KvConfig(sinkParallelism=3)
    stream_kv.start(spark, kv_jobs.INTERLEAVE, cfg, out, str(tmp_path / "cp"),
                    stream_of(spark, folder, kv.schema), True).awaitTermination()
    want = kv_jobs.with_target(kv, kv_jobs.INTERLEAVE, 3).groupBy("sink_id").count()
    # a target is one partition, hence one file per batch
    files = spark.read.schema("key STRING, val INT, checksum BIGINT").option("basePath", out).csv(f"{out}/batch=*")
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).cast("int")
    got = files.groupBy(part.alias("sink_id")).count()
    assert rows_of(got) == rows_of(want)


def test_rate_source_is_repeatable(spark):
    from sinogrid.sources.generators import kv_batch, kv_stream

    cfg = KvConfig(ratePerSecond=50, sourceParallelism=2, sinkParallelism=1, maxRecords=60)
    query = (kv_stream(spark, cfg).drop("ts").writeStream.format("memory").queryName("rate_kv").start())
    for _ in range(60):
        query.awaitTermination(0.25)
        if spark.table("rate_kv").count() >= 60:
            break
    query.stop()
    got = rows_of(spark.table("rate_kv").select("seq", "key", "val"))
    assert got == rows_of(kv_batch(spark, cfg).select("seq", "key", "val"))


def test_window_stream_equals_batch(spark, tmp_path):
    rows = spark.range(1, 400).selectExpr("id * id % 7 AS row_id", "id AS seq")
    folder = str(tmp_path / "in")
    write_parts(rows, folder, [90, 91, 250])
    out = stateful_count_windows(stream_of(spark, folder, rows.schema), 6, 4)
    query = (out.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    want = windows.count_windows(rows, 6, 4, ["row_id"], ["seq"], block_of(F.col("seq"), 50))
    assert rows_of(spark.table("fired")) == rows_of(want.select("row_id", "pass", "rn", "seq"))
    root = str(tmp_path / "tables")
    start_count_windows(stream_of(spark, folder, rows.schema), 6, 4, root, str(tmp_path / "cp2"), 50,
                        available_now=True).awaitTermination()
    assert rows_of(fired_windows(spark, root).select("row_id", "pass", "rn", "seq")) == rows_of(spark.table("fired"))


def frames(spark, n=6, count=14):
    rng = np.random.default_rng(11)
    data = [(r, i + 1, 0.21 * i + 0.1, 0.0, [float(v) for v in rng.random(n)])
            for r in range(3) for i in range(count)]
    return spark.createDataFrame(data, FRAME)


def pixels(df, nx, tile):
    out = sirt.image_pixels(df.select("row_id", "tile", "vals", "iteration"), nx, tile)
    return {(r.row_id, r.iteration, r.pix): r.val for r in out.collect()}


CFG = TomoConfig(window_length=5, window_step=3, write_freq=2, tile=4, num_sinograms=3)


def close(a, b):
    assert set(a) == set(b)
    for key in a:
        assert math.isclose(a[key], b[key], abs_tol=1e-9), key


def test_reconstruction_restarts_to_the_same_result(spark, tmp_path):
    df = frames(spark)
    want = pixels(sirt_reconstruct(df, CFG).emitted(), 6, 4)
    folder, root, cp = (str(tmp_path / x) for x in ("in", "run", "cp"))
    df.where("seq <= 5").coalesce(1).write.parquet(folder)
    tomography.start(stream_of(spark, folder, df.schema), CFG, root, cp, True).awaitTermination()
    # the rest arrives later, with repeats of old messages
    for low, high in ((3, 9), (8, 14)):
        df.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(folder)
    tomography.start(stream_of(spark, folder, df.schema), CFG, root, cp, True).awaitTermination()
    job = tomography.Reconstruction(spark, root, CFG)
    close(pixels(job.iterations(), 6, 4), want)
    assert rows_of(job.progress(2).select("row_id", "n", "last_seq")) == [(r, 14, 14) for r in range(3)]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    df = frames(spark)
    job = tomography.Reconstruction(spark, str(tmp_path / "run"), CFG)
    job.process(df.where("seq <= 8"), 0)
    first = pixels(job.iterations(), 6, 4)
    job.process(df.where("seq <= 8"), 0)
    close(pixels(job.iterations(), 6, 4), first)

    # a batch that fails midway is run again from the tables of the one before
    broken = tomography.Reconstruction(spark, str(tmp_path / "run"), CFG)
    broken._keep_images = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.process(df.where("seq > 8"), 1)
    job.process(df.where("seq > 8"), 1)
    close(pixels(job.iterations(), 6, 4), pixels(sirt_reconstruct(df, CFG).emitted(), 6, 4))


def test_batches_without_messages(spark, tmp_path):
    df = frames(spark)
    job = tomography.Reconstruction(spark, str(tmp_path / "run"), CFG)
    job.process(df.where("seq < 0"), 0)
    job.process(df, 1)
    job.process(df.where("seq < 0"), 2)
    close(pixels(job.iterations(), 6, 4), pixels(sirt_reconstruct(df, CFG).emitted(), 6, 4))
    assert rows_of(job.progress(2).select("row_id", "n", "last_seq")) == [(r, 14, 14) for r in range(3)]


def test_incomplete_iterations_wait(spark, tmp_path):
    df = frames(spark)
    job = tomography.Reconstruction(spark, str(tmp_path / "run"), CFG)
    job.process(df.where("row_id < 2"), 0)
    assert not (tmp_path / "run" / "recon").exists()
    job.process(df.where("row_id = 2"), 1)
    close(pixels(job.iterations(), 6, 4), pixels(sirt_reconstruct(df, CFG).emitted(), 6, 4))


def test_fin_and_rejects_and_calibration(spark, data, tmp_path):
    cfg = TomoConfig(window_length=8, window_step=4, write_freq=1, tile=64, num_sinograms=10,
                     num_sinogram_columns=64, normalize=True, remove_invalids=True)
    source = views.frames_calib(spark, data).withColumn("kind", F.lit("DATA"))
    fin = source.where("row_id = 3 AND seq = 20").withColumn("kind", F.lit("FIN"))
    short = source.where("seq = 7").withColumn("ray", F.slice("ray", 1, 10)).withColumn("seq", F.lit(1000).cast("bigint"))
    job = tomography.Reconstruction(spark, str(tmp_path / "run"), cfg)
    job.process(source.where("seq <= 13").unionByName(short), 0)
    job.process(source.where("seq > 13").unionByName(fin), 1)
    clean = calibrate.calibrate(source.drop("kind"), cfg).where("NOT (row_id = 3 AND seq >= 20)")
    want = sirt_reconstruct(clean, cfg)
    all_rows = want.emitted().groupBy("iteration").agg(F.count_distinct("row_id").alias("r")).where("r = 10")
    expected = want.emitted().join(all_rows, "iteration", "left_semi")
    close(pixels(job.iterations(), 64, 64), pixels(expected, 64, 64))
    assert job.rejected().select("reason").distinct().collect()[0].reason == "wrong length"
    assert job.rejected().count() == 10


def test_restored_run_goes_on_as_if_uninterrupted(spark, data, tmp_path):
    frames = views.frames(spark, data).select("row_id", "seq", "theta", "center", "ray").where("row_id < 3")
    cfg = TomoConfig(window_length=4, window_step=2, write_freq=2, num_sinograms=3, tile=64)
    first, rest = frames.where("seq <= 7"), frames.where("seq > 7 AND seq <= 12")

    def run(name, *parts):
        job = tomography.Reconstruction(spark, str(tmp_path / name), cfg)
        for batch, part in enumerate(parts):
            job.process(part, batch)
        return job

    whole, early = run("whole", first, rest), run("early", first)
    late = tomography.Reconstruction(spark, str(tmp_path / "late"), cfg)
    with pytest.raises(ValueError):
        late.restore(tomography.Reconstruction(spark, str(tmp_path / "none"), cfg))
    late.restore(early)
    late.restore(early)
    late.process(rest, 0)
    with pytest.raises(ValueError):
        late.restore(early)
    images = lambda job: {(r.row_id, r.tile): r.vals for r in job.images().read(job.last_batch()).collect()}
    want, got = images(whole), images(late)
    assert want.keys() == got.keys() and len(want) == 3
    assert all(np.allclose(want[k], got[k]) for k in want)
    assert rows_of(late.progress(0).select("row_id", "n", "last_seq")) == rows_of(whole.progress(1).select("row_id", "n", "last_seq"))
    written = lambda *jobs: sorted({r.iteration for j in jobs for r in j.iterations().select("iteration").distinct().collect()})
    assert written(whole) == written(early, late)


def test_state_windows_sort_across_arrow_batches(spark, tmp_path):
    seqs = [(n * 37) % 101 for n in range(101)]
    spark.createDataFrame([(1, s) for s in seqs], "row_id BIGINT, seq BIGINT").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.readStream.schema("row_id BIGINT, seq BIGINT").parquet(str(tmp_path / "in"))
        out = stateful_count_windows(rows, 6, 4)
        (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    assert max(r["pass"] for r in got) == 25
    assert all(r.seq == r.rn - 1 for r in got)
