import json

from pyspark.sql import functions as F

from sinogrid import __main__ as cli
from sinogrid.config import KvConfig, TomoConfig
from sinogrid.operators import sirt
from sinogrid.plans import kv_jobs, tomography
from sinogrid.plans.reconstruct import sirt_reconstruct
from sinogrid.sinks import read_kv_csv
from sinogrid.sources import frames as fr
from sinogrid.sources import generators as gen
from sinogrid.sources import views
from tests.model import mixed_checksum


def test_parameters_from_json(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"window_length": 4, "window_step": "4", "center": 1427, "mlog": False,
                                "checksum": True, "simulation_file": "x", "proj_sleep": 0.4}))
    args = cli.parse(["tomography", "--frames", "f", "--out", "o", "--params", str(path), "--write_freq", "9"])
    cfg = cli._config(TomoConfig, args)
    assert (cfg.window_length, cfg.window_step, cfg.center, cfg.mlog, cfg.checksum, cfg.write_freq) == (
        4, 4, 1427.0, False, True, 9)
    assert cfg.rows_per_second == 2 and cfg.total_ticks == 1440


def test_kv_batch_job_writes_checksummed_lines(spark, tmp_path):
    cfg = KvConfig(sinkParallelism=3, maxRecords=500)
    for job in kv_jobs.JOBS:
        out = str(tmp_path / job)
        kv_jobs.run_batch(spark, job, cfg, out)
        rows = read_kv_csv(spark, out).collect()
        assert len(rows) == 500 * (3 if job == kv_jobs.BROADCAST else 1)
        assert all(r.checksum == mixed_checksum(r.key) for r in rows[:20])


def typed_images(spark, data):
    """Ten flats, five darks, then projections, as one numbered stream."""
    src = views.images(spark, data).where("unique_id < 60")
    part = lambda low, high, scale: src.where(f"unique_id >= {low} AND unique_id < {high}").selectExpr(
        f"unique_id - {low} AS idx", "theta", "center", "ny", "nx",
        f"transform(data, x -> cast({scale} AS FLOAT)) AS data")
    return fr.sequence_frames(part(0, 10, "abs(x) + 2"), part(10, 15, "abs(x) * 0.1"), part(15, 60, "abs(x) + 1"), 10, 5)


def test_tomography_stream_equals_batch(spark, data, tmp_path):
    """Calibrated frames, fewer rows than asked for, ticks at a rate."""
    images = typed_images(spark, data)
    images.write.parquet(str(tmp_path / "frames"))
    images = spark.read.parquet(str(tmp_path / "frames"))
    cfg = TomoConfig(num_sinograms=10, num_sinogram_projections=60, proj_sleep=0.01, window_length=8, window_step=8,
                     write_freq=2, tile=4, normalize=True, mlog=True, remove_invalids=True, checksum=True)
    notices = tomography.run_batch(spark, images, cfg, str(tmp_path / "out")).collect()
    done = sorted(r.iteration for r in notices if r.status == "DENOISED")
    assert done == ["000000", "000002", "000004"]
    assert sum(r.status == "WARMUP" for r in notices) == sum(r.status == "FIN" for r in notices) == 10

    n, ny = tomography.image_facts(images)
    job = tomography.live_job(spark, str(tmp_path / "stream"), cfg, ny)
    process = tomography.tick_batch(job, images, n)
    for batch, (low, high) in enumerate(((1, 23), (24, 60))):
        process(gen.ticks(spark, cfg).where(F.col("seq").between(low, high)), batch)
    key = lambda df: {(r.row_id, r.iteration, r.pix): round(r.val, 9) for r in sirt.image_pixels(df, 8, 4).collect()}
    written = spark.read.schema("row_id BIGINT, tile INT, vals ARRAY<DOUBLE>, iteration STRING").parquet(str(tmp_path / "out"))
    got = key(job.iterations())
    assert len(got) == 3 * 10 * 64 and got == key(written)


def test_cycled_frames_equal_the_lookup(spark, data):
    images = views.images(spark, data)
    n = images.count()
    for total in (n * 2 + 17, n - 5):
        cfg = TomoConfig(num_sinogram_projections=total)
        look = fr.tick_frames(gen.ticks(spark, cfg), images, n).selectExpr("seq", "iter", "kind", "unique_id")
        cycle = fr.cycle_frames(images, n, total, total).selectExpr("seq", "iter", "kind", "unique_id")
        assert sorted(map(tuple, look.collect())) == sorted(map(tuple, cycle.collect()))


def test_only_frames_in_reach_are_read(spark, data):
    images = views.images(spark, data)
    n = images.count()
    for low, high in ((3, 9), (n - 2, n + 4), (1, 3 * n)):
        ticks = gen.ticks(spark, TomoConfig(num_sinogram_projections=4 * n)).where(F.col("seq").between(low, high))
        near = fr.frames_in_reach(images, ticks, n)
        assert near.count() == min(high - low + 1, n)
        assert fr.tick_frames(ticks, near, n).count() == high - low + 1


def test_keying_does_not_change_results(spark, data):
    rows = views.frames(spark, data).where("row_id < 2").select("row_id", "seq", "theta", "center", "ray")
    images = []
    for keying in ("hash", "modulo"):
        cfg = TomoConfig(window_length=16, window_step=16, write_freq=1, keying=keying)
        pixels = sirt_reconstruct(rows, cfg).emitted_pixels().select("row_id", "pass0", "pix", F.round("val", 9).alias("v"))
        images.append(sorted(tuple(r) for r in pixels.collect()))
    assert images[0] == images[1]


def test_broadcast_summary_counts_keys_before_copies(spark):
    rows = spark.createDataFrame([(i, f"key{i % 7}", i % 5) for i in range(40)], "seq BIGINT, key STRING, val INT")
    plain = kv_jobs.target_summary(kv_jobs.with_target(rows, "broadcast", 3))
    ours = kv_jobs.broadcast_summary(rows, 3)
    assert sorted(ours.collect()) == sorted(plain.collect())
    plan = ours._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Generate" in line or "Aggregate" in line]
    assert ["Generate" in line for line in lines] == [False, True, False]
