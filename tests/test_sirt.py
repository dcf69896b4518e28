import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sinogrid.config import TomoConfig
from sinogrid.operators import fold, sirt
from sinogrid.plans.reconstruct import sirt_reconstruct
from tests import model

N = 9
RNG = np.random.default_rng(5)
ANGLES = [0.0, math.pi / 2, math.pi / 4, 0.3, 1.2, 2.0, 2.9, 4.0, -0.7, 5.5, 0.9, 1.7]


def make_frames(spark, rows=2, n=N, center=0.0):
    data = []
    for row in range(rows):
        for i, t in enumerate(ANGLES):
            data.append((row, i + 1, float(t), center, [float(v) for v in RNG.random(n)]))
    return data, spark.createDataFrame(data, "row_id BIGINT, seq BIGINT, theta DOUBLE, center DOUBLE, ray ARRAY<DOUBLE>")


@pytest.mark.parametrize("tile", [3, 4, 64])
def test_weights_equal_model(spark, tile):
    data, frames = make_frames(spark, rows=1)
    got = {}
    for r in sirt.ray_weights(sirt.ray_lines(frames), tile).collect():
        got[(r.seq, r.col, r.pix)] = got.get((r.seq, r.col, r.pix), 0) + r.chord
    want = {}
    for _, seq, theta, center, _ in data:
        for col in range(N):
            for p, w in model.ray_pixels(N, theta, col, model.kernel_center(center, N)):
                want[(seq, col, p)] = want.get((seq, col, p), 0) + w
    for key in set(got) | set(want):
        assert got.get(key, 0) == pytest.approx(want.get(key, 0), abs=1e-9), key


@pytest.mark.parametrize("length,step,sweeps,freq,tile,center", [
    (4, 4, 1, 1, 64, 0), (6, 4, 2, 1, 4, 0), (5, 2, 1, 3, 3, 4), (32, 1, 1, 5, 64, 0)])
def test_passes_equal_model(spark, length, step, sweeps, freq, tile, center):
    data, frames = make_frames(spark)
    cfg = TomoConfig(window_length=length, window_step=step, window_iter=sweeps, write_freq=freq,
                     tile=tile, center=float(center))
    got = {}
    for r in sirt_reconstruct(frames, cfg).emitted_pixels().collect():
        got.setdefault((r.row_id, r.pass0), np.full(N * N, np.nan))[r.pix] = r.val
    for row in (0, 1):
        messages = [(t, c, ray) for rid, _, t, c, ray in data if rid == row]
        want = model.sirt(messages, N, length, step, sweeps, freq, center)
        assert {p for rid, p in got if rid == row} == set(want)
        for p, image in want.items():
            np.testing.assert_allclose(got[(row, p)], image, atol=1e-9)


def test_rows_with_different_message_counts(spark):
    data, frames = make_frames(spark)
    frames = frames.where("row_id = 0 OR seq <= 5")
    cfg = TomoConfig(window_length=4, window_step=2, write_freq=1, tile=4)
    fired = sirt_reconstruct(frames, cfg)
    passes = {r.row_id: r.n for r in fired.emitted_pixels().groupBy("row_id").agg(
        F.count_distinct("pass0").alias("n")).collect()}
    assert passes == {0: 6, 1: 2}
    last = {r.row_id: r.pass0 for r in fired.latest().select("row_id", "pass0").distinct().collect()}
    assert last == {0: 5, 1: 1}
    messages = [(t, c, ray) for rid, seq, t, c, ray in data if rid == 1 and seq <= 5]
    want = model.sirt(messages, N, 4, 2, 1, 1)[1]
    got = np.zeros(N * N)
    for r in sirt.image_pixels(fired.latest().where("row_id = 1"), N, 4).collect():
        got[r.pix] = r.val
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_nan_sample_leaves_its_pixels_unchanged(spark):
    data, _ = make_frames(spark, rows=1)
    data = data[:4]
    data[2][4][3] = math.nan
    frames = spark.createDataFrame(data, "row_id BIGINT, seq BIGINT, theta DOUBLE, center DOUBLE, ray ARRAY<DOUBLE>")
    got = np.zeros(N * N)
    out = sirt_reconstruct(frames, TomoConfig(window_length=4, window_step=4, write_freq=1, tile=64))
    for r in out.emitted_pixels().collect():
        got[r.pix] = r.val
    want = model.sirt([(t, c, ray) for _, _, t, c, ray in data], N, 4, 4, 1, 1)[0]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_intermediate_images_are_removed(spark, tmp_path):
    _, frames = make_frames(spark, rows=1)
    root = str(tmp_path / "run")
    sirt_reconstruct(frames, TomoConfig(window_length=4, window_step=2, write_freq=3, tile=64), root)
    kept = sorted(p.parent.name for p in (tmp_path / "run").glob("step=*/keep=*"))
    assert kept == ["step=1", "step=4", "step=6"]


def test_a_sweep_moves_cells_once(spark):
    """Besides rays and whole tiles, only the cell sums of blocks are exchanged."""
    from sinogrid.operators import sirt

    frames = spark.createDataFrame([(0, i + 1, 0.3 * i, 0.0, [1.0] * 8) for i in range(4)],
                                   "row_id BIGINT, seq BIGINT, theta DOUBLE, center DOUBLE, ray ARRAY<FLOAT>")
    lines = sirt.ray_lines(frames)
    blank = sirt.blank_image(frames.select("row_id").distinct(), 8, 4)
    swept = sirt.sweep(lines, None, blank, ["seq"], 4)
    plan = swept._jdf.queryExecution().executedPlan().toString()
    cells = [line for line in plan.split("\n") if "Exchange hashpartitioning(row_id" in line and "tile" in line]
    assert len(cells) == 3  # rays by tile and block, sums by tile, old tiles by tile
    assert "cell" not in "".join(cells)


def test_passes_over_small_images_add_no_jobs(spark):
    jobs = []
    for step in (6, 1):  # 2 and 12 passes
        _, frames = make_frames(spark)
        spark.sparkContext.setJobGroup(f"passes-{step}", "")
        fired = sirt_reconstruct(frames, TomoConfig(window_length=6, window_step=step, write_freq=1, tile=64))
        assert fired.steps == 12 // step
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"passes-{step}")))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[0] == jobs[1]


def test_missing_rays_samples_and_copies_fold_as_in_one_job_per_pass(spark, monkeypatch):
    """Null rays, null and NaN samples, a null angle, one message given twice: both forms agree."""
    from sinogrid.operators import fold

    data, _ = make_frames(spark)
    data = [list(r) for r in data] + [list(data[4])]
    data[1][4] = None
    data[2][4] = [None, *data[2][4][1:]]
    data[6][4] = [*data[6][4][:-1], math.nan]
    data[8][2] = None
    data[9][3] = 4.0
    frames = spark.createDataFrame([tuple(r) for r in data], "row_id BIGINT, seq BIGINT, theta DOUBLE, center DOUBLE, ray ARRAY<DOUBLE>")
    images = []
    for most in (fold.MOST_COLUMNS, 0):
        monkeypatch.setattr(fold, "MOST_COLUMNS", most)
        out = sirt_reconstruct(frames, TomoConfig(window_length=4, window_step=2, window_iter=2, write_freq=2, tile=16)).emitted_pixels()
        images.append({(r.row_id, r.iteration, r.pix): r.val for r in out.collect()})
    assert images[0].keys() == images[1].keys() and len(images[0]) == 6 * N * N
    assert all(images[0][k] == pytest.approx(images[1][k], abs=1e-9) for k in images[0])


def test_a_message_is_traced_once_for_all_passes(monkeypatch):
    calls, plain = [], fold._Message.crossings
    monkeypatch.setattr(fold._Message, "crossings", lambda self, *a: calls.append(self.rn) or plain(self, *a))

    def passes(most):
        monkeypatch.setattr(fold, "_TRACED", most)
        row = fold._Row(0, 8, 8)
        row.ready(0)
        sent = [fold._Message(n, n, 4.0, True, 0.1 * n, 1.0, pa.array(np.arange(8.0) + n)) for n in range(12)]
        for begin in (0, 4, 4, 8):
            row.sweep(sent[begin:begin + 8], 4.0)
        row.sweep(sent[8:], 3.5)  # another centre is traced anew
        return row.image

    kept = passes(1 << 22)
    assert len(calls) == 12 + 4
    calls.clear()
    assert (passes(0) == kept).all() and len(calls) == 8 + 8 + 8 + 4 + 4
