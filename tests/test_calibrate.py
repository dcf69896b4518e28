"""Calibration against a plain model, for any block width, and the plan of the join."""

import random

import pytest
from pyspark.sql import functions as F

from sinogrid.operators import calibrate
from sinogrid.sources import views
from sinogrid.sources.frames import ITYPES

NAMES = ["Projection", "White", "Dark", "WhiteReset", "DarkReset"]
SCHEMA = "row_id long, seq long, itype tinyint, ray array<float>"


def made(seed, rows, most, rare):
    """Frames with gaps in their numbers; calibration frames are `rare`, some row ids have none at the end or at all."""
    r, out = random.Random(seed), []
    for row_id in range(rows):
        seq = 0
        while seq < most:
            seq += r.randrange(1, 4)
            kind = r.choice(NAMES) if r.random() < rare and seq < most * row_id / rows else "Projection"
            out.append((row_id, seq, ITYPES[kind], [r.random() + k for k in range(3)]))
    return out


def model(frames):
    """{(row_id, seq): ray} of projections, {(row_id, set, seq): mean} of calibration frames."""
    sets, rays, means = {}, {}, {}
    for row_id, seq, itype, ray in sorted(frames):
        name = next(n for n, v in ITYPES.items() if v == itype)
        if name == "Projection":
            w, d = (sets.get((row_id, k)) for k in ("white", "dark"))
            mean = lambda s: [sum(x) / len(s) for x in zip(*s)]
            rays[row_id, seq] = [(x - b) / max(a - b, 1e-6) for x, a, b in zip(ray, mean(w), mean(d))] if w and d else ray
            continue
        kind = "white" if name.startswith("White") else "dark"
        held = [] if name.endswith("Reset") else sets.get((row_id, kind), [])
        sets[row_id, kind] = [*held, ray]
        means[row_id, kind, seq] = [sum(x) / len(held + [ray]) for x in zip(*sets[row_id, kind])]
    return rays, means


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
@pytest.mark.parametrize("rare", [0.02, 0.5])
def test_normalize_equals_model(spark, width, rare):
    frames = made(width, 5, 300, rare)
    df = spark.createDataFrame(frames, SCHEMA).repartition(5)
    rays, means = model([(a, b, c, [float(F32(x)) for x in ray]) for a, b, c, ray in frames])
    got = {(x.row_id, x.seq): x.ray for x in calibrate.normalize(df, width).collect()}
    assert set(got) == set(rays)
    assert all(x == pytest.approx(rays[k], rel=1e-9) for k, x in got.items())
    sets = {}
    for x in calibrate.calibration_sets(df, width).orderBy("pix").collect():
        sets.setdefault((x.row_id, x.set, x.seq), []).append(x["mean"])
    assert set(sets) == set(means) and all(x == pytest.approx(means[k], rel=1e-9) for k, x in sets.items())


def F32(x):
    import numpy as np

    return np.float32(x)


def test_without_calibration_frames(spark):
    df = spark.createDataFrame([(1, 1, 1, [2.0])], SCHEMA)
    assert calibrate.normalize(df).select("row_id", "ray").collect() == [(1, [2.0])]
    assert calibrate.calibration_sets(df).collect() == []
    assert calibrate.normalize(df.limit(0)).collect() == []


def test_rays_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 2, [2.0]), (1, 2, 2, [2.0, 3.0]), (1, 3, 1, [1.0, 1.0])], SCHEMA)
    with pytest.raises(Exception, match="calibration rays of 1 and 2 samples"):
        calibrate.normalize(df).collect()


def test_plan_reads_projections_once_and_moves_them_once(spark, data):
    """The frames are scanned once for the sets' table, which is written, and once for the projections."""
    frames = views.frames_calib(spark, data)
    out = calibrate.normalize(frames, 16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.rindex("== Initial Plan ==") if "== Initial Plan ==" in plan else 0:]
    scans = [line for line in final.splitlines() if "FileScan" in line]
    assert sum("embeddings" in line for line in scans) == 1 and len(scans) <= 5
    with_ray = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "_key" in line]
    assert len(with_ray) <= 1
    assert "posexplode" not in final and "collect_list" not in final
    assert final.count("Join") <= 4 and out.where(F.size("ray") == 64).count() == out.count()
