"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid import scratch, sinks
from sinogrid.config import KvConfig, TomoConfig
from sinogrid.functions import cleaning
from sinogrid.functions import hashing as h
from sinogrid.operators import assemble, calibrate, records, routing, sirt, stats, windows
from sinogrid.plans import kv_jobs, tomography
from sinogrid.plans.reconstruct import sirt_reconstruct
from sinogrid.sources import frames as fr
from sinogrid.sources import generators as gen
from sinogrid.sources import views
from sinogrid.streaming import kv as stream_kv
from sinogrid.streaming import tomography as stream_tomo
from sinogrid.streaming import windows as streams
from sinogrid.streaming.tomography import OPEN

TARGETS = 4
NX = 64
TILE = 64
WINDOW, STEP = 6, 4
ARRIVAL_WINDOW = dict(keys=["row_id"], order=views.ARRIVAL_ORDER)
SIRT = TomoConfig(window_length=32, window_step=16, window_iter=1, write_freq=2, tile=TILE)
SIRT_TWICE = TomoConfig(window_length=40, window_step=40, window_iter=2, write_freq=1, center=31.0, tile=TILE)
CLEAN = TomoConfig(normalize=True, mlog=True, remove_invalids=True)

_REGISTRY = {}


def query(fn):
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict:
    return dict(_REGISTRY)


def _round(*names: str) -> list[str]:
    return [f"round({n}, 6) AS {n}" for n in names]


def _pixels(df: DataFrame, keys: list[str], value: str = "ray", out: str = "x") -> DataFrame:
    return df.selectExpr(*keys, f"posexplode({value}) AS (pix, {out})")


# -- sources ----------------------------------------------------------------

@query
def gen_kv(spark, d):
    seq = views.table(spark, d, "events").selectExpr("event_id AS seq")
    return gen.with_kv(seq, KvConfig(sourceParallelism=3, seed=7))


@query
def ticks(spark, d):
    """Every event is a tick; an iteration is as many ticks as there are projections."""
    seq = views.table(spark, d, "events").selectExpr("event_id + 1 AS seq")
    return gen.tick_columns(seq, views.frames_per_row(spark, d))


@query
def tick_iter(spark, d):
    seq = views.table(spark, d, "events").selectExpr("event_id + 1 AS seq")
    return gen.tick_columns(seq, 144)


@query
def tick_union(spark, d):
    data = ticks(spark, d)
    last = data.agg(F.max("seq").alias("seq"), F.max("iter").alias("iter")).first()
    return gen.with_control_ticks(spark, data, last["seq"], last["iter"] + 1)


@query
def control_rows(spark, d):
    n = views.frames(spark, d).agg(F.max("row_id") + 1).first()[0]
    control, _ = records.split_control(tick_union(spark, d))
    return records.per_row_id(control, n)


@query
def split_control(spark, d):
    control, data = records.split_control(views.arrivals(spark, d))
    count = lambda df, part: df.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(part))
    return count(control, "control").unionByName(count(data, "data"))


@query
def scan_frames(spark, d):
    rows = fr.prepare_scan(views.frames(spark, d))
    return rows.selectExpr("row_id", "seq", *_round("theta", "theta_deg"),
                           "round(aggregate(ray, 0D, (a, x) -> a + cast(x AS DOUBLE)), 6) AS total")


@query
def read_slices(spark, d):
    return fr.read_slices(views.frames(spark, d), 3, 4).selectExpr("row_id", "seq", "size(ray) AS nx")


@query
def read_projections(spark, d):
    return fr.read_projections(views.frames(spark, d), 5, 20).selectExpr("row_id", "projection_id", "ray[0] AS x0")


@query
def dataset_stats(spark, d):
    return fr.dataset_stats(views.frames(spark, d))


@query
def tile_rows(spark, d):
    return fr.tile_rows(views.frames(spark, d), 24, views.ROWS).selectExpr("row_id", "seq", "ray[1] AS x1")


@query
def sequence_frames(spark, d):
    kinds = {r["label"]: r["n"] for r in _frame_kinds(spark, d).groupBy("kind").agg(
        F.first("label").alias("label"), F.max("idx").alias("m")).selectExpr("label", "m + 1 AS n").collect()}
    src = _frame_kinds(spark, d)
    part = lambda k: src.where(F.col("label") == k).select("idx", "theta", "data")
    out = fr.sequence_frames(part("flat"), part("dark"), part("projection"), kinds["flat"], kinds["dark"])
    return out.selectExpr("seq", "unique_id", "cast(itype AS INT) AS itype", "round(theta, 6) AS theta",
                          "data[0] AS x0").withColumn("label", fr.itype_label(F.col("itype")))


def _frame_kinds(spark, d):
    """Images as three inputs of different length, numbered from 0."""
    return views.images(spark, d).selectExpr(
        "CASE unique_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kind",
        "CASE unique_id % 5 WHEN 0 THEN 'flat' WHEN 1 THEN 'dark' ELSE 'projection' END AS label",
        "CASE WHEN unique_id % 5 < 2 THEN unique_id div 5 ELSE unique_id div 5 * 3 + unique_id % 5 - 2 END AS idx",
        "theta", "data")


@query
def replay(spark, d):
    n = views.table(spark, d, "embeddings").count()
    return fr.replay(views.images(spark, d), 3, n).selectExpr("seq", "iter", "unique_id", "data[2] AS x2")


@query
def tick_frames(spark, d):
    n = views.table(spark, d, "embeddings").count()
    t = gen.ticks(spark, TomoConfig(d_iteration=2, num_sinogram_projections=n))
    return fr.tick_frames(t, views.images(spark, d), n).selectExpr("seq", "iter", "unique_id", "data[3] AS x3")


@query
def ordered_subset(spark, d):
    n = views.frames_per_row(spark, d)
    one = views.frames(spark, d).selectExpr("row_id", "projection_id AS idx")
    return fr.ordered_subset(one, n)


# -- sinks ------------------------------------------------------------------

@query
def sink_kv_csv(spark, d):
    path = scratch.new_folder(spark, "kv-csv")
    sinks.write_kv_csv(views.kv(spark, d), path)
    return sinks.read_kv_csv(spark, path).groupBy("key", "val", "checksum").agg(F.count(F.lit(1)).alias("n"))


@query
def sink_iterations(spark, d):
    path = scratch.new_folder(spark, "iterations")
    rows = _pixels(views.frames(spark, d).withColumn("iteration", windows.pass_label(F.col("projection_id"))),
                   ["row_id", "iteration"])
    sinks.write_iterations(rows, path)
    back = sinks.read_iterations(spark, path, rows.schema)
    return back.groupBy("iteration").agg(F.count_distinct("row_id").alias("row_ids"),
                                         F.count(F.lit(1)).alias("samples"),
                                         F.round(F.sum(F.col("x").cast("double")), 6).alias("total"))


@query
def save_frames(spark, d):
    """The typed frame table kept beside its source and scanned again."""
    path = scratch.new_folder(spark, "frames")
    sinks.write_frames(views.frames(spark, d), path)
    return fr.scan_frames(spark, path).selectExpr(
        "row_id", "seq", *_round("theta_deg"), "round(aggregate(ray, 0D, (a, x) -> a + cast(x AS DOUBLE)), 6) AS total")


# -- records ----------------------------------------------------------------

@query
def upper_map(spark, d):
    return records.upper_map(views.table(spark, d, "events").select("event_id", "event_type"), "event_type")


@query
def split_rows_even(spark, d):
    return records.split_rows_even(views.images(spark, d), 3).selectExpr(
        "seq", "part", "row_offset", "rows", "size(block) AS samples",
        "round(aggregate(block, 0D, (a, x) -> a + cast(x AS DOUBLE)), 6) AS total")


@query
def explode_rows(spark, d):
    return records.explode_rows(views.images(spark, d), checksum=True).selectExpr(
        "row_id", "seq", "projection_id", *_round("theta", "center"), "size(ray) AS nx", "ray[0] AS x0", "checksum")


@query
def validate_rows(spark, d):
    marked = records.mark_rows(views.bad_rows(spark, d), NX)
    return marked.withColumn("reason", F.coalesce("reason", F.lit("ok"))).groupBy("projection_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def validate_strict(spark, d):
    """Usable rows, where any other row would end the job."""
    usable, _ = records.validate_rows(records.with_checksum(views.frames(spark, d)), NX, strict=True)
    return usable.selectExpr("row_id", "seq", "checksum")


@query
def job_rejects(spark, d):
    """Faulty messages through the job's input check: why and how many were rejected, and how many went on."""
    usable, rejected = records.checked(views.bad_rows(spark, d), NX, checksum=True)
    count = lambda df, reason: df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ray")).alias("samples"))
    return count(usable, F.lit("ok")).unionByName(count(rejected, F.col("reason")))


@query
def verify_checksum(spark, d):
    return records.verify_checksum(views.bad_rows(spark, d)).select("row_id", "seq", "checksum", "actual", "checksum_ok")


# -- calibration and cleaning -------------------------------------------------

@query
def reinterpret(spark, d):
    """8-bit and 16-bit samples from bytes, 8-bit ones from signed numbers, and floats, all as float samples."""
    byte, word = "cast(floor(abs(cast(x AS DOUBLE)) * 1000) AS BIGINT) % 256", "cast(floor(abs(cast(x AS DOUBLE)) * 100000) AS BIGINT) % 65536"
    raw = views.frames(spark, d).selectExpr(
        "row_id", "seq", f"unhex(array_join(transform(ray, x -> lpad(hex({byte}), 2, '0')), '')) AS u8",
        f"unhex(array_join(transform(ray, x -> lpad(hex(({word}) % 256), 2, '0') || lpad(hex(({word}) div 256), 2, '0')), '')) AS u16",
        f"transform(ray, x -> cast(IF({byte} > 127, {byte} - 256, {byte}) AS TINYINT)) AS s8", "ray AS f32")
    for column, kind in (("u8", "uint8"), ("u16", "uint16"), ("s8", "uint8"), ("f32", "float32")):
        raw = cleaning.to_float_ray(raw, column, kind)
    return raw.selectExpr("row_id", "seq", "posexplode(arrays_zip(u8, u16, s8, f32)) AS (pix, v)").selectExpr(
        "row_id", "seq", "pix", *[f"cast(v.{c} AS DOUBLE) AS {c}" for c in ("u8", "u16", "s8", "f32")])


@query
def calibration_sets(spark, d):
    return calibrate.calibration_sets(views.frames_calib(spark, d)).selectExpr(
        "row_id", "set", "seq", "pix", *_round("mean"))


@query
def normalize(spark, d):
    out = calibrate.normalize(views.frames_calib(spark, d), block_width=16)
    return _pixels(out, ["row_id", "seq"]).selectExpr("row_id", "seq", "pix", *_round("x"))


@query
def calibrate_frames(spark, d):
    out = calibrate.calibrate(views.frames_calib(spark, d), CLEAN)
    return _pixels(out, ["row_id", "seq"]).selectExpr("row_id", "seq", "pix", *_round("x"))


@query
def minus_log(spark, d):
    x = cleaning.minus_log(F.col("x").cast("double"))
    state = F.when(F.isnan(x), "nan").when(x == cleaning.INF, "inf").when(x == -cleaning.INF, "-inf").otherwise("number")
    finite = F.when(F.isnan(x) | (F.abs(x) == cleaning.INF), F.lit(None)).otherwise(x)
    return views.samples_dirty(spark, d).select(
        "row_id", "projection_id", "pix", state.alias("state"), F.round(finite, 6).alias("x"))


@query
def remove_invalids(spark, d):
    x = cleaning.remove_invalids(F.col("x")).cast("double")
    return views.samples_dirty(spark, d).select("row_id", "projection_id", "pix", F.round(x, 6).alias("x"))


@query
def sanitize_report(spark, d):
    out = records.sanitize_report(views.samples_dirty(spark, d), keys=("row_id",))
    return out.selectExpr("row_id", "samples", "negatives", "nans", "abnormal",
                          *_round("sum_absolute", "sum_nonnegative", "sum_without_nan", "sum_normal"))


# -- hashes -----------------------------------------------------------------

@query
def fnv1a(spark, d):
    return views.frames(spark, d).select("row_id", "seq", h.fnv1a_floats(F.col("ray")).alias("hash"))


@query
def fnv1a_text(spark, d):
    return views.kv(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("hash", h.fnv1a_text(F.col("key")))


@query
def murmur_u32(spark, d):
    ids = views.table(spark, d, "events").select("event_id")
    return h.with_murmur_u32(ids, "event_id", "hash")


@query
def murmur_inv_u32(spark, d):
    ids = views.table(spark, d, "events").select("event_id")
    there = h.with_murmur_inv_u32(ids, "event_id", "source")
    return h.with_murmur_u32(there, "source", "again")


@query
def record_checksum(spark, d):
    return views.kv(spark, d).select("seq", h.record_checksum(F.col("key")).alias("checksum"))


@query
def record_checksum_wide(spark, d):
    wide = views.kv_wide(spark, d).select("key", h.record_checksum(F.col("key")).alias("checksum"))
    return wide.groupBy("key", "checksum").agg(F.count(F.lit(1)).alias("n"))


@query
def java_hash(spark, d):
    return views.kv_wide(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "hash", h.java_hash(F.col("key")))


# -- routing ----------------------------------------------------------------

@query
def route_forward(spark, d):
    return routing.forward(views.kv(spark, d), TARGETS)


@query
def route_shuffle(spark, d):
    return routing.shuffle(views.kv(spark, d), TARGETS)


@query
def route_broadcast(spark, d):
    out = routing.broadcast_to_all(views.kv(spark, d), TARGETS)
    return routing.place(out, TARGETS)


def _placed(df: DataFrame, targets: int = TARGETS) -> DataFrame:
    # the partition that really received the row
    return routing.place(df, targets).withColumn(routing.SINK, F.spark_partition_id())


@query
def route_shift_zero(spark, d):
    return _placed(routing.with_shift_zero(views.kv(spark, d), TARGETS))


@query
def route_interleave(spark, d):
    return _placed(routing.with_interleave(views.kv(spark, d), TARGETS, block_width=1024))


@query
def route_modulo(spark, d):
    rows = views.frames(spark, d).selectExpr("row_id", "seq", "ray[0] AS x0")
    return _placed(routing.with_modulo(rows, TARGETS))


@query
def placement_forward(spark, d):
    """Rows by where they lay and where they lie after forwarding: none has moved."""
    rows = views.kv(spark, d).withColumn("was", F.spark_partition_id())
    moved = F.when(F.col("part") != F.col("was"), F.col("records")).otherwise(0)
    return routing.partition_load(routing.forward(rows), "was").agg(
        F.coalesce(F.sum(moved), F.lit(0)).alias("moved"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


@query
def placement_shuffle(spark, d):
    """Rows after shuffling: every target is used, and no task gave one of them more than its even share."""
    rows = views.kv(spark, d).withColumn("was", F.spark_partition_id())
    dealt = routing.partition_load(routing.shuffle(rows, TARGETS), "was")
    share = dealt.groupBy("was").agg(F.sum("records").alias("records"), F.max("records").alias("most"), F.collect_set("part").alias("parts"))
    return share.agg(F.size(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("targets"), F.sum("records").alias("records"),
                     F.max(F.col("most") - F.ceil(F.col("records") / TARGETS)).alias("above_share"))


@query
def balanced_placement(spark, d):
    """Plain hash partitioning of inverted keys deals consecutive ids out in turn."""
    ids = views.table(spark, d, "orders").selectExpr("o_orderkey AS row_id")
    placed = routing.with_balanced_key(ids).repartition(TARGETS, "place_key")
    return placed.select("row_id", F.spark_partition_id().alias("part"))


@query
def key_or_random(spark, d):
    rows = views.bad_rows(spark, d).select("row_id", "seq", "projection_id")
    return routing.key_or_random(rows, views.ROWS).groupBy("seq", "row_id").agg(F.count(F.lit(1)).alias("n"))


@query
def routing_skew(spark, d):
    kv = views.kv(spark, d)
    plain = kv.withColumn(routing.SINK, routing.hash_target(F.col("key"), TARGETS))
    spread = h.with_murmur_u32(kv, "seq", "_h").withColumn(
        routing.SINK, routing.modulo_target(F.col("_h"), TARGETS)).drop("_h")
    balanced = kv.withColumn(routing.SINK, routing.modulo_target(F.col("seq"), TARGETS))
    loads = [("hash", plain), ("shift_zero", routing.with_shift_zero(kv, TARGETS)),
             ("interleave", routing.with_interleave(kv, TARGETS, block_width=1024)),
             ("spread", spread), ("balanced", balanced)]
    out = None
    for name, df in loads:
        one = routing.target_load(df).selectExpr(f"'{name}' AS strategy", "sink_id", "records", *_round("share"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def kv_reroute_summary(spark, d):
    """Rerouted records per target with the XOR of their checksums."""
    return kv_jobs.target_summary(kv_jobs.with_target(views.kv(spark, d), "reroute", TARGETS))


@query
def kv_interleave_summary(spark, d):
    return kv_jobs.target_summary(kv_jobs.with_target(views.kv(spark, d), "reroute-interleave", TARGETS))


@query
def kv_broadcast_summary(spark, d):
    return kv_jobs.broadcast_summary(views.kv_wide(spark, d), TARGETS)


# -- reconstruction ---------------------------------------------------------

def _messages(spark, d):
    return views.frames(spark, d, spread=True).select("row_id", "seq", "theta", "center", "ray")


def _first_image(spark, d, tile):
    """A start image of all messages, folded onto its rows, written out as the image between sweeps is."""
    pixels = (views.frames(spark, d, spread=True).selectExpr("row_id", "seq", "posexplode(ray) AS (col, x)")
              .selectExpr("row_id", "cast((seq - 1) % 64 * 64 + col AS INT) AS pix", "cast(x AS DOUBLE) AS val"))
    path = scratch.new_folder(spark, "image")
    image = sirt.image_tiles(pixels, NX, tile)
    image.write.parquet(path)
    return spark.read.schema(image.schema).parquet(path)


@query
def ray_geometry(spark, d):
    """Line of each ray over the grid; angles come in degrees, centres are the defaults."""
    rows = views.frames(spark, d).withColumn("theta", F.degrees("theta"))
    rows = fr.prepare_scan(rows, angles_in="degrees").select("row_id", "seq", "theta", "center", "ray")
    return sirt.ray_lines(rows).selectExpr("row_id", "seq", "col", "nx", "steep", *_round("slope", "icept"))


@query
def ray_weights(spark, d):
    """Chords of each projection's rays, worked out once for all detector rows."""
    angles = _messages(spark, d).groupBy("seq", "theta", "center").agg(F.max(F.size("ray")).alias("nx"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = sirt.ray_lines(angles.repartition(parts, "seq").selectExpr(
        "seq", "theta", "center", "array_repeat(0D, nx) AS ray"))
    weights = sirt.ray_weights(lines, 16)
    return weights.groupBy("seq", "pix").agg(F.count(F.lit(1)).alias("rays"), F.round(F.sum("chord"), 6).alias("chord"))


@query
def forward_project(spark, d):
    image = _first_image(spark, d, 16)
    lines = sirt.ray_lines(_messages(spark, d))
    return sirt.forward_project(lines, image, ["seq"], 16).selectExpr("row_id", "seq", "col", *_round("sim", "norm"))


@query
def back_project(spark, d):
    lines = sirt.ray_lines(_messages(spark, d))
    out = sirt.back_project(sirt.forward_project(lines, None, ["seq"], TILE, NX), ["seq"], TILE, NX)
    return out.selectExpr("row_id", "cell AS pix", *_round("num", "den"))


@query
def sirt_update(spark, d):
    """One sweep over all frames from a start image."""
    image = _first_image(spark, d, TILE)
    out = sirt.sweep(sirt.ray_lines(_messages(spark, d)), image, None, ["seq"], TILE, NX)
    return sirt.image_pixels(out, NX, TILE).selectExpr("row_id", "pix", *_round("val"))


@query
def sirt_emit(spark, d):
    """Windowed reconstruction, every second pass emitted."""
    out = sirt_reconstruct(_messages(spark, d), SIRT).emitted_pixels()
    return out.selectExpr("row_id", "iteration", "pix", *_round("val"))


@query
def sirt_iterated(spark, d):
    """Two sweeps per window, a job-wide centre, all passes emitted."""
    out = sirt_reconstruct(_messages(spark, d), SIRT_TWICE).emitted_pixels()
    return out.selectExpr("row_id", "iteration", "pix", *_round("val"))


@query
def recon_state(spark, d):
    """Image left after the last pass of each row id: what a restart begins from."""
    fired = sirt_reconstruct(_messages(spark, d), SIRT)
    return sirt.image_pixels(fired.latest(), fired.nx, SIRT.tile).groupBy("row_id", "pass0").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("val"), 6).alias("total"))


# -- gather -----------------------------------------------------------------

def _recon_messages(spark, d):
    """Emitted images with gaps and repeats: iteration, row_id, arrival and one value."""
    return views.frames(spark, d).selectExpr(
        "row_id", "projection_id", "posexplode(ray) AS (pix, val)").where(
        "NOT (projection_id % 7 = 3 AND row_id = 4)").selectExpr(
        "row_id", "projection_id AS pass0", "pix", "cast(val AS DOUBLE) AS val",
        "explode(sequence(0, IF(row_id % 3 = 1, 1, 0))) AS again").selectExpr(
        "row_id", "pix", "val + again AS val", "lpad(cast(pass0 AS STRING), 6, '0') AS iteration",
        "(row_id + again * 7) * 2 + again AS arrival")


@query
def assemble_iterations(spark, d):
    out = assemble.assemble_iterations(_recon_messages(spark, d), views.ROWS)
    return out.selectExpr("iteration", "row_id", "pix", "arrival", *_round("val"))


@query
def iteration_notices(spark, d):
    return assemble.iteration_notices(_recon_messages(spark, d), views.ROWS)


def _whole_job(spark, d):
    n = views.table(spark, d, "embeddings").count()
    return TomoConfig(num_sinogram_projections=n, num_sinograms=12, window_length=64, window_step=n // 4,
                      write_freq=3, tile=4, keying="modulo", remove_invalids=True)


@query
def tomography_job(spark, d):
    """Ticks, frame lookup, detector rows, windowed reconstruction and gathering as one job.

    Images of 8 x 8 samples; rows are repeated to 12.
    """
    cfg, path = _whole_job(spark, d), scratch.new_folder(spark, "recon")
    notices = tomography.run_batch(spark, views.images(spark, d), cfg, path)
    written = sinks.read_iterations(spark, path, OPEN)
    sums = sirt.image_pixels(written, views.SIDE, cfg.tile).groupBy("iteration").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("val"), 6).alias("total"))
    out = notices.groupBy("status", "iteration").agg(F.count(F.lit(1)).alias("notices"))
    return out.join(sums, "iteration", "left")


# -- windows and order ------------------------------------------------------

@query
def count_windows(spark, d):
    out = windows.count_windows(views.arrivals(spark, d), WINDOW, STEP, **ARRIVAL_WINDOW)
    return out.select("row_id", F.col("pass").cast("bigint").alias("pass"), "rn", "event_id")


@query
def window_view(spark, d):
    out = windows.count_windows(views.arrivals(spark, d), WINDOW, STEP, **ARRIVAL_WINDOW)
    view = windows.window_view(out, ["row_id"])
    return view.selectExpr("row_id", "cast(pass AS BIGINT) AS pass", "messages", "first_rn", "last_rn", "center",
                           *_round("min_theta", "max_theta"))


@query
def snapshot_points(spark, d):
    out = windows.snapshot_points(views.arrivals(spark, d), 4, **ARRIVAL_WINDOW)
    return out.select("row_id", "event_id", "processed")


@query
def monotone_dedup(spark, d):
    out = windows.monotone_dedup(views.arrivals(spark, d), **ARRIVAL_WINDOW)
    return out.select("row_id", "event_id", "seq")


@query
def after_fin_filter(spark, d):
    out = windows.after_fin_filter(views.arrivals(spark, d), **ARRIVAL_WINDOW)
    return out.select("row_id", "event_id", "kind")


# -- streams ----------------------------------------------------------------
# A given table is the stream; the query runs until all of it is taken in.

BATCHES = 3


def _in_batches(src, order, start, parts=BATCHES):
    """Hand the rows of `src` to a stream in `parts` parts by `order`; it is started anew, from its checkpoint, for each.

    `start` takes the streaming table and gives the started query, which ends
    when it has read what is there. The ended queries are returned.
    """
    spark, schema = src.sparkSession, src.schema
    folder = scratch.new_folder(spark, "stream-source")
    low, high = src.agg(F.min(order), F.max(order)).first()
    cuts = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    ended = []
    for begin, end in zip(cuts, cuts[1:]):
        src.where((F.col(order) >= begin) & (F.col(order) < end)).write.mode("append").parquet(folder)
        ended.append(start(spark.readStream.schema(schema).parquet(folder)))
        ended[-1].awaitTermination()
    return ended


@query
def stream_count_windows(spark, d):
    src = views.table(spark, d, "events").selectExpr("user_id AS row_id", "event_id AS seq")
    root, progress = scratch.new_folder(spark, "windows"), scratch.new_folder(spark, "windows-progress")
    _in_batches(src, "seq", lambda rows: streams.start_count_windows(rows, WINDOW, STEP, root, progress, available_now=True))
    return streams.fired_windows(spark, root)


@query
def stateful_count_windows(spark, d):
    """The same with the windows of a key in the state store."""
    src = views.table(spark, d, "events").selectExpr("user_id AS row_id", "event_id AS seq")
    path, progress = scratch.new_folder(spark, "state"), scratch.new_folder(spark, "state-progress")
    schema = []

    def start(rows):
        out = streams.stateful_count_windows(rows, WINDOW, STEP)
        schema.append(out.schema)
        return (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
                .trigger(availableNow=True).start())

    _in_batches(src, "seq", start)
    return spark.read.schema(schema[0]).parquet(path)


def _stream_kv(spark, d, job):
    src = views.kv(spark, d)
    path, progress = scratch.new_folder(spark, "kv-stream"), scratch.new_folder(spark, "kv-progress")
    _in_batches(src, "seq", lambda rows: stream_kv.start(
        spark, job, KvConfig(sinkParallelism=TARGETS), path, progress, source=rows, available_now=True))
    return stream_kv.read_output(spark, job, path).groupBy("key", "val", "checksum").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_kv_forward(spark, d):
    return _stream_kv(spark, d, kv_jobs.FORWARD)


@query
def stream_kv_shuffle(spark, d):
    return _stream_kv(spark, d, kv_jobs.SHUFFLE)


@query
def stream_kv_broadcast(spark, d):
    """Every record once for each target."""
    return _stream_kv(spark, d, kv_jobs.BROADCAST)


@query
def stream_kv_reroute(spark, d):
    return _stream_kv(spark, d, kv_jobs.REROUTE)


@query
def stream_kv_interleave(spark, d):
    return _stream_kv(spark, d, kv_jobs.INTERLEAVE)


@query
def stream_reconstruct(spark, d):
    src = views.frames(spark, d).select("row_id", "seq", "theta", "center", "ray")
    cfg = replace(SIRT, num_sinograms=views.ROWS)
    root, progress = scratch.new_folder(spark, "recon-stream"), scratch.new_folder(spark, "recon-progress")
    _in_batches(src, "seq", lambda rows: stream_tomo.start(rows, cfg, root, progress, True))
    images = stream_tomo.Reconstruction(spark, root, cfg).iterations()
    return sirt.image_pixels(images, NX, cfg.tile).selectExpr("row_id", "iteration", "pix", *_round("val"))


@query
def restore_rows(spark, d):
    """Even row ids taken out of a run after half its messages into a new one: their last images."""
    src = views.frames(spark, d).select("row_id", "seq", "theta", "center", "ray")
    half = views.frames_per_row(spark, d) // 2
    runs = []
    for part, rows in ((src.where(F.col("seq") <= half), views.ROWS), (src.where((F.col("seq") > half) & (F.col("row_id") % 2 == 0)), views.ROWS // 2)):
        cfg = replace(SIRT, num_sinograms=rows)
        root, progress = scratch.new_folder(spark, "restore"), scratch.new_folder(spark, "restore-progress")
        run = stream_tomo.Reconstruction(spark, root, cfg)
        if runs:
            run.restore(runs[0], spark.range(0, views.ROWS, 2).select(F.col("id").alias("row_id")))
        _in_batches(part, "seq", lambda rows: stream_tomo.start(rows, cfg, root, progress, True), parts=1)
        runs.append(run)
    last = runs[1].last_batch()
    passes = runs[1].progress(last).select("row_id", (F.floor(F.col("n") / SIRT.window_step) - 1).alias("pass0"))
    return sirt.image_pixels(runs[1].images().read(last), NX, TILE).join(passes, "row_id").groupBy("row_id", "pass0").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("val"), 6).alias("total"))


@query
def stream_tomography(spark, d):
    """The whole job as one streaming query: ticks come as a stream and look up frames of a static table."""
    cfg, images = _whole_job(spark, d), views.images(spark, d)
    seq = views.table(spark, d, "events").selectExpr("event_id + 1 AS seq").where(F.col("seq") <= cfg.total_ticks)
    root, progress = scratch.new_folder(spark, "live"), scratch.new_folder(spark, "live-progress")
    _in_batches(gen.tick_columns(seq, cfg.num_sinogram_projections), "seq",
                lambda ticks: tomography.start_stream(spark, images, cfg, root, progress, ticks, True))
    done = stream_tomo.Reconstruction(spark, root, cfg).iterations()
    return sirt.image_pixels(done, views.SIDE, cfg.tile).groupBy("iteration").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("val"), 6).alias("total"))


# -- statistics -------------------------------------------------------------

@query
def processed_counts(spark, d):
    return stats.processed_counts(views.arrivals(spark, d), ["row_id"])


@query
def progress_snapshot(spark, d):
    return stats.progress_snapshot(views.arrivals(spark, d), "events")


@query
def stream_progress(spark, d):
    """Figures that a running stream reports with its batches."""
    src = views.kv(spark, d)
    progress = scratch.new_folder(spark, "observed-progress")
    ended = _in_batches(src, "seq", lambda rows: (
        stats.observed(rows, F.octet_length("key")).writeStream.format("noop")
        .option("checkpointLocation", progress).trigger(availableNow=True).start()))
    reports = [r for one in ended for r in stats.batch_progress(one)]
    rows = [(r["batch"], r["messages"], r["bytes"], r["last_seq"]) for r in reports]
    return spark.createDataFrame(rows, "batch BIGINT, messages BIGINT, bytes BIGINT, last_seq BIGINT")


@query
def progress_json(spark, d):
    return stats.progress_json(stats.progress_snapshot(views.arrivals(spark, d), "events")).select("row_id", "json")


@query
def throughput_stats(spark, d):
    rows = views.table(spark, d, "events")
    out = stats.throughput_stats(rows, F.octet_length("props"), F.col("ts"), ("event_type",))
    return out.selectExpr("event_type", "messages", *_round("mib", "seconds", "mib_per_s", "messages_per_s"))
