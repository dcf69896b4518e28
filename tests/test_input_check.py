"""Unusable input: parameters that are not offered, ragged payloads, false checksums."""

import pytest
from pyspark.sql import functions as F

from sinogrid.config import KvConfig, TomoConfig
from sinogrid.operators import records
from sinogrid.plans import kv_jobs
from sinogrid.plans.reconstruct import sirt_reconstruct
from sinogrid.streaming.tomography import Reconstruction

SCHEMA = "row_id BIGINT, seq BIGINT, projection_id BIGINT, theta DOUBLE, center DOUBLE, ray ARRAY<FLOAT>"


def messages(spark, sizes):
    return spark.createDataFrame([(0, i + 1, i, 0.3 * i, 0.0, [1.0 + k for k in range(n)]) for i, n in enumerate(sizes)], SCHEMA)


def test_switches_that_are_not_offered_raise():
    with pytest.raises(ValueError, match="remove_stripes"):
        TomoConfig.from_mapping({"remove_stripes": True})
    assert TomoConfig.from_mapping({"remove_stripes": False, "thread_count": 4, "mlog": True}).mlog


def test_a_batch_without_a_number_of_records_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="maxRecords"):
        kv_jobs.run_batch(spark, kv_jobs.JOBS[0], KvConfig(), str(tmp_path / "out"))


def test_ragged_payloads_raise_instead_of_a_wrong_image(spark):
    with pytest.raises(ValueError, match="one length"):
        sirt_reconstruct(messages(spark, [6, 6, 3, 6]), TomoConfig(window_length=2, window_step=2, write_freq=1, tile=4))


def test_false_checksums_are_rejected_whether_or_not_a_length_is_given(spark, tmp_path):
    rows = records.with_checksum(messages(spark, [6, 6, 6, 0]))
    rows = rows.withColumn("checksum", F.expr("IF(seq = 2, checksum + 1, checksum)"))
    for nx in (0, 6):
        usable, rejected = records.checked(rows, nx, checksum=True)
        assert sorted(r.seq for r in usable.collect()) == [1, 3]
        assert sorted((r.seq, r.reason) for r in rejected.collect()) == [(2, "wrong checksum"), (4, "empty payload")]
    cfg = TomoConfig(window_length=2, window_step=2, write_freq=1, tile=4, num_sinograms=1, checksum=True)
    job = Reconstruction(spark, str(tmp_path), cfg)
    job.process(rows, 0)
    assert {r.reason for r in job.rejected().collect()} == {"wrong checksum", "empty payload"}


def test_a_stream_needs_the_number_of_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="num_sinograms"):
        Reconstruction(spark, str(tmp_path), TomoConfig())


def test_byte_payloads(spark):
    from sinogrid.functions.cleaning import to_float_ray

    rows = spark.createDataFrame([(1, bytearray([200, 1, 255, 255])), (2, bytearray([7])), (3, None)], "seq BIGINT, ray BINARY")
    got = {k: [r.ray for r in to_float_ray(rows, "ray", k).orderBy("seq").collect()] for k in ("uint8", "uint16", "float32")}
    assert got["uint8"] == [[200.0, 1.0, 255.0, 255.0], [7.0], None]
    assert got["uint16"] == [[456.0, 65535.0], None, None]
    assert [r is None for r in got["float32"]] == [False, True, True]
    signed = spark.createDataFrame([([-56, 5],)], "ray ARRAY<TINYINT>")
    assert to_float_ray(signed, "ray", "uint8").first().ray == [200.0, 5.0]
    usable, rejected = records.checked(rows.selectExpr("seq", "ray"), 2)
    assert [r.seq for r in usable.collect()] == [1] and {r.reason for r in rejected.collect()} == {"wrong length", "empty payload"}
