"""Command line: python -m sinogrid kv JOB ... | tomography ..."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from pyspark.sql import SparkSession

from sinogrid.config import KvConfig, TomoConfig
from sinogrid.plans import kv_jobs, tomography
from sinogrid.streaming import kv as stream_kv


def _add_fields(parser: argparse.ArgumentParser, config) -> None:
    for f in fields(config):
        if isinstance(f.default, bool):
            parser.add_argument(f"--{f.name}", action="store_true", default=None)
        else:
            parser.add_argument(f"--{f.name}", type=type(f.default), default=None)


def _config(kind, args: argparse.Namespace):
    values = {}
    if getattr(args, "params", None):
        with open(args.params, encoding="utf-8") as handle:
            values.update(json.load(handle))
    values.update({f.name: getattr(args, f.name) for f in fields(kind) if getattr(args, f.name) is not None})
    return kind.from_mapping(values)


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sinogrid")
    kinds = parser.add_subparsers(dest="kind", required=True)
    kv = kinds.add_parser("kv", help="key/value routing job")
    kv.add_argument("job", choices=kv_jobs.JOBS)
    tomo = kinds.add_parser("tomography", help="reconstruct a Parquet table of frames")
    tomo.add_argument("--frames", required=True, help="image table")
    tomo.add_argument("--params", help="JSON file with job parameters")
    for sub, config in ((kv, KvConfig), (tomo, TomoConfig)):
        sub.add_argument("--out", required=True)
        sub.add_argument("--checkpoint", help="folder for restarts; without it a run starts over")
        sub.add_argument("--stream", action="store_true", help="run at the configured rate instead of at once")
        _add_fields(sub, config)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = SparkSession.builder.appName(f"sinogrid-{args.kind}").getOrCreate()
    if args.kind == "kv":
        cfg = _config(KvConfig, args)
        if args.stream:
            stream_kv.start(spark, args.job, cfg, args.out, args.checkpoint).awaitTermination()
        else:
            kv_jobs.run_batch(spark, args.job, cfg, args.out)
        return
    cfg = _config(TomoConfig, args)
    images = spark.read.parquet(args.frames)
    if args.stream:
        tomography.start_stream(spark, images, cfg, args.out, args.checkpoint).awaitTermination()
    else:
        tomography.run_batch(spark, images, cfg, args.out).show(truncate=False)


if __name__ == "__main__":
    main()
