"""Job parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


# Parameters of launchers, hosts, threads, failures and reports: where and how a job runs, not what it computes.
OPERATIONAL = frozenset((
    "thread_count", "parallelism", "simulation_file", "image_pv", "iteration_sleep", "logdir", "checkpoint_interval", "restart",
    "failure_period", "failure_interval", "recovery_interval", "sink_delay", "cpu_delay"))


class _FromMapping:
    @classmethod
    def from_mapping(cls, values: dict):
        """Build from a parsed JSON object.

        False or empty values leave the default. Names of OPERATIONAL have no say
        in the result and are ignored; any other unknown name that is set is an error.
        """
        known = {f.name: f for f in fields(cls)}
        picked = {}
        for name, value in values.items():
            if value is None or value is False or value == "" or name in OPERATIONAL:
                continue
            if name not in known:
                raise ValueError(f"parameter {name!r} is not offered")
            default = known[name].default
            kind = str if default is None else type(default)
            picked[name] = True if kind is bool else kind(value)
        return cls(**picked)

    @classmethod
    def from_json(cls, path: str):
        with open(path, encoding="utf-8") as handle:
            return cls.from_mapping(json.load(handle))

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class TomoConfig(_FromMapping):
    """Tomography job: source, cleaning switches and reconstruction windows."""

    # source
    ntask_sirt: int = 1
    num_sinograms: int = 0
    beg_sinogram: int = 0  # where the table's rows begin in the full detector; not a filter
    num_sinogram_columns: int = 0
    num_sinogram_projections: int = 1440
    d_iteration: int = 1
    proj_sleep: float = 0.6
    # cleaning
    degree_to_radian: bool = False
    mlog: bool = False
    uint16_to_float32: bool = False
    uint8_to_float32: bool = False
    cast_to_float32: bool = False
    normalize: bool = False
    remove_invalids: bool = False
    checksum: bool = False
    # reconstruction
    write_freq: int = 10000
    ckpt_freq: int = 4
    window_length: int = 32
    window_step: int = 1
    window_iter: int = 1
    center: float = 0.0
    # how rows are placed on tasks: "hash" or "modulo"
    keying: str = "hash"
    # side of the square image blocks that one row of the image table holds
    tile: int = 64
    # messages per (row, block) group when arrival numbers are computed
    rank_block: int = 65536

    @property
    def total_ticks(self) -> int:
        return self.d_iteration * self.num_sinogram_projections

    @property
    def rows_per_second(self) -> int:
        return max(1, round(1.0 / max(self.proj_sleep, 1e-9)))


@dataclass(frozen=True)
class KvConfig(_FromMapping):
    """Key/value routing job."""

    ratePerSecond: int = 100
    sourceParallelism: int = 1
    sinkParallelism: int = 1
    maxRecords: int = 2**63 - 1
    ckptDuration: int = 0
    seed: int = 0

    @property
    def rows_per_second(self) -> int:
        return self.ratePerSecond * self.sourceParallelism

    @property
    def num_keys(self) -> int:
        return 20 * self.sourceParallelism
