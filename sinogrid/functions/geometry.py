"""Ray and pixel geometry in closed form, as SQL expressions.

The image is an n x n grid centred at the origin; below, grid coordinates run
from 0 to n on both axes. A ray at angle theta through detector column c is the
line y*cos(theta) - x*sin(theta) = offset. Following the axis along which the
line is longer (the major axis), its minor coordinate is slope*s + icept with
|slope| <= 1. So in each strip of one cell it meets at most two cells, and the
whole set of crossed pixels comes from arithmetic on the strip number: no sort,
no window and no shuffle.
"""

from __future__ import annotations

# Fixed value: shift that keeps rays off the grid lines.
GRID_SHIFT = 1e-6


def frame_center(center: str, nx: str) -> str:
    """Centre of a detector row: the middle when none was recorded."""
    return f"coalesce(nullif(cast({center} AS DOUBLE), 0D), {nx} / 2D)"


def kernel_center(center: str, nx: str, override: float = 0.0) -> str:
    """Whole-number centre used for reconstruction; a job centre wins."""
    whole = f"{int(override)}D" if int(override) else f"cast(cast({center} AS BIGINT) AS DOUBLE)"
    return f"CASE WHEN {whole} <= 0 THEN {nx} / 2D + 1D ELSE {whole} END"


def ray_offset(column: str, nx: str, center: str) -> str:
    return f"((1D - {nx}) / 2D + {column} + ({nx} / 2D - {center} + {GRID_SHIFT!r}D))"


def ray_line(theta: str, offset: str, nx: str) -> list[str]:
    """`steep`, `slope`, `icept` of a ray in grid coordinates."""
    return [
        f"abs(sin({theta})) > abs(cos({theta})) AS steep",
        f"CASE WHEN steep THEN cos({theta}) / sin({theta}) ELSE sin({theta}) / cos({theta}) END AS slope",
        f"CASE WHEN steep THEN -{offset} / sin({theta}) ELSE {offset} / cos({theta}) END"
        f" + {nx} / 2D * (1D - slope) AS icept",
    ]


def strip_end(start: str, size: int, which: str) -> str:
    """`which` = least or greatest minor coordinate of the line in [start, start + size)."""
    return f"{which}(slope * {start} + icept, slope * ({start} + {size}) + icept)"


def cell_range(low: str, high: str) -> str:
    """Cell numbers low..high as an array, NULL when the range is empty.

    Exploding it drops empty ranges without a filter, which would be pushed
    below and evaluate the geometry once more.
    """
    return f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) END"


def cell_share(cell: str, bottom: str, top: str) -> str:
    """Part of the strip that a line from `bottom` to `top` spends in `cell`."""
    return (f"CASE WHEN floor({bottom}) = floor({top}) THEN 1D "
            f"ELSE (least({top}, {cell} + 1D) - greatest({bottom}, cast({cell} AS DOUBLE)))"
            f" / ({top} - {bottom}) END")


CHORD_PER_STRIP = "sqrt(1D + slope * slope)"
