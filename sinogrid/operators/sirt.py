"""Iterative reconstruction (SIRT) as joins and aggregations.

One sweep compares every measured ray with the sum of the image along it and
spreads the difference back over the crossed pixels:

    sim = sum(image * chord)            per ray
    upd = (sample - sim) / sum(chord^2) per ray
    image += sum(chord * upd) / sum(chord)   per pixel, image fixed in the sweep

Layout for large images. A ray of an n-column detector crosses up to 2n pixels;
shuffling (ray, pixel) rows would move thousands of rows per sample. The image
is therefore kept in square tiles, one array per row (`tile` x `tile` values),
and what is shuffled are (ray, tile) pairs, about 1.3 n/tile per ray. A pair
meets its tile in an equi-join, is expanded to pixels in place and aggregated
before anything is shuffled again.

Tables
  lines:  keys.., row_id, col, steep, slope, icept, nx [, sample]  one row per ray
  image:  row_id, tile, vals ARRAY<DOUBLE>                         one row per tile
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.functions import geometry as g

LINE = ("steep", "slope", "icept", "nx")
# Projections whose rays are summed together before the last exchange.
BACK_BLOCK = 16


def ray_lines(frames: DataFrame, center: float = 0.0) -> DataFrame:
    """One row per ray of each message, as a line over the image grid."""
    names = [c for c in frames.columns if c not in ("ray", "theta", "center", "nx")]
    mid = g.kernel_center(g.frame_center("center", "size(ray)"), "size(ray)", center)
    rays = frames.selectExpr(*names, "theta", "size(ray) AS nx", f"{mid} AS _mid",
                             "posexplode(ray) AS (col, sample)")
    return rays.selectExpr(*names, "col", "cast(sample AS DOUBLE) AS sample", "nx",
                           *g.ray_line("theta", g.ray_offset("col", "nx", "_mid"), "nx"))


def to_tiles(lines: DataFrame, tile: int, nx: int | None = None) -> DataFrame:
    """(ray, tile) pairs with `tmaj`, `tmin`: tile numbers on the ray's two axes.

    When all rays are known to have `nx` columns and one tile holds the image,
    nothing has to be worked out.
    """
    if nx is not None and nx <= tile:
        return lines.selectExpr("*", "0 AS tmaj", "0 AS tmin", "0 AS tile")
    side = f"cast(ceil(nx / {tile}D) AS INT)"
    ends = [f"cast(floor({g.strip_end(f'(tmaj * {tile})', tile, w)} / {tile}D) AS INT)"
            for w in ("least", "greatest")]
    cells = g.cell_range(f"greatest({ends[0]}, 0)", f"least({ends[1]}, {side} - 1)")
    return (lines.selectExpr("*", f"explode(sequence(0, {side} - 1)) AS tmaj")
            .selectExpr("*", f"explode({cells}) AS tmin")
            .selectExpr("*", f"IF(steep, tmin + tmaj * {side}, tmaj + tmin * {side}) AS tile"))


def to_pixels(pairs: DataFrame, tile: int, outs: list[str]) -> DataFrame:
    """Crossed pixels of each (ray, tile) pair: `cell` in the tile and `chord`.

    `outs` are expressions over the columns of `pairs`, `cell` and `chord`.
    """
    begin, edge = f"(tmaj * {tile})", f"(tmin * {tile})"
    cells = g.cell_range(f"greatest(cast(floor(_bottom) AS INT), {edge})",
                         f"least(cast(floor(_top) AS INT), {edge} + {tile - 1}, nx - 1)")
    along, across = f"(_s - {begin})", f"(_r - {edge})"
    return (pairs.selectExpr("*", f"explode(sequence({begin}, least({begin} + {tile}, nx) - 1)) AS _s")
            .selectExpr("*", f"{g.strip_end('_s', 1, 'least')} AS _bottom",
                        f"{g.strip_end('_s', 1, 'greatest')} AS _top")
            .selectExpr("*", f"explode({cells}) AS _r")
            .selectExpr("*", f"IF(steep, {across} + {along} * {tile}, {along} + {across} * {tile}) AS cell",
                        f"{g.cell_share('_r', '_bottom', '_top')} * {g.CHORD_PER_STRIP} AS chord")
            .selectExpr(*outs))


def pixel_number(tile: int) -> str:
    side = f"cast(ceil(nx / {tile}D) AS INT)"
    x = f"(tile % {side} * {tile} + cell % {tile})"
    y = f"(tile div {side} * {tile} + cell div {tile})"
    return f"cast({x} + {y} * nx AS INT) AS pix"


def ray_weights(lines: DataFrame, tile: int) -> DataFrame:
    """Chord length of every (ray, pixel) crossing; no exchange at all."""
    own = [c for c in lines.columns if c not in LINE]
    return to_pixels(to_tiles(lines, tile), tile, [*own, pixel_number(tile), "chord"]).where("chord > 0")


# -- image tables -----------------------------------------------------------

def blank_image(rows: DataFrame, nx: int, tile: int) -> DataFrame:
    """All-zero image for each row_id of `rows` (distinct already)."""
    side = -(-nx // tile)
    # the zero depends on a column only so that the array is not folded into the plan
    return (rows.selectExpr("row_id", f"explode(sequence(0, {side * side - 1})) AS tile")
            .selectExpr("row_id", "tile", f"array_repeat(IF(tile >= 0, 0D, NULL), {tile * tile}) AS vals"))


def image_pixels(image: DataFrame, nx: int, tile: int) -> DataFrame:
    """Long form: one row per pixel of the nx x nx image."""
    keep = [c for c in image.columns if c not in ("vals", "tile")]
    side = -(-nx // tile)
    return (image.selectExpr(*keep, "tile", "posexplode(vals) AS (_cell, val)")
            .selectExpr(*keep, "val", f"tile % {side} * {tile} + _cell % {tile} AS _x",
                        f"tile div {side} * {tile} + _cell div {tile} AS _y")
            .where(f"_x < {nx} AND _y < {nx}")
            .selectExpr(*keep, f"cast(_x + _y * {nx} AS INT) AS pix", "val"))


def image_tiles(pixels: DataFrame, nx: int, tile: int) -> DataFrame:
    """Inverse of `image_pixels` for a table (row_id, pix, val); absent pixels are 0."""
    side = -(-nx // tile)
    x, y = f"(pix % {nx})", f"(pix div {nx})"
    given = pixels.selectExpr("row_id", f"cast({x} div {tile} + {y} div {tile} * {side} AS INT) AS tile",
                              f"cast({x} % {tile} + {y} % {tile} * {tile} AS INT) AS cell", "val")
    zeros = image_cells(blank_image(pixels.select("row_id").distinct(), nx, tile), ["val"])
    summed = given.unionByName(zeros).groupBy("row_id", "tile", "cell").agg(F.sum("val").alias("val"))
    return _to_arrays(summed)


def image_cells(image: DataFrame, outs: list[str]) -> DataFrame:
    return image.selectExpr("row_id", "tile", "posexplode(vals) AS (cell, val)").selectExpr(
        "row_id", "tile", "cell", *outs)


def _to_arrays(cells: DataFrame) -> DataFrame:
    # A list is as long as a tile has cells, whatever the size of the data.
    listed = cells.groupBy("row_id", "tile").agg(
        F.expr("sort_array(collect_list(struct(cell, val)))").alias("_l"))
    return listed.selectExpr("row_id", "tile", "_l.val AS vals")


# -- one sweep --------------------------------------------------------------

def forward_project(lines: DataFrame, image: DataFrame | None, keys: list[str], tile: int,
                    nx: int | None = None) -> DataFrame:
    """`lines` with `sim` and `norm` (sum of squared chords); rays off the grid drop out.

    `keys` identify a message within a row_id, its number first. Without an
    image the simulated values are 0 and no join runs.
    """
    ray = ["row_id", *keys, "col"]
    pairs = to_tiles(lines, tile, nx)
    sim = "0D"
    if image is not None:
        pairs = pairs.join(image, ["row_id", "tile"])
        sim = "vals[cell] * chord"
    pixels = to_pixels(pairs, tile, [*ray, "sample", *LINE, f"{sim} AS part", "chord"])
    # sample and line are functions of the ray: first() carries them through the
    # same aggregation, and all its inputs in a group are equal.
    carried = [F.first(c).alias(c) for c in ("sample", *LINE)]
    return pixels.groupBy(*ray).agg(
        F.sum("part").alias("sim"), F.expr("sum(chord * chord)").alias("norm"), *carried)


def _back_sums(projected: DataFrame, keys: list[str], tile: int, nx: int | None) -> DataFrame:
    df = projected.selectExpr("row_id", *keys, "col", "try_divide(sample - sim, norm) AS upd", *LINE)
    # Rays of one tile and one block of projections meet in a task, are summed
    # there, and only sums per cell are shuffled for the total. The block bounds
    # the task when a row_id holds much of the data. The number of partitions is
    # given because the expansion to pixels, not the input size, is the work.
    df = df.withColumn("_block", F.expr(f"{keys[0]} div {BACK_BLOCK}"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = to_tiles(df, tile, nx).repartition(parts, "row_id", "tile", "_block")
    cells = to_pixels(pairs, tile, ["row_id", "tile", "_block", "cell", "chord * upd AS num", "chord AS den"])
    # lies by (row_id, tile, block) already: these sums need no exchange
    return cells.groupBy("row_id", "tile", "_block", "cell").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def back_project(projected: DataFrame, keys: list[str], tile: int, nx: int | None = None) -> DataFrame:
    """(row_id, tile, cell) with `num`, `den` summed over all rays of `projected`."""
    return _back_sums(projected, keys, tile, nx).groupBy("row_id", "tile", "cell").agg(
        F.sum("num").alias("num"), F.sum("den").alias("den"))


# num/den of a cell; one without a defined quotient does not change.
CHANGE = "nanvl(coalesce(try_divide(num, den), 0D), 0D)"


def sweep(lines: DataFrame, image: DataFrame | None, blank: DataFrame | None,
          keys: list[str], tile: int, nx: int | None = None) -> DataFrame:
    """The image after one sweep over `lines`; `blank` stands in for a first image."""
    projected = forward_project(lines, image, keys, tile, nx)
    parts = int(projected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The one exchange of cells: sums of blocks meet by tile, and both the totals
    # and the arrays are built where they lie. The old image comes to the same
    # places as whole tiles and is one more summand per cell.
    spread = _back_sums(projected, keys, tile, nx).drop("_block").withColumn("val", F.lit(0.0)).repartition(parts, "row_id", "tile")
    tiles = (blank if image is None else image).select("row_id", "tile", "vals").repartition(parts, "row_id", "tile")
    old = image_cells(tiles, ["0D AS num", "0D AS den", "val"])
    summed = spread.unionByName(old).groupBy("row_id", "tile", "cell").agg(
        F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("val").alias("val"))
    return _to_arrays(summed.selectExpr("row_id", "tile", "cell", f"val + {CHANGE} AS val"))
