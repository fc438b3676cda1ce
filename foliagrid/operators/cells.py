"""A regular grid over points, and per-cell indicators in one aggregation."""

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import run_ends

BY = ["group_id", "row", "col"]


def extent(points: DataFrame, resolution: float, aligned: bool = False) -> DataFrame:
    """group_id, x0 (left), y0 (top), width, height of each group's grid, one cell at least.

    aligned moves origins to multiples of the resolution, so that groups lie on one lattice and mosaics need no resampling.
    """
    b = points.groupBy("group_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    x0 = F.floor(F.col("lo_x") / resolution) * resolution if aligned else F.col("lo_x")
    y0 = F.ceil(F.col("hi_y") / resolution) * resolution if aligned else F.col("hi_y")
    size = lambda d: F.greatest(F.lit(1).cast("long"), F.ceil(d / resolution))
    return b.select("group_id", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), size(F.col("hi_x") - x0).alias("width"), size(y0 - F.col("lo_y")).alias("height"))


def with_cells(points: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """points with row (from the top) and col; a point on the far edge belongs to the last cell."""
    place = lambda d, n: F.greatest(F.lit(0).cast("long"), F.least(F.floor(d / resolution), F.col(n) - 1))
    joined = points.join(grid, "group_id")
    return joined.withColumns({"row": place(F.col("y0") - F.col("y"), "height"), "col": place(F.col("x") - F.col("x0"), "width")}).drop("x0", "y0", "width", "height")


def bin_edges(low: float, high: float, step: float) -> list[float]:
    """Edges from low up to, and perhaps past, high: as float steps give them, and not recomputed anywhere else."""
    return [float(v) for v in np.arange(low, high + step, step)]


def in_bin(value: Column, edges: list[float], k: int) -> Column:
    upper = value <= edges[k + 1] if k == len(edges) - 2 else value < edges[k + 1]
    return (value >= edges[k]) & upper


def entropy(counts: list[Column]) -> Column:
    """Natural Shannon entropy of counts; null when there are none."""
    total = sum(counts[1:], counts[0])
    part = sum((F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0)) for n in counts), F.lit(0.0))
    return F.when(total > 0, F.ln(total) - part / total)


def quantile(value: str = "hag", q: float = 100.0) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(value, q / 100)


def indicators(cells: DataFrame, quantiles: dict[str, float], edges: list[float], value: str = "hag") -> DataFrame:
    """n, the quantiles and fhd of every cell: one shuffle, partial sums before it, and no list of a cell's values.

    The heights' histogram has as many counters as bins, so foliage-height diversity needs no second grouping.
    """
    bins = [F.count_if(in_bin(F.col(value), edges, k)).alias(f"__b{k}") for k in range(len(edges) - 1)]
    sums = cells.groupBy(*BY).agg(F.count(value).alias("n"), *[quantile(value, q).alias(name) for name, q in quantiles.items()], *bins)
    fhd = entropy([F.col(f"__b{k}") for k in range(len(edges) - 1)])
    return sums.select(*BY, "n", *quantiles, fhd.alias("fhd"))


#: Named builders of aggregates that a cell's indicator can be asked for by.
REGISTRY: dict[str, Callable[..., Column]] = {
    "quantile": quantile,
    "mean": lambda value="hag": F.avg(value),
    "deviation": lambda value="hag": F.stddev_pop(value),
    "count": lambda value="hag": F.count(value),
}


def cell_indicator(cells: DataFrame, name: str, how: str | Callable, value: str = "hag", **options) -> DataFrame:
    """One value for each cell by a registered aggregate, or by any function of a cell's values (numpy array -> float).

    The second way gathers a cell's values in Python, and a cell must fit a task: rows come sorted by cell, and the function
    is called on parts of the batches' arrays.
    """
    if not callable(how):
        return cells.groupBy(*BY).agg(REGISTRY[how](value=value, **options).alias(name))

    def each(batches):
        own, held = None, []  # the last cell so far: its key as a batch of one row, and its values
        for batch in batches:
            values, keys = np.array(batch.column(value).to_numpy(zero_copy_only=False)), batch.select(BY)
            starts, results, at = [], [], 0
            for end in run_ends(batch, BY):
                if not at and own is not None and own != keys.slice(0, 1):
                    yield result(own, [how(np.concatenate(held), **options)])
                    own, held = None, []
                elif at and own is not None:
                    yield result(own, [how(np.concatenate(held), **options)])
                    own, held = None, []
                if end == batch.num_rows:
                    own, held = own or keys.slice(at, 1), [*held, values[at:]]
                elif own is not None:
                    held.append(values[at:end])
                else:
                    starts.append(at)
                    results.append(how(values[at:end], **options))
                at = end
            if starts:
                yield result(keys.take(pa.array(starts)), results)
        if own is not None:
            yield result(own, [how(np.concatenate(held), **options)])

    def result(keys, found):
        return pa.RecordBatch.from_arrays([*keys.columns, pa.array([float(x) for x in found], pa.float64())], names=[*BY, name])

    rows = cells.select(*BY, value).repartition(*BY).sortWithinPartitions(*BY)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(each, ", ".join([*[f"{c} {kinds[c]}" for c in BY], f"{name} double"]))


def dense(raster: DataFrame, grid: DataFrame) -> DataFrame:
    """Every cell of the grids, with nulls where the raster has no row."""
    rows = grid.select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("row"), "width")
    cells = rows.select("group_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("col"))
    return cells.join(raster, BY, "left")


def trim_edge(raster: DataFrame, grid: DataFrame) -> DataFrame:
    """Without each grid's last row and last column."""
    inside = (F.col("row") < F.col("height") - 1) & (F.col("col") < F.col("width") - 1)
    return raster.join(grid.select("group_id", "width", "height"), "group_id").filter(inside).drop("width", "height")


def fhd_limit(edges: list[float]) -> float:
    return math.log(len(edges) - 1)
