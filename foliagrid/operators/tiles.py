"""Tiles: coordinates from names, the occupancy grid, neighbours, groups."""

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import tile_number
from ..scratch import Scratch

#: Neighbours in the order in which a group grows: N, S, W, E, NW, NE, SE, SW as (row, column) steps.
NEIGHBOURS = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, 1), (1, -1))
#: Tiles of a batch of results.
ROWS_AT_ONCE = 10_000


def parse_tiles(files: DataFrame, path: str = "path", token: int = 2) -> DataFrame:
    """files with tile_x and tile_y from the name's tokens; a malformed name loses that file alone."""
    return files.withColumns({"tile_x": tile_number(F.col(path), token), "tile_y": tile_number(F.col(path), token + 1)}).dropna(subset=["tile_x", "tile_y"])


def tile_grid(tiles: DataFrame) -> DataFrame:
    """Distinct tiles with their row (from the least y) and column (from the least x)."""
    once = tiles.select("tile_x", "tile_y").distinct()
    least = once.agg(F.min("tile_x").alias("__x"), F.min("tile_y").alias("__y"))
    return once.join(F.broadcast(least)).select("tile_x", "tile_y", (F.col("tile_y") - F.col("__y")).alias("row"), (F.col("tile_x") - F.col("__x")).alias("col"))


def tile_neighbours(tiles: DataFrame) -> DataFrame:
    """Pairs of adjacent tiles, by an equi-join on the eight steps."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])
    out = tiles.select("tile_x", "tile_y", F.explode(steps).alias("s")).select("tile_x", "tile_y", (F.col("tile_x") + F.col("s.j")).alias("to_x"), (F.col("tile_y") + F.col("s.i")).alias("to_y"))
    there = tiles.select(F.col("tile_x").alias("to_x"), F.col("tile_y").alias("to_y"))
    return out.join(there, ["to_x", "to_y"], "left_semi").select("tile_x", "tile_y", "to_x", "to_y")


def growing_groups(cells: Iterable[tuple[int, int]], n: int) -> Iterator[list[tuple[int, int]]]:
    """Breadth-first groups of distinct (row, col) that come in row-major order; a group stops growing, between expansions,
    at n cells. It reaches n rows below its first cell at most, and only so many rows of cells are held."""
    stream, left, coming = iter(cells), {}, deque()
    ahead = next(stream, None)
    while coming or ahead is not None:
        top = (coming[0] if coming else ahead)[0]
        while ahead is not None and ahead[0] <= top + n:
            left.setdefault(ahead[0], set()).add(ahead[1])
            coming.append(ahead)
            ahead = next(stream, None)
        start = coming.popleft()
        for passed in [i for i in left if i < start[0]]:
            del left[passed]
        if start[1] not in left[start[0]]:
            continue
        left[start[0]].discard(start[1])
        group, queue = [start], deque([start])
        while queue and len(group) < n:
            i, j = queue.popleft()
            for di, dj in NEIGHBOURS:
                if j + dj in left.get(i + di, ()):
                    left[i + di].discard(j + dj)
                    group.append((i + di, j + dj))
                    queue.append((i + di, j + dj))
        yield group


def adjacent_groups(cells: set[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """growing_groups of a set of cells."""
    return list(growing_groups(sorted(cells), n))


def _grown(n: int):
    def grow(batches):
        least = None

        def cells():
            nonlocal least
            for batch in batches:
                rows, cols, x, y = (batch.column(c).to_pylist() for c in ("row", "col", "tile_x", "tile_y"))
                if rows and least is None:
                    least = x[0] - cols[0], y[0] - rows[0]
                yield from zip(rows, cols, strict=True)

        def result(held):
            i, j, g, p = (np.array(c, np.int64) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a) for a in ((j + least[0]).astype(np.int32), (i + least[1]).astype(np.int32), i.astype(np.int32), j.astype(np.int32), g, p)], names=["tile_x", "tile_y", "row", "col", "group_no", "place"])

        held = []
        for g, group in enumerate(growing_groups(cells(), n)):
            held += [(i, j, g, p) for p, (i, j) in enumerate(group)]
            if len(held) >= ROWS_AT_ONCE:
                yield result(held)
                held = []
        if held:
            yield result(held)

    return grow


def group_tiles(tiles: DataFrame, n: int, strategy: str = "adjacent", seed: int = 0) -> DataFrame:
    """tile_x, tile_y, row, col, group_no, place. n = -1: one group; n = 0: one tile each; strategy adjacent or random.

    The adjacent strategy's growth is sequential: one task reads the tiles (not points) in row-major order, and holds n + 1
    rows of them. The distinct tiles are written before, so that names are parsed once.
    """
    grid = tile_grid(tiles)
    if strategy not in ("adjacent", "random"):
        raise ValueError(f"no such strategy: {strategy}")
    if n == -1:
        return grid.withColumns({"group_no": F.lit(0).cast("long"), "place": (F.row_number().over(Window.orderBy("row", "col")) - 1).cast("long")})
    if strategy == "random":
        return spread_groups(grid, n, seed).join(grid, ["tile_x", "tile_y"]).select("tile_x", "tile_y", "row", "col", "group_no", "place")
    grid = tile_grid(Scratch(tiles.sparkSession, "tiles").save(tiles.select("tile_x", "tile_y").distinct(), "tiles"))
    return grid.repartition(1).sortWithinPartitions("row", "col").mapInArrow(_grown(max(1, n)), "tile_x int, tile_y int, row int, col int, group_no long, place long")


def spread_groups(tiles: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """tile_x, tile_y, group_no, place: groups of n tiles in a pseudo-random order without the driver.

    The order is that of a hash, numbered within 4096 buckets by its first digits; only the buckets' counts are summed in
    one place.
    """
    names = ["tile_x", "tile_y"] if seed is None else [F.lit(seed), "tile_x", "tile_y"]
    hashed = tiles.select("tile_x", "tile_y").distinct().withColumn("h", F.sha2(F.concat_ws("_", *names), 256)).withColumn("bucket", F.substring("h", 1, 3))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("bucket").orderBy("h")
    at = F.col("base") + F.row_number().over(order) - 1
    return hashed.join(F.broadcast(base), "bucket").withColumn("at", at).select("tile_x", "tile_y", F.floor(F.col("at") / max(1, n)).alias("group_no"), (F.col("at") % max(1, n)).alias("place"))


def tiles_at(places: DataFrame, grid: DataFrame) -> DataFrame:
    """places (row, col) with tile_x and tile_y of the grid's cell, null where it has no tile."""
    return places.join(grid.select("row", "col", "tile_x", "tile_y"), ["row", "col"], "left")


def coordinates_of(row, col, least_x: int, least_y: int):
    """(tile_x, tile_y) of a cell of a grid that begins at the least coordinates, tiles there or not."""
    return col + least_x, row + least_y


def group_paths(grouped: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """group_no, tiles (paths in place order) and group_id, the first 16 digits of SHA-256 over the joined paths."""
    found = grouped.join(files.select("tile_x", "tile_y", F.col(path).alias("__path")), ["tile_x", "tile_y"])
    paths = F.transform(F.sort_array(F.collect_list(F.struct("place", "__path"))), lambda s: s["__path"])
    return found.groupBy("group_no").agg(paths.alias("tiles")).withColumn("group_id", group_id(F.col("tiles")))


def group_id(tiles):
    return F.substring(F.sha2(F.concat_ws("", tiles), 256), 1, 16)


def not_done(groups: DataFrame, done: DataFrame) -> DataFrame:
    """Groups that the status table doesn't have; none left is no error."""
    return groups.join(done.select("group_id"), "group_id", "left_anti")


class TileIndex:
    """The tiles of a list of files, and what is asked of them: one place for grids, neighbours, groups and coordinates."""

    def __init__(self, files: DataFrame, path: str = "path", token: int = 2):
        self.path, self.tiles = path, parse_tiles(files, path, token)

    def grid(self) -> DataFrame:
        return tile_grid(self.tiles)

    def neighbours(self) -> DataFrame:
        return tile_neighbours(self.tiles)

    def groups(self, n: int, strategy: str = "adjacent", seed: int = 0) -> DataFrame:
        """group_no, tiles and group_id."""
        return group_paths(group_tiles(self.tiles, n, strategy, seed), self.tiles, self.path)

    def at(self, places: DataFrame) -> DataFrame:
        return tiles_at(places, self.grid())
