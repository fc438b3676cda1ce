"""The three steps from points to a vegetation map as plans."""

from pyspark.sql import DataFrame

from ..operators import cells, classify, raster
from . import stages

QUANTILES = {"q95": 95.0, "q50": 50.0}
EDGES = cells.bin_edges(0.0, 2.0, 0.15)


def clean_points(tile_points: DataFrame, stage_list: list[dict]) -> DataFrame:
    return stages.run_two_phase(tile_points, stage_list)


def cell_indicators(points: DataFrame, resolution: float, quantiles: dict[str, float] = QUANTILES, edges: list[float] = EDGES, aligned: bool = False) -> tuple[DataFrame, DataFrame]:
    """(indicators, grid): scan, broadcast of the groups' extents, one shuffle on cells."""
    grid = cells.extent(points, resolution, aligned)
    return cells.indicators(cells.with_cells(points, grid, resolution), quantiles, edges), grid


def vegetation_map(points: DataFrame, masks: DataFrame | None, resolution: float, k: int, method: str = "gmm", height: str = "q95", features: tuple[str, ...] = ("q95", "fhd")) -> tuple[DataFrame, DataFrame]:
    """(cells with class_id, names of the clusters) on one lattice, masked if masks (row, col, rock, shadow) are given."""
    found, grid = cell_indicators(points, resolution, aligned=True)
    bands = [*QUANTILES, "fhd"]
    whole = raster.mosaic(raster.nodata_where_zero(found, bands), grid, resolution, bands)
    whole = raster.apply_masks(whole, masks, bands) if masks is not None else whole
    return classify.land_cover(whole, height, list(features), k, masked=masks is not None, method=method)
