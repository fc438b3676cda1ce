"""A list of stage descriptions as one plan over points, and its two-phase form: per tile, then per group."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ground, neighbours, points

#: Dimension names of stage lists as columns here.
COLUMNS = {"X": "x", "Y": "y", "Z": "z", "HeightAboveGround": "hag", "Classification": "classification", "Intensity": "intensity", "NumberOfReturns": "number_of_returns", "ReturnNumber": "return_number"}
#: Stages that need the tiles of a group together.
GROUPED = ("filters.hag_nn", "filters.hag_delaunay", "filters.csf", "filters.merge")


def _range(df, s):
    return points.in_range(df, s["limits"], COLUMNS)


def _expression(df, s):
    return points.where(df, s["expression"], COLUMNS)


def _assign(df, s):
    return points.assign(df, s.get("value") or s["assignment"], COLUMNS)


def _outlier(df, s):
    return neighbours.statistical_outliers(df, s.get("mean_k", 8), s.get("multiplier", 2.0), s.get("side", 1.0), s.get("drop_noise", False)).drop("mean_distance")


def _low(df, s):
    if "threshold" not in s:
        raise ValueError("filters.elm needs a threshold")
    return points.low_outliers(df, s.get("cell", 10.0), s["threshold"], s.get("drop_noise", False))


def _thin(df, s):
    return points.thin(df, s["cell"], ["x", "y", "z"])


def _hag_nn(df, s):
    return neighbours.height_above_nearest_ground(df.drop("hag"), s.get("count", 1), s.get("side", 5.0), max_distance=s.get("max_distance"))


def _hag_tin(df, s):
    return ground.height_above_triangulation(df, s.get("allow_extrapolation", True))


def _cloth(df, s):
    return ground.cloth_filter(df, s.get("resolution", 1.0), s.get("rigidness", 3), s.get("iterations", 500), s.get("threshold", 0.5))


STAGES = {
    "filters.range": _range, "filters.expression": _expression, "filters.assign": _assign, "filters.outlier": _outlier, "filters.elm": _low,
    "filters.voxeldownsize": _thin, "filters.hag_nn": _hag_nn, "filters.hag_delaunay": _hag_tin, "filters.csf": _cloth, "filters.merge": lambda df, s: df,
}


def run_stages(df: DataFrame, stages: list[dict]) -> DataFrame:
    """Points after all stages, in order. Readers and writers in the list are left out: a plan has its own ends."""
    for stage in stages:
        kind = stage["type"]
        if kind.startswith(("readers.", "writers.")):
            continue
        if kind not in STAGES:
            raise ValueError(f"no such stage: {kind}")
        df = STAGES[kind](df, stage)
    return df


def run_two_phase(tile_points: DataFrame, stages: list[dict], tile: str = "tile_id") -> DataFrame:
    """Stages up to the first that needs a whole group run by tile (narrow ones without a shuffle), the rest by group."""
    at = next((i for i, s in enumerate(stages) if s["type"] in GROUPED), len(stages))
    by_tile = run_stages(tile_points.withColumns({"__group": F.col("group_id"), "group_id": F.col(tile)}), stages[:at])
    return run_stages(by_tile.withColumn("group_id", F.col("__group")).drop("__group"), stages[at:])
