"""The three steps from a configuration: points, indicators, classes; each from tables or files to tables and images."""

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, classify, points, raster, tiles
from ..sources import readers, writers
from . import stages
from .workflow import Status, Step, Workflow


def _read_points(spark: SparkSession, config: dict) -> DataFrame:
    kind, path = config.get("format", "las"), config["input"]
    if kind == "las":
        return readers.read_points(spark, path, config.get("extra"))
    if kind == "npy":
        return readers.read_npy(spark, path, config.get("dimensions"))
    if kind == "table":
        return spark.read.parquet(path)
    raise ValueError(f"no such format of points: {kind}")


def clean_points(spark: SparkSession, config: dict) -> None:
    """Group tiles by their names, run the stage list by tile and by group, and write what isn't done yet."""
    rows = _read_points(spark, config)
    files = tiles.parse_tiles(rows.select("path").distinct(), token=config.get("name_token", 2))
    grouped = tiles.group_tiles(files, config.get("tiles_per_group", 20), config.get("strategy", "adjacent"), config.get("seed", 0))
    named = tiles.group_paths(grouped, files)
    status = Status(spark, f"{config['output']}-status")
    todo = status.remaining(named.select("group_id", "tiles"))
    if todo.isEmpty():
        return
    rows = rows.join(todo.select("group_id", F.explode("tiles").alias("path")), "path").withColumn("id", F.xxhash64("path", "x", "y", "z", F.monotonically_increasing_id()))
    if "area" in config:
        rows = points.crop(rows, readers.read_polygons(spark, config["area"]))
    out = stages.run_two_phase(rows, config.get("stages", []), "path")
    writers.write_points(out, config["output"], config.get("keep"), "append" if config.get("resume", True) else "overwrite")
    writers.record_run(spark, f"{config['output']}-runs", config, todo)
    status.record(todo, "processed")


def indicate(spark: SparkSession, config: dict) -> None:
    """Indicators of all cells as a table, with the grids beside it, and as one image for each group."""
    rows = _read_points(spark, {"format": "table"} | config)
    low, high, step = config.get("heights", (0.0, 2.0, 0.15))
    quantiles = config.get("quantiles", {"q95": 95.0, "q50": 50.0})
    resolution = float(config["resolution"])
    grid = cells.extent(rows, resolution, aligned=True)
    grid.write.mode("overwrite").parquet(f"{config['output']}-grid")
    grid = spark.read.parquet(f"{config['output']}-grid")
    found = cells.indicators(cells.with_cells(rows, grid, resolution), quantiles, cells.bin_edges(low, high, step))
    writers.write_raster(found, config["output"])
    if "images" in config:
        names = [f"CHM_quantile_{q:g}" for q in quantiles.values()] + ["FHD"]
        metadata = {f"{n}_description": f"Canopy height, quantile {q:g}, {resolution:g} m" for n, q in quantiles.items()} | {"FHD_description": f"Foliage height diversity from {low:g} to {high:g} by {step:g}"}
        images = writers.tiff_files(spark.read.parquet(config["output"]), grid, [*quantiles, "fhd"], resolution, nodata=raster.NODATA, names=names, metadata=metadata, epsg=config.get("epsg", 2154))
        writers.write_images(images, config["images"], ".tif")


def _mask(spark: SparkSession, path: str, name: str, left: float, top: float, resolution: float) -> DataFrame:
    """A mask's cells on the lattice whose corner is (left, top)."""
    info = readers.raster_info(spark, os.path.dirname(path), os.path.basename(path)).first()
    if info is None or abs(info.resolution - resolution) > 1e-6:
        raise ValueError(f"{path} must be a raster of resolution {resolution}")
    down, right = round((top - info.y0) / resolution), round((info.x0 - left) / resolution)
    found = readers.read_rasters(spark, os.path.dirname(path), [name], os.path.basename(path))
    return found.select((F.col("row") + down).alias("row"), (F.col("col") + right).alias("col"), F.col(name).cast("int").alias(name))


def classify_cells(spark: SparkSession, config: dict) -> None:
    """Mosaic, masks, classes by rule and by clusters: a table, the names, an image and its side-car."""
    resolution, bands = float(config["resolution"]), config.get("bands", ["q95", "q50", "fhd"])
    found, grid = spark.read.parquet(config["input"]), spark.read.parquet(f"{config['input']}-grid")
    whole = raster.mosaic(raster.nodata_where_zero(found, bands), grid, resolution, bands).drop("group_id")
    box = raster.raster_extent(grid, resolution).first()
    masked = "rock" in config and "shadow" in config
    if masked:
        rock, shadow = (_mask(spark, config[n], n, box.xmin, box.ymax, resolution) for n in ("rock", "shadow"))
        whole = raster.apply_masks(whole, rock.join(shadow, ["row", "col"]), bands)
    options = {"method": config.get("method", "gmm"), "seed": config.get("seed", 42), "max_iter": config.get("max_iter", 200), "tol": config.get("tol", 1e-6)}
    found, ranks = classify.land_cover(whole, config.get("height", "q95"), config.get("features", ["q95", "fhd"]), config.get("k", 4), masked, **options)
    writers.write_raster(found, config["output"])
    ranks.write.mode("overwrite").parquet(f"{config['output']}-names")
    if "images" in config:
        names = classify.NAMES | {r.class_id: r.name for r in spark.read.parquet(f"{config['output']}-names").collect()}
        chosen = {int(c): tuple(rgb) for c, rgb in config.get("colours", {}).items()}
        colours = classify.colours(list(names), chosen, config.get("seed", 42))
        width, height = round((box.xmax - box.xmin) / resolution), round((box.ymax - box.ymin) / resolution)
        one = spark.createDataFrame([("classes", box.xmin, box.ymax, width, height)], "group_id string, x0 double, y0 double, width long, height long")
        cells_of = spark.read.parquet(config["output"]).select(F.lit("classes").alias("group_id"), "row", "col", "class_id")
        writers.write_images(writers.class_files(cells_of, one, resolution, names, colours, config.get("epsg", 2154)), config["images"], ".tif")
        sidecar = bytearray(writers.category_sidecar(names, colours).encode())
        writers.write_images(spark.createDataFrame([("classes", sidecar)], "group_id string, image binary"), config["images"], ".tif.aux.xml")


ACTIONS = {"points": clean_points, "indicators": indicate, "classes": classify_cells}


def in_order(steps: dict[str, dict]) -> list[str]:
    """Names of the steps, each after all that it needs."""
    out: list[str] = []

    def visit(name, above):
        if name in above:
            raise ValueError(f"{name} needs itself")
        if name not in steps:
            raise ValueError(f"{above[-1]} needs {name}, which isn't there")
        if name not in out:
            for need in steps[name].get("needs", []):
                visit(need, (*above, name))
            out.append(name)

    for name in steps:
        visit(name, ())
    return out


def workflow(spark: SparkSession | None, path: str) -> Workflow:
    """The steps of a configuration file. A step says its action (its name, else), needs, enabled, and config: an object, or
    the path of a file beside this one."""
    found = readers.read_config(path)
    steps = []
    for name in in_order(found["steps"]):
        step = found["steps"][name]
        action = step.get("action", name)
        if action not in ACTIONS:
            raise ValueError(f"no such action: {action}")
        config = step.get("config", {})
        if isinstance(config, str):
            config = readers.read_config(os.path.join(os.path.dirname(path), config))
        steps.append(Step(name, ACTIONS[action], tuple(step.get("needs", [])), step.get("enabled", True), config))
    return Workflow(spark, steps, found.get("continue_on_error", False))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m foliagrid", description="Run the steps of a configuration.")
    parser.add_argument("config")
    parser.add_argument("--steps", help="names by commas; all enabled ones else")
    parser.add_argument("--done", default="", help="names by commas of steps that an earlier run did")
    parser.add_argument("--list", action="store_true", help="show the steps and stop")
    given = parser.parse_args(arguments)
    split = lambda text: [x for x in (text or "").split(",") if x]
    if given.list:
        for name, enabled, needs in workflow(None, given.config).listing():
            print(json.dumps({"step": name, "enabled": enabled, "needs": list(needs)}))
        return 0
    from ..session import ship_package

    spark = spark or SparkSession.builder.appName("foliagrid").getOrCreate()
    ship_package(spark)
    flow = workflow(spark, given.config)
    well = flow.run(split(given.steps) or None, set(split(given.done)))
    print(json.dumps({"seconds": {k: round(v, 1) for k, v in flow.seconds.items()}, "errors": flow.errors}))
    return 0 if well else 1
