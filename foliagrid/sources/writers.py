"""Writers: point and raster tables, array files, GeoTIFF images with palettes, run records, data of figures."""

import io
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import run_ends
from ..operators.points import keep_columns
from . import las, tiff


def write_points(points: DataFrame, path: str, keep: list[str] | None = None, mode: str = "overwrite") -> None:
    """A point table partitioned by group, with the kept columns that exist."""
    rows = keep_columns(points, ["group_id", *[c for c in keep if c != "group_id"]]) if keep else points
    rows.repartition("group_id").write.mode(mode).partitionBy("group_id").parquet(path)


def write_raster(raster: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A raster table sorted by row and column within partitions, so that windows prune row groups."""
    raster.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode(mode).parquet(path)


def array_files(points: DataFrame, names: dict[str, str]) -> DataFrame:
    """group_id and the image of a structured .npy file with the columns that exist, whole numbers of as many bytes as they
    have here. A group is a task's memory."""
    have = {column: name for name, column in names.items() if column in points.columns}
    kinds = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8"}
    types = {c: kinds.get(kind, "f8") for c, kind in points.dtypes}

    def each(key, rows):
        kind = {c: "f8" if rows[c].isna().any() else types[c] for c in have}
        out = np.zeros(len(rows), [(name, kind[c]) for c, name in have.items()])
        for c, name in have.items():
            out[name] = rows[c].to_numpy()
        image = io.BytesIO()
        np.save(image, out)
        return pd.DataFrame({"group_id": [key[0]], "image": [image.getvalue()]})

    return points.groupBy("group_id").applyInPandas(each, "group_id string, image binary")


#: Points of a LAS file at most, and steps of its scale that its points may be apart.
FILE_POINTS, FILE_STEPS = 250_000, 1 << 30


def las_files(points: DataFrame, extra: dict[str, str] | None = None, scale: float = 0.01, most: int = FILE_POINTS) -> DataFrame:
    """group_id, part and the image of an uncompressed LAS file, with further dimensions (name: column).

    A group is one file if it has `most` points at most and the format's 32-bit steps span it, else a file for each so many
    points of each cube that they span: a file, not a group, is a task's memory. Points are read twice, to be counted first.
    """
    extra = {"HeightAboveGround": "hag"} if extra is None else extra
    names = ["group_id", "x", "y", "z", "intensity", "classification", "return_number", "number_of_returns", *extra.values()]
    rows = keep_columns(points, list(dict.fromkeys(names)))
    cube = F.struct(*[F.floor(F.col(c) / (FILE_STEPS * scale) + 0.5).alias(c) for c in "xyz"])
    rows = rows.withColumn("__key", F.xxhash64("group_id", cube))
    parts = rows.groupBy("__key").agg(F.ceil(F.count(F.lit(1)) * 1.1 / most).alias("__parts"))
    nth = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "__key"]), F.col("__parts"))
    dealt = rows.join(parts, "__key").withColumn("__part", nth).drop("__parts").repartition("__key", "__part").sortWithinPartitions("__key", "__part", "group_id")
    keys = ["group_id", "__key", "__part"]

    def write(batches):
        own, held, n, part = None, [], 0, 0

        def closed():
            nonlocal held, n, part
            whole = pa.Table.from_batches(held)
            image = las.encode({c: whole.column(c).to_numpy() for c in whole.column_names if c not in keys}, scale, extra)
            row = pa.RecordBatch.from_arrays([held[0].column("group_id").slice(0, 1), pa.array([f"{own[1] % (1 << 64):x}-{own[2]}-{part}"]), pa.array([image], pa.binary())], names=["group_id", "part", "image"])
            held, n, part = [], 0, part + 1
            return row

        for batch in batches:
            at = 0
            for end in run_ends(batch, keys):
                now = tuple(batch.column(k)[at].as_py() for k in keys)
                if now != own:
                    if held:
                        yield closed()
                    own, part = now, 0
                while at < end:
                    some = min(end - at, most - n)
                    held.append(batch.slice(at, some))
                    at, n = at + some, n + some
                    if n == most:
                        yield closed()
        if held:
            yield closed()

    return dealt.mapInArrow(write, f"group_id {dict(points.dtypes)['group_id']}, part string, image binary")


def write_images(images: DataFrame, folder: str, end: str) -> None:
    """Each row's image as a file in a folder that driver and executors share: named after its group, or after its part in
    a folder named after its group, if there are parts."""
    where = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    parts = "part" in images.columns

    def put(batches):
        for batch in batches:
            store, path = pyarrow.fs.FileSystem.from_uri(where)
            store.create_dir(path, recursive=True)
            names = [f"{g}{end}" for g in batch.column("group_id").to_pylist()]
            if parts:
                for g in set(batch.column("group_id").to_pylist()):
                    store.create_dir(f"{path}/{g}", recursive=True)
                names = [f"{g}/{p}{end}" for g, p in zip(batch.column("group_id").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            for name, image in zip(names, batch.column("image"), strict=True):
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(image.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    images.select("group_id", *["part"] * parts, "image").mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()


def tiff_files(raster: DataFrame, grid: DataFrame, bands: list[str], resolution: float, nodata: float | None = None, palette: dict | None = None, trim: bool = False, names: list[str] | None = None, metadata: dict[str, str] | None = None, epsg: int = 2154) -> DataFrame:
    """group_id and the image of a GeoTIFF of its bands, with their descriptions and further items of metadata: a grid of a
    group of tiles is a task's memory."""

    def each(key, rows):
        first = rows.iloc[0]
        height, width = int(first["height"]), int(first["width"])
        out = np.full((len(bands), height, width), 0 if palette is not None else np.nan)
        out[:, rows["row"].to_numpy(), rows["col"].to_numpy()] = rows[bands].to_numpy(float).T
        out = out[:, : height - trim, : width - trim]
        if nodata is not None:
            out = np.where(np.isnan(out), nodata, out)
        return pd.DataFrame({"group_id": [key[0]], "image": [tiff.encode(out, first["x0"], first["y0"], resolution, epsg, nodata, palette, ",".join(bands), names or bands, metadata)]})

    rows = raster.select("group_id", "row", "col", *bands).join(grid, "group_id")
    return rows.groupBy("group_id").applyInPandas(each, "group_id string, image binary")


def class_metadata(names: dict[int, str]) -> dict[str, str]:
    """Items of a class image's metadata: what it is, and each class's name."""
    return {"LAYER_TYPE": "classifications", "STATISTICS_APPROXIMATE": "NO"} | {f"Class_{c}": n for c, n in sorted(names.items())}


def class_files(classes: DataFrame, grid: DataFrame, resolution: float, names: dict[int, str], colours: dict[int, tuple[int, int, int]], epsg: int = 2154) -> DataFrame:
    """group_id and the image of a palette GeoTIFF of class_id, with the classes' names."""
    return tiff_files(classes, grid, ["class_id"], resolution, palette=colours, metadata=class_metadata(names), epsg=epsg)


def category_sidecar(names: dict[int, str], colours: dict[int, tuple[int, int, int]]) -> str:
    """The XML that stands beside a class image: names from code 0 to the highest, and a colour table."""
    from xml.sax.saxutils import escape

    top = max(names, default=-1)
    categories = "".join(f"<Category>{escape(names.get(c, ''))}</Category>" for c in range(top + 1))
    rows = "".join(f'<Row index="{i}"><F>{c}</F><F>{escape(names[c])}</F>{"".join(f"<F>{v}</F>" for v in colours.get(c, (0, 0, 0)))}</Row>' for i, c in enumerate(sorted(names)))
    fields = "".join(f'<FieldDefn index="{i}"><Name>{n}</Name><Type>{t}</Type><Usage>{u}</Usage></FieldDefn>' for i, (n, t, u) in enumerate((("Value", 0, 5), ("Class", 2, 2), ("Red", 0, 6), ("Green", 0, 7), ("Blue", 0, 8))))
    return f'<PAMDataset><PAMRasterBand band="1"><CategoryNames>{categories}</CategoryNames><GDALRasterAttributeTable>{fields}{rows}</GDALRasterAttributeTable></PAMRasterBand></PAMDataset>'


def record_run(spark: SparkSession, path: str, config: dict, groups: DataFrame) -> None:
    """Append a run's configuration and the files of its groups to a table, a row for each group."""
    groups.select("group_id", "tiles").withColumns({"config": F.lit(json.dumps(config, sort_keys=True)), "at": F.current_timestamp()}).write.mode("append").parquet(path)


def figure_groups(grouped: DataFrame) -> DataFrame:
    """What a map of tile groups draws: a square and a group number for each tile."""
    return grouped.select("group_no", "row", "col", F.count(F.lit(1)).over(Window.partitionBy("group_no")).alias("group_size"))


def figure_regression(pairs: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """What a regression figure draws: the points and both lines' values there."""
    line = lambda kind: F.col(f"{kind}_slope") * F.col("lx") + F.col(f"{kind}_intercept")
    return pairs.join(fits, by).select(*by, "lx", "ly", line("ols").alias("ols_y"), line("tls").alias("tls_y"))
