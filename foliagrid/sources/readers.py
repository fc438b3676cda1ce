"""Readers. Binary files are listed and opened by Spark, so they can be wherever Spark reads."""

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import las, tiff

POINT_SCHEMA = "path string, x double, y double, z double, intensity double, classification int, return_number int, number_of_returns int"
#: Points of a page, and cells of a strip of rows.
PAGE = 100_000


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length and content of the files below a folder whose names match; listing alone reads no content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.las") -> DataFrame:
    return files(spark, folder, pattern).select("path", "length", "modificationTime")


def read_las(spark: SparkSession, folder: str, pattern: str = "*.las", extra: dict[str, str] | None = None, start: int = 0, count: int | None = None) -> DataFrame:
    """Points of all LAS files below a folder, in pages, with their file's path.

    extra names further dimensions and their columns (doubles, null where a file lacks one); start and count choose rows of
    each file. Compressed files are an error that names them. A file is read whole by a task, so 2 GB is its limit.
    """
    extra = extra or {}

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for page in las.pages(content.as_buffer().to_pybytes(), PAGE, start, count, tuple(extra), path):
                    more = {extra[k]: pa.array(page.pop(k), from_pandas=True) for k in extra}
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(page["x"]), **page, **more})

    schema = ", ".join([POINT_SCHEMA, *[f"{c} double" for c in extra.values()]])
    return files(spark, folder, pattern).select("path", "content").mapInArrow(read, schema)


def read_points(spark: SparkSession, folder: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Points of all LAS files below a folder; an error at listing if there are compressed ones, which need a codec."""
    packed = list_files(spark, folder, "*.[lL][aA][zZ]").select("path").head()
    if packed:
        raise ValueError(f"{packed[0]} is compressed, and no codec is here: decompress it first")
    return read_las(spark, folder, "*.[lL][aA][sS]", extra)


#: Names of array dimensions as columns here.
DIMENSIONS = {"X": "x", "Y": "y", "Z": "z", "Intensity": "intensity", "Classification": "classification", "HeightAboveGround": "hag"}


def read_npy(spark: SparkSession, folder: str, names: dict[str, str] | None = None, pattern: str = "*.npy") -> DataFrame:
    """Points of all structured arrays below a folder: path and the named dimensions as doubles, null where a file lacks one."""
    names = names or DIMENSIONS

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = np.load(io.BytesIO(content.as_buffer().to_pybytes()), allow_pickle=False)
                for at in range(0, len(rows), PAGE):
                    some = rows[at : at + PAGE]
                    columns = [pa.array(some[n].astype(np.float64)) if n in (rows.dtype.names or ()) else pa.nulls(len(some), pa.float64()) for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), *columns], names=["path", *names.values()])

    return files(spark, folder, pattern).select("path", "content").mapInArrow(read, ", ".join(["path string", *[f"{c} double" for c in names.values()]]))


def read_survey(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_polygons(spark: SparkSession, path: str) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a GeoJSON file, each a list of rings; multi-polygons give several. An area of interest is a small file."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise FileNotFoundError(path)
    found = json.loads(text[0])
    shapes = [f["geometry"] for f in found["features"]] if found.get("type") == "FeatureCollection" else [found.get("geometry", found)]
    polygons = [p for s in shapes for p in (s["coordinates"] if s["type"] == "MultiPolygon" else [s["coordinates"]])]
    if not polygons:
        raise ValueError(f"no polygon in {path}")
    return [[[(float(x), float(y)) for x, y, *_ in (ring[:-1] if ring[0] == ring[-1] else ring)] for ring in polygon] for polygon in polygons]


def read_config(path: str) -> dict:
    with open(path) as text:
        return json.load(text)


def read_raster_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a raster table in half-open ranges; comparisons reach the row groups."""
    return spark.read.parquet(path).filter(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1))


RASTER_INFO = "path string, width int, height int, count int, x0 double, y0 double, resolution double, epsg int, nodata double, dtype string, names array<string>, metadata map<string,string>"


def raster_info(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """What the headers of all GeoTIFF files below a folder say, a row for each: size, place, projection, bands."""

    def read(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                i = tiff.Image(content.as_buffer().to_pybytes())
                rows.append((path, i.width, i.height, i.count, i.x0, i.y0, i.resolution, i.epsg, i.nodata, i.dtype.newbyteorder("=").name, i.names, list(i.metadata.items())))
            types = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 3, pa.int32(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in RASTER_INFO.split(", ")])

    return files(spark, folder, pattern).select("path", "content").mapInArrow(read, RASTER_INFO)


def read_rasters(spark: SparkSession, folder: str, bands: list[str], pattern: str = "*.tif*", rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Cells of all GeoTIFF files below a folder: path, row, col and the first bands under the given names, as doubles.

    Only the blocks that half-open ranges of rows and columns meet are decoded. Values that are NaN or the file's nodata are
    null, and cells without any value have no row. A file is a task's memory, its cells a strip of rows at a time.
    """

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                image = tiff.Image(content.as_buffer().to_pybytes())
                if image.count < len(bands):
                    raise ValueError(f"{path} has {image.count} bands, not {len(bands)}")
                top, bottom = (0, image.height) if rows is None else (max(0, rows[0]), min(image.height, rows[1]))
                left = 0 if cols is None else max(0, cols[0])
                step = max(1, PAGE // max(1, image.width))
                for at in range(top, bottom, step):
                    values = image.window((at, min(bottom, at + step)), cols)[: len(bands)].astype(float)
                    if image.nodata is not None:
                        values[values == image.nodata] = np.nan
                    i, j = np.nonzero(~np.isnan(values).all(axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(i), pa.string()), pa.array(i + at), pa.array(j + left), *[pa.array(v[i, j], from_pandas=True) for v in values]], names=["path", "row", "col", *bands])

    schema = ", ".join(["path string, row long, col long", *[f"{b} double" for b in bands]])
    return files(spark, folder, pattern).select("path", "content").mapInArrow(read, schema)
