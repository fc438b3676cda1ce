"""The queries of the library over the driver's tables, each with the SQL that says the same.

Points are line items: group by return flag, x from the part, y from the supplier, heights from the price. A second set
of points, for neighbours, are the embeddings' first numbers. Other roles are noted where they are read.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import lambert_xy
from ..operators import cells, classify, ground, neighbours, points, raster, survey, tiles
from ..scratch import Scratch
from ..sources import readers, writers
from . import stages, vegetation

RESOLUTION = 200.0
EDGES = vegetation.EDGES
_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_points(spark, sf_dir) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("group_id"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), c("l_partkey").cast("double").alias("x"), (c("l_suppkey").cast("double") * 20).alias("y"),
        (c("l_extendedprice") / 100).alias("z"), (c("l_extendedprice") / 50000).alias("hag"), c("l_linenumber").cast("long").alias("classification"), c("l_quantity").alias("intensity"),
    )


P = """pts AS (SELECT l_returnflag AS group_id, (l_orderkey * 8 + l_linenumber)::BIGINT AS id, l_partkey::DOUBLE AS x, l_suppkey::DOUBLE * 20 AS y,
  l_extendedprice / 100 AS z, l_extendedprice / 50000 AS hag, l_linenumber::BIGINT AS classification, l_quantity AS intensity FROM lineitem)"""
G = f"""{P}, grid AS (SELECT group_id, min(x) AS x0, max(y) AS y0, greatest(1, ceil((max(x) - min(x)) / {RESOLUTION}))::BIGINT AS width,
  greatest(1, ceil((max(y) - min(y)) / {RESOLUTION}))::BIGINT AS height FROM pts GROUP BY group_id),
cel AS (SELECT pts.*, greatest(0, least(floor((y0 - y) / {RESOLUTION})::BIGINT, height - 1)) AS "row", greatest(0, least(floor((x - x0) / {RESOLUTION})::BIGINT, width - 1)) AS col FROM pts JOIN grid USING (group_id))"""
_BIN = " ".join(f"WHEN hag >= {a!r} AND hag <{'=' if k == len(EDGES) - 2 else ''} {b!r} THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))
I = f"""{G}, bins AS (SELECT group_id, "row", col, CASE {_BIN} END AS b, count(*) AS n FROM cel GROUP BY ALL),
fhds AS (SELECT group_id, "row", col, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS fhd FROM bins WHERE b IS NOT NULL GROUP BY ALL),
ind AS (SELECT group_id, "row", col, count(hag) AS n, quantile_cont(hag, 0.95) AS q95, quantile_cont(hag, 0.5) AS q50 FROM cel GROUP BY ALL),
ras AS (SELECT ind.*, fhd FROM ind LEFT JOIN fhds USING (group_id, "row", col))"""  # noqa: E741


def gridded(spark, sf_dir):
    p = line_points(spark, sf_dir)
    grid = cells.extent(p, RESOLUTION)
    return cells.with_cells(p, grid, RESOLUTION), grid


def line_raster(spark, sf_dir):
    return vegetation.cell_indicators(line_points(spark, sf_dir), RESOLUTION)[0]


def r8(*names):
    return [F.round(n, 8).alias(n) for n in names]


def s8(*names):
    return ", ".join(f"round({n}, 8) AS {n}" for n in names)


@query(f'WITH {I} SELECT group_id, "row", col, n, {s8("q95", "q50", "fhd")} FROM ras')
def cell_indicators(spark, sf_dir):
    return line_raster(spark, sf_dir).select("group_id", "row", "col", "n", *r8("q95", "q50", "fhd"))


@query(f'WITH {G} SELECT group_id, "row", col, round(quantile_cont(hag, 0.95), 8) AS chm FROM cel GROUP BY ALL')
def chm_quantiles(spark, sf_dir):
    return cells.cell_indicator(gridded(spark, sf_dir)[0], "chm", "quantile", q=95.0).select("group_id", "row", "col", *r8("chm"))


@query(f'WITH {G} SELECT group_id, "row", col, max(hag) AS chm FROM cel GROUP BY ALL')
def chm_maximum(spark, sf_dir):
    return cells.cell_indicator(gridded(spark, sf_dir)[0], "chm", "quantile")


@query(f'WITH {I} SELECT group_id, "row", col, {s8("fhd")} FROM ras')
def fhd_entropy(spark, sf_dir):
    return cells.indicators(gridded(spark, sf_dir)[0], {}, EDGES).select("group_id", "row", "col", *r8("fhd"))


@query(f'WITH {G} SELECT group_id, "row", col, round(max(hag) - min(hag), 8) AS spread FROM cel GROUP BY ALL')
def cell_function(spark, sf_dir):
    """Any function of a cell's values, given as Python."""
    return cells.cell_indicator(gridded(spark, sf_dir)[0], "spread", lambda v: v.max() - v.min()).select("group_id", "row", "col", *r8("spread"))


@query(f"WITH {G} SELECT * FROM grid")
def grid_extent(spark, sf_dir):
    return gridded(spark, sf_dir)[1]


@query(f"WITH {G} SELECT group_id, id, \"row\", col FROM cel")
def grid_cells(spark, sf_dir):
    return gridded(spark, sf_dir)[0].select("group_id", "id", "row", "col")


@query(f'WITH {I} SELECT g.group_id, r."row", c.col, {s8("q95")} FROM grid g, unnest(range(height)) r("row"), unnest(range(width)) c(col) LEFT JOIN ras ON ras.group_id = g.group_id AND ras."row" = r."row" AND ras.col = c.col')
def dense_raster(spark, sf_dir):
    found, grid = vegetation.cell_indicators(line_points(spark, sf_dir), RESOLUTION)
    return cells.dense(found, grid).select("group_id", "row", "col", *r8("q95"))


@query(f'WITH {I} SELECT group_id, "row", col, {s8("q95")} FROM ras JOIN grid USING (group_id) WHERE "row" < height - 1 AND col < width - 1')
def trimmed_raster(spark, sf_dir):
    found, grid = vegetation.cell_indicators(line_points(spark, sf_dir), RESOLUTION)
    return cells.trim_edge(found, grid).select("group_id", "row", "col", *r8("q95"))


@query(f"WITH {P} SELECT id, x, y, hag FROM pts")
def column_pruning(spark, sf_dir):
    return points.keep_columns(line_points(spark, sf_dir), ["id", "x", "y", "hag", "no_such_column"])


@query(f"WITH {P} SELECT * FROM pts WHERE z BETWEEN 200 AND 600")
def altitude_range(spark, sf_dir):
    return points.in_range(line_points(spark, sf_dir), "Z[200:600]", stages.COLUMNS)


@query(f"WITH {P} SELECT * FROM pts WHERE hag BETWEEN 0.5 AND 1.5")
def hag_range_filter(spark, sf_dir):
    return points.in_range(line_points(spark, sf_dir), "HeightAboveGround[0.5:1.5]", stages.COLUMNS)


@query(f"WITH {P} SELECT * FROM pts WHERE classification = 2")
def ground_class(spark, sf_dir):
    return points.in_range(line_points(spark, sf_dir), "Classification[2:2]", stages.COLUMNS)


@query(f"WITH {P} SELECT * FROM pts WHERE classification >= 2 AND classification <= 5")
def class_expression(spark, sf_dir):
    return points.where(line_points(spark, sf_dir), "((Classification >= 2) && (Classification <= 5))", stages.COLUMNS)


@query(f"WITH {P} SELECT *, 1::INTEGER AS number_of_returns, 1::INTEGER AS return_number FROM pts")
def assign_returns(spark, sf_dir):
    return points.assign(line_points(spark, sf_dir), ["NumberOfReturns = 1", "ReturnNumber = 1"], stages.COLUMNS)


@query(f"WITH {P} SELECT * REPLACE (CASE WHEN classification BETWEEN 3 AND 5 THEN 0 ELSE classification END AS classification) FROM pts")
def assign_in_range(spark, sf_dir):
    return points.assign(line_points(spark, sf_dir), "Classification[3:5]=0", stages.COLUMNS)


@query(f"WITH {P} SELECT * FROM pts WHERE classification = 1 UNION ALL SELECT * REPLACE (NULL::DOUBLE AS intensity) FROM pts WHERE classification = 2")
def merge_views(spark, sf_dir):
    p = line_points(spark, sf_dir)
    return points.merge([p.filter("classification = 1"), p.filter("classification = 2").drop("intensity")])


@query(f"WITH {P} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 100), floor(y / 100), floor(z / 100) ORDER BY x, y, z, id) AS k FROM pts) WHERE k = 1")
def voxel_thin(spark, sf_dir):
    return points.thin(line_points(spark, sf_dir), 100.0, ["x", "y", "z", "id"])


AREA = [[(100.0, 100.0), (900.0, 200.0), (700.0, 1500.0), (300.0, 1100.0)], [(400.0, 400.0), (600.0, 400.0), (600.0, 700.0), (400.0, 700.0)]]


def _inside_sql(rings):
    edges = [(a, b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if a[1] != b[1]]
    return "(" + " + ".join(f"(CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < {b[0] - a[0]} * (y - {a[1]}) / {b[1] - a[1]} + {a[0]} THEN 1 ELSE 0 END)" for a, b in edges) + ") % 2 = 1"


@query(f"WITH {P} SELECT id, x, y FROM pts WHERE {_inside_sql(AREA)}")
def polygon_crop(spark, sf_dir):
    """Points in a polygon with a hole."""
    return points.crop(line_points(spark, sf_dir), [AREA]).select("id", "x", "y")


@query(f"WITH {P} SELECT id, x, y FROM pts WHERE {_inside_sql(AREA[:1])} AND x >= 200 AND x < 600.5 AND y > 210 AND y < 990")
def tile_polygon_crop(spark, sf_dir):
    return points.crop_to_tile(line_points(spark, sf_dir), [AREA[:1]], (200.0, 210.0, 600.5, 990.0)).select("id", "x", "y")


@query("SELECT c_name AS name, c_custkey AS id FROM customer WHERE contains(c_name, '1') AND contains(c_name, '7') ORDER BY c_name LIMIT 1")
def tile_lookup(spark, sf_dir):
    return points.tiles_named(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")), "1", "7")


@query(f"""WITH {P}, up AS (SELECT *, floor(x / 100) AS cx, floor(y / 100) AS cy FROM pts),
g AS (SELECT *, lead(z) OVER w - z AS gap, row_number() OVER w AS k, count(*) OVER (PARTITION BY group_id, cx, cy) AS n FROM up WINDOW w AS (PARTITION BY group_id, cx, cy ORDER BY z)),
f AS (SELECT *, max(CASE WHEN gap > 40 AND 2 * k <= n THEN k END) OVER (PARTITION BY group_id, cx, cy) AS lastk FROM g)
SELECT id, (CASE WHEN k <= coalesce(lastk, 0) THEN 7 ELSE classification END)::BIGINT AS classification FROM f""")
def elm_flags(spark, sf_dir):
    return points.low_outliers(line_points(spark, sf_dir), 100.0, 40.0).select("id", "classification")


def line_tiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("in/uncompress_A_B_"), F.floor(F.col("l_partkey") / 100), F.lit("_"), F.floor(F.col("l_suppkey") / 10), F.lit("_C.las")).alias("path"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


T = "tl AS (SELECT DISTINCT l_partkey // 100 AS tile_x, l_suppkey // 10 AS tile_y FROM lineitem)"


@query("SELECT DISTINCT 'in/uncompress_A_B_' || l_partkey // 100 || '_' || l_suppkey // 10 || '_C.las' AS path, (l_partkey // 100)::INTEGER AS tile_x, (l_suppkey // 10)::INTEGER AS tile_y FROM lineitem")
def parse_tile_names(spark, sf_dir):
    return tiles.parse_tiles(line_tiles(spark, sf_dir).select("path").distinct())


def tile_table(spark, sf_dir):
    return tiles.parse_tiles(line_tiles(spark, sf_dir).select("path").distinct())


@query(f'WITH {T} SELECT tile_x::INTEGER AS tile_x, tile_y::INTEGER AS tile_y, (tile_y - min(tile_y) OVER ())::INTEGER AS "row", (tile_x - min(tile_x) OVER ())::INTEGER AS col FROM tl')
def tile_grid_index(spark, sf_dir):
    return tiles.tile_grid(tile_table(spark, sf_dir))


@query(f"WITH {T} SELECT a.tile_x::INTEGER AS tile_x, a.tile_y::INTEGER AS tile_y, b.tile_x::INTEGER AS to_x, b.tile_y::INTEGER AS to_y FROM tl a JOIN tl b ON abs(a.tile_x - b.tile_x) <= 1 AND abs(a.tile_y - b.tile_y) <= 1 AND NOT (a.tile_x = b.tile_x AND a.tile_y = b.tile_y)")
def tile_neighbours(spark, sf_dir):
    return tiles.tile_neighbours(tile_table(spark, sf_dir))


@query(f"WITH {T} SELECT tile_x::INTEGER AS tile_x, tile_y::INTEGER AS tile_y, 0::BIGINT AS group_no FROM tl")
def group_all(spark, sf_dir):
    return tiles.group_tiles(tile_table(spark, sf_dir), -1).select("tile_x", "tile_y", "group_no")


@query()
def group_adjacent(spark, sf_dir):
    return tiles.group_tiles(tile_table(spark, sf_dir), 20)


@query(f"""WITH {T}, o AS (SELECT *, row_number() OVER (ORDER BY sha256('7_' || tile_x || '_' || tile_y)) - 1 AS nth FROM tl)
SELECT tile_x::INTEGER AS tile_x, tile_y::INTEGER AS tile_y, (tile_y - min(tile_y) OVER ())::INTEGER AS "row", (tile_x - min(tile_x) OVER ())::INTEGER AS col, (nth // 20)::BIGINT AS group_no, (nth % 20)::BIGINT AS place FROM o""")
def group_random(spark, sf_dir):
    return tiles.group_tiles(tile_table(spark, sf_dir), 20, "random", seed=7)


@query(f"WITH {T} SELECT tile_x::INTEGER AS tile_x, tile_y::INTEGER AS tile_y, ((row_number() OVER (ORDER BY sha256(tile_x || '_' || tile_y)) - 1) // 20)::BIGINT AS group_no FROM tl")
def group_random_hash(spark, sf_dir):
    return tiles.spread_groups(tile_table(spark, sf_dir), 20).drop("place")


@query(f"""WITH {T}, o AS (SELECT tile_x AS group_no, tile_y, 'in/uncompress_A_B_' || tile_x || '_' || tile_y || '_C.las' AS path FROM tl)
SELECT group_no::BIGINT AS group_no, substr(sha256(string_agg(path, '' ORDER BY tile_y)), 1, 16) AS group_id, count(*)::BIGINT AS n FROM o GROUP BY group_no""")
def group_id_sha(spark, sf_dir):
    t = tile_table(spark, sf_dir)
    grouped = t.select("tile_x", "tile_y", F.col("tile_x").cast("long").alias("group_no"), F.col("tile_y").cast("long").alias("place"))
    return tiles.group_paths(grouped, t).select("group_no", "group_id", F.size("tiles").cast("long").alias("n"))


@query("SELECT DISTINCT l_suppkey::VARCHAR AS group_id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def resume_anti(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("group_id")).distinct()
    return tiles.not_done(groups, table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("group_id")))


M = f"""{P}, grid AS (SELECT group_id, floor(min(x) / {RESOLUTION}) * {RESOLUTION} AS x0, ceil(max(y) / {RESOLUTION}) * {RESOLUTION} AS y0, min(y) AS ly, max(x) AS hx FROM pts GROUP BY group_id),
cel AS (SELECT pts.*, least(floor((y0 - y) / {RESOLUTION}), greatest(1, ceil((y0 - ly) / {RESOLUTION})) - 1)::BIGINT AS r0, least(floor((x - x0) / {RESOLUTION}), greatest(1, ceil((hx - x0) / {RESOLUTION})) - 1)::BIGINT AS c0, x0, y0 FROM pts JOIN grid USING (group_id)),
mo AS (SELECT group_id, (r0 + round(((SELECT max(y0) FROM grid) - y0) / {RESOLUTION}))::BIGINT AS "row", (c0 + round((x0 - (SELECT min(x0) FROM grid)) / {RESOLUTION}))::BIGINT AS col, quantile_cont(hag, 0.95) AS q95, quantile_cont(hag, 0.5) AS q50 FROM cel GROUP BY ALL),
mosaic AS (SELECT "row", col, arg_min(q95, group_id) FILTER (q95 IS NOT NULL AND q95 <> -999) AS q95, arg_min(q50, group_id) FILTER (q50 IS NOT NULL AND q50 <> -999) AS q50, min(group_id) AS group_id FROM mo GROUP BY ALL)"""


def line_mosaic(spark, sf_dir):
    found, grid = vegetation.cell_indicators(line_points(spark, sf_dir), RESOLUTION, aligned=True)
    return raster.mosaic(found, grid, RESOLUTION, ["q95", "q50", "fhd"])


@query(f'WITH {M} SELECT "row", col, group_id, {s8("q95", "q50")} FROM mosaic')
def mosaic_first(spark, sf_dir):
    return line_mosaic(spark, sf_dir).select("row", "col", "group_id", *r8("q95", "q50"))


def masks_of(mosaic):
    rc = F.col("row") + F.col("col")
    return mosaic.select("row", "col", F.when(rc % 7 == 0, 1).otherwise(0).alias("rock"), F.when(rc % 5 == 0, 0).otherwise(1).alias("shadow"))


MASKED = f"""{M}, msk AS (SELECT *, CASE WHEN ("row" + col) % 5 = 0 THEN 'shadow' WHEN ("row" + col) % 7 = 0 THEN 'rock' END AS mask_state FROM mosaic),
mv AS (SELECT "row", col, mask_state, CASE mask_state WHEN 'shadow' THEN -89.0 WHEN 'rock' THEN -99.0 ELSE q95 END AS q95 FROM msk)"""


def masked(spark, sf_dir):
    m = line_mosaic(spark, sf_dir)
    return raster.apply_masks(m, masks_of(m), ["q95", "q50", "fhd"])


@query(f'WITH {MASKED} SELECT "row", col, mask_state, {s8("q95")} FROM mv')
def mask_overlay(spark, sf_dir):
    return masked(spark, sf_dir).select("row", "col", "mask_state", *r8("q95"))


RULED = "CASE WHEN q95 IS NULL OR isnan(q95) OR q95 = -999 THEN 128 WHEN q95 = -99 THEN 0 WHEN q95 = -89 THEN 1 WHEN q95 > 2 THEN 2 END::BIGINT"


@query(f'WITH {MASKED} SELECT "row", col, {RULED} AS class_id FROM mv')
def rule_classes(spark, sf_dir):
    return classify.classified(masked(spark, sf_dir), "q95").select("row", "col", "class_id")


@query(f'WITH {M} SELECT "row", col, CASE WHEN q95 > 2 THEN 2 END::BIGINT AS class_id FROM mosaic')
def rule_classes_unmasked(spark, sf_dir):
    return classify.classified(line_mosaic(spark, sf_dir), "q95", masked=False).select("row", "col", "class_id")


@query(f"WITH {MASKED}, c AS (SELECT {RULED} AS class_id, count(*) AS n FROM mv GROUP BY 1) SELECT class_id, n, round(n * 100 / (sum(n) OVER ())::DOUBLE, 8) AS percent FROM c")
def class_stats(spark, sf_dir):
    return classify.class_statistics(classify.classified(masked(spark, sf_dir), "q95")).select("class_id", "n", *r8("percent"))


@query(f"""WITH {I}, l AS (SELECT (("row" * 3 + col) % 4)::BIGINT AS raw_label, round(q95, 8) AS q95, round(q50, 8) AS q50 FROM ras WHERE q95 <= 2),
s AS (SELECT raw_label, avg(q95) AS h, avg(q50) AS d, count(*) AS n FROM l GROUP BY 1), k AS (SELECT *, (row_number() OVER (ORDER BY h, raw_label) - 1)::BIGINT AS rank FROM s)
SELECT raw_label, rank, rank + 3 AS class_id, printf('cluster %d H=%.2fm D=%.2f N=%d', rank + 1, h, d, n) AS name FROM k""")
def cluster_rank_names(spark, sf_dir):
    low = line_raster(spark, sf_dir).filter("q95 <= 2").select(((F.col("row") * 3 + F.col("col")) % 4).alias("raw_label"), *r8("q95", "q50"))
    return classify.rank_clusters(low, "q95", "q50")


CENTROIDS = [[0.5, 0.2], [1.0, 1.0], [1.8, 0.9], [1.9, 1.3]]


@query(f"""WITH {I}, d AS (SELECT group_id, "row", col, [{', '.join(f"pow(q95 - {a}, 2) + pow(q50 - {b}, 2)" for a, b in CENTROIDS)}] AS d FROM ras)
SELECT group_id, "row", col, (list_position(d, list_min(d)) - 1)::BIGINT AS raw_label FROM d""")
def nearest_centroid(spark, sf_dir):
    return classify.nearest_centroid(line_raster(spark, sf_dir), ["q95", "q50"], CENTROIDS).select("group_id", "row", "col", "raw_label")


@query(f"""WITH {MASKED} SELECT "row", col, c.class_id, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b FROM (SELECT "row", col, {RULED} AS class_id FROM mv) c
LEFT JOIN (VALUES (0, 128, 128, 128), (1, 0, 0, 0), (2, 0, 100, 0), (128, 255, 255, 255)) k(class_id, r, g, b) ON c.class_id = k.class_id""")
def class_colours(spark, sf_dir):
    chosen = {0: (128, 128, 128), 1: (0, 0, 0), 2: (0, 100, 0), 128: (255, 255, 255)}
    return classify.with_colours(classify.classified(masked(spark, sf_dir), "q95").select("row", "col", "class_id"), classify.colours([0, 1, 2, 128], chosen))


def _clustered(spark, sf_dir, method, **options):
    """Low cells with the classes of their clusters. Cells are written once, and again with their labels: a fit and the
    ranks read them many times."""
    scratch = Scratch(spark, "clusters")
    low = scratch.save(line_raster(spark, sf_dir).filter("q95 <= 2").dropna(), "low")
    labelled = scratch.save(classify.fit_clusters(low, ["q95", "fhd"], 4, method, **options), "labelled")
    scratch.drop("low")
    return classify.relabel(labelled, classify.rank_clusters(labelled, "q95", "fhd")).select("group_id", "row", "col", "raw_label", "class_id")


@query()
def kmeans_fit(spark, sf_dir):
    return _clustered(spark, sf_dir, "kmeans")


@query()
def gmm_fit(spark, sf_dir):
    return _clustered(spark, sf_dir, "gmm", max_iter=60)


@query()
def vegetation_map(spark, sf_dir):
    m = line_mosaic(spark, sf_dir)
    return vegetation.vegetation_map(line_points(spark, sf_dir), masks_of(m), RESOLUTION, 4, method="kmeans")[0].select("row", "col", "mask_state", "raw_label", "class_id")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, (l_linenumber % 2)::DOUBLE AS b0, (l_suppkey % 2)::DOUBLE AS b1, (l_partkey % 2)::DOUBLE AS b2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN b0 = 0 AND b1 = 0 AND b2 = 0 THEN -999 ELSE b0 END::DOUBLE AS b0, CASE WHEN b0 = 0 AND b1 = 0 AND b2 = 0 THEN -999 ELSE b1 END::DOUBLE AS b1, CASE WHEN b0 = 0 AND b1 = 0 AND b2 = 0 THEN -999 ELSE b2 END::DOUBLE AS b2 FROM b""")
def zero_to_nodata(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 2).cast("double").alias("b0"), (F.col("l_suppkey") % 2).cast("double").alias("b1"), (F.col("l_partkey") % 2).cast("double").alias("b2"))
    return raster.nodata_where_zero(b, ["b0", "b1", "b2"])


@query(f'WITH {I} SELECT group_id, "row", col, {s8("q95", "fhd")} FROM ras')
def band_selection(spark, sf_dir):
    return line_raster(spark, sf_dir).select("group_id", "row", "col", *r8("q95", "fhd"))


@query(f'WITH {M} SELECT "row", col, {s8("q95")} FROM mosaic WHERE "row" >= 2 AND "row" < 7 AND col >= 1 AND col < 6')
def window_read(spark, sf_dir):
    return raster.window(line_mosaic(spark, sf_dir), (2, 7), (1, 6)).select("row", "col", *r8("q95"))


@query(f"""WITH {I}, a AS (SELECT "row", col, round(q95, 8) AS a95 FROM ras WHERE group_id = 'A'), r AS (SELECT "row", col, round(q95, 8) AS r95 FROM ras WHERE group_id = 'R' AND q95 > 2)
SELECT coalesce(a."row", r."row") AS "row", coalesce(a.col, r.col) AS col, a95, r95 FROM a FULL JOIN r ON a."row" = r."row" AND a.col = r.col""")
def stack_bands(spark, sf_dir):
    found = line_raster(spark, sf_dir)
    a = found.filter("group_id = 'A'").select("row", "col", F.round("q95", 8).alias("a95"))
    r = found.filter("group_id = 'R' and q95 > 2").select("row", "col", F.round("q95", 8).alias("r95"))
    return raster.stack(a, r)


@query(f"WITH {G} SELECT max(x0) AS xmin, min(x0 + width * {RESOLUTION}) AS xmax, max(y0 - height * {RESOLUTION}) AS ymin, min(y0) AS ymax FROM grid")
def extent_intersection(spark, sf_dir):
    return raster.common_extent(gridded(spark, sf_dir)[1], RESOLUTION)


@query(f"WITH {G} SELECT min(x0) AS xmin, max(x0 + width * {RESOLUTION}) AS xmax, min(y0 - height * {RESOLUTION}) AS ymin, max(y0) AS ymax FROM grid")
def raster_extent(spark, sf_dir):
    return raster.raster_extent(gridded(spark, sf_dir)[1], RESOLUTION)


@query("SELECT DISTINCT event_type AS file FROM events WHERE value > 400")
def files_with_nodata(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.when(F.col("value") > 400, raster.NODATA).otherwise(F.col("value")).alias("b0"), F.col("value").alias("b1"))
    return raster.files_with_nodata(rows, "b0", "b1")


@query(f"WITH {I} SELECT group_id, {s8('mean', 'deviation', 'least', 'greatest')} FROM (SELECT group_id, avg(q95) AS mean, stddev_pop(q95) AS deviation, min(q95) AS least, max(q95) AS greatest FROM ras WHERE q95 > -999 GROUP BY group_id)")
def band_stats(spark, sf_dir):
    return raster.band_statistics(line_raster(spark, sf_dir), ["group_id"], "q95").select("group_id", *r8("mean", "deviation", "least", "greatest"))


def _band_sql(column, low, step, count):
    return f"CASE WHEN {column} >= {low} THEN least(floor(({column} - {low}) / {step}), {count - 1})::BIGINT END"


def _share_sql(bands):
    """By definition: of the cells with the same other bands that are in any altitude band, the share that is predicted."""
    cols = ", ".join(f"{_band_sql(*b)} AS {n}" for n, b in bands.items())
    names = ", ".join(bands)
    some = " AND ".join(f"{n} IS NOT NULL" for n in bands)
    same = " AND ".join(["t.altitude IS NOT NULL", *[f"t.{n} = b.{n}" for n in bands if n != "altitude"]])
    return f"""WITH {P}, k AS (SELECT {cols}, CASE WHEN hag > 1 THEN 1 ELSE 0 END AS p FROM pts), b AS (SELECT {names}, sum(p) AS s FROM k WHERE {some} GROUP BY {names})
SELECT {names}, round(s::DOUBLE * 100 / (SELECT count(*) FROM k t WHERE {same}), 8) AS percent FROM b"""


ALTITUDE = {"altitude": ("z", 200.0, 100.0, 6)}
ASPECT = {"aspect": ("intensity", 0.0, 10.0, 4)}
SLOPE = {"slope": ("x", 0.0, 500.0, 3)}


def _shares(spark, sf_dir, bands):
    rows = line_points(spark, sf_dir).withColumn("p", F.when(F.col("hag") > 1, 1).otherwise(0))
    return raster.share_by_band(rows, "p", bands, "altitude").select(*bands, *r8("percent"))


@query(_share_sql(ALTITUDE))
def altitude_hist(spark, sf_dir):
    return _shares(spark, sf_dir, ALTITUDE)


@query(_share_sql(ASPECT | ALTITUDE))
def aspect_alt_hist(spark, sf_dir):
    return _shares(spark, sf_dir, ASPECT | ALTITUDE)


@query(_share_sql(ASPECT | ALTITUDE | SLOPE))
def slope_aspect_alt_hist(spark, sf_dir):
    return _shares(spark, sf_dir, ASPECT | ALTITUDE | SLOPE)


@query("SELECT p_brand AS kind, (count(DISTINCT (p_size, p_type)) = 1)::BIGINT AS same FROM part GROUP BY p_brand")
def raster_compatibility(spark, sf_dir):
    return raster.compatible(table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_size").alias("resolution"), F.col("p_type").alias("crs")), ["kind"])


@query(f'WITH {M} SELECT "row" // 2 AS "row", col // 2 AS col, round(arg_min(q95, "row" * 100000 + col), 8) AS q95 FROM mosaic GROUP BY ALL')
def resample_nearest(spark, sf_dir):
    return raster.coarser(line_mosaic(spark, sf_dir), 2, ["q95"]).select("row", "col", *r8("q95"))


@query(f'WITH {M} SELECT "row" // 2 AS "row", col // 2 AS col, round(avg(round(q95, 8)), 11) AS q95 FROM mosaic GROUP BY ALL')
def resample_mean(spark, sf_dir):
    return raster.coarser(line_mosaic(spark, sf_dir).withColumn("q95", F.round("q95", 8)), 2, ["q95"], "mean").select("row", "col", F.round("q95", 11).alias("q95"))


def places(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 12).alias("row"), F.floor(F.col("c_custkey") / 12).alias("c")).select("id", "row", (F.col("c") % 12).alias("col"))


PL = 'pl AS (SELECT c_custkey AS id, c_custkey % 12 AS "row", c_custkey // 12 % 12 AS col FROM customer)'


def _window_sql(size, diagonal):
    low = -(size // 2)
    some = f"(i = j OR i + j = {size - 1})" if diagonal else "true"
    return f"""WITH {M}, {PL}, rs AS (SELECT "row", col, round(q95, 6) AS v FROM mosaic),
w AS (SELECT id, i, j, v FROM pl, unnest(range({size})) a(i), unnest(range({size})) b(j) JOIN rs ON rs."row" = pl."row" + i + {low} AND rs.col = pl.col + j + {low}),
s AS (SELECT id, count(*) AS n, avg(v) FILTER ({some} AND v < 2) AS mean, median(v) FILTER ({some} AND v < 2) AS med, stddev_samp(v) FILTER ({some} AND v < 2) AS std FROM w GROUP BY id)
SELECT pl.id, round(CASE WHEN n = {size * size} THEN mean END, 10) AS mean, round(CASE WHEN n = {size * size} THEN med END, 8) AS median, round(CASE WHEN n = {size * size} THEN std END, 8) AS std FROM pl LEFT JOIN s USING (id)"""


def _windows(spark, sf_dir, size):
    rounded = line_mosaic(spark, sf_dir).select("row", "col", F.round("q95", 6).alias("q95"))
    return survey.window_statistics(places(spark, sf_dir), rounded, size, "q95")


@query(_window_sql(3, False))
def window_stats(spark, sf_dir):
    return _windows(spark, sf_dir, 3).select("id", F.round("mean_all", 10).alias("mean"), F.round("median_all", 8).alias("median"), F.round("std_all", 8).alias("std"))


@query(_window_sql(4, True))
def diag_stats(spark, sf_dir):
    return _windows(spark, sf_dir, 4).select("id", F.round("mean", 10).alias("mean"), *r8("median", "std"))


@query(f"""WITH {G}, sv AS (SELECT c_custkey AS id, c_custkey::DOUBLE AS x, c_nationkey * 70.0 + 30 AS y FROM customer)
SELECT id, group_id, floor((y0 - y) / {RESOLUTION})::BIGINT AS "row", floor((x - x0) / {RESOLUTION})::BIGINT AS col FROM sv JOIN grid ON x >= x0 AND x < x0 + width * {RESOLUTION} AND y <= y0 AND y > y0 - height * {RESOLUTION}""")
def pixel_lookup(spark, sf_dir):
    sv = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("x"), (F.col("c_nationkey") * 70.0 + 30).alias("y"))
    return survey.pixels(sv, gridded(spark, sf_dir)[1], RESOLUTION).select("id", "group_id", "row", "col")


_LAMBERT = """WITH s AS (SELECT c_custkey, radians(c_custkey % 900 / 100.0 - 3) AS lon, radians(c_nationkey / 5.0 + 43) AS lat FROM customer),
k AS (SELECT 0.0818191910428158 AS e, radians(44) AS a1, radians(49) AS a2, radians(46.5) AS a0),
h AS (SELECT e, a0, cos(a1) / sqrt(1 - pow(e * sin(a1), 2)) AS m1, cos(a2) / sqrt(1 - pow(e * sin(a2), 2)) AS m2,
  atanh(sin(a1)) - e * atanh(e * sin(a1)) AS l1, atanh(sin(a2)) - e * atanh(e * sin(a2)) AS l2, atanh(sin(a0)) - e * atanh(e * sin(a0)) AS l0 FROM k),
n AS (SELECT *, ln(m2 / m1) / (l1 - l2) AS n FROM h), c AS (SELECT *, 6378137.0 * m1 / n * exp(n * l1) AS c FROM n)
SELECT c_custkey, round(700000 + c * exp(-n * (atanh(sin(lat)) - e * atanh(e * sin(lat)))) * sin(n * (lon - radians(3))), 3) AS x,
  round(6600000 + c * exp(-n * l0) - c * exp(-n * (atanh(sin(lat)) - e * atanh(e * sin(lat)))) * cos(n * (lon - radians(3))), 3) AS y FROM s, c"""


@query(_LAMBERT)
def projected_survey(spark, sf_dir):
    sv = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 900 / 100.0 - 3).alias("X"), (F.col("c_nationkey") / 5.0 + 43).alias("Y"))
    x, y = lambert_xy(F.col("X"), F.col("Y"))
    return sv.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def survey_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select((F.col("c_nationkey") % 3 == 0).cast("int").alias("isForest"), F.col("c_mktsegment").alias("segment"), (F.col("o_totalprice") / 100000).alias("lidar"), (F.col("c_acctbal") / 10000 + F.col("o_totalprice") / 200000).alias("Hmean_canopy"), F.when(F.col("c_nationkey") != 4, F.col("c_acctbal") / 1000).alias("Hmean_vegetation"))


SCENARIOS = {"mean": {"canopy": ("lidar", "Hmean_canopy"), "vegetation": ("lidar", "Hmean_vegetation")}, "swapped": {"canopy": ("Hmean_canopy", "lidar"), "vegetation": ("Hmean_vegetation", "lidar")}}
V = """sv AS (SELECT o_totalprice / 100000 AS lidar, c_acctbal / 10000 + o_totalprice / 200000 AS can, CASE WHEN c_nationkey <> 4 THEN c_acctbal / 1000 END AS veg FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 3 <> 0),
pr AS (SELECT scenario, part, lx, ly FROM (SELECT 'mean' AS scenario, 'canopy' AS part, lidar AS lx, can AS ly FROM sv UNION ALL SELECT 'mean', 'vegetation', lidar, veg FROM sv UNION ALL SELECT 'swapped', 'canopy', can, lidar FROM sv UNION ALL SELECT 'swapped', 'vegetation', veg, lidar FROM sv) WHERE lx IS NOT NULL AND ly IS NOT NULL),
st AS (SELECT scenario, part, count(*) AS n, avg(lx) AS mx, avg(ly) AS my, var_pop(lx) AS sxx, var_pop(ly) AS syy, covar_pop(lx, ly) AS sxy, regr_slope(ly, lx) AS ols_slope, regr_intercept(ly, lx) AS ols_intercept FROM pr GROUP BY ALL),
ft AS (SELECT *, (syy - sxx + sqrt(pow(syy - sxx, 2) + 4 * sxy * sxy)) / (2 * sxy) AS tls_slope, my - (syy - sxx + sqrt(pow(syy - sxx, 2) + 4 * sxy * sxy)) / (2 * sxy) * mx AS tls_intercept FROM st)"""
BY = ["scenario", "part"]


def survey_pairs(spark, sf_dir):
    return survey.pairs_by_scenario(survey_rows(spark, sf_dir), SCENARIOS)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"WITH {V} SELECT scenario, part, n, {s6('ols_slope', 'ols_intercept')} FROM ft")
def ols_fit(spark, sf_dir):
    return survey.regressions(survey_pairs(spark, sf_dir), BY).select(*BY, "n", *r6("ols_slope", "ols_intercept"))


@query(f"WITH {V} SELECT scenario, part, n, {s6('tls_slope', 'tls_intercept')} FROM ft")
def tls_fit(spark, sf_dir):
    return survey.regressions(survey_pairs(spark, sf_dir), BY).select(*BY, "n", *r6("tls_slope", "tls_intercept"))


RES = ["ols_distance", "ols_deviation", "tls_distance", "tls_deviation", "ols_mse", "tls_mse", "ols_r2", "tls_r2"]


@query(f"""WITH {V}, rs AS (SELECT scenario, part, ly, ly - (ols_slope * lx + ols_intercept) AS e, ly - (tls_slope * lx + tls_intercept) AS o, tls_slope AS s FROM pr JOIN ft USING (scenario, part)),
ag AS (SELECT scenario, part, avg(abs(e)) AS ols_distance, stddev_pop(abs(e)) AS ols_deviation, avg(abs(o) / sqrt(s * s + 1)) AS tls_distance, stddev_pop(abs(o) / sqrt(s * s + 1)) AS tls_deviation, avg(e * e) AS ols_mse, avg(o * o) AS tls_mse, 1 - sum(e * e) / (var_pop(ly) * count(*)) AS ols_r2, 1 - sum(o * o) / (var_pop(ly) * count(*)) AS tls_r2 FROM rs GROUP BY ALL)
SELECT scenario, part, {s6(*RES)} FROM ag""")
def residual_metrics(spark, sf_dir):
    p = survey_pairs(spark, sf_dir)
    return survey.residuals(p, survey.regressions(p, BY), BY).select(*BY, *r6(*RES))


def vector_points(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("group_id"), F.col("vec_id").alias("id"), *[F.get(e, i).cast("double").alias(a) for i, a in enumerate("xyz")], F.when(F.col("vec_id") % 3 == 0, 2).otherwise(1).cast("long").alias("classification"))


E = "vp AS (SELECT label::VARCHAR AS group_id, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS classification FROM embeddings)"


@query(f"""WITH {E}, d AS (SELECT a.group_id, a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM vp a JOIN vp b ON a.group_id = b.group_id AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id, id ORDER BY d, other) AS rank FROM d)
SELECT group_id, id, other, round(d, 8) AS distance, rank FROM k WHERE rank <= 5""")
def knn_bounded(spark, sf_dir):
    p = vector_points(spark, sf_dir)
    return neighbours.nearest(p, p, 5, 0.05).select("group_id", "id", "other", F.round("distance", 8).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {E}, d AS (SELECT a.group_id, a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM vp a JOIN vp b ON a.group_id = b.group_id AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id, id ORDER BY d) AS rank FROM d), m AS (SELECT group_id, id, avg(d) AS md FROM k WHERE rank <= 8 GROUP BY ALL),
l AS (SELECT group_id, avg(md) + 1.5 * stddev_samp(md) AS lim FROM m GROUP BY ALL)
SELECT id, round(md, 8) AS mean_distance, md > lim AS noise FROM m JOIN l USING (group_id)""")
def knn_outlier(spark, sf_dir):
    return neighbours.statistical_outliers(vector_points(spark, sf_dir), 8, 1.5, 0.1).select("id", F.round("mean_distance", 8).alias("mean_distance"), "noise")


@query(f"""WITH {E}, d AS (SELECT a.group_id, a.id, b.id AS other, a.z, b.z AS gz, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM vp a JOIN vp b ON a.group_id = b.group_id AND b.classification = 2 WHERE a.classification = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id, id ORDER BY d, other) AS rank FROM d)
SELECT id, round(any_value(z) - sum(gz / d) / sum(1 / d), 6) AS hag FROM k WHERE rank <= 3 GROUP BY group_id, id UNION ALL SELECT id, 0.0 FROM vp WHERE classification = 2""")
def hag_nn(spark, sf_dir):
    return neighbours.height_above_nearest_ground(vector_points(spark, sf_dir), 3, 0.1).select("id", F.round("hag", 6).alias("hag"))


@query()
def hag_delaunay(spark, sf_dir):
    return ground.height_above_triangulation(vector_points(spark, sf_dir)).select("id", F.round("hag", 6).alias("hag"))


@query()
def csf_ground(spark, sf_dir):
    return ground.cloth_filter(vector_points(spark, sf_dir), resolution=0.05, iterations=200, threshold=0.05).select("id", "classification")


STAGE_LIST = [
    {"type": "readers.las"}, {"type": "filters.range", "limits": "Z[50:900]"}, {"type": "filters.assign", "value": ["NumberOfReturns = 1", "ReturnNumber = 1"]},
    {"type": "filters.merge"}, {"type": "filters.range", "limits": "HeightAboveGround[0.2:1.9]"}, {"type": "filters.expression", "expression": "((Classification >= 2) && (Classification <= 5))"}, {"type": "writers.las"},
]


@query(f"WITH {P} SELECT id, hag, classification, 1::INTEGER AS return_number FROM pts WHERE z BETWEEN 50 AND 900 AND hag BETWEEN 0.2 AND 1.9 AND classification BETWEEN 2 AND 5")
def stage_list(spark, sf_dir):
    p = line_points(spark, sf_dir).withColumn("tile_id", F.concat_ws("_", "group_id", F.floor(F.col("x") / 100)))
    return stages.run_two_phase(p, STAGE_LIST).select("id", "hag", "classification", "return_number")


@query(f"""WITH {M}, mc AS (SELECT "row", col, q95, col * {RESOLUTION} + {RESOLUTION / 2} AS x, 2000.0 - "row" * {RESOLUTION} - {RESOLUTION / 2} AS y FROM mosaic)
SELECT "row", col, {s8("q95")} FROM mc WHERE {_inside_sql(AREA[:1])}""")
def raster_crop(spark, sf_dir):
    m = line_mosaic(spark, sf_dir).withColumns({"x": F.col("col") * RESOLUTION + RESOLUTION / 2, "y": F.lit(2000.0) - F.col("row") * RESOLUTION - RESOLUTION / 2})
    return points.crop(m, [AREA[:1]]).select("row", "col", *r8("q95"))


@query("""WITH s AS (SELECT event_type AS group_id, value / 100 AS hag, floor(epoch(ts) / 3600) AS h FROM events)
SELECT group_id, (h * 3600)::BIGINT AS at, count(*) AS n, round(avg(hag), 8) AS mean, max(hag) AS greatest FROM s GROUP BY ALL""")
def heights_by_hour(spark, sf_dir):
    from ..streaming.tiles import heights_by_time

    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("group_id"), (F.col("value") / 100).alias("hag"))
    return heights_by_time(rows, "ts", "1 hour", "1 day").select("group_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', window.start)").alias("at"), "n", *r8("mean"), "greatest")


def _files(spark, images, end):
    """A folder with the images as files."""
    folder = f"{Scratch(spark, 'files').path}/images"
    writers.write_images(images, folder, end)
    return folder


def _from_path():
    return F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("group_id")


def _from_folder():
    return F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("group_id")


@query(f"WITH {P} SELECT group_id, x, y, round(z, 4) AS z, hag, intensity, classification::INTEGER AS classification, 1::INTEGER AS return_number FROM pts")
def las_round_trip(spark, sf_dir):
    """Points as LAS files, with a further dimension, and back."""
    folder = _files(spark, writers.las_files(line_points(spark, sf_dir), scale=0.0001), ".las")
    back = readers.read_points(spark, folder, {"HeightAboveGround": "hag"})
    return back.select(_from_folder(), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("z", 4).alias("z"), "hag", "intensity", "classification", "return_number")


@query(f"WITH {P} SELECT group_id, x, y, z, hag, intensity, classification::DOUBLE AS classification FROM pts")
def array_round_trip(spark, sf_dir):
    """Points as structured arrays, and back."""
    names = {name: column for name, column in readers.DIMENSIONS.items()}
    folder = _files(spark, writers.array_files(line_points(spark, sf_dir), names), ".npy")
    return readers.read_npy(spark, folder).select(_from_path(), "x", "y", "z", "hag", "intensity", "classification")


def _images(spark, sf_dir):
    found, grid = vegetation.cell_indicators(line_points(spark, sf_dir), RESOLUTION)
    return _files(spark, writers.tiff_files(found, grid, ["q95", "fhd"], RESOLUTION, nodata=raster.NODATA, names=["height", "diversity"]), ".tif")


@query(f'WITH {I} SELECT group_id, "row", col, round(q95::FLOAT::DOUBLE, 4) AS q95 FROM ras')
def tiff_round_trip(spark, sf_dir):
    """Indicators as GeoTIFF images, and back."""
    return readers.read_rasters(spark, _images(spark, sf_dir), ["q95", "fhd"]).select(_from_path(), "row", "col", F.round("q95", 4).alias("q95"))


@query(f'WITH {I} SELECT group_id, "row", col, round(q95::FLOAT::DOUBLE, 4) AS q95 FROM ras WHERE "row" BETWEEN 1 AND 3 AND col >= 2')
def tiff_window(spark, sf_dir):
    """A window of GeoTIFF images: the blocks that it meets are decoded."""
    return readers.read_rasters(spark, _images(spark, sf_dir), ["q95"], rows=(1, 4), cols=(2, 1 << 30)).select(_from_path(), "row", "col", F.round("q95", 4).alias("q95"))


@query(f"WITH {G} SELECT group_id, x0, y0, width::INTEGER AS width, height::INTEGER AS height, 2154 AS epsg, 'height,diversity' AS names FROM grid")
def tiff_headers(spark, sf_dir):
    """What the headers say: place, size, projection, bands' names."""
    return readers.raster_info(spark, _images(spark, sf_dir)).select(_from_path(), "x0", "y0", "width", "height", "epsg", F.concat_ws(",", "names").alias("names"))


@query(f"""WITH {T}, g AS (SELECT DISTINCT tile_y - (SELECT min(tile_y) FROM tl) AS "row", tile_x - (SELECT min(tile_x) FROM tl) AS col, tile_x, tile_y FROM tl),
p AS (SELECT c_custkey % 12 AS "row", c_nationkey AS col FROM customer)
SELECT p."row"::INTEGER AS "row", p.col::INTEGER AS col, coalesce(tile_x, -1)::INTEGER AS tile_x, coalesce(tile_y, -1)::INTEGER AS tile_y FROM p LEFT JOIN g USING ("row", col)""")
def tile_of_index(spark, sf_dir):
    """Coordinates of grid cells, -1 where there's no tile."""
    places = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 12).cast("int").alias("row"), F.col("c_nationkey").alias("col"))
    return tiles.tiles_at(places, tiles.tile_grid(tile_table(spark, sf_dir))).select("row", "col", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("tile_x", "tile_y")])
