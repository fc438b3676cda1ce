"""Edge cases and invariants, against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliagrid.functions.expressions import boolean_expression, clip_to_box, inside_rings, lambert_xy, range_predicate
from foliagrid.operators import cells, classify, ground, neighbours, points, raster, survey, tiles
from foliagrid.plans import stages
from foliagrid.plans.workflow import Status, Step, Workflow
from foliagrid.sources import las, readers, writers
from foliagrid.streaming import tiles as streaming


def cloud(spark, n=3000, seed=5):
    """Terrain that rises to the east, with shrubs and trees on it, points of five classes."""
    r = np.random.default_rng(seed)
    x, y = 7000 + 900 * r.random(n), 2500 + 1100 * r.random(n)
    hag = np.where(r.random(n) < 0.3, 0.0, r.gamma(1.5, 1.2, n))
    rows = pd.DataFrame({"group_id": "g", "id": np.arange(n), "x": x, "y": y, "z": 100 + 0.02 * (x - 7000) + hag, "hag": hag, "classification": r.integers(1, 6, n)})
    return rows, spark.createDataFrame(rows)


def test_indicators_against_numpy(spark):
    rows, df = cloud(spark)
    edges = cells.bin_edges(0.0, 2.0, 0.2)
    grid = cells.extent(df, 100.0)
    got = cells.indicators(cells.with_cells(df, grid, 100.0), {"q95": 95.0, "q50": 50.0}, edges).toPandas()
    w, h = math.ceil((rows.x.max() - rows.x.min()) / 100), math.ceil((rows.y.max() - rows.y.min()) / 100)
    col = np.clip(((rows.x - rows.x.min()) / 100).astype(int), 0, w - 1)
    row = np.clip(((rows.y.max() - rows.y) / 100).astype(int), 0, h - 1)
    assert got.n.sum() == len(rows)
    for r in got.itertuples():
        v = rows.hag[(row == r.row) & (col == r.col)].to_numpy()
        assert math.isclose(r.q95, np.quantile(v, 0.95), abs_tol=1e-12) and math.isclose(r.q50, np.quantile(v, 0.5), abs_tol=1e-12)
        n, _ = np.histogram(v, edges)
        p = n[n > 0] / n.sum()
        assert math.isclose(r.fhd, -(p * np.log(p)).sum(), abs_tol=1e-12) and r.fhd <= cells.fhd_limit(edges) + 1e-12
        assert r.q50 <= r.q95


def test_one_point_and_line(spark):
    df = spark.createDataFrame([("a", 5.0, 5.0, 3.0), ("b", 1.0, 0.0, 1.0), ("b", 1.0, 30.0, 2.0)], "group_id string, x double, y double, hag double")
    grid = cells.extent(df, 10.0)
    assert {(r.group_id, r.width, r.height) for r in grid.collect()} == {("a", 1, 1), ("b", 1, 3)}
    got = cells.indicators(cells.with_cells(df, grid, 10.0), {}, [0.0, 1.0, 2.0]).collect()
    assert {(r.group_id, r.row, r.fhd) for r in got} == {("a", 0, None), ("b", 0, 0.0), ("b", 2, 0.0)}


def test_edges_and_bins():
    edges = cells.bin_edges(0.0, 2.0, 0.15)
    assert len(edges) == 15 and math.isclose(edges[-1], 2.1)


def test_predicates(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, None)], "classification int, z double")
    assert [r[0] for r in df.filter(range_predicate("z[:5]")).collect()] == [1]
    assert [r[0] for r in df.filter(boolean_expression("(classification >= 2) && !(z == 5)")).collect()] == [2]
    with pytest.raises(ValueError):
        range_predicate("z 1 2")


def test_polygon_and_clip(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 5.0)], "x double, y double")
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]
    assert [tuple(r) for r in df.filter(inside_rings(F.col("x"), F.col("y"), [square, hole])).collect()] == [(1.0, 1.0)]
    many = [(5 + 5 * math.cos(2 * math.pi * i / 90), 5 + 5 * math.sin(2 * math.pi * i / 90)) for i in range(90)]
    assert df.filter(inside_rings(F.col("x"), F.col("y"), [many])).count() == 1
    assert sorted(clip_to_box(square, (5, 5, 20, 20))) == [(5, 5), (5, 10.0), (10.0, 5), (10.0, 10.0)]
    assert clip_to_box(square, (20, 20, 30, 30)) == []


def test_tiles(spark):
    files = spark.createDataFrame([("in/A_B_10_20_x.las",), ("in/uncompress_A_B_11_20_x.las",), ("in/bad_name.las",), ("A_B_x_1_2.las",)], "path string")
    t = tiles.parse_tiles(files)
    assert {(r.tile_x, r.tile_y) for r in t.collect()} == {(10, 20), (11, 20)}
    block = {(i, j) for i in range(5) for j in range(5)}
    groups = tiles.adjacent_groups(block, 4)
    assert sorted(c for g in groups for c in g) == sorted(block) and max(map(len, groups)) <= 11
    assert tiles.adjacent_groups({(0, 0), (5, 5)}, 1) == [[(0, 0)], [(5, 5)]]
    grid = spark.createDataFrame([(x, y) for x in range(3) for y in range(3)], "tile_x int, tile_y int")
    assert tiles.group_tiles(grid, 0).select("group_no").distinct().count() == 9
    assert tiles.group_tiles(grid, -1).select("group_no").distinct().count() == 1
    with pytest.raises(ValueError):
        tiles.group_tiles(grid, 2, "by hand")


def test_masks_and_rules(spark):
    r = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 0, float("nan")), (1, 1, 2.5)], "row int, col int, q95 double")
    m = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 1, 1), (1, 0, 0, 1), (1, 1, 0, 1)], "row int, col int, rock int, shadow int")
    got = classify.classified(raster.apply_masks(r, m, ["q95"]), "q95")
    assert {(x.row, x.col): x.class_id for x in got.collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 128, (1, 1): 2}
    with pytest.raises(ValueError):
        classify.classified(r, "q50")


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_clusters_are_found_and_ranked(spark, method):
    r = np.random.default_rng(1)
    rows = [(float(m + r.normal(0, 0.02)), float(m / 2 + r.normal(0, 0.02)), i) for i, m in enumerate((1.5, 0.3, 0.9)) for _ in range(60)]
    got = classify.fit_clusters(spark.createDataFrame(rows, "q95 double, fhd double, truth int"), ["q95", "fhd"], 3, method)
    done = classify.relabel(got, classify.rank_clusters(got, "q95", "fhd"))
    assert {(x.truth, x.class_id) for x in done.select("truth", "class_id").distinct().collect()} == {(1, 3), (2, 4), (0, 5)}


def test_neighbours_outliers_heights(spark):
    rows, df = cloud(spark, 400)
    near = neighbours.nearest(df, df, 3, 5.0).toPandas()
    xy = rows[["x", "y"]].to_numpy()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    got = near.sort_values(["id", "rank"]).distance.to_numpy().reshape(-1, 3)
    assert np.allclose(got, want)
    lone = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 3.0, 4.0)], "group_id string, id int, x double, y double")
    assert [r.distance for r in neighbours.nearest(lone, lone, 5, 0.5).collect()] == [5.0, 5.0]
    hag = neighbours.height_above_nearest_ground(df, 4, 50.0).toPandas()
    assert (hag.hag[hag.classification == 2] == 0).all() and hag.hag.notna().all()


def test_low_outliers(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0, z, 1) for z in (-9.0, 0.1, 0.2, 0.3, 0.4, 9.0)], "group_id string, x double, y double, z double, classification int")
    got = points.low_outliers(df, 10.0, 1.0)
    assert sorted((r.z, r.classification) for r in got.collect())[0] == (-9.0, 7) and got.filter("classification = 7").count() == 1
    assert points.low_outliers(df, 10.0, 1.0, drop=True).count() == 5


def test_ground_surfaces():
    r = np.random.default_rng(3)
    xy = r.uniform(0, 10, (60, 2))
    plane = lambda p: 2 * p[:, 0] - p[:, 1] + 3
    at = r.uniform(3, 7, (40, 2))
    assert np.allclose(ground.linear_surface(xy, plane(xy), at, False), plane(at))
    assert np.isnan(ground.linear_surface(xy, plane(xy), np.array([[99.0, 99.0]]), False)).all()
    x, y = r.uniform(0, 40, 3000), r.uniform(0, 40, 3000)
    tree = r.random(3000) < 0.2
    z = 0.02 * x + np.where(tree, 6.0, 0.0)
    assert (ground.cloth_ground(x, y, z, 2.0, 2, 500, 0.5) == ~tree).mean() > 0.95


def test_windows_of_many_places_are_not_broadcast(spark, tmp_path):
    grid = spark.createDataFrame([(i, j, float(i + j) / 4) for i in range(6) for j in range(6)], "row long, col long, v double")
    spark.range(150_000).select("id", (F.col("id") % 4).alias("row"), F.lit(2).cast("long").alias("col")).write.parquet(f"{tmp_path}/places")
    places = spark.read.parquet(f"{tmp_path}/places")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "80m")
    try:
        few = {r.id: r for r in survey.window_statistics(places.filter("id < 8"), grid, 4, "v").collect()}
        got = survey.window_statistics(places, grid, 4, "v")
        assert got.count() == 150_000
        assert {(r.row, r.mean) for r in got.join(places, "id").select("row", "mean").distinct().collect()} == {(i, few[i].mean) for i in range(4)}
        assert survey.windows(places, grid, 4, "v").count() == 37_500 * (8 + 12 + 16 + 16)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert few[2].mean is not None and few[0].mean is None
    twice = survey.window_statistics(places.filter("id < 8").unionByName(places.filter("id = 2")), grid, 4, "v").collect()
    assert {r.id: r.mean_all for r in twice} == {i: None if i == 2 else few[i].mean_all for i in range(8)}


def test_windows_and_fits(spark):
    grid = spark.createDataFrame([(i, j, float(i + j) / 4) for i in range(6) for j in range(6)], "row long, col long, v double")
    places = spark.createDataFrame([(1, 2, 2), (2, 0, 0)], "id int, row long, col long")
    got = {r.id: r for r in survey.window_statistics(places, grid, 3, "v").collect()}
    values = np.array([[(i + j) / 4 for j in range(1, 4)] for i in range(1, 4)])
    assert math.isclose(got[1].mean_all, values[values < 2].mean()) and got[2].mean_all is None
    r = np.random.default_rng(0)
    x = r.normal(0, 1, 200)
    y = 0.7 * x + r.normal(0, 0.2, 200)
    pairs = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y, strict=True)], "s string, lx double, ly double")
    fit = survey.regressions(pairs, ["s"]).first()
    assert np.allclose([fit.ols_slope, fit.ols_intercept], np.polyfit(x, y, 1))
    _, _, vt = np.linalg.svd(np.stack([x - x.mean(), y - y.mean()], 1))
    assert math.isclose(fit.tls_slope, -vt[1, 0] / vt[1, 1], rel_tol=1e-9)
    out = survey.residuals(pairs, survey.regressions(pairs, ["s"]), ["s"]).first()
    assert 0 < out.ols_r2 < 1 and out.tls_distance <= out.ols_distance + 1e-9


def test_projection(spark):
    x, y = lambert_xy(F.lit(3.0), F.lit(46.5))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert math.isclose(r.x, 700000, abs_tol=1e-6) and math.isclose(r.y, 6600000, abs_tol=1e-3)


def test_files_of_large_groups(spark, tmp_path):
    """A group of more points than a file's, and further apart than a file's steps span, has several files."""
    rows = [(g, float(i), i * 6000.0 - 3e6, i / 8.0 - 40, i / 16.0) for g in ("a", "b") for i in range(1000)] + [("c", 1.0, 2.0, 3.0, 4.0), (None, 5.0, 6.0, 7.0, 8.0)]
    df = spark.createDataFrame(rows, "group_id string, x double, y double, z double, hag double")
    images = writers.las_files(df, scale=0.001, most=150).cache()
    found = images.toPandas()
    n = [next(las.pages(x))["x"].size for x in found.image]
    assert max(n) <= 150 and sum(n) == len(rows) and len(found[["group_id", "part"]].drop_duplicates()) == len(found) and (found.group_id == "c").sum() == 1
    writers.write_images(images, str(tmp_path / "las"), ".las")
    back = readers.read_points(spark, str(tmp_path / "las"), {"HeightAboveGround": "hag"})
    got = sorted((r.path.split("/")[-2], round(r.x, 3), round(r.y, 3), round(r.z, 3), r.hag) for r in back.collect())
    assert got == sorted((str(g), *v) for g, *v in rows)


def test_files_round_trip(spark, tmp_path):
    rows, df = cloud(spark, 500)
    image = writers.las_files(df).first().image
    (tmp_path / "a.las").write_bytes(image)
    back = readers.read_points(spark, str(tmp_path), {"HeightAboveGround": "hag", "Other": "other"}).toPandas().sort_values("hag")
    want = rows.sort_values("hag")
    assert len(back) == 500 and np.allclose(np.sort(back.x), np.sort(rows.x), atol=0.006) and back.other.isna().all()
    assert np.array_equal(back.hag, want.hag) and (back.number_of_returns == 1).all()
    assert readers.read_las(spark, str(tmp_path), start=490, count=50).count() == 10
    (tmp_path / "packed.laz").write_bytes(image[:104] + bytes([image[104] | 0x80]) + image[105:])
    with pytest.raises(ValueError, match="packed.laz"):
        readers.read_points(spark, str(tmp_path))
    (tmp_path / "b.npy").write_bytes(writers.array_files(df, {"X": "x", "Y": "y", "Z": "z", "HeightAboveGround": "hag"}).first().image)
    back = readers.read_npy(spark, str(tmp_path)).toPandas()
    assert np.allclose(np.sort(back.hag), np.sort(rows.hag)) and back.intensity.isna().all()
    grid = cells.extent(df, 100.0)
    found = cells.indicators(cells.with_cells(df, grid, 100.0), {"q95": 95.0}, [0.0, 1.0, 2.0])
    writers.write_images(writers.tiff_files(found, grid, ["q95", "fhd"], 100.0, nodata=-999.0, names=["height", "diversity"], metadata={"MADE": "a<b"}), str(tmp_path / "images"), ".tif")
    info = readers.raster_info(spark, str(tmp_path / "images")).first()
    at = grid.first()
    assert (info.x0, info.y0, info.width, info.height, info.resolution, info.epsg, info.nodata) == (at.x0, at.y0, at.width, at.height, 100.0, 2154, -999.0)
    assert info.names == ["height", "diversity"] and info.metadata == {"MADE": "a<b"}
    cell = {(r.row, r.col): r for r in found.collect()}
    got = readers.read_rasters(spark, str(tmp_path / "images"), ["q95", "fhd"]).collect()
    assert {(r.row, r.col) for r in got} == {k for k, r in cell.items() if r.q95 is not None or r.fhd is not None}
    assert all(math.isclose(r.q95, cell[r.row, r.col].q95, rel_tol=1e-6) for r in got)
    some = readers.read_rasters(spark, str(tmp_path / "images"), ["q95"], rows=(2, 4), cols=(1, 3)).collect()
    assert {(r.row, r.col) for r in some} == {(r.row, r.col) for r in got if 2 <= r.row < 4 and 1 <= r.col < 3}
    assert "<Category>rock</Category>" in writers.category_sidecar({0: "rock", 2: "a<b"}, {0: (1, 2, 3)})
    geo = tmp_path / "a.geojson"
    geo.write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"geometry":{"type":"Polygon","coordinates":[[[5,5],[6,5],[6,6],[5,5]]]}}]}')
    assert len(readers.read_polygons(spark, str(geo))) == 2


def test_stages_and_workflow(spark, tmp_path):
    _, df = cloud(spark, 300)
    out = stages.run_stages(df, [{"type": "readers.las"}, {"type": "filters.range", "limits": "Classification[2:5]"}, {"type": "filters.hag_nn", "count": 2, "side": 100.0}, {"type": "filters.voxeldownsize", "cell": 50.0}])
    assert 0 < out.count() <= 300
    with pytest.raises(ValueError):
        stages.run_stages(df, [{"type": "filters.unknown"}])
    ran = []
    flow = Workflow(spark, [Step("a", lambda s, c: ran.append("a")), Step("b", lambda s, c: 1 / 0, needs=("a",)), Step("c", lambda s, c: ran.append("c"), needs=("b",)), Step("d", lambda s, c: ran.append("d"), needs=("a",))], continue_on_error=True)
    assert not flow.run() and ran == ["a", "d"] and set(flow.errors) == {"b", "c"}
    assert flow.run(["d"], done={"a"}) is False or ran[-1] == "d"
    status = Status(spark, str(tmp_path / "status"))
    groups = spark.createDataFrame([("g1",), ("g2",)], "group_id string")
    assert status.remaining(groups).count() == 2
    status.record(groups.filter("group_id = 'g1'"), "processed")
    status.record(groups.filter("group_id = 'g2'"), "failed")
    assert [r.group_id for r in status.remaining(groups).collect()] == ["g2"]
    status.record(groups, "processed")
    assert status.remaining(groups).isEmpty()


def test_streaming(spark, tmp_path):
    _, df = cloud(spark, 200)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{c} {k}" for c, k in df.dtypes)
    q = streaming.write_indicators(streaming.arriving(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check"), 100.0)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 200


def test_land_cover_keeps_cells_without_features(spark):
    from foliagrid.operators import classify

    rows = [(0, 1.0, 0.5), (1, 0.2, 0.1), (2, -1.0, None), (3, -2.0, float("nan")), (4, 9.0, None), (5, None, None), (6, 1.1, 0.6)]
    cells = spark.createDataFrame(rows, "cell long, h double, fhd double")
    got = {r.cell: r.class_id for r in classify.land_cover(cells, "h", ["h", "fhd"], 2, masked=False, method="kmeans")[0].collect()}
    assert sorted(got) == list(range(7))
    assert got[2] == got[3] == got[5] == classify.NODATA_CLASS and got[4] == classify.TALL_CLASS and got[0] == got[6] != got[1]


def lzw(data: bytes) -> bytes:
    """Codes of the TIFF variant, as plainly as can be."""
    table, codes, width, out, last = {bytes([i]): i for i in range(256)}, [(256, 9)], 9, "", b""
    for i in range(len(data)):
        now = last + data[i : i + 1]
        if now in table:
            last = now
            continue
        codes.append((table[last], width))
        table[now] = len(table) + 2
        width = 9 + sum(len(table) + 2 >= n for n in (512, 1024, 2048))
        if len(table) + 2 >= 4093:
            codes.append((256, width))
            table, width = {bytes([j]): j for j in range(256)}, 9
        last = data[i : i + 1]
    codes += [(table[last], width), (257, width)] if last else [(257, width)]
    out = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(out[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(out), 8))


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_layouts(compression, tiled):
    """Files written here by hand: strips and tiles, both byte orders, chunky and planar, with and without predictor."""
    import struct
    import zlib

    from foliagrid.sources import tiff

    r = np.random.default_rng(2)
    for order, kind, planar, predictor in (("<", "u1", False, 1), (">", "i2", True, 1), ("<", "u2", False, 2), (">", "f4", False, 1), ("<", "f4", True, 3), ("<", "f8", False, 1)):
        bands = (r.random((3, 21, 37)) * 100).round().astype(kind)
        high, wide = (16, 16) if tiled else (8, 37)
        down, across = -(-21 // high), -(-37 // wide)
        blocks = []
        for group in [[b] for b in range(3)] if planar else [[0, 1, 2]]:
            for i in range(down):
                for j in range(across):
                    rows = high if tiled else min(high, 21 - i * high)
                    cells = np.zeros((rows, wide, len(group)), kind)
                    part = bands[group, i * high : i * high + rows, j * wide : (j + 1) * wide].transpose(1, 2, 0)
                    cells[: part.shape[0], : part.shape[1]] = part
                    if predictor == 2:
                        cells[:, 1:] = cells[:, 1:] - cells[:, :-1]
                    raw = cells.astype(order + kind).tobytes()
                    if predictor == 3:
                        planes = cells.astype(">" + kind).view(np.uint8).reshape(rows, -1, np.dtype(kind).itemsize).transpose(0, 2, 1).reshape(rows, -1, len(group)).copy()
                        planes[:, 1:] = planes[:, 1:] - planes[:, :-1]
                        raw = planes.tobytes()
                    bits = b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100))
                    blocks.append({1: raw, 5: lzw(raw) if compression == 5 else b"", 8: zlib.compress(raw), 32773: bits}[compression])
        form = {"u": 1, "i": 2, "f": 3}[kind[0]]
        tags = {256: (37,), 257: (21,), 258: (8 * int(kind[1]),) * 3, 259: (compression,), 277: (3,), 284: (2 if planar else 1,), 317: (predictor,), 339: (form,) * 3}
        tags |= {322: (16,), 323: (16,)} if tiled else {278: (8,)}
        at, where = 8, []
        for x in blocks:
            where.append(at)
            at += len(x)
        tags |= {324: tuple(where), 325: tuple(map(len, blocks))} if tiled else {273: tuple(where), 279: tuple(map(len, blocks))}
        entries, extra, beyond = b"", b"", at + 2 + 12 * len(tags) + 4
        for tag in sorted(tags):
            raw = struct.pack(f"{order}{len(tags[tag])}I", *tags[tag])
            entries += struct.pack(f"{order}HHI", tag, 4, len(tags[tag])) + (raw if len(raw) == 4 else struct.pack(f"{order}I", beyond + len(extra)))
            extra += raw if len(raw) > 4 else b""
        content = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at) + b"".join(blocks) + struct.pack(f"{order}H", len(tags)) + entries + bytes(4) + extra
        image = tiff.Image(content)
        assert np.array_equal(image.window(), bands), (order, kind, planar, predictor)
        assert np.array_equal(image.window((5, 19), (3, 30)), bands[:, 5:19, 3:30])
        assert image.window((30, 40)).shape == (3, 0, 37)


def test_las_limits_and_returns():
    from foliagrid.sources import las

    points = {"x": np.array([1.0, 2.0]), "y": np.array([3.0, 4.5]), "z": np.array([5.0, 6.25]), "classification": np.array([64, 255]), "return_number": np.array([2, 15]), "number_of_returns": np.array([3, 15]), "intensity": np.array([65535, 0])}
    page, = las.pages(las.encode(points))
    assert all(np.array_equal(page[k], points[k]) for k in points)
    for wrong in ({"intensity": np.array([70_000, 0])}, {"classification": np.array([300, 0])}, {"x": np.array([0.0, 1e9])}):
        with pytest.raises(ValueError):
            las.encode(points | wrong)
    assert list(las.pages(las.encode({c: np.zeros(0) for c in "xyz"}))) == []


def test_shares_by_their_definition(spark):
    r = np.random.default_rng(11)
    n = 4000
    alt, asp, slo = r.uniform(150, 900, n), r.uniform(-20, 360, n), r.uniform(0, 60, n)
    hit = np.where(r.random(n) < 0.1, np.nan, r.integers(0, 2, n)).astype(float)
    low, high, step, aspects, slopes = 200.0, 800.0, 100.0, [0.0, 90.0, 180.0], [0.0, 30.0]
    df = spark.createDataFrame(pd.DataFrame({"alt": alt, "asp": asp, "slo": slo, "hit": hit}))
    count = len(np.arange(low + step, high, step)) + 1
    bands = {"altitude": ("alt", low, step, count), "aspect": ("asp", aspects), "slope": ("slo", slopes)}
    inside = lambda v, edges, k: (v >= edges[k]) & (v < edges[k + 1] if k + 1 < len(edges) else True)
    for names in (["altitude"], ["altitude", "aspect"], ["altitude", "aspect", "slope"]):
        got = {tuple(row[x] for x in names): row.percent for row in raster.share_by_band(df, "hit", {k: bands[k] for k in names}, "altitude").collect()}
        for b in range(len(aspects) if "aspect" in names else 1):
            for s in range(len(slopes) if "slope" in names else 1):
                where = np.ones(n, bool)
                where &= inside(asp, aspects, b) if "aspect" in names else True
                where &= inside(slo, slopes, s) if "slope" in names else True
                edges = [low + step * k for k in range(count)]
                parts = [hit[where & inside(alt, edges, k)] for k in range(count)]
                total = sum(len(p) for p in parts)
                for k in range(count):
                    key = (k, b, s)[: len(names)]
                    assert math.isclose(got[key], np.nansum(parts[k]) * 100 / total, rel_tol=1e-9)
    four = spark.createDataFrame([(50.0, 1), (210.0, 1), (310.0, 1), (320.0, 0)], "alt double, hit int")
    assert sorted(round(r.percent, 1) for r in raster.share_by_band(four, "hit", {"altitude": ("alt", 200.0, 100.0, 3)}, "altitude").collect()) == [33.3, 33.3]


def test_cluster_names_count_from_one(spark):
    df = spark.createDataFrame([(7, 1.0), (7, 2.0), (3, 0.5)], "raw_label long, h double")
    got = [(r.raw_label, r["rank"], r.class_id, r.name) for r in classify.rank_clusters(df, "h", None).orderBy("rank").collect()]
    assert got == [(3, 0, 3, "cluster 1 H=0.50m D=0.00 N=1"), (7, 1, 4, "cluster 2 H=1.50m D=0.00 N=2")]


def test_mosaic_takes_each_band_from_the_first_valid(spark):
    grid = spark.createDataFrame([("a", 0.0, 10.0, 1, 1), ("b", 0.0, 10.0, 1, 1)], "group_id string, x0 double, y0 double, width int, height int")
    rows = spark.createDataFrame([("a", 0, 0, 1.0, None), ("b", 0, 0, 2.0, 5.0)], "group_id string, row long, col long, p double, q double")
    assert [tuple(r) for r in raster.mosaic(rows, grid, 10.0, ["p", "q"]).collect()] == [(0, 0, "a", 1.0, 5.0)]
    rows = spark.createDataFrame([("a", 0, 0, -999.0, -999.0), ("b", 0, 0, 2.0, None)], "group_id string, row long, col long, p double, q double")
    assert [tuple(r) for r in raster.mosaic(rows, grid, 10.0, ["p", "q"]).collect()] == [(0, 0, "b", 2.0, None)]


def test_neighbours_far_away_and_few(spark):
    schema = "group_id string, id int, x double, y double"
    ground = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 0.5, 0.5), ("b", 3, -1e6, 7.0)], schema)
    probes = spark.createDataFrame([("a", 10, 100.0, 100.0), ("b", 11, 1e6, 7.0), ("c", 12, 0.0, 0.0)], schema)
    got = {(r.id, r.other, round(r.distance, 3)) for r in neighbours.nearest(probes, ground, 1, 0.5).collect()}
    assert got == {(10, 2, 140.714), (11, 3, 2e6)}
    assert neighbours.nearest(probes, ground, 5, 0.5).count() == 3
    r = np.random.default_rng(4)
    many = spark.createDataFrame([("a", i, float(v), float(w)) for i, (v, w) in enumerate(r.normal(0, 1, (300, 2)))], schema)
    away = spark.createDataFrame([("a", 1000 + i, 500.0 * i, -300.0) for i in range(5)], schema)
    got = neighbours.nearest(away, many, 4, 0.1).toPandas()
    xy = np.array([(x.x, x.y) for x in many.orderBy("id").collect()])
    for i in range(5):
        want = np.sort(np.sqrt(((xy - [500.0 * i, -300.0]) ** 2).sum(1)))[:4]
        assert np.allclose(got[got.id == 1000 + i].sort_values("rank").distance, want)
    points3 = spark.createDataFrame([("a", 1, 5.0, 0.0, 3.0, 2), ("a", 2, 900.0, 0.0, 8.0, 1)], "group_id string, id int, x double, y double, z double, classification int")
    assert {x.id: x.hag for x in neighbours.height_above_nearest_ground(points3, 1, 1.0).collect()} == {1: 0.0, 2: 5.0}


def test_pixels_of_many_grids(spark):
    r = np.random.default_rng(6)
    grids = [(f"g{i}", float(x), float(y), int(w), int(h)) for i, (x, y, w, h) in enumerate(zip(r.integers(-500, 500, 40), r.integers(-500, 500, 40), r.integers(1, 30, 40), r.integers(1, 30, 40), strict=True))]
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-600, 600, (400, 2)))] + [(400, grids[0][1], grids[0][2])]
    got = {(x.id, x.group_id, x.row, x.col) for x in survey.pixels(spark.createDataFrame(places, "id int, x double, y double"), spark.createDataFrame(grids, "group_id string, x0 double, y0 double, width int, height int"), 5.0).collect()}
    assert got == {(i, g, int((y0 - y) // 5), int((x - x0) // 5)) for i, x, y in places for g, x0, y0, w, h in grids if x0 <= x < x0 + 5 * w and y0 - 5 * h < y <= y0}


def groups_by_matrix(cells, n):
    """Growth on a matrix of flags, written apart from the operator."""
    high, wide = max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1
    free = np.zeros((high + 2, wide + 2), bool)
    for i, j in cells:
        free[i + 1, j + 1] = True
    out = []
    for i, j in zip(*np.nonzero(free.copy()), strict=True):
        if not free[i, j]:
            continue
        free[i, j] = False
        members, at = [(i, j)], 0
        while at < len(members) and len(members) < n:
            a, b = members[at]
            at += 1
            for p, q in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1), (a - 1, b - 1), (a - 1, b + 1), (a + 1, b + 1), (a + 1, b - 1)):
                if free[p, q]:
                    free[p, q] = False
                    members.append((p, q))
        out.append([(int(p) - 1, int(q) - 1) for p, q in members])
    return out


def test_adjacent_groups_without_the_driver(spark, monkeypatch):
    """Tiles aren't collected, and groups that grow along a stream are those that grow on a matrix."""
    rng = np.random.default_rng(3)
    found = {(int(i), int(j)) for i, j in rng.integers(0, 40, (900, 2))} | {(200, 3), (201, 4)}
    for n in (1, 2, 5, 9, 40):
        held = iter(sorted(found))
        assert list(tiles.growing_groups(held, n)) == groups_by_matrix(found, n)
    t = spark.createDataFrame([(j + 7, i - 3) for i, j in found], "tile_x int, tile_y int")
    monkeypatch.setattr(type(t), "collect", lambda self: pytest.fail("collected"))
    grouped = tiles.group_tiles(t, 9)
    monkeypatch.undo()
    least = min(i for i, _ in found), min(j for _, j in found)
    got = grouped.toPandas().sort_values(["group_no", "place"])
    assert (got.tile_x - got["col"] == 7 + least[1]).all() and (got.tile_y - got.row == least[0] - 3).all()
    want = groups_by_matrix({(i - least[0], j - least[1]) for i, j in found}, 9)
    assert [list(zip(g.row, g["col"], strict=True)) for _, g in got.groupby("group_no")] == want


def test_cell_functions_across_batches(spark):
    """A function of a cell's values sees all of them, once, wherever batches end, and isn't called by way of a frame."""
    rows = [(g, i % 7, i % 3, float(i) if i % 11 else None) for g in ("a", None) for i in range(500)]
    df = spark.createDataFrame(rows, "group_id string, row long, col long, hag double")
    want = {}
    for g, i, j, v in rows:
        want.setdefault((g, i, j), []).append(math.nan if v is None else v)
    how = lambda v, more: float(len(v)) + more + float(np.nansum(v)) / 1e6
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            made = cells.cell_indicator(df, "spread", how, more=2)
            got = {(r.group_id, r.row, r.col): r.spread for r in made.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys() and all(math.isclose(got[k], how(np.array(v), 2)) for k, v in want.items())
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()


def test_adjacent_groups_on_a_matrix(spark):
    r = np.random.default_rng(8)
    for n in (1, 4, 20):
        found = {(int(i), int(j)) for i, j in r.integers(0, 14, (90, 2))}
        assert tiles.adjacent_groups(found, n) == groups_by_matrix(found, n)
    t = spark.createDataFrame([(i, j) for i in range(20) for j in range(10)], "tile_x int, tile_y int")
    some = tiles.group_tiles(t, 7, "random", seed=3).toPandas()
    assert len(some) == 200 and some.groupby("group_no").size().tolist() == [7] * 28 + [4] and set(some.place) == set(range(7))
    files = spark.createDataFrame([(f"d/A_B_{i}_{j}_C.las",) for i in range(4) for j in range(3)], "path string")
    index = tiles.TileIndex(files)
    assert index.grid().count() == 12 and index.neighbours().count() == 2 * (3 * 3 + 4 * 2 + 2 * 3 * 2)
    assert sorted(len(x.tiles) for x in index.groups(5).collect()) and sum(len(x.tiles) for x in index.groups(5, "random").collect()) == 12
    assert index.at(spark.createDataFrame([(2, 3)], "row int, col int")).first().tile_x == 3
    at = tiles.tiles_at(spark.createDataFrame([(9, 19), (0, 0), (50, 0)], "row int, col int"), tiles.tile_grid(t)).collect()
    assert {(x.row, x.col): (x.tile_x, x.tile_y) for x in at} == {(9, 19): (19, 9), (0, 0): (0, 0), (50, 0): (None, None)}


def test_triangles_have_empty_circles():
    r = np.random.default_rng(9)
    xy = r.uniform(0, 10, (120, 2))
    found = {tuple(sorted(t)) for t in ground.triangulate(xy).tolist()}
    for i, j, k in found:
        a, b, c = xy[[i, j, k]]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), np.array([b @ b - a @ a, c @ c - a @ a]))
        assert (((xy - m) ** 2).sum(1) >= ((a - m) ** 2).sum() * (1 - 1e-9)).all()
    area = sum(abs(np.linalg.det(np.array([xy[j] - xy[i], xy[k] - xy[i]]))) / 2 for i, j, k in found)
    hull, rest = [], sorted(map(tuple, xy))
    for side in (rest, rest[::-1]):
        chain = []
        for p in side:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        hull += chain[:-1]
    whole = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, [*hull[1:], hull[0]], strict=True))) / 2
    assert math.isclose(area, whole, rel_tol=1e-3)
    big = r.uniform(0, 1000, (4000, 2))
    z = 3 * big[:, 0] - big[:, 1]
    at = r.uniform(100, 900, (5000, 2))
    assert np.allclose(ground.linear_surface(big, z, at, False), 3 * at[:, 0] - at[:, 1], atol=1e-6)


def test_run_from_a_configuration(spark, tmp_path, capsys):
    import json

    from foliagrid.plans import run

    r = np.random.default_rng(3)
    (tmp_path / "tiles").mkdir()
    from foliagrid.sources import las, tiff

    for i in range(3):
        n = 1500
        x, y = 1000.0 * i + 100 * r.random(n), 5000 + 100 * r.random(n)
        tall = (x // 20 + y // 20) % 3
        points = {"x": x, "y": y, "z": 50 + r.random(n) * (tall + 0.3), "classification": r.integers(2, 5, n)}
        points["hag"] = points["z"] - 50
        (tmp_path / "tiles" / f"A_B_{i}_5_C.las").write_bytes(las.encode(points, extra={"HeightAboveGround": "hag"}))
    (tmp_path / "bad_name.las").write_bytes(b"")
    for name, value in (("rock", 0), ("shadow", 1)):
        cells = np.full((1, 5, 210), value, float)
        cells[0, 0, 2] = 1 - value
        (tmp_path / f"{name}.tif").write_bytes(tiff.encode(cells, 0.0, 5100.0, 20.0))
    steps = {
        "classes": {"needs": ["indicators"], "config": {"input": f"{tmp_path}/cells", "resolution": 20, "rock": f"{tmp_path}/rock.tif", "shadow": f"{tmp_path}/shadow.tif", "k": 2, "method": "kmeans", "output": f"{tmp_path}/classes", "images": f"{tmp_path}/maps", "colours": {"2": [1, 2, 3]}}},
        "indicators": {"needs": ["points"], "config": "indicators.json"},
        "points": {"config": {"input": f"{tmp_path}/tiles", "extra": {"HeightAboveGround": "hag"}, "tiles_per_group": 1, "stages": [{"type": "filters.range", "limits": "Classification[2:4]"}], "output": f"{tmp_path}/points"}},
    }
    (tmp_path / "indicators.json").write_text(json.dumps({"input": f"{tmp_path}/points", "resolution": 20, "output": f"{tmp_path}/cells", "images": f"{tmp_path}/cell-images"}))
    (tmp_path / "run.json").write_text(json.dumps({"steps": steps}))
    assert run.main([str(tmp_path / "run.json"), "--list"]) == 0 and capsys.readouterr().out.count('"step"') == 3
    assert run.main([str(tmp_path / "run.json")], spark) == 0
    assert json.loads(capsys.readouterr().out)["errors"] == {}
    assert spark.read.parquet(f"{tmp_path}/points").select("group_id").distinct().count() == 3
    info = {r.path.rsplit("/", 1)[-1]: r for r in readers.raster_info(spark, str(tmp_path / "maps"), "*.tif").collect()}["classes.tif"]
    assert info.metadata["Class_1"] == "shadow" and "Class_4" in info.metadata and info.dtype == "uint8"
    drawn = readers.read_rasters(spark, str(tmp_path / "maps"), ["c"], "*.tif").collect()
    table = {(r.row, r.col): r.class_id for r in spark.read.parquet(f"{tmp_path}/classes").collect()}
    assert table and all(dict(((r.row, r.col), r.c) for r in drawn)[k] == v for k, v in table.items()) and {1, 3, 4} <= set(table.values())
    assert "<Category>rock</Category>" in (tmp_path / "maps" / "classes.tif.aux.xml").read_text()
    assert run.main([str(tmp_path / "run.json"), "--steps", "points"], spark) == 0  # nothing is left to do
    assert spark.read.parquet(f"{tmp_path}/points").count() == 4500
    assert run.main([str(tmp_path / "run.json"), "--steps", "classes"], spark) == 1
    with pytest.raises(ValueError):
        run.in_order({"a": {"needs": ["b"]}, "b": {"needs": ["a"]}})


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from foliagrid import scratch

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn", "getConf": staticmethod(lambda: {})})

    with pytest.raises(ValueError):
        scratch.shared_dir(Elsewhere())
    assert scratch.shared_dir(spark)
