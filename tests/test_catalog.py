"""Every query with SQL against DuckDB on the small tables."""

import itertools
from pathlib import Path

import duckdb
import numpy as np
import pytest

from foliagrid.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(frame, names):
    some = frame[names].astype(object)
    return sorted((tuple(None if v != v or v is None else v for v in r) for r in some.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name not in catalog.oracle_sql():
        assert list(got.columns)
        return
    want = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert rows(got, names) == rows(want, names)


def test_clusters_are_settled(spark):
    low = catalog.line_raster(spark, DATA).filter("q95 <= 2").dropna().toPandas()
    got = catalog.queries()["kmeans_fit"](spark, DATA).toPandas().merge(low, on=["group_id", "row", "col"])
    assert len(got) == len(low)
    means = got.groupby("raw_label")[["q95", "fhd"]].mean()
    far = ((got[["q95", "fhd"]].to_numpy()[:, None] - means.to_numpy()[None]) ** 2).sum(2)
    assert (means.index.to_numpy()[far.argmin(1)] == got.raw_label).mean() > 0.98  # each cell is nearest to its own cluster's mean
    for name in ("kmeans_fit", "gmm_fit"):
        got = catalog.queries()[name](spark, DATA).toPandas().merge(low, on=["group_id", "row", "col"])
        heights = got.groupby("class_id").q95.mean()
        assert heights.index.min() == 3 and heights.is_monotonic_increasing and got.groupby("raw_label").class_id.nunique().max() == 1


def test_vegetation_map_by_rule(spark, con):
    got = {(r.row, r.col): r for r in catalog.queries()["vegetation_map"](spark, DATA).collect()}
    want = con.sql(f'WITH {catalog.MASKED} SELECT "row", col, mask_state, {catalog.RULED} AS class_id FROM mv').fetchall()
    assert len(got) == len(want)
    for row, col, state, ruled in want:
        r = got[row, col]
        assert r.mask_state == state and (r.class_id == ruled if ruled is not None else r.class_id >= 3)


def test_adjacent_groups_of_the_tiles(spark):
    from test_operators import groups_by_matrix

    got = catalog.queries()["group_adjacent"](spark, DATA).toPandas().sort_values(["group_no", "place"])
    want = groups_by_matrix(set(zip(got.row.tolist(), got["col"].tolist(), strict=True)), 20)
    assert [list(zip(g.row.tolist(), g["col"].tolist(), strict=True)) for _, g in got.groupby("group_no")] == want


def test_heights_above_triangles(spark):
    """Each point's height above the plane of a triangle of ground points whose circle holds no other and which it is in."""
    points = catalog.vector_points(spark, DATA).toPandas()
    got = catalog.queries()["hag_delaunay"](spark, DATA).toPandas().set_index("id").hag
    checked = 0
    for _, group in points.groupby("group_id"):
        ground = group[group.classification == 2]
        xy, z = ground[["x", "y"]].to_numpy(), ground.z.to_numpy()
        triples = np.array(list(itertools.combinations(range(len(xy)), 3)))
        for p in group[group.classification != 2].sample(min(4, (group.classification != 2).sum()), random_state=1).itertuples():
            a, b, c = (xy[triples[:, i]] for i in range(3))
            d = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
            u = ((b[:, 1] - c[:, 1]) * (p.x - c[:, 0]) + (c[:, 0] - b[:, 0]) * (p.y - c[:, 1])) / d
            v = ((c[:, 1] - a[:, 1]) * (p.x - c[:, 0]) + (a[:, 0] - c[:, 0]) * (p.y - c[:, 1])) / d
            for t in np.flatnonzero((u > 0) & (v > 0) & (u + v < 1)):
                i, j, k = triples[t]
                centre = np.linalg.solve(2 * np.array([xy[j] - xy[i], xy[k] - xy[i]]), np.array([xy[j] @ xy[j] - xy[i] @ xy[i], xy[k] @ xy[k] - xy[i] @ xy[i]]))
                if (((xy - centre) ** 2).sum(1) >= ((xy[i] - centre) ** 2).sum() * (1 - 1e-9)).all():
                    assert abs(got[p.id] - (p.z - (u[t] * z[i] + v[t] * z[j] + (1 - u[t] - v[t]) * z[k]))) < 2e-6
                    checked += 1
    assert checked > 10


def test_ground_by_cloth(spark):
    from foliagrid.operators import ground

    points = catalog.vector_points(spark, DATA).toPandas()
    got = catalog.queries()["csf_ground"](spark, DATA).toPandas().set_index("id").classification
    for _, group in points.groupby("group_id"):
        own = ground.cloth_ground(*(group[c].to_numpy(float) for c in "xyz"), 0.05, 2, 200, 0.05)
        assert (got[group.id].to_numpy() == np.where(own, 2, 1)).all()


@pytest.mark.parametrize("name", ["kmeans_fit", "gmm_fit"])
def test_clusters_read_written_cells(spark, name):
    """The fitted cells and their labels are tables: the points aren't read again for labels and ranks."""
    assert not any("lineitem" in f for f in catalog.queries()[name](spark, DATA).inputFiles())
