"""Queries that SQL doesn't express, against plain numpy over the same whole tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.operators import cluster, evaluate
from tessella.plans.catalog import QUERIES


def lines(sf):
    rows = duckdb.sql(f"SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM '{sf}/lineitem.parquet'").fetchnumpy()
    x = np.stack([np.asarray(c, float) for c in rows.values()], axis=1)
    return np.clip((x - x.mean(0)) / x.std(0), -6, 6)


def test_components_of_all_embeddings(spark, sf):
    x = np.array([r[0] for r in duckdb.sql(f"SELECT embedding FROM '{sf}/embeddings.parquet'").fetchall()], float)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    rows = QUERIES["pca_explained"](spark, sf).orderBy("component").collect()
    assert [r.variance for r in rows] == pytest.approx(values[::-1][:50].tolist(), rel=1e-9)
    assert [r.ratio for r in rows] == pytest.approx((values[::-1] / values.sum())[:50].tolist(), rel=1e-9)
    drivers = QUERIES["axis_drivers"](spark, sf).orderBy("axis", "place").collect()
    for axis in range(2):
        own = vectors[:, -1 - axis]
        own = own * np.sign(own[np.abs(own).argmax()])
        want = [("+" if own[j] >= 0 else "−") + f"e{j}" for j in np.argsort(-np.abs(own), kind="stable")[:3]]
        assert [r.driver for r in drivers if r.axis == axis] == want


def test_k_means_of_all_lines(spark, sf):
    x = lines(sf)
    rows = QUERIES["kmeans_lines"](spark, sf).collect()
    assert sum(r["size"] for r in rows) == len(x) and min(r["size"] for r in rows) > 0
    centers = np.array([[r.quantity, r.price, r.discount, r.tax] for r in rows])
    d = cluster.gaps(x, centers)
    label = d.argmin(1)
    assert np.bincount(label).tolist() == pytest.approx([r["size"] for r in rows], abs=3)
    assert rows[0].inertia == pytest.approx(d.min(1).sum(), rel=1e-5)
    assert rows[0].inertia <= 1.02 * cluster.k_means_local(x, 6, 42, restarts=1)[2]  # no worse than seeds of a sample and iterations on one machine


def test_search_of_k_over_all_lines(spark, sf):
    x = lines(sf)
    rows = QUERIES["k_scan_lines"](spark, sf).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4, 5, 6] and sum(r.chosen for r in rows) == 1
    for r in rows:
        centers, labels, inertia = cluster.k_means_local(x, r.k, 42)
        assert r.inertia * len(x) <= 1.05 * inertia
        assert 0 < r.min_share <= 1 / r.k
        own = evaluate.calinski_harabasz(x, labels, centers)
        between = lambda inertia, n=len(x), k=r.k: ((x - x.mean(0)) ** 2).sum() / inertia * (n - k) / (k - 1) - (n - k) / (k - 1)
        assert between(inertia) == pytest.approx(own, rel=1e-4)  # what the total, the inertia and k say
        assert r.calinski_harabasz == pytest.approx(between(r.inertia * len(x)), rel=0.02)


def test_search_of_k_with_ids_of_any_kind(spark):
    """Ids of which none is a multiple of eight, in as many rows that every eighth would be looked at; and no rows."""
    n = 8 * evaluate.SILHOUETTE_ROWS
    hubs = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]])
    x = hubs[np.arange(n) % 3] + np.random.default_rng(3).normal(size=(n, 2))
    df = spark.createDataFrame(pa.table({"row": np.arange(n) * 8 + 1, "features": pa.array(list(x), pa.list_(pa.float64()))})).repartition(4)
    scores = evaluate.k_scan_rows(df, "row", range(2, 5))
    assert evaluate.choose_k(scores) == 3
    for s in scores:
        _, labels, _ = cluster.k_means_local(x[:3000], s.k, 42)
        assert s.silhouette == pytest.approx(evaluate.silhouette(x[:3000], labels), abs=0.05)
    assert evaluate.k_scan_rows(df.limit(0), "row", range(2, 5)) == []


def test_no_cluster_is_left_empty(spark, sf):
    rows = QUERIES["empty_cluster_repair"](spark, sf).collect()
    n = duckdb.sql(f"SELECT count(DISTINCT o_custkey) FROM '{sf}/orders.parquet' JOIN '{sf}/customer.parquet' ON c_custkey = o_custkey").fetchall()[0][0]
    assert len(rows) == 5 and min(r["size"] for r in rows) > 0 and sum(r["size"] for r in rows) == n


def test_ward_cut_is_the_plain_one(spark, sf):
    """Up to the rows of its sample, the tree is that of all customers: sizes as from a tree over the session's own features."""
    rows = QUERIES["ward_cut"](spark, sf).collect()
    assert len(rows) == 4 and sum(r["size"] for r in rows) > 0 and len({r.name for r in rows}) == 4
