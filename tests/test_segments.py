from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks, cluster, encode, evaluate, explain, export, infer, reduce, stats
from tessella.plans.session import Session, capped_levels, typed_table
from tessella.sources.demo import demo_customers, wide_numeric
from tessella.sources.text import ROW_ID, from_text
from tessella.spec import ColumnSpec, RunOptions, all_features, no_features


def blobs(n, k, dim, spread, seed):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, k, n)
    return rng.normal(size=(k, dim))[truth] * spread + rng.normal(size=(n, dim)), truth


def rand_index(a, b):
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, rows, cols, total = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(np.array([len(a)]))
    return (both - rows * cols / total) / ((rows + cols) / 2 - rows * cols / total)


def test_k_means_finds_blobs_and_fills_clusters():
    x, truth = blobs(400, 4, 6, 8, 3)
    assert rand_index(cluster.k_means_local(x, 4, 42)[1], truth) > 0.95
    x, _ = blobs(100, 2, 3, 10, 5)
    assert (np.bincount(cluster.k_means_local(x, 8, 42)[1], minlength=8) > 0).all()
    assert cluster.k_means_local(x[:3], 5, 1)[2] == 0.0


def test_distributed_lloyd(spark):
    x, truth = blobs(4000, 4, 5, 9, 11)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, features array<double>").repartition(5)
    centers, inertia, _ = cluster.lloyd(df, cluster.plus_plus(x[:500], 4, np.random.default_rng(1)))
    out = cluster.assign(df, centers).orderBy("id").collect()
    labels = np.array([r.label for r in out])
    assert rand_index(labels, truth) > 0.95 and inertia == pytest.approx(sum(r.distance for r in out))
    near = df.select("id", cluster.nearest_center(F.col("features"), centers).alias("n")).orderBy("id").collect()
    assert [r.n.id for r in near] == labels.tolist()


def test_all_empty_clusters_are_mended_at_once(spark):
    """Seeds that no row is near take the farthest rows, of clusters that keep one; partitions don't matter."""
    x, _ = blobs(600, 3, 4, 9, 2)
    seeds = np.vstack([x[:2], np.full((4, 4), 500.0) + np.arange(4)[:, None] * 1000])
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(parts)
        step = cluster.lloyd_step(df, seeds)
        assert (step.n[2:] == 0).all() and len(step.far_gap) == 6 and (np.diff(step.far_gap) <= 0).all()
        new = step.centers(seeds)
        gap = cluster.gaps(x, seeds).min(1)
        assert {tuple(r) for r in np.round(new[2:], 9)} == {tuple(r) for r in np.round(x[np.argsort(-gap)[:4]], 9)}
        centers, inertia, _ = cluster.lloyd(df, seeds, max_iter=20)
        assert (np.bincount(cluster.gaps(x, centers).argmin(1), minlength=6) > 0).all()
        found.append(inertia)
    assert found[0] == pytest.approx(found[1])
    same = spark.createDataFrame([([1.0, 2.0],)] * 5, "features array<double>")  # nobody can give a row that differs
    assert cluster.lloyd(same, np.array([[1.0, 2.0], [9.0, 9.0]]))[1] == 0.0


def test_seeds_over_all_rows(spark):
    """The same whatever the partitions; with Lloyd's iterations no worse than restarts over the whole matrix."""
    x, truth = blobs(5000, 6, 5, 9, 21)
    rows = [(k, r.tolist()) for k, r in enumerate(x)]
    dfs = [spark.createDataFrame(rows, "id long, features array<double>").repartition(p) for p in (2, 9)]
    a, b = (cluster.parallel_seeds(df, "id", 6, seed=3) for df in dfs)
    assert a.shape == (6, 5) and a == pytest.approx(b)
    centers, inertia, _ = cluster.lloyd(dfs[0], a)
    assert inertia <= cluster.k_means_local(x, 6, 42)[2] * 1.001 and rand_index(cluster.gaps(x, centers).argmin(1), truth) > 0.95
    few = spark.createDataFrame(rows[:2] * 3, "id long, features array<double>")
    assert len(cluster.parallel_seeds(few, "id", 6)) == 2
    assert cluster.parallel_seeds(few.limit(0), "id", 6).size == 0


def test_the_search_of_k_over_all_rows(spark):
    """Figures of all rows: those of plain numpy for the same centres; the right k is chosen."""
    x, truth = blobs(3000, 4, 4, 9, 31)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, features array<double>").repartition(5)
    scores = evaluate.k_scan_rows(df, "id", range(2, 7))
    assert evaluate.choose_k(scores) == 4
    s = scores[2]
    centers, labels, inertia = cluster.k_means_local(x, 4, 1)
    assert s.inertia * 3000 == pytest.approx(inertia, rel=1e-6) and s.min_share == pytest.approx(np.bincount(labels).min() / 3000)
    assert s.calinski_harabasz == pytest.approx(evaluate.calinski_harabasz(x, labels, centers), rel=1e-6)
    assert s.davies_bouldin == pytest.approx(evaluate.davies_bouldin(x, labels, centers), rel=1e-6)
    assert s.silhouette == pytest.approx(evaluate.silhouette(x[::2], labels[::2]), rel=1e-6)


def test_labelled_rows_are_one_file(spark, tmp_path):
    """Byte for byte what the rules say, in the order of rows, whatever the parts; read again, the same rows."""
    from tessella.sources.text import read_delimited

    cells = ["plain", ' "quoted" ', "two\nlines", "a;b", "", None, "\r", "x,y", "  spaces  "]
    rows = [(k, f"r{k}", cells[k % len(cells)], str(k % 3 + 1) if k % 4 else None) for k in range(95)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, id string, `a b.c` string, segment_id string").repartition(6)
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '";\n\r') else v
    want = export.BOM + "".join(";".join(quote(v or "") for v in r) + "\n" for r in [("id", "a b.c", "segment_id"), *[r[1:] for r in rows]])
    path = tmp_path / "out_segments.csv"
    for parts in (1, 4, 95):
        export.write_labelled(df, f"file://{path}", ROW_ID, delimiter=";", parts=parts)
        assert path.is_file() and path.read_bytes().decode() == want
        assert not (tmp_path / "out_segments.csv.parts").exists()
    back = [tuple(r) for r in read_delimited(spark, str(path), delimiter=";").orderBy(ROW_ID).collect()]
    assert back == [tuple(v if k == 0 else v or "" for k, v in enumerate(r)) for r in rows]
    export.write_labelled(df.filter("false"), f"file://{path}", ROW_ID)
    assert path.read_bytes().decode() == export.BOM + "id,a b.c,segment_id\n"


def test_ward_matches_a_plain_search():
    x, truth = blobs(150, 4, 4, 8, 7)
    tree = cluster.ward_tree(x)
    assert rand_index(tree.cut(4), truth) > 0.95 and (np.diff(tree.height) >= -1e-9).all()
    assert [tree.cut(k).max() + 1 for k in (2, 3, 5, 10)] == [2, 3, 5, 10]
    x = np.random.default_rng(5).normal(size=(24, 2))
    groups = [[i] for i in range(len(x))]
    while len(groups) > 3:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    got = cluster.ward_tree(x).cut(3)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == c).tolist()) for c in range(3)}


def test_pca(spark):
    """Over all rows and any partitions; the range finder agrees with the whole covariance."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=2000)
    x = np.stack([10 * a, 5 * a + 0.1 * rng.normal(size=2000), *(0.1 * rng.normal(size=(3, 2000)))], axis=1) + 1000
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(6)
    pca = reduce.fit_pca(df, 5, 2)
    assert pca.ratios[0] > 0.95 and abs(pca.components[0][:2]) @ abs(pca.components[0][:2]) > 0.99
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    full = reduce.fit_pca(df, 5, 5)
    assert full.variances == pytest.approx(want, rel=1e-6, abs=1e-9) and full.mean == pytest.approx(x.mean(0))
    y = (x - full.mean) @ full.components.T
    assert np.linalg.norm(y[0] - y[1]) == pytest.approx(np.linalg.norm(x[0] - x[1]))
    shape = rng.normal(size=(6, 80)) * np.array([9, 7, 5, 3, 2, 1.5])[:, None]
    z = rng.normal(size=(1500, 6)) @ shape + 0.05 * rng.normal(size=(1500, 80)) + 3
    df = spark.createDataFrame([(v.tolist(),) for v in z], "features array<double>").repartition(4)
    exact, found = reduce.fit_pca(df, 80, 5), reduce.fit_pca(df, 80, 5, gram_dim=10)
    assert found.variances == pytest.approx(exact.variances, rel=1e-6) and found.ratios == pytest.approx(exact.ratios, rel=1e-6)
    assert found.components == pytest.approx(exact.components, abs=1e-4)
    assert reduce.fit_pca(df.limit(0), 80, 3).size == 1
    assert reduce.axis_drivers(np.array([0.1, -0.9, 0.5]), ["a", "b", "b"]) == ["−b", "+a"]


def test_scores_and_choice(spark):
    x, truth = blobs(200, 3, 3, 12, 21)
    noise = np.random.default_rng(1).integers(0, 3, 200)
    assert evaluate.silhouette(x, truth) > 0.6 and evaluate.silhouette(x, truth) - evaluate.silhouette(x, noise) > 0.3
    assert evaluate.silhouette(x[:2], truth[:2]) == 0 and evaluate.choose_k([]) == 3
    scores = evaluate.k_scan(x, range(2, 7))
    assert evaluate.choose_k(scores) == 3
    table = spark.createDataFrame([(s.k, float(s.inertia), float(s.silhouette), float(s.min_share)) for s in scores], "k int, inertia double, silhouette double, min_share double")
    assert [r.k for r in evaluate.choose_k_table(table).filter("chosen").collect()] == [3]


def test_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 5.0, None, 100.0)], "x double")
    s = stats.numeric_stats(df, ["x"]).first()
    assert (s.n, s.missing, s["min"], s["max"]) == (6, 1, 1, 100) and s["mean"] == pytest.approx(115 / 6) and s.skewness > 1
    empty = stats.numeric_stats(df.filter("false"), ["x"]).first()
    assert empty.n == 0 and empty["mean"] == 0 and empty.median == 0


@pytest.mark.parametrize(("cuts", "few"), [(3, 0), (40, 0), (40, 500_000), (1024, 500_000)])
def test_block_quantiles_are_exact(spark, monkeypatch, cuts, few):
    """Hot values, ties, gaps and groups: the same as numpy's linear quantiles, however few cuts there are and wherever places are found."""
    monkeypatch.setattr(blocks, "CUTS", cuts)
    monkeypatch.setattr(blocks, "FEW", few)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.lognormal(3, 4, 3000), np.full(1500, 7.0), np.arange(500) - 250.0])
    y = np.where(rng.random(5000) < 0.4, np.nan, rng.integers(0, 3, 5000))
    group = np.arange(5000) % 4 - 1
    df = spark.createDataFrame([(float(a), None if b != b else float(b), None, 2.0, int(g)) for a, b, g in zip(x, y, group, strict=True)], "`a.x` double, y double, z double, c double, g int").repartition(5)
    names, shares = ["a.x", "y", "z", "c"], [0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0]
    table = np.stack([x, y, np.full(5000, np.nan), np.full(5000, 2.0)], axis=1)
    want = lambda rows: np.array([[np.quantile(c[~np.isnan(c)], p) if (~np.isnan(c)).any() else np.nan for p in shares] for c in rows.T])
    assert blocks.quantiles(df, names, shares)[0] == pytest.approx(want(table), rel=1e-12, nan_ok=True)
    got, n, means = blocks.quantiles(df, names, shares, group="g", groups=3, means=True)
    for g in range(3):
        assert got[g] == pytest.approx(want(table[group == g]), rel=1e-12, nan_ok=True)
        assert n[g].tolist() == (~np.isnan(table[group == g])).sum(0).tolist()
        assert means[g][[0, 1, 3]] == pytest.approx(np.nanmean(table[group == g][:, [0, 1, 3]], axis=0))


def test_shades_ranges_and_sizes(spark):
    from tessella.functions import scalars
    from tessella.plans.session import memory_estimate

    shades = spark.sql("SELECT explode(array(0D, 0.25D, 1D, 2D, 100D)) AS x").select(scalars.lift_intensity(F.col("x")).alias("s")).collect()
    assert [r.s for r in shades] == pytest.approx([-1, -1, 0, 1 / 1.2, 1])
    x = np.concatenate([np.arange(1000.0), [1e6, -1e6]])
    low, high = reduce.plot_range(x)
    assert low == pytest.approx(4 - 0.06 * 991, abs=3) and high == pytest.approx(995 + 0.06 * 991, abs=3)
    assert reduce.plot_range(np.array([])) == (0.0, 1.0) and reduce.plot_range(np.array([5.0])) == (4.0, 6.0)
    specs = [ColumnSpec(0, "a", "numeric", "numeric", "feature"), ColumnSpec(1, "b", "categorical", "categorical", "profile"), ColumnSpec(2, "c", "text", "text", "ignore")]
    assert memory_estimate(100, specs) == 1200


def test_first_levels_are_told_exactly(spark):
    """Whatever the partitions and the order in them: the levels that appear first, also with exactly as many as fit."""
    rng = np.random.default_rng(8)
    rows = [(int(r), f"v{rng.integers(0, 400)}", None if rng.random() < 0.3 else f"w{rng.integers(0, 20)}") for r in rng.permutation(3000)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, f"{ROW_ID} long, `a.b` string, c string").repartition(parts)
        for cap in (20, 50, 1000):
            found = {}
            for r in stats.first_levels(df, ["a.b", "c"], ROW_ID, cap).collect():
                found.setdefault(r.k, {})[r.value] = r.first_row
            for k in (0, 1):
                first = {}
                for row in sorted(rows):
                    if row[k + 1] is not None:
                        first.setdefault(row[k + 1], row[0])
                want = sorted(first.items(), key=lambda x: x[1])[: cap + 1]
                assert sorted(found[k].items(), key=lambda x: x[1])[: cap + 1] == want
                assert (len(found[k]) > cap) == (len(first) > cap)
            specs = [ColumnSpec(0, "a.b", "categorical", "categorical", "feature"), ColumnSpec(1, "c", "categorical", "categorical", "feature")]
            kept = {r[0] for r in capped_levels(df, specs, cap=cap).select("`a.b`").distinct().collect()} - {None}
            first = list(dict.fromkeys(r[1] for r in sorted(rows)))
            assert kept == set(first[:cap])


def test_block_summaries(spark):
    """Moments are those of all rows whatever the partitions, also far from zero."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(1e6, 1, 4000), rng.lognormal(0, 1, 4000), np.where(rng.random(4000) < 0.5, np.nan, 3.0)], axis=1)
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], "a double, b double, c double").repartition(7)
    m = blocks.summarise(df, ["a", "b", "c"])
    assert m.rows == 4000 and m.n.tolist() == (~np.isnan(x)).sum(0).tolist()
    rest = x - np.nanmean(x, axis=0)
    assert m.mean == pytest.approx(np.nanmean(x, axis=0), rel=1e-12) and m.m2 == pytest.approx(np.nansum(rest**2, axis=0), rel=1e-9)
    assert m.m3 == pytest.approx(np.nansum(rest**3, axis=0), rel=1e-6, abs=1e-6) and m.low == pytest.approx(np.nanmin(x, axis=0)) and m.high == pytest.approx(np.nanmax(x, axis=0))
    logs = np.log1p(np.maximum(x, 0))
    assert m.log_mean == pytest.approx(np.nanmean(logs, axis=0)) and m.log_m2 == pytest.approx(np.nansum((logs - np.nanmean(logs, axis=0)) ** 2, axis=0), rel=1e-6, abs=1e-9)


def test_a_block_encodes_as_expressions_do(spark):
    """Twenty columns of every kind and transform, with gaps: the kernel's values are the expressions'."""
    rng = np.random.default_rng(6)
    modes = ["standard", "robust", "log", "quantile", "minmax"]
    rows = []
    for k in range(600):
        numbers = [None if rng.random() < 0.1 else float(rng.lognormal()) for _ in range(15)]
        words = [None if rng.random() < 0.05 else f"w{min(int(rng.exponential(3)), 40)}" for _ in range(5)]
        rows.append((k, *numbers, *words))
    df = spark.createDataFrame(rows, f"{ROW_ID} long, " + ", ".join([f"`n.{k}` double" for k in range(15)] + [f"t{k} string" for k in range(5)])).repartition(3)
    specs = [ColumnSpec(k, f"n.{k}", "numeric", "numeric", "feature", modes[k % 5], weight=1 + k % 2) for k in range(15)] + [ColumnSpec(15 + k, f"t{k}", "categorical", "categorical", "feature") for k in range(5)]
    plan = encode.fit_encoding(df, specs, ROW_ID)
    values = [np.array([r.features for r in plan.encode(df, ROW_ID, block=way).orderBy(ROW_ID).collect()]) for way in (False, True)]
    assert values[0].shape[1] == plan.size > 40 and values[1] == pytest.approx(values[0], abs=1e-9)
    big = spark.createDataFrame([(k, float(v)) for k, v in enumerate(rng.normal(size=25_000))], f"{ROW_ID} long, x double").repartition(3)
    plan = encode.fit_encoding(big, [ColumnSpec(0, "x", "numeric", "numeric", "feature", "quantile")], ROW_ID)  # ranks in a table
    values = [np.array([r.features for r in plan.encode(big, ROW_ID, block=way).orderBy(ROW_ID).collect()]) for way in (False, True)]
    assert plan.features[0].looked_up and values[1] == pytest.approx(values[0], abs=1e-9)


def test_wide_tables_are_parsed_as_narrow_ones_are(spark, monkeypatch):
    cells = ["1,234", "¥5", "(7)", "", "なし", "x", "12.5%", "2024-03-15", "2024年3月1日", "yes", "いいえ", None]
    df = spark.createDataFrame([(k, *[cells[(k + j) % len(cells)] for j in range(9)]) for k in range(24)], f"{ROW_ID} long, " + ", ".join(f"`c.{j}` string" for j in range(9)))
    specs = [ColumnSpec(j, f"c.{j}", kind, kind, "feature") for j, kind in enumerate(["numeric", "datetime", "boolean"] * 3)]
    rows = lambda: [tuple(r) for r in typed_table(df, specs).orderBy(ROW_ID).collect()]
    narrow = rows()
    monkeypatch.setattr("tessella.plans.session.WIDE", 4)
    assert rows() == narrow and any(v is not None for r in narrow for v in r[1:])


def test_inference(spark):
    words = ["red", "blue", "green"]
    prose = "これは自由記述です。とても長い文章なので、分類には使いません。番号"
    rows = [(k, str(k * 3), words[k % 3], f"U{k}", f"2024-01-{k % 28 + 1:02d}", prose + str(k), "same", "yes" if k % 2 else "no", "") for k in range(60)]
    names = ["price", "color", "user id", "day", "memo", "fixed", "flag", "void"]
    df = spark.createDataFrame(rows, [ROW_ID, *names])
    kinds = {s.name: (s.kind, s.role) for s in infer.infer_columns(df, ROW_ID)}
    assert kinds == {"price": ("numeric", "feature"), "color": ("categorical", "feature"), "user id": ("identifier", "ignore"), "day": ("datetime", "feature"), "memo": ("text", "ignore"), "fixed": ("constant", "ignore"), "flag": ("boolean", "feature"), "void": ("empty", "ignore")}


def test_specs():
    s = ColumnSpec(0, "a", "categorical", "categorical", "profile")
    assert s.with_kind("text").role == "ignore" and s.with_kind("text").with_kind("numeric").role == "feature" and s.with_kind("numeric").role == "profile"
    assert all_features([s])[0].role == "feature" and no_features(all_features([s]))[0].role == "ignore"
    for bad in ({"k": 1}, {"algorithm": "x"}, {"k_max": 31}):
        with pytest.raises(ValueError):
            RunOptions(**bad)
    with pytest.raises(ValueError):
        s.replace(weight=21)


@pytest.mark.parametrize("mode", ["standard", "robust", "log", "quantile", "minmax"])
def test_every_transform_is_finite_and_clipped(spark, mode):
    df = spark.range(500).select(F.col("id").alias(ROW_ID), F.when(F.col("id") % 10 != 0, F.exp(F.col("id") / 40.0)).alias("x"))
    plan = encode.fit_encoding(df, [ColumnSpec(0, "x", "numeric", "numeric", "feature", mode)], ROW_ID)
    rows = np.array([r.features for r in plan.encode(df).collect()])
    assert rows.shape == (500, 2) and np.isfinite(rows).all() and abs(rows[:, 0]).max() <= 6


def test_quantiles_rank_every_row(spark):
    """30,000 rows, 25,000 distinct values: every score is that of the rank over all rows."""
    x = np.concatenate([np.random.default_rng(2).permutation(24_999) ** 1.5, np.full(5_001, 7.25)])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], f"{ROW_ID} long, x double").repartition(5)
    plan = encode.fit_encoding(df, [ColumnSpec(0, "x", "numeric", "numeric", "feature", "quantile")], ROW_ID)
    got = np.array([r.features[0] for r in plan.encode(df, ROW_ID).orderBy(ROW_ID).collect()])
    below = np.searchsorted(np.sort(x), x)
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in np.clip((below + 0.5) / len(x), 0.0005, 0.9995)], abs=1e-6)


@pytest.mark.parametrize("bucket", [7, 100, 10_000])
def test_ranks_in_ranges(spark, bucket):
    x = np.random.default_rng(3).integers(-300, 300, 2000) / 4
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    ranks = encode.fit_ranks(df, "x", knots=20, bucket=bucket)
    want = {v: int((x < v).sum()) for v in x.tolist()}
    assert {r.value: r.below for r in ranks.table.collect()} == want and ranks.n == 2000
    assert len(ranks.values) <= 20 and list(ranks.below) == [want[v] for v in ranks.values]


def test_one_column_has_total_variance_of_one(spark):
    df = spark.range(1000).select(F.col("id").alias(ROW_ID), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("c"))
    rows = np.array([r.features for r in encode.fit_encoding(df, [ColumnSpec(0, "c", "categorical", "categorical", "feature")], ROW_ID).encode(df).collect()])
    assert rows.shape[1] == 4 and rows.var(0).sum() == pytest.approx(1)


def test_typed_table_counts_late_levels_as_missing(spark):
    df = spark.range(40).select(F.col("id").alias(ROW_ID), F.concat(F.lit("v"), F.col("id")).alias("c"))
    specs = [ColumnSpec(0, "c", "categorical", "categorical", "feature")]
    typed = capped_levels(typed_table(df, specs), specs, cap=10)
    assert typed.filter("c is not null").count() == 10 and typed.count() == 40


@pytest.fixture(scope="module")
def customers(spark):
    return demo_customers(spark, 3000, truth=True).persist()


@pytest.fixture(scope="module")
def session(spark, customers):
    s = Session(spark)
    found = s.load(customers, name="customers.csv")
    s.specs = [x.replace(role="ignore") if x.name == "真のセグメント" else x for x in found.specs]
    s.found = found
    return s


def test_demo_inference(session):
    kinds = {s.name: s.kind for s in session.found.specs}
    assert (kinds["顧客ID"], kinds["年齢"], kinds["累計購入金額"], kinds["会員ランク"], kinds["最終購入日"], kinds["都道府県"]) == ("identifier", "numeric", "numeric", "categorical", "datetime", "categorical")
    assert session.found.rows == 3000 and len(session.found.preview) == 30


def test_run_with_k(session, customers, tmp_path):
    r = session.run(session.specs, RunOptions(k=5))
    ari = evaluate.adjusted_rand(r.labels.join(customers.select(ROW_ID, F.col("真のセグメント").alias("truth")), ROW_ID), "label", "truth").first()[0]
    assert ari > 0.5 and r.silhouette > 0.1 and sum(s["share"] for s in r.segments) == pytest.approx(1)
    assert all(s["size"] > 0 and s["name"] for s in r.segments) and len({s["name"] for s in r.segments}) == 5 and len(r.scores) == 9
    assert r.scatter.count() == 3000 and len(r.axis_labels) == 2
    profile = open(session.export("profile", str(tmp_path))).read()
    assert profile.startswith("﻿列,種別,水準,指標,全体,1: ") and "効果量(z),0.00" in profile and "セグメント,名称,件数,構成比,主な特徴" in profile
    assert "## セグメント一覧" in open(session.export("markdown", str(tmp_path))).read()
    session.export("labeled", str(tmp_path))
    back = session.spark.read.csv(str(tmp_path / "customers_segments.csv"), header=True)
    assert back.count() == 3000 and {int(r.segment_id) for r in back.select("segment_id").distinct().collect()} == {1, 2, 3, 4, 5}


def test_auto_k_and_ward(session):
    r = session.run(session.specs, RunOptions(k_max=8))
    assert 2 <= r.k <= 8 and len(r.scores) == 7 and min(s["share"] for s in r.segments) >= 0.01
    w = session.run(session.specs, RunOptions(k=5, algorithm="ward"))
    assert w.k == 5


def test_stride_leaves_rows_without_a_segment(session):
    r = session.run(session.specs, RunOptions(k=3, max_rows=1000))
    assert r.rows == 1000
    assert session.labelled().filter("segment_id is null").count() == 2000


def test_all_missing_rows_are_counted(spark):
    s = Session(spark)
    rows = "\n".join(f"{i},{a},{b},{c}" for i, a, b, c in [(1, 10, 1, "A"), (2, 20, 2, "B"), (3, "", "", ""), (4, 30, 3, "A"), (5, 40, 4, "B"), (6, "", "", ""), (7, 50, 5, "A"), (8, 60, 6, "B")])
    s.load(from_text(spark, "id,金額,回数,ランク\n" + rows))
    specs = [ColumnSpec(1, "金額", "numeric", "numeric", "feature"), ColumnSpec(2, "回数", "numeric", "numeric", "feature"), ColumnSpec(3, "ランク", "categorical", "categorical", "feature")]
    r = s.run(specs, RunOptions(k=2))
    assert r.rows == 8 and r.effective_rows == 6 and r.labels.count() == 8 and r.warnings


def test_wide_table_goes_through_pca(spark):
    df = wide_numeric(spark, 1000, 80).persist()
    s = Session(spark)
    s.load(df.drop("truth"))
    r = s.run([ColumnSpec(k, f"f{k}", "numeric", "numeric", "feature") for k in range(80)], RunOptions(k=4, k_max=4))
    assert r.reduced == 50 and evaluate.adjusted_rand(r.labels.join(df.select(ROW_ID, "truth"), ROW_ID), "label", "truth").first()[0] > 0.9


def test_names_are_distinct(spark):
    marks = spark.createDataFrame([(0, 1, "a", "high", None), (1, 1, "a", "high", None)], "label int, rank int, column string, direction string, level string")
    assert [r["name"] for r in explain.segment_names(marks, 3).orderBy("label").collect()] == ["高a層", "高a層2", "セグメント3"]


def test_csv_fields():
    assert export.csv_row(["a", 'b"c', "d,e", None, "x\ny"]) == 'a,"b""c","d,e",,"x\ny"' and export.file_name("profile", "data.v1.csv") == "data.v1_profile.csv"


def test_stream_scoring(spark, tmp_path):
    from tessella.streaming.scoring import score_stream

    df = spark.range(100).select(F.col("id").alias(ROW_ID), (F.col("id") % 10).cast("double").alias("x"))
    plan = encode.fit_encoding(df, [ColumnSpec(0, "x", "numeric", "numeric", "feature")], ROW_ID)
    df.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), plan, np.array([[-1.0], [1.0]]), ROW_ID)
    q = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").groupBy("label").count().count() == 2
