"""Operators 11 to 13 against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import catalog, sort_means, spelling, topk_search

VECTORS = "vec_id long, embedding array<float>"
UNUSABLE = [None, [], [1.0], [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")] * 8]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def same_as_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas().astype("string").fillna("-")
    want = duck(catalog.SQL[name]).astype("string").fillna("-")
    assert sorted(got.columns) == sorted(want.columns)
    lines = lambda f: sorted(map(tuple, f[sorted(f.columns)].replace(r"\.0$", "", regex=True).to_numpy().tolist()))
    assert lines(got) == lines(want)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_sort_means", "op13_topk"])
def test_whole_tables_by_sql(spark, sf, duck, name):
    same_as_sql(spark, sf, duck, name)


# --- spelling variants


def near(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows, min_chars=5, min_count=3, typo=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def brute_variants(n, ratio=2):
    own = {w: sorted((-n[v], v) for v in n if near(w, v)) for w in n}
    form = {w: v[0][1] if v and -v[0][0] >= ratio * n[w] else None for w, v in own.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(own[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def texts():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Straße", "ÀÀÀÀÀ", "àÀÀÀÀ", "naïveté", "x" * 300]
    rows = []
    for i in range(120):
        words = [rng.choice(base) for _ in range(60)]
        words = [w if rng.random() < 0.7 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "b", "éa"]) + w[k + 1 :] for w in words]
        rows.append((i, rng.choice([" ", ", ", "\n", "1", "Ж", "中"]).join(words)))
    return [*rows, (None, "aaaaa aaaaa Straße"), (7, rows[7][1]), (7, rows[7][1]), (200, None), (201, ""), (202, "y" * 100_000), (203, "abcab " * 50_000)]


def test_spelling_by_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, word int, half int").repartition(4)
    want = brute_words(rows)
    assert rows_of(spelling.word_counts(df), "word", "n") == sorted(want.items(), key=str)
    cols = ("word", "form", "root", "n", "n_near", "form_n")
    expected = brute_variants(want)
    assert sum(x[4] for x in expected) > 300 and any(x[1] and x[1] != x[2] for x in expected)
    assert rows_of(spelling.spelling_variants(df, typo=97), *cols) == expected
    # Many small tasks, and halves whose words are dealt over parts.
    assert rows_of(spelling.spelling_variants(df, typo=97, bucket_words=50, part_words=3), *cols) == expected
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    renamed = df.select(F.col("doc_id").alias("d.id"), F.col("text").alias("a.text"), F.lit(1).alias("n"))
    assert rows_of(spelling.spelling_variants(renamed, id_col="d.id", text_col="a.text", typo=97), *cols) == expected


def test_automata_number_words_and_find_half_exact_ones():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(900)})
    found = spelling.Automaton(words)
    assert len(found.edges) < sum(map(len, words)) / 4  # equal ends are shared
    for number, word in enumerate(words):  # a path's number is its word's place
        state = at = 0
        for c in word:
            state, skip = found.edges[state][c]
            at += skip
        assert found.final[state] and at == number
    for word in rng.sample(words, 150) + ["abcabcabc", "", "zz"]:
        half = len(word) // 2
        assert {words[x] for x in found.near(word, half)} == {v for v in words if near(word, v) and v.startswith(word[:half])}
    assert spelling.Automaton([]).near("abc", 1) == set()


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w30")], "word string, form string")
    assert rows_of(spelling.roots(links), "word", "root") == sorted([(f"w{k}", "w37") for k in range(37)] + [("x", "w37")], key=str)


# --- centroids


def brute_sort_means(rows, k, rounds, dim, scale=256):
    kept = [(i, tuple(int(np.floor(np.float64(np.float32(x)) * scale)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for turn in range(rounds + 1):
        label = [min(range(len(centers)), key=lambda c: (gap(v, centers[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centers)):
                own = [v for (_, v), at in zip(kept, label, strict=True) if at == c]
                if own:
                    centers[c] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    d = [gap(v, centers[c]) for (_, v), c in zip(kept, label, strict=True)]
    inertia = defaultdict(int)
    for c, x in zip(label, d, strict=True):
        inertia[c] += x
    return sorted(((i, c, x, inertia[c], sum(d), list(centers[c])) for (i, _), c, x in zip(kept, label, d, strict=True)), key=str)


RESULT = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


@pytest.mark.parametrize("size", [0.5, 0.004, 1e4])
def test_sort_means_by_brute_force(spark, size):
    """Also with so small components that most distances tie, and such large ones that doubles don't hold them."""
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(6, 8))
    rows = [(k, (size * (hubs[k % 6] + 0.3 * rng.normal(size=8))).astype(np.float32).tolist()) for k in range(150)]
    rows += [(k, rows[0][1]) for k in range(150, 170)] + [rows[3], rows[3], (None, rows[5][1]), (None, rows[6][1])] + [(300 + k, v) for k, v in enumerate(UNUSABLE)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], VECTORS + ", cluster int, x string").repartition(3)
    assert rows_of(sort_means.sort_means(df, k=12, rounds=4, dim=8), *RESULT) == brute_sort_means(rows, 12, 4, 8)
    few = spark.createDataFrame(rows[:5], VECTORS)
    assert rows_of(sort_means.sort_means(few, k=12, dim=8), *RESULT) == brute_sort_means(rows[:5], 12, 5, 8)


def test_sort_means_of_odd_tables(spark):
    empty = sort_means.sort_means(spark.createDataFrame([(1, None)], VECTORS))
    assert empty.count() == 0 and empty.columns == list(RESULT)
    with pytest.raises(ValueError, match="result"):
        sort_means.sort_means(empty, id_col="cluster")
    with pytest.raises(Exception, match="beyond"):
        sort_means.sort_means(spark.createDataFrame([(1, [1e30, 0.0])], VECTORS), dim=2)
    dotted = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], VECTORS).toDF("a.id", "a.v")
    assert sort_means.sort_means(dotted, id_col="a.id", vector_col="a.v", dim=2).columns[0] == "a.id"


def test_the_scan_stops_and_loses_no_nearest():
    rng = np.random.default_rng(8)
    hubs = rng.integers(-3000, 3000, size=(30, 6))
    x = (hubs[rng.integers(0, 30, 4000)] + rng.integers(-40, 40, size=(4000, 6))).astype(np.int64)
    order, apart = sort_means._distances(hubs)
    brute = np.stack([sort_means._gaps(x, c) for c in hubs], axis=1)
    label, gap, taken = sort_means.nearest(x, rng.integers(0, 30, 4000), hubs, order, apart)
    assert (label == brute.argmin(1)).all() and (gap == brute.min(1)).all()
    again, _, fewer = sort_means.nearest(x, label, hubs, order, apart)
    assert (again == label).all() and fewer < 2 * len(x) < taken  # from the right start hardly anything is looked at


# --- inner products


def brute_top(rows, k=5, scale=256, dim=None, dtype=np.float32):
    kept = [(i, [int(np.floor(np.float64(dtype(x)) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = dim or Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = [(i, v) for i, v in kept if len(v) == dim]
    out = []
    for i, v in kept:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in kept if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def skewed(n, dim, seed=2):
    """Rows of very different length, a few of them far out, as inner products favour."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.pareto(2.5, size=(n, 1)) * np.exp(-np.arange(dim))
    return [(int(k), v.astype(np.float32).tolist()) for k, v in enumerate(x)]


@pytest.mark.parametrize("parts", [10_000, 60, 7])
def test_top_products_by_brute_force(spark, parts):
    rows = skewed(900, 8)
    rows[100:140] = [(k, rows[100][1]) for k in range(100, 140)]  # ties
    rows += [(2000, [0.0] * 8), (2050, [-9.0] * 8), (None, [1.0] * 8), *[(3000 + k, v) for k, v in enumerate(UNUSABLE)]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS + ", part int").repartition(4)
    got = topk_search.top_inner_products(df, df.filter("vec_id % 50 = 0"), part_rows=parts, query_rows=parts)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(rows)


def test_top_products_of_small_and_large_values(spark):
    few = [(0, [1.0, 2.0]), (1, [3.0, -4.0]), (50, [0.5, 0.25])]
    df = spark.createDataFrame(few, VECTORS)
    assert rows_of(topk_search.top_inner_products(df, df.filter("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score") == brute_top(few)
    assert topk_search.top_inner_products(df.limit(0), df).count() == 0
    assert topk_search.top_inner_products(df, df.limit(0)).count() == 0
    rng = np.random.default_rng(6)
    big = [(k, (rng.normal(size=4) * 1e5).tolist()) for k in range(60)]  # products beyond what doubles hold
    big += [(k, big[0][1]) for k in range(60, 70)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>").toDF("a.id", "a.v")
    got = topk_search.top_inner_products(df, df.filter("`a.id` % 50 = 0"), id_col="a.id", vector_col="a.v", part_rows=20)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(big, dtype=np.float64)


def test_the_search_stops_before_all_rows():
    rows = skewed(4000, 8)
    x = np.floor(np.array([v for _, v in rows], np.float64) * 256)
    ids = np.arange(4000)
    asked = np.arange(0, 4000, 50)
    floor = np.full(len(asked), topk_search.LEAST)
    q, who, score, taken = topk_search.search(ids, x, asked, x[asked], floor, 5)
    assert taken < 0.3 * len(asked) * len(ids)
    want = [(i, j, s) for i, _, j, s in brute_top(rows)]
    assert sorted(((int(a), int(b), int(c)) for a, b, c in zip(q, who, score, strict=True)), key=str) == sorted(want, key=str)
    kth = np.array([min(s for a, _, s in want if a == i) for i in asked])
    again = topk_search.search(ids, x, asked, x[asked], kth, 5)
    assert again[3] <= taken and {(a, b) for a, b in zip(again[0], again[1], strict=True)} >= {(i, j) for i, j, _ in want}
