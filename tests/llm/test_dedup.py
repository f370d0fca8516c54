import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import graph, line_dedup, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string"
LONG = "The quick brown fox jumps over the lazy dog again and again"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).repartition(parts)


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- lines


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")}:
            if len(x) >= min_chars:
                holders[x].append(i)
    holders = {x: {i for i in own if i is not None} for x, own in holders.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = [(k, f"Own line number {k}\n  {LONG.upper() if k % 2 else LONG}\t\nend") for k in range(8)] + [
    (8, None), (9, ""), (10, "\n\n"), (11, LONG), (11, LONG), (12, "é" * 39 + "\n" + "é" * 40), (13, "é" * 40 + "\n" + "é" * 40), (14, "É" * 40), (15, "é" * 40), (16, "é" * 40), (17, "é" * 40), (None, LONG), (None, "x" * 50), (18, "日本" * 20 + "\r\n" + LONG),
]


@pytest.mark.parametrize(("bits", "per_line"), [(1 << 28, 8), (1 << 28, 1), (1024, 250)])
def test_lines_by_brute_force(spark, monkeypatch, bits, per_line):
    """Filters that are far too small give the same result, too, and so do many passes."""
    monkeypatch.setattr(line_dedup, "BITS", per_line)
    out = line_dedup.line_dedup(docs(spark, LINES), max_bits=bits)
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    assert found(out, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(LINES)


def test_lines_of_an_empty_table_and_clashing_columns(spark):
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0
    names = ["key", "id", "keep", "twin", "own_twin", "drop_id", "drop_twin", "drop", "made", "kept", "__drop", "__drop_id", "__out", "a.b"]
    df = docs(spark, LINES).withColumn("n_lines", F.lit("x"))
    for k, name in enumerate(names):
        df = df.withColumn(name, F.lit(k))
    out = line_dedup.line_dedup(df)
    assert found(out, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(LINES)
    assert [tuple(r) for r in out.select(*[f"`{n}`" for n in names]).distinct().collect()] == [tuple(range(len(names)))]


@pytest.mark.parametrize("others", [1, 4])
def test_rows_that_share_an_id_are_told_apart(spark, others):
    """They count as one document, and rows without an id as none, whether or not a line is in five."""
    rows = [(None, f"{LONG}\nown {k} {LONG}") for k in range(40)] + [(7, f"{LONG}\nmine {k}") for k in range(40)] + [(9 + k, LONG) for k in range(others)]
    assert found(line_dedup.line_dedup(docs(spark, rows)), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows)


def packed_lines(keys):
    import pandas as pd

    return pd.DataFrame({"digests": [b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys[s : s + 50]) for s in range(0, len(keys), 50)]})


def twice_bits(parts, bits):
    import pandas as pd

    rows = pd.concat([p for part in parts for p in line_dedup._fill(bits, 4)(iter([packed_lines(part)]))])
    merged = {r.chunk: r.twice for r in pd.concat(line_dedup._merge(bits)(iter([rows[:9], rows[9:]]))).itertuples()}
    return np.frombuffer(b"".join(merged[c] for c in range(line_dedup.CHUNKS)), np.uint8)


def digests_of(keys):
    return b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys)


def test_merged_filters_miss_no_repeat():
    keys = [f"{LONG} {k}" for k in range(200)]
    parts = [keys[:120], keys[80:], keys[:10], [*keys[190:], *keys[190:]]]  # also within a batch
    bits = 1 << 14
    on = twice_bits(parts, bits)
    assert line_dedup._has(on, line_dedup._slots(digests_of(keys[80:120] + keys[:10] + keys[190:]), bits, 4)).all()
    assert np.unpackbits(on).mean() < 0.1


def test_each_hash_is_of_one_class(spark):
    import pandas as pd

    text = "\n".join(f"{LONG} {k}" for k in range(300))
    rows = pd.concat(line_dedup._digests(40, 7)(iter([pd.DataFrame({"id": [1, 2, 3], "twin": [b"a", b"b", b"c"], "text": [text, None, LONG]})])))
    assert set(rows["id"]) == {1, 3} and sorted(rows["turn"][rows["id"] == 1]) == list(range(7))
    assert sorted(d for x in rows["digests"] for d in np.frombuffer(x, "S16")) == sorted(np.frombuffer(digests_of([f"{LONG} {k}".lower() for k in range(300)] + [LONG.lower()]), "S16"))
    assert rows["n"].sum() == 301


def test_as_few_lines_pass_in_vain_at_any_size():
    """The share of once-seen lines that the filter lets through doesn't grow with the lines of a class."""
    shares = []
    for n in (2_000, 20_000):
        keys = [f"line {k}" for k in range(n)]
        bits = line_dedup.filter_bits(n, 1 << 28)
        assert line_dedup.BITS * n <= bits <= line_dedup.BITS * n + 128 and line_dedup.filter_bits(n, 1024) == 1024
        on = twice_bits([keys[: n // 2], keys[n // 2 :]], bits)
        shares.append(line_dedup._has(on, line_dedup._slots(digests_of(keys), bits, 4)).mean())
    assert max(shares) < 0.05


def test_filters_of_32_mb_take_little_more():
    """A pair of filters of 2 ** 28 bits and what it takes to send them, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, pandas as pd, numpy as np
from tessella.llm import line_dedup
rng = np.random.default_rng(1)
batches = [pd.DataFrame({"digests": [rng.bytes(16 * 20) for _ in range(512)]}) for _ in range(60)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for part in line_dedup._fill(1 << 28, 4)(iter(batches)):
    pass
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    import os

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.getcwd()}, timeout=120)
    assert float(out.stdout) < 110, out


# --- fingerprints


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [32_770, 32_771, 40_000, 70_000])
def test_long_texts_keep_every_shingle(monkeypatch, n):
    counted = []
    count = simhash._bit_counts
    monkeypatch.setattr(simhash, "_bit_counts", lambda rows: (counted.append(len(rows)), count(rows))[1])
    for seed in range(8):
        text = " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n))
        counted.clear()
        assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)
        assert sum(counted) == n - 2


def brute_groups(rows, prints):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)].append(d)
    return [min(low[root(i)], default=None) for i in range(len(rows))]


def test_simhash_by_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        base = list(rng.choice(words, 80))
        rows.append((3 * k, " ".join(base)))
        if k % 3 == 0:
            base[rng.integers(80)] = "Changed"
            rows.append((3 * k + 1, " ".join(base)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "One  TWO"), (505, "É é"), (0, rows[0][1]), (None, rows[0][1]), (None, "nobody else has this text at all"), (506, "a " * 40_000)]
    prints = [brute_print(t) for _, t in rows]
    out = simhash.simhash_groups(docs(spark, rows))
    want = sorted(((i, p - (1 << 64) if p >> 63 else p, g) for (i, _), p, g in zip(rows, prints, brute_groups(rows, prints), strict=True)), key=str)
    assert found(out, "doc_id", "fp", "component_id") == want
    names = ["fp", "component_id", "kept_id", "__keep", "__keep_id", "id", "a.b"]
    clash = docs(spark, rows)
    for k, name in enumerate(names):
        clash = clash.withColumn(name, F.lit(k))
    kept = simhash.simhash_dedup(clash)
    assert kept.columns == ["doc_id", "text", "lang", *names]
    assert [tuple(r) for r in kept.select(*[f"`{n}`" for n in names]).distinct().collect()] == [tuple(range(len(names)))]
    ids = [r.doc_id for r in kept.collect()]
    least = {i for i, _, g in want if i == g}
    assert sorted(map(str, ids)) == sorted(str(i) for i, _, _ in want if i in least)  # rows with one id stay together


@pytest.mark.parametrize(("segments", "tile", "stream"), [(1, 4096, 65536), (2, 8, 16), (4, 3, 5), (8, 4096, 65536)])
def test_links_connect_what_all_pairs_do(spark, segments, tile, stream):
    """Whatever the tiles; links are few, groups are those of all pairs."""
    rng = np.random.default_rng(segments)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near])).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in graph.connected_components(simhash.links(df, segments=segments, tile=tile, stream=stream)).collect()}
    groups = brute_groups([(x, "") for x in fps], [x % (1 << 64) for x in fps])
    assert [roots.get(x, x) for x in fps] == groups


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 70)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(71)} | {100: 100, 150: 100, 200: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_of_an_empty_table(spark):
    assert simhash.simhash_groups(docs(spark, [])).count() == 0 and simhash.simhash_dedup(docs(spark, [])).count() == 0


# --- substrings


def brute_substrings(rows, width):
    owner = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                owner[key] = min(owner.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {k + j for k in range(len(w) - width + 1) for j in range(width) if i is not None and owner[tuple(w[k : k + width])] < i}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def passages(seed):
    rng = np.random.default_rng(seed)
    shared = [" ".join(rng.choice([f"v{k}" for k in range(500)], 9)) for _ in range(6)]
    rows = []
    for k in range(80):
        own = [f"d{k}w{j}" for j in range(int(rng.integers(0, 12)))]
        for _ in range(int(rng.integers(0, 3))):
            own.insert(int(rng.integers(0, len(own) + 1)), shared[int(rng.integers(0, 6))])
        rows.append((int(k * 7 % 80) * 3 - 60, "\n".join(own)))
    return [*rows, (1000, None), (1001, ""), (1002, " \t"), (1003, shared[0]), (1003, shared[0] + " more"), (None, shared[0]), (1004, "the " * 3000), (1005, "the " * 40), (1006, shared[1].replace(" ", "　"))]


def test_more_buckets_and_shares_than_a_task_sends_to(spark, monkeypatch):
    """Sends and answers in two steps, and Spark's buckets with several of ours, give the same result."""
    for name, value in (("SENDS", 3), ("TABLE_BUCKETS", 4), ("BUCKET_CHARS", 200), ("SHARE_CHARS", 200), ("GATHER", 50)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = passages(9)
    out = substring_dedup.substring_dedup(docs(spark, rows), width=5, batches=3)
    assert found(out, "doc_id", "text", "n_words", "n_removed") == brute_substrings(rows, 5)


def test_an_index_for_10_tb_can_be_made(spark):
    """As many buckets and shares as 10 TB of text ask for."""
    chars = 10 * 10**12
    index = substring_dedup.FingerprintIndex(spark, width=5, buckets=chars // substring_dedup.BUCKET_CHARS, shares=chars // substring_dedup.SHARE_CHARS)
    assert index.buckets > 600_000 and index.table_buckets == 50_000
    assert index._read([]).count() == 0
    index.drop_runs()
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    cut = list(substring_dedup._slices(substring_dedup._bucket_of(keys, index.buckets)))
    assert sum(s.stop - s.start for _, s in cut) == len(keys) and len(cut) <= len(keys)  # steps follow the windows, not the buckets


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_substrings_by_brute_force(spark, batches):
    rows = passages(batches)
    out = substring_dedup.substring_dedup(docs(spark, rows), width=5, batches=batches)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_removed"]
    assert found(out, "doc_id", "text", "n_words", "n_removed") == brute_substrings(rows, 5)


def test_substrings_of_an_empty_table_and_clashing_columns(spark):
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0
    rows = passages(9)
    names = ["share", "keys", "id", "own_id", "kept", "words", "removed", "__id", "__kept", "__share", "a.b", "N_removed"]
    df = docs(spark, rows).withColumn("n_words", F.lit("x"))
    for k, name in enumerate(names):
        df = df.withColumn(name, F.lit(k))
    out = substring_dedup.substring_dedup(df, width=5)
    assert found(out, "doc_id", "text", "n_words", "n_removed") == brute_substrings(rows, 5)
    rows = out.select(*[f"`{n}`" for n in names[:-1]]).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(range(len(names) - 1))]
    with pytest.raises(TypeError, match="integer"):
        substring_dedup.substring_dedup(df.withColumn("doc_id", F.lit("x")))


def thue_morse(n, flip=0):
    return "".join("ab"[(k.bit_count() & 1) ^ flip] for k in range(n))


def test_words_of_like_make_up_are_told_apart(spark):
    """Pairs of long words that polynomials modulo 2 ** 64 can't tell apart; windows that differ in one word, or in their order."""
    rest = [f"w{k}" for k in range(12)]
    rows = []
    for n in (1024, 2048, 4096):
        for flip in (0, 1):
            rows.append((len(rows), " ".join([thue_morse(n, flip), *rest])))
            rows.append((len(rows), " ".join([*rest[:6], thue_morse(n, flip), *rest[6:]])))
    rows.append((len(rows), " ".join([*rest, "w12"])))
    rows.append((len(rows), " ".join(["w1", "w0", *rest[2:], "w12"])))
    rows.append((len(rows), rows[0][1]))
    out = substring_dedup.substring_dedup(docs(spark, rows), batches=2)
    assert found(out, "doc_id", "text", "n_words", "n_removed") == brute_substrings(rows, 13)
    assert sum(r.n_removed for r in out.collect()) == 13


def test_window_hashes_are_spread_evenly():
    """Keys and checks of a million windows of two words only: no pair agrees, bits are set half the time."""
    rng = np.random.default_rng(6)
    words = [b"x" if b else b"y" for b in rng.integers(0, 2, 200_000)]
    keys, checks = substring_dedup.Hasher(40)(words)
    assert len(np.unique(keys)) == len({tuple(words[k : k + 40]) for k in range(len(keys))})
    for values, bits in ((keys, 64), (checks, 32)):
        share = [float((values >> values.dtype.type(b) & values.dtype.type(1)).mean()) for b in range(bits)]
        assert 0.49 < min(share) and max(share) < 0.51


def test_an_index_outlives_its_calls(spark, tmp_path):
    rows = [r for r in passages(4) if r[0] is not None]
    order = sorted(rows, key=lambda r: r[0])
    cuts = [0, 30, 31, 60, len(order)]
    path, got = f"file://{tmp_path}/index", []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = order[a:b]
        index = substring_dedup.FingerprintIndex(spark, path=path, width=5, buckets=3, shares=11) if k == 0 else substring_dedup.FingerprintIndex.open(spark, path)
        got += found(substring_dedup.substring_dedup(docs(spark, part), index=index, batches=1 + k % 2), "doc_id", "text", "n_words", "n_removed")
        assert len(index.runs) <= 3
    assert sorted(got, key=str) == brute_substrings(rows, 5)
    with pytest.raises(ValueError, match="above"):
        substring_dedup.substring_dedup(docs(spark, order[:3]), index=substring_dedup.FingerprintIndex.open(spark, path))


def test_runs_are_read_where_they_lie(spark):
    """Only the batch is shuffled to meet the runs."""
    index = substring_dedup.FingerprintIndex(spark, width=5, buckets=4)
    batch = docs(spark, passages(2)).selectExpr("doc_id as id", "text").filter("id is not null")
    index.add(batch)
    mine = batch.mapInArrow(substring_dedup._extract(5, 4), "bucket int, kind int, n long, keys binary, checks binary, ids binary")
    both = mine.groupBy("bucket").cogroup(index._read([f for _, f in index.runs]).groupBy("bucket")).applyInArrow(substring_dedup._settle(11, 4096, True), substring_dedup.SETTLED_TYPE)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1
    index.drop_runs()


def test_long_texts_are_hashed_in_parts_alike():
    hasher = substring_dedup.Hasher(13)
    words = [b"w%d" % (k % 9973) for k in range(450_000)]
    keys, checks = hasher(words)
    assert len(keys) == 450_000 - 12 and len(checks) == len(keys)
    assert keys[199_990:200_020].tolist() == hasher(words[199_990:200_032])[0].tolist()


def test_a_key_that_recurs_is_settled_by_its_check():
    keys, checks = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint32)
    assert substring_dedup._found(keys, checks, np.array([5, 5, 9], np.uint64), np.array([7, 2, 4], np.uint32)).tolist() == [False, True, False]
    values = np.array([3, 1 << 60, 1 << 63], np.uint64)
    assert substring_dedup.expand(substring_dedup.shrink(values, True), np.uint64, True).tolist() == values.tolist()


def test_sql(spark, sf, duck, same_rows):
    assert same_rows(line_dedup.op9_line_dedup(spark, sf).toPandas(), duck(line_dedup.OP9_SQL))
    assert same_rows(substring_dedup.op3_substring_dedup(spark, sf).toPandas(), duck(substring_dedup.OP3_SQL))


def test_op10_over_a_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [brute_print(t) for _, t in rows]
    want = sorted((i, f"{p:016x}", g) for (i, _), p, g in zip(rows, prints, brute_groups(rows, prints), strict=True))
    assert found(simhash.op10_simhash(spark, sf), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_digest(spark, sf):
    rows = {r.doc_id: r for r in line_dedup.op9_line_dedup(spark, sf).collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    same = next(i for i, r in rows.items() if not r.n_dropped)
    assert rows[same].kept_sha256 == hashlib.sha256(text[same].encode()).hexdigest()
