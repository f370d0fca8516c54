"""Substring dedup with a log-structured fingerprint index (operator 3).

Documents come in batches of rising ids.  The window hashes of a batch are sorted
within hash buckets, merge-joined with the sorted immutable runs of all earlier
batches, and what is new becomes a run of its own; two neighbouring runs of as many
batches are compacted into one, so a history of n batches has about log2(n) runs.
Windows of one batch are settled among themselves by the smallest id.

A word's hash is xxh3 of 128 bits, keyed.  Its two halves feed two separate chains of
multiplications and shifts over the words of a window, one for the 64-bit key that
orders a run and one for a 32-bit check that verifies a hit; both travel with every
entry and every answer.  A single pair of windows agrees by chance in 2 ** -96, so
among n different windows n * n / 2 ** 97 wrong pairs are expected: about 2e-10 for
30 GB of text (5e9 windows) and 2e-3 for 100 TB.

The index is a bucketed table in the shared folder, a partition a run: runs are read
where they lie and only a batch's own windows are shuffled.  A bucket is a handful of
rows of hashes as bytes, and is bounded, as the number of buckets follows the input.  Beyond
``SENDS`` buckets or shares (65 GB and 33 GB) what tasks send is cut in two steps, so that rows of
hashes don't thin out; Spark's own buckets, which are limited, then hold several of ours.
Kept between calls, an index settles each new batch of documents against all before.

Only windows travel, never texts: a task sends a window once for the smallest id it
saw it in, and answers the others itself, so a passage that a third of all documents
share costs a task one entry.  The answers (an id and its repeated windows) then meet
the texts, dealt by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column, delete, exists, new_path, release, small_batches, table, without

#: Characters of text for one hash bucket of the index, and for one share of the final step.
BUCKET_CHARS, SHARE_CHARS = 16_000_000, 8_000_000
#: Windows a task gathers before it sorts and sends them, and windows hashed at once.
GATHER, HASH_BLOCK = 1_000_000, 50_000
#: Parts that a task cuts what it sends into; with more buckets or shares, a second shuffle cuts each part.
SENDS = 4096
#: Spark's buckets of the index at most; each holds the rows of one or more of ours.
TABLE_BUCKETS = 50_000
#: Words whose digests a task remembers, and the longest that it does.
KNOWN_WORDS, KNOWN_BYTES = 200_000, 64
#: Key of the word hash, and what the two chains start from.
SEED, STARTS = 0x5EED, (0x243F6A8885A308D3, 0x13198A2E03707344)


class _Digests(dict):
    """128 bits for each word; frequent words are looked up, and what is remembered is bounded."""

    def __missing__(self, word: bytes) -> bytes:
        digest = xxhash.xxh3_128_digest(word, SEED)
        if len(word) <= KNOWN_BYTES:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = digest
        return digest


class Hasher:
    """A 64-bit key and a 32-bit check of every window of ``width`` words."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.digests = _Digests()

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words) - self.width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        keys, checks = [], []
        for start in range(0, n, HASH_BLOCK):  # long texts in parts that overlap by a window
            part = words[start : start + HASH_BLOCK + self.width - 1]
            raw = np.frombuffer(b"".join(map(self.digests.__getitem__, part)), "<u8").reshape(-1, 2)
            keys.append(self._chain(raw[:, 0], STARTS[0]))
            checks.append((self._chain(raw[:, 1], STARTS[1]) >> np.uint64(32)).astype(np.uint32))
        return np.concatenate(keys), np.concatenate(checks)

    def _chain(self, words: np.ndarray, start: int) -> np.ndarray:
        words = np.ascontiguousarray(words)
        n = len(words) - self.width + 1
        out = np.full(n, start, np.uint64)
        for k in range(self.width):
            out ^= words[k : k + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return _mix(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []  # bytes split at ASCII white space only


def shrink(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as bytes; differences if they rise, byte planes, and zstd."""
    if rising and len(values):
        values = np.diff(values, prepend=values[:1] * 0)
    wide = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.compress(np.ascontiguousarray(wide.T).tobytes(), 1)


def expand(data: bytes, kind, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    out = np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(out, dtype=kind) if rising else out


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _extract(width: int, buckets: int):
    """Windows of a partition: sorted entries for each bucket, and answers for windows that repeat here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, task = Hasher(width), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = turn = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, turn
            if not held:
                return
            keys, checks, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            order = _order(keys, checks, ids)
            keys, checks, ids = keys[order], checks[order], ids[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]
            fresh = new | np.r_[True, ids[1:] != ids[:-1]]  # a window once for each document
            answer = fresh & ~new  # a smaller id is here
            turn += 1
            if answer.any():
                yield _rows([(task * 31 + turn) % buckets], [1], [keys[answer]], [checks[answer]], [ids[answer]])
            keys, checks, ids = keys[new], checks[new], ids[new]
            for b, s in _slices(_bucket_of(keys, buckets)):
                yield _rows([b], [0], [keys[s]], [checks[s]], [ids[s]])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, checks = hasher(_words(text))
                if len(keys):
                    held.append((keys, checks, np.full(len(keys), doc, np.int64)))
                    size += len(keys)
                    if size >= GATHER:
                        yield from send()
        yield from send()

    return run


def _finer(buckets: int):
    """Entries that were sent in coarse parts, gathered and cut by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                keys, checks, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
                order = np.argsort(keys, kind="stable")
                keys, checks, ids = keys[order], checks[order], ids[order]
                for at, s in _slices(_bucket_of(keys, buckets)):
                    yield _rows([at], [0], [keys[s]], [checks[s]], [ids[s]])

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:  # answers go to any bucket
                    spread = int(xxhash.xxh64_intdigest(r["keys"]) % buckets)
                    yield pa.RecordBatch.from_pylist([r | {"bucket": spread}], schema=batch.schema)
                else:
                    held.append((expand(r["keys"], np.uint64, True), expand(r["checks"], np.uint32), expand(r["ids"], np.int64)))
                    size += r["n"]
                    if size >= GATHER:
                        yield from send()
        yield from send()

    return run


def _finer_answers(shares: int):
    """Answers that were sent in coarse parts, gathered and cut by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                keys, checks, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
                order = np.lexsort((keys, np.mod(ids, shares)))
                keys, checks, ids = keys[order], checks[order], ids[order]
                for at, s in _slices(np.mod(ids, shares)):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([shrink(keys[s], True)]), pa.array([shrink(checks[s])]), pa.array([shrink(ids[s])])], names=["share", "keys", "checks", "ids"])

        for batch in batches:
            for r in batch.to_pylist():
                held.append((expand(r["keys"], np.uint64, True), expand(r["checks"], np.uint32), expand(r["ids"], np.int64)))
                size += len(held[-1][0])
                if size >= GATHER:
                    yield from send()
        yield from send()

    return run


def _slices(sorted_: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array and where it stands; steps follow the values that are there."""
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, int)
    for a, b in pairwise([*first.tolist(), len(sorted_)]):
        yield int(sorted_[a]), slice(a, b)


def _rows(buckets, kinds, keys, checks, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array([len(k) for k in keys], pa.int64()), pa.array([shrink(k, True) for k in keys], pa.binary()), pa.array([shrink(c) for c in checks], pa.binary()), pa.array([shrink(i) for i in ids], pa.binary())],
        names=["bucket", "kind", "n", "keys", "checks", "ids"],
    )


#: What settling a bucket gives: rows of kind "run" (no share, no ids) and of kind "answer".
SETTLED = pa.schema([("bucket", pa.int32()), ("share", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary()), ("kind", pa.string())])
SETTLED_TYPE = "bucket int, share int, n long, keys binary, checks binary, ids binary, kind string"
ANSWER = "bucket int, share int, n long, keys binary, checks binary, ids binary"


def _settle(shares: int, sends: int, keep: bool):
    """A bucket's entries of this batch against its runs: a new run, and answers by share of ids (or by part of them, if there are more than ``sends``)."""

    def run(mine: pa.Table, runs: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in SETTLED.names}
        if not len(mine):
            return pa.table(out, schema=SETTLED)
        bucket = mine.column("bucket")[0].as_py()

        def add(*row) -> None:
            for name, x in zip(SETTLED.names, (bucket, *row), strict=True):
                out[name].append(x)

        def answer(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> None:
            at = np.mod(ids, shares)
            if shares > sends:
                at = at % sends
            order = np.argsort(at, kind="stable")  # keys still rise within a share
            keys, checks, ids = keys[order], checks[order], ids[order]
            for p, s in _slices(at[order]):
                add(p, s.stop - s.start, shrink(keys[s], True), shrink(checks[s]), shrink(ids[s]), "answer")

        held = []
        for kind, keys, checks, ids in zip(*(mine.column(c).to_pylist() for c in ("kind", "keys", "checks", "ids")), strict=True):
            entries = expand(keys, np.uint64, True), expand(checks, np.uint32), expand(ids, np.int64)
            if kind:
                answer(*entries)
            else:
                held.append(entries)
        if held:
            keys, checks, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            order = _order(keys, checks, ids)
            keys, checks, ids = keys[order], checks[order], ids[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])]
            hit = ids > ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            old = np.zeros(len(keys), bool)
            for k, c in zip(runs.column("keys").to_pylist(), runs.column("checks").to_pylist(), strict=True):
                old |= _found(keys, checks, expand(k, np.uint64, True), expand(c, np.uint32))
            if (hit | old).any():
                answer(keys[hit | old], checks[hit | old], ids[hit | old])
            fresh = new & ~old
            if keep and fresh.any():
                add(None, int(fresh.sum()), shrink(keys[fresh], True), shrink(checks[fresh]), None, "run")
        return pa.table(out, schema=SETTLED)

    return run


def _found(keys: np.ndarray, checks: np.ndarray, run: np.ndarray, run_checks: np.ndarray) -> np.ndarray:
    """Which entries are in a sorted run, check hash included (a key may recur with another check)."""
    out = np.zeros(len(keys), bool)
    at = np.searchsorted(run, keys)
    live = np.arange(len(keys))
    while True:
        live = live[at[live] < len(run)]
        live = live[run[at[live]] == keys[live]]
        if not len(live):
            return out
        same = run_checks[at[live]] == checks[live]
        out[live[same]] = True
        live = live[~same]
        at[live] += 1


def _order(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """By key, check and id; checks are sorted only where two windows share a key by chance."""
    order = np.lexsort((ids, keys))
    k, c = keys[order], checks[order]
    return np.lexsort((ids, checks, keys)) if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any() else order


def _compact(rows: pa.Table) -> pa.Table:
    keys = np.concatenate([expand(k, np.uint64, True) for k in rows.column("keys").to_pylist()])
    checks = np.concatenate([expand(c, np.uint32) for c in rows.column("checks").to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, checks = keys[order], checks[order]
    return pa.table({"bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([shrink(keys, True)], pa.binary()), "checks": pa.array([shrink(checks)], pa.binary())})


class FingerprintIndex:
    """Sorted immutable runs of the window hashes of all batches so far, in a folder that the cluster shares.

    ``FingerprintIndex(spark)`` makes a new one; with ``path`` it outlives the session, and
    ``FingerprintIndex.open(spark, path)`` goes on with it.  Ids of a later batch are above
    ``top``, the largest so far.
    """

    def __init__(self, spark: SparkSession, *, path: str | None = None, width: int = 13, buckets: int = 64, shares: int = 67) -> None:
        self.spark, self.width, self.buckets, self.shares = spark, width, buckets, shares
        self.path = path or new_path(spark, "index")
        self.kept = path is not None
        self.runs: list[tuple[int, str]] = []  # level and folder, the oldest first
        self.answers: list[str] = []
        self.top: int | None = None
        self.table = f"tessella_index_{uuid.uuid4().hex}"
        self.table_buckets = min(buckets, TABLE_BUCKETS)
        self.version = 0
        spark.sql(f"CREATE TABLE {self.table} (bucket INT, n BIGINT, keys BINARY, checks BINARY, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY (bucket) INTO {self.table_buckets} BUCKETS LOCATION '{self.path}/runs'")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        about = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        index = cls(spark, path=path, width=about.width, buckets=about.buckets, shares=about.shares)
        index.version, index.top = about.version, about.top
        for run in about.runs:
            index._attach(run.level, run.folder)
        return index

    def save(self) -> None:
        """Write the list of runs; what a crash leaves behind is the list before, whose runs are still there."""
        self.version += 1
        row = (self.version, self.width, self.buckets, self.shares, self.top, self.runs)
        kind = "version long, width int, buckets int, shares int, top long, runs array<struct<level int, folder string>>"
        self.spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _attach(self, level: int, folder: str) -> None:
        self.runs.append((level, folder))
        self.spark.sql(f"ALTER TABLE {self.table} ADD PARTITION (run='{folder}') LOCATION '{self.path}/runs/{folder}/kind=run'")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("run").isin(folders)).select("bucket", "n", "keys", "checks")

    def _write(self, rows: DataFrame) -> str:
        """Rows with a ``kind``, bucketed as the index is, so that no reader of a run has to shuffle it."""
        folder = uuid.uuid4().hex
        name = f"{self.table}_{folder}"
        rows.write.format("parquet").partitionBy("kind").bucketBy(self.table_buckets, "bucket").option("compression", "none").option("path", f"{self.path}/runs/{folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return folder

    def add(self, batch: DataFrame, *, keep: bool = True) -> None:
        """Settle a batch (``id`` long, ``text``) whose ids are above those of all batches before.

        ``keep=False`` adds no run: for a last batch, after which the index is dropped.
        """
        kind = "bucket int, kind int, n long, keys binary, checks binary, ids binary"
        mine = batch.mapInArrow(_extract(self.width, min(self.buckets, SENDS)), kind)
        if self.buckets > SENDS:
            mine = mine.repartition(SENDS, "bucket").mapInArrow(_finer(self.buckets), kind)
        both = mine.groupBy("bucket").cogroup(self._read([f for _, f in self.runs]).groupBy("bucket"))
        folder = self._write(both.applyInArrow(_settle(self.shares, SENDS, keep), SETTLED_TYPE))
        if exists(self.spark, f"{self.path}/runs/{folder}/kind=answer"):
            self.answers.append(f"{self.path}/runs/{folder}/kind=answer")
        if exists(self.spark, f"{self.path}/runs/{folder}/kind=run"):
            self._attach(0, folder)
        release(self.spark)
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self.compact()

    def compact(self) -> None:
        """The last two runs become one."""
        (level, old), (_, new) = self.runs[-2:]
        both = self._read([old, new]).groupBy("bucket").applyInArrow(_compact, "bucket int, n long, keys binary, checks binary")
        folder = self._write(both.withColumn("kind", F.lit("run")))
        self.runs = self.runs[:-2]
        self._attach(level + 1, folder)
        if self.kept:
            self.save()
        self._forget([old, new])
        release(self.spark)

    def _forget(self, folders: list[str]) -> None:
        for folder in folders:
            self.spark.sql(f"ALTER TABLE {self.table} DROP PARTITION (run='{folder}')")
            delete(self.spark, f"{self.path}/runs/{folder}/kind=run")

    def drop_runs(self) -> None:
        self._forget([f for _, f in self.runs])
        self.runs = []
        self.spark.sql(f"DROP TABLE {self.table}")

    def repeated(self) -> DataFrame:
        """``share, keys, checks, ids``: the windows of each id of this session's batches that an earlier document has."""
        if not self.answers:
            return self.spark.createDataFrame([], "share int, keys binary, checks binary, ids binary")
        parts = [self.spark.read.schema(ANSWER).parquet(p) for p in self.answers]
        found = reduce(DataFrame.union, parts).select("share", "keys", "checks", "ids")
        if self.shares > SENDS:
            found = found.repartition(SENDS, "share").mapInArrow(_finer_answers(self.shares), "share int, keys binary, checks binary, ids binary")
        return found


def _remove(width: int, text_col: str, schema: pa.Schema):
    """The documents of a share without the words that repeated windows cover."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hasher = Hasher(width)
        found = [(expand(k, np.uint64, True), expand(c, np.uint32), expand(i, np.int64)) for k, c, i in zip(*(answers.column(x).to_pylist() for x in ("keys", "checks", "ids")), strict=True)]
        keys, checks, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, k) for k in (np.uint64, np.uint32, np.int64))
        order = np.lexsort((checks, keys, ids))
        keys, checks, ids = keys[order], checks[order], ids[order]
        texts, n_words, n_removed = [], [], []
        for doc, text in zip(docs.column("id").to_pylist(), docs.column(text_col).to_pylist(), strict=True):
            words = _words(text)
            gone = 0
            a, b = (0, 0) if doc is None else (int(np.searchsorted(ids, doc, side)) for side in ("left", "right"))
            if b > a:
                own = hasher(words)
                hit = np.flatnonzero(_found(*own, keys[a:b], checks[a:b]))
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + width, -1)
                bare = np.cumsum(cover[:-1]) == 0
                gone = len(words) - int(bare.sum())
                texts.append(b" ".join([w for w, keep in zip(words, bare.tolist(), strict=True) if keep]))
            else:
                texts.append(b" ".join(words))
            n_words.append(len(words))
            n_removed.append(gone)
        new = {"kept": [t.decode("utf-8", "surrogatepass") for t in texts], "n_words": n_words, "n_removed": n_removed}
        return pa.table([pa.array(new[f.name], f.type) if f.name in new else docs.column(f.name).combine_chunks() for f in schema], schema=schema)

    return run


def _prime(n: int) -> int:
    """The least prime from ``n`` on: ids in any common step are dealt evenly by it."""
    return next(p for p in range(n, 2 * n + 2) if all(p % k for k in range(2, int(p**0.5) + 1)))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, batches: int = 4, index: FingerprintIndex | None = None) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts in a document with a smaller id.

    Words are runs of anything but ASCII white space.  Returns the rows of ``docs`` with
    ``text_col`` replaced by the kept words joined by one space, and ``n_words`` and
    ``n_removed`` (they replace input columns of the same name).  With ``index``, documents
    of earlier calls count, too (all ids of ``docs`` must be above theirs), and the windows
    of ``docs`` are added to it and saved.

    Defined cases: a null or empty text has no words and comes out empty; a text under
    ``width`` words has no window.  Rows with the same id are one document: they lose
    nothing to each other.  A row with a null id neither takes words from others nor
    loses any.  An empty table gives an empty table.  Other columns may have any name.
    Ids that aren't integers are refused.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, not {docs.schema[id_col].dataType.simpleString()}")
    small_batches(spark)
    batches = max(1, batches)
    base = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text")).filter("id is not null")
    cuts = [k / batches for k in range(1, batches)]
    about = base.agg(F.sum(F.octet_length("text")).alias("chars"), F.min("id").alias("low"), F.max("id").alias("top"), (F.percentile_approx("id", F.array(*map(F.lit, cuts)), 10_000) if cuts else F.lit(None)).alias("cuts")).first()
    chars = about.chars or 0
    lasting = index is not None
    if lasting and about.low is not None and index.top is not None and about.low <= index.top:
        raise ValueError(f"ids must be above {index.top}, the largest of the index")
    if not lasting:
        index = FingerprintIndex(spark, width=width, buckets=max(8, -(-chars // BUCKET_CHARS)), shares=_prime(max(11, -(-chars // SHARE_CHARS))))
    index.answers = []
    edges = [None, *dict.fromkeys(about.cuts or []), None]
    for low, high in pairwise(edges):
        part = base
        if low is not None:
            part = part.filter(F.col("id") > low)
        if high is not None:
            part = part.filter(F.col("id") <= high)
        index.add(part, keep=lasting or high is not None)
    if lasting:
        index.top = index.top if about.top is None else about.top
        index.save()
    else:
        index.drop_runs()
    names = without(docs, "n_words", "n_removed")
    inner = {c: f"c{k}" for k, c in enumerate(names)}  # whatever the columns are called, these names are free
    own = docs.select(*[column(c).alias(k) for c, k in inner.items()], column(id_col).cast("long").alias("id"))
    # Rows without an id get no answer and are dealt by their text.
    own = own.withColumn("share", F.pmod(F.coalesce("id", F.xxhash64(inner[text_col])), F.lit(index.shares)).cast("int"))
    out = T.StructType([own.schema[k] for k in inner.values()] + [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    joined = own.groupBy("share").cogroup(index.repeated().groupBy("share")).applyInArrow(_remove(index.width, inner[text_col], to_arrow_schema(out)), out)
    return joined.select(*[F.col("kept" if c == text_col else k).alias(c) for c, k in inner.items()], "n_words", "n_removed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p.pos AS pos, p.key AS key FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'pos': i, 'key': array_to_string(w[i:i+12], ' ')})) AS p
    FROM words WHERE len(w) >= 13)),
owners AS (SELECT key, min(doc_id) AS owner FROM windows GROUP BY key),
hits AS (SELECT w.doc_id, w.pos FROM windows w JOIN owners o ON w.key = o.key WHERE o.owner < w.doc_id),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM hits, range(0, 13) AS r(k)),
parts AS (
  SELECT doc_id, p.pos AS pos, p.word AS word FROM (
    SELECT doc_id, unnest(list_transform(w, lambda x, i: {'pos': i, 'word': x})) AS p FROM words)),
kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
         coalesce(string_agg(e.word, ' ' ORDER BY e.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM parts e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
