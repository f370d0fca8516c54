"""Line dedup with two Bloom filters (operator 9).

Scan 1 writes the 128-bit hashes of each document's long lines, a small table.  Over it, every
hash goes to a *once* filter, and to a *twice* filter if it was in the first already.
Tasks work alone and their filters are merged: what both have seen once goes to the
twice filter.  A line that occurs in two documents is therefore always in the merged
twice filter.  Only the hashes found in it are shuffled; grouping them confirms repeats
and chooses the occurrence that stays.  A filter that lets a line through in vain never
changes a result.

The filters follow the input: ``BITS`` bits for every line of the table.  Where that is
more than ``max_bits``, the hashes are dealt into as many classes as needed (from an upper bound
of the lines, the characters over ``min_chars``), the table is written by class, and each class
has a pass of its own over its own part of the table, with filters of ``max_bits`` at most.  So
all passes together read the table once, the share of lines that pass in vain is the same at
every size, and what is broadcast and held at once is bounded: ``max_bits / 8`` bytes a filter
(32 MB by default), two of them in a worker.

Lines are equal if their 128-bit hashes are: among n different lines n * n / 2 ** 129 wrong
pairs are expected, 1e-16 for the 3e11 long lines of 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import column, exists, new_path, small_batches, table, unused, without

STRIP = b" \t\n\x0b\x0c\r"
CHUNKS = 16
#: Bits of a filter for each long line of the input.
BITS = 8
#: Parts into which the rows of each confirmed key are dealt, and those of a class of hashes.
SALTS, PIECES = 32, 32


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """The keys of the lines of a text that are long enough to be judged, each once."""
    if not text:
        return []
    out = {}
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(STRIP).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            out[key] = None
    return list(out)


def _digests(min_chars: int, turns: int):
    """Rows with the hashes of their long lines, 16 bytes each; a row for each class that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, classes, sizes, digests = [], [], [], []
            for k, text in enumerate(batch["text"]):
                keys = b"".join(map(xxhash.xxh3_128_digest, _keys(text, min_chars)))
                if not keys:
                    continue
                own = class_of(keys, turns)
                for turn in np.unique(own).tolist() if turns > 1 else [0]:
                    mine = np.frombuffer(keys, "V16")[own == turn].tobytes() if turns > 1 else keys
                    rows.append(k)
                    classes.append(turn)
                    sizes.append(len(mine) // 16)
                    digests.append(mine)
            yield batch[["id", "twin"]].take(rows).assign(turn=classes, n=sizes, digests=digests)

    return run


def class_of(digests: bytes, turns: int) -> np.ndarray:
    both = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    return ((both[:, 1] >> np.uint64(32)) * np.uint64(turns) >> np.uint64(32)).astype(np.int64)


def _slots(digests: bytes, bits: int, hashes: int) -> np.ndarray:
    """The bit positions of hashes, a row a hash."""
    both = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    step = both[:, 1:] << np.uint64(32) | np.uint64(1)
    places = (both[:, :1] + step * np.arange(hashes, dtype=np.uint64)) >> np.uint64(32)
    return (places * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of positions are all set in a filter of packed bits."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(packed, at >> 3, np.left_shift(1, 7 - (at & 7)).astype(np.uint8))


def _fill(bits: int, hashes: int):
    """One task's pair of filters, of packed bits, in chunks; positions if these take less room than bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            digests = np.frombuffer(b"".join(batch["digests"]), "V16")
            if not len(digests):
                continue
            halves = digests.view(">u8")
            order = np.lexsort((halves[1::2], halves[::2]))  # equal hashes stand together
            own = digests[order]
            again = np.zeros(len(own), bool)
            again[1:] = own[1:] == own[:-1]
            at = _slots(own.tobytes(), bits, hashes)
            seen = _has(once, at) | again
            _set(twice, at[seen])
            _set(once, at[~seen])
        size = bits // 8 // CHUNKS
        for k in range(CHUNKS):
            parts = [_shut(f[k * size : (k + 1) * size]) for f in (once, twice)]
            yield pd.DataFrame({"chunk": [k], "once": [parts[0]], "twice": [parts[1]]})

    return run


def _shut(part: np.ndarray) -> bytes:
    """Bits as positions or as they are, whichever takes less room."""
    live = np.flatnonzero(part)
    if 32 * len(live) < len(part):
        byte, bit = np.nonzero(np.unpackbits(part[live, None], axis=1))
        return b"s" + (live[byte] * 8 + bit).astype("<u4").tobytes()
    return b"d" + part.tobytes()


def _open(data: bytes, size: int) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data, np.uint8, offset=1).copy()
    out = np.zeros(size, np.uint8)
    _set(out, np.frombuffer(data, "<u4", offset=1).astype(np.int64))
    return out


def _merge(bits: int):
    """Merged twice filters; holds the chunks of one pair of filters at most, however many tasks there were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, have = bits // 8 // CHUNKS, {}
        for batch in batches:
            for chunk, once, twice in batch[["chunk", "once", "twice"]].itertuples(index=False):
                a, b = _open(once, size), _open(twice, size)
                if chunk in have:
                    c, d = have[chunk]
                    d |= b | (a & c)
                    c |= a
                else:
                    have[chunk] = (a, b)
        for chunk, (_, twice) in have.items():
            yield pd.DataFrame({"chunk": [chunk], "twice": [twice.tobytes()]})

    return run


def filter_bits(lines: int, max_bits: int) -> int:
    """Bits of a filter for so many long lines."""
    step = 8 * CHUNKS
    return min(max(step, -(-BITS * lines // step) * step), max_bits // step * step)


def repeated_filter(lines: DataFrame, *, bits: int, hashes: int) -> np.ndarray:
    """The bits of the merged twice filter of a class, packed: ``bits / 8`` bytes."""
    pairs = lines.select("digests").mapInPandas(_fill(bits, hashes), "chunk int, once binary, twice binary")
    merged = pairs.repartition(CHUNKS, "chunk").mapInPandas(_merge(bits), "chunk int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    size = bits // CHUNKS // 8
    for row in merged.collect():  # at most CHUNKS rows of bits / CHUNKS bits
        out[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.twice, np.uint8)
    return out


def _suspects(shared, bits: int, hashes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = shared.value
        for batch in batches:
            rows, keys = [], []
            for k, digests in enumerate(batch["digests"]):
                for j in np.flatnonzero(_has(packed, _slots(digests, bits, hashes))).tolist():
                    rows.append(k)
                    keys.append(digests[16 * j : 16 * j + 16])
            ids = batch["id"].take(rows).astype(object)
            yield pd.DataFrame({"id": ids.where(ids.notna(), None), "twin": batch["twin"].take(rows), "key": keys})

    return run


def _apply(min_chars: int):
    def run(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, drops, strict=True):
            lines = ("" if text is None else text).encode("utf-8", "surrogatepass").split(b"\n")
            if drop is None or not len(drop):
                kept = lines
            else:
                gone = {bytes(x) for x in drop}
                kept = [x for x in lines if len(x) < min_chars or xxhash.xxh3_128_digest(x.strip(STRIP).lower()) not in gone]
            out.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    run.__annotations__ = {"texts": pd.Series, "drops": pd.Series, "return": pd.DataFrame}
    return run


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, max_bits: int = 1 << 28, hashes: int = 4) -> DataFrame:
    """Drop lines whose key is in ``min_docs`` documents or more, but for the largest id that holds it.

    A line's key is the line without ASCII white space at its ends, with A-Z
    lower-cased; keys under ``min_chars`` code points are never judged.

    Returns the rows of ``docs`` with ``text_col`` replaced by the kept lines, and
    ``n_lines`` and ``n_dropped`` (they replace input columns of the same name).

    Defined cases: a null or empty text is one empty line, and comes out empty.
    Rows with one id are one document, and every row with the largest id keeps its
    lines.  A row without an id counts as no document, but loses lines like others.  An empty table
    gives an empty table.  Other columns may have any name.
    """
    if not 1024 <= max_bits < 1 << 32:
        raise ValueError("max_bits must be within 1,024 and 2 ** 32 - 1")
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    # A row is known by its id and the hash of its text, so that rows with one id, or none, are spread.
    twin = F.unhex(F.md5(F.coalesce(column(text_col).cast("binary"), F.lit(b""))))
    lines = docs.select(column(id_col).alias("id"), twin.alias("twin"), column(text_col).alias("text"))
    chars = lines.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    turns = max(1, -(-BITS * (chars // min_chars) // max_bits))
    schema = f"id {kind}, twin binary, turn int, n long, digests binary"
    hashed = lines.mapInPandas(_digests(min_chars, turns), schema)
    where = new_path(spark, "line-hashes")
    if turns > 1:  # a class's part of the table is dealt over as many files as its size asks for
        hashed = hashed.repartition(turns * PIECES, "turn", F.pmod(F.xxhash64("twin"), F.lit(PIECES)))
    hashed.write.partitionBy("turn").parquet(where)
    path = new_path(spark, "line-suspects")
    for turn in range(turns):
        if not exists(spark, f"{where}/turn={turn}"):
            continue
        own = spark.read.schema(f"id {kind}, twin binary, n long, digests binary").parquet(f"{where}/turn={turn}")
        bits = filter_bits(own.agg(F.sum("n").alias("n")).first().n or 0, max_bits)
        shared = spark.sparkContext.broadcast(repeated_filter(own, bits=bits, hashes=hashes))  # bits / 8 bytes
        own.mapInPandas(_suspects(shared, bits, hashes), f"id {kind}, twin binary, key binary").write.mode("append").parquet(path)
        shared.unpersist()
    if not exists(spark, path):
        spark.createDataFrame([], f"id {kind}, twin binary, key binary").write.parquet(path)
    found = spark.read.schema(f"id {kind}, twin binary, key binary").parquet(path)
    each = found.groupBy("key", "id").agg(F.lit(1).alias("one"))  # rows of one id are one document
    confirmed = each.groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs).select("key", "keep")
    # A key may be in a third of all documents: its rows are dealt over SALTS tasks.
    confirmed = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    drops = found.withColumn("salt", F.pmod(F.xxhash64("id", "twin"), F.lit(SALTS)).cast("long")).join(confirmed, ["key", "salt"]).filter(~F.col("id").eqNullSafe(F.col("keep")))
    own_twin, drop_id, drop_twin, drop, made = unused(docs.columns, "own_twin", "drop_id", "drop_twin", "drop", "made")
    drops = drops.groupBy(F.col("id").alias(drop_id), F.col("twin").alias(drop_twin)).agg(F.collect_set("key").alias(drop))
    joined = docs.withColumn(own_twin, twin)
    joined = joined.join(drops, column(id_col).eqNullSafe(F.col(drop_id)) & (F.col(own_twin) == F.col(drop_twin)), "left")
    joined = joined.withColumn(made, F.pandas_udf(_apply(min_chars), "kept string, n_lines long, n_dropped long")(column(text_col), F.col(drop)))
    names = without(docs, "n_lines", "n_dropped")
    return joined.select(*[F.col(f"{made}.kept").alias(c) if c == text_col else column(c) for c in names], f"{made}.n_lines", f"{made}.n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, p.pos AS pos, p.line AS line,
         translate(trim(p.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) AS p
        FROM documents)),
hot AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (h.key IS NOT NULL AND l.doc_id <> h.keep) AS gone
  FROM lines l LEFT JOIN hot h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
