"""N-best segmentation into SentencePiece pieces, and decoding (operator 2).

A text is escaped as SentencePiece does it: a space in front, spaces as U+2581; characters
without a piece fall back to bytes, as does a U+2581 of the text itself, so decoding gives
every text back.  No piece has a space inside but pieces of spaces alone, so the lattice
falls apart before each space that follows something else.  Within such a unit a forward
Viterbi pass gives the best score of every position; these scores are the exact heuristic
of a backward A-star search, which therefore pops whole segmentations from the best down.

A text's N best differ from its best in few units.  The forward pass keeps the second-best
score, too, and only the N - 1 units whose second choice costs least can differ; the search
runs on those alone, and their choices are combined exactly.  New units of several texts are
passed in sorted order, and a unit goes on from where it parts from the one before.

Scores are integers (log-probabilities times 2 ** 20), so sums are exact in any order.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column, refuse, small_batches, table

SCALE = 1 << 20
LOW, NEVER = -(1 << 62), 1 << 62
#: Units kept with their best segmentation in each Python worker, in either of two generations.
KNOWN = 300_000
#: Longest unit that is kept.
LONGEST_KNOWN = 64
UNIT = re.compile("▁+[^▁]*|[^▁]+")
#: Stands for a U+2581 of the text itself; a lone surrogate, which no string of Spark can hold.
OWN_MARK = "\ud800"


class Vocabulary:
    """Pieces with integer scores, and the ids of the 256 bytes."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int], byte_score: int, table: list[bytes]) -> None:
        self.pieces, self.byte_ids, self.byte_score, self.table = pieces, byte_ids, byte_score, table
        #: Every beginning or ending of a piece, with the piece itself if it is one: a search ends where nothing goes on.
        self.heads: dict[str, tuple[int, int] | None] = {p[:k]: None for p in pieces for k in range(1, len(p))} | pieces
        self.tails: dict[str, tuple[int, int, bytes] | None] = {p[k:]: None for p in pieces for k in range(1, len(p))} | {p: (i, s, i.to_bytes(4, "little")) for p, (i, s) in pieces.items()}

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        """The pieces of a SentencePiece model file.

        A BPE model scores a piece by minus its merge rank; log-probabilities are taken to
        fall as Zipf's law has it, -log(1 + rank).  A unigram model's scores are used as they are.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        bytes_, pieces, table = [0] * 256, {}, [b""] * n
        raw = {k: model.get_score(k) for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))}
        ranks = all(float(s).is_integer() for s in raw.values())
        for k in range(n):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                bytes_[int(piece[3:5], 16)] = k
                table[k] = bytes([int(piece[3:5], 16)])
            elif k in raw:
                pieces[piece] = (k, round((-log(1 - raw[k]) if ranks else raw[k]) * SCALE))
                table[k] = piece.replace("▁", " ").encode()
        return cls(pieces, bytes_, min((s for _, s in pieces.values()), default=0) - 10 * SCALE, table)

    def char(self, c: str) -> tuple[tuple[int, ...], int]:
        """A single character as one piece or as bytes."""
        if (got := self.pieces.get(c)) is not None:
            return (got[0],), got[1]
        raw = ("▁" if c == OWN_MARK else c).encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw), self.byte_score * len(raw)


class Segmenter:
    """Segmentations by one vocabulary; units are known without the U+2581 that begins each."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        #: Score and ids of the best segmentation, and what the second costs more.
        self.young: dict[str, tuple[int, bytes, int]] = {}
        self.old: dict[str, tuple[int, bytes, int]] = {}
        #: N best of the units whose second choice costs little; these recur most.
        self.lists: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        self.words = np.array(vocabulary.table, dtype=object)

    @staticmethod
    def units(text: str) -> list[str]:
        if not text:
            return []
        if "▁" not in text and "" not in (parts := text.split(" ")):
            return parts
        return [u[1:] for u in UNIT.findall("▁" + text.replace("▁", OWN_MARK).replace(" ", "▁"))]

    def learn(self, units: set[str]) -> dict[str, tuple[int, bytes, int]]:
        """Best segmentations of units, kept for later."""
        out, young, old = {}, self.young, self.old
        new = []
        for u in units:
            if (hit := old.get(u)) is None:
                new.append(u)
            else:
                out[u] = hit
        new.sort()
        tail, char = self.v.tails.get, self.v.char
        best, second, back, last = [0], [LOW], [0], [b""]
        before = ""
        for u in new:
            unit = "▁" + u
            n = len(unit)
            same = 0
            for x, y in zip(before, unit, strict=False):
                if x != y:
                    break
                same += 1
            del best[same + 1 :], second[same + 1 :], back[same + 1 :], last[same + 1 :]
            before = unit
            for i in range(same + 1, n + 1):
                j = i - 1
                got = tail(unit[j], 0)
                if got:
                    s, piece = got[1], got[2]
                else:
                    ids, s = char(unit[j])
                    piece = b"".join([x.to_bytes(4, "little") for x in ids])
                top, at, low = best[j] + s, j, second[j] + s
                if got != 0:
                    while j:
                        j -= 1
                        got = tail(unit[j:i], 0)
                        if got:
                            s = got[1]
                            c = best[j] + s
                            if c > top:
                                low, top, at, piece = top, c, j, got[2]
                            elif c > low:
                                low = c
                            c = second[j] + s
                            if c > low:
                                low = c
                        elif got == 0:
                            break
                best.append(top)
                second.append(low)
                back.append(at)
                last.append(piece)
            i, ids = n, []
            while i:
                ids.append(last[i])
                i = back[i]
            ids.reverse()
            out[u] = best[n], b"".join(ids), best[n] - second[n] if second[n] > LOW // 2 else NEVER
        for u, hit in out.items():
            if len(u) <= LONGEST_KNOWN:
                young[u] = hit
        if len(young) >= KNOWN:
            self.young, self.old = {}, young
        return out

    def arcs(self, unit: str, j: int) -> list[tuple[int, int]]:
        """Ends and scores of the pieces that begin at ``j``; every single character has one."""
        heads, n = self.v.heads, len(unit)
        got = heads.get(unit[j], 0)
        out = [(j + 1, got[1] if got else self.v.char(unit[j])[1])]
        if got == 0:
            return out
        for i in range(j + 2, n + 1):
            got = heads.get(unit[j:i], 0)
            if got == 0:
                break
            if got:
                out.append((i, got[1]))
        return out

    def _ids(self, piece: str) -> tuple[int, ...]:
        return self.v.char(piece)[0] if len(piece) == 1 else (self.v.pieces[piece][0],)

    def n_best_unit(self, unit: str, n: int) -> list[tuple[int, bytes]]:
        """The ``n`` best segmentations of a unit, from the best down; fewer if there are fewer."""
        size = len(unit)
        best, into = [LOW] * (size + 1), [[] for _ in range(size + 1)]
        best[0] = 0
        for j in range(size):
            for i, s in self.arcs(unit, j):
                into[i].append((j, s))
                if best[j] + s > best[i]:
                    best[i] = best[j] + s
        # -(score + heuristic), position, serial, score, path: of equal hopes the one nearest its end goes first,
        # or a run of one letter, whose segmentations mostly tie, would be searched in breadth.
        heap: list = [(-best[-1], size, 0, 0, None)]
        serial, out = 0, []
        while heap and len(out) < n:
            _, i, _, score, path = heapq.heappop(heap)
            if not i:
                ids, at = [], 0
                while path:
                    ids += self._ids(unit[at : path[0]])
                    at, path = path
                out.append((score, b"".join([x.to_bytes(4, "little") for x in ids])))
                continue
            for j, s in into[i]:
                serial += 1
                heapq.heappush(heap, (-(score + s + best[j]), j, serial, score + s, (i, path)))
        return out

    def n_best(self, text: str | None, n: int) -> list[tuple[int, bytes]]:
        return self.n_best_all([text], n)[0]

    def n_best_all(self, texts: list[str | None], n: int) -> list[list[tuple[int, bytes]]]:
        """The ``n`` best segmentations of whole texts as (score, ids), ties in a fixed order."""
        rows = [self.units(t or "") for t in texts]
        known = self.young.get
        firsts = [list(map(known, row)) for row in rows]
        fresh = self.learn({u for row, own in zip(rows, firsts, strict=True) for u, first in zip(row, own, strict=True) if first is None})
        for row, own in zip(rows, firsts, strict=True):
            if None in own:
                own[:] = [fresh[u] if first is None else first for u, first in zip(row, own, strict=True)]
        return [self._combine(row, own, n) for row, own in zip(rows, firsts, strict=True)]

    def _combine(self, units: list[str], firsts: list[tuple[int, bytes, int]], n: int) -> list[tuple[int, bytes]]:
        if not units:
            return [(0, b"")]
        scores, plain, costs = zip(*firsts, strict=True)
        total, left, loose = sum(scores), list(costs), []
        for _ in range(n - 1):
            least = min(left)
            if least == NEVER:
                break
            loose.append(left.index(least))
            left[loose[-1]] = NEVER
        choices: list[tuple[int, tuple[tuple[int, bytes], ...]]] = [(total, ())]
        for k in loose:
            unit = units[k]
            if (own := self.lists.get((unit, n))) is None:
                own = self.n_best_unit("▁" + unit, n)
                if len(unit) <= LONGEST_KNOWN:
                    if len(self.lists) >= KNOWN // 10:
                        self.lists.clear()
                    self.lists[unit, n] = own
            mixed = [(score + s - own[0][0], (*picked, (k, ids))) for score, picked in choices for s, ids in own]
            choices = heapq.nsmallest(n, mixed, key=lambda x: -x[0])
        out = []
        for score, picked in choices[:n]:
            row = list(plain)
            for k, ids in picked:
                row[k] = ids
            out.append((score, b"".join(row)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids."""
        return b"".join(self.words[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "surrogatepass")[1:]


def bounded(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text, a row at least."""
    start = size = 0
    for k, text in enumerate(batch.column(1)):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= chars:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < len(batch):
        yield batch.slice(start)


@cache
def _segmenter(path: str | None) -> Segmenter:
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Segmenter(Vocabulary.from_model(path))


def encode_n_best(docs: DataFrame, *, n: int = 3, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col, rank, score, n_pieces, ids``: the ``n`` best segmentations of every text.

    ``decoded`` adds a column of that name, the text that the ids decode to.

    ``ids`` are little-endian 32-bit integers as bytes, ``score`` a log-probability.

    Defined cases: a null or empty text has one segmentation, without pieces; a text with
    fewer than ``n`` segmentations gets those it has.  Rows with equal or null ids are
    segmented each.  An empty table gives an empty table.  Other columns are not read; an id column
    with the name of a result is refused.
    """
    refuse(id_col, "rank", "score", "n_pieces", "ids", "decoded")
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(model)
        gc.disable()  # hundreds of thousands of kept tuples, none in a cycle, would be walked again and again
        try:
            yield from segmented(segmenter, batches)
        finally:
            gc.enable()

    def segmented(segmenter: Segmenter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch):
                cols: list[list] = [[] for _ in schema.names]
                for doc, rows in zip(part.column(0).to_pylist(), segmenter.n_best_all(part.column(1).to_pylist(), n), strict=True):
                    for rank, (score, ids) in enumerate(rows, 1):
                        row = (doc, rank, score / SCALE, len(ids) // 4, ids, *([segmenter.decode(ids)] * decoded))
                        for col, x in zip(cols, row, strict=True):
                            col.append(x)
                kinds = [batch.schema.field(0).type, pa.int32(), pa.float64(), pa.int64(), pa.binary(), *([pa.string()] * decoded)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

    return docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, schema)


def decode_column(ids, model: str | None = None):
    """The texts of a column of ids as :func:`encode_n_best` gives them; null for null."""
    import pandas as pd

    def run(rows: pd.Series) -> pd.Series:
        decode = _segmenter(model).decode
        return pd.Series([None if r is None else decode(r) for r in rows], dtype=object)

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(ids)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and rank: score, pieces, checksums of the ids and of the text they decode to."""
    # Decoded where it is encoded: a second Python worker would hold the vocabulary once more.
    out = encode_n_best(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return out.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
