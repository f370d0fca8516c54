"""Hierarchical multi-length packing (operator 1).

Each partition is packed by itself, without a shuffle.  A document's full windows
become sequences at once.  What is left of it is routed to the smallest context
tier that holds it; tiers are packed from the longest down, the longest rest of a
tier opening a window whose gap is filled with the longest rests of shorter tiers
that fit, and at last by cutting one.  So every window is filled to its tier, but
for the last few tokens of a partition.  The windows of a block of rests are dealt
to step groups of equal size so that their attention costs are balanced.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column, refuse, small_batches, table

TIERS = (128, 256, 512, 1024)
#: Tokens of one step group, and of the rests that are packed together.
STEP_TOKENS, POOL_TOKENS = 64 * 1024, 1 << 21
#: A word longer than this, or a gap of this many spaces, is left to the slower tokenizer.
LONG = 400
_GAP = b" " * LONG


class ByteBpe:
    """Token ids of whole texts under a byte-level BPE vocabulary of the ``tokenizers`` library.

    ``ranks`` may name the same vocabulary as ranks of the ``tiktoken`` library, which
    is five times as fast.  It takes the texts for which both are known to agree: all
    characters in Latin-1, no special token's string, no very long word or gap.  All
    other texts go to ``tokenizers`` itself, so the ids are always its ids.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, slow = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if self.fast and self._plain(text):
                out[k] = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            elif text:
                slow.append(k)
        for k in slow:  # one at a time: an encoding takes many times the room of its ids
            out[k] = array("I", self.tokenizer.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids).tobytes()
        return out

    def _plain(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return _GAP not in raw and max(map(len, raw.split()), default=0) <= LONG and not any(s in text for s in self.special)


@cache
def _encoder(*paths: str) -> ByteBpe:
    return ByteBpe(*paths)


class Packer:
    """Packs the documents of one partition; ``add`` and ``close`` give finished sequences.

    A piece is (document, start, ids as bytes, tokens of the document); a sequence is
    a list of pieces with its tier.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL_TOKENS) -> None:
        self.tiers, self.window, self.pool = tuple(sorted(tiers)), max(tiers), pool
        self.rests: list[tuple] = []
        self.held = 0

    def add(self, doc, ids: bytes) -> list[tuple[int, list[tuple]]]:
        n, w = len(ids) // 4, self.window
        full = n // w
        done = [(w, [(doc, k * w, ids[4 * k * w : 4 * (k + 1) * w], n)]) for k in range(full)]
        if n % w:
            self.rests.append((doc, full * w, ids[4 * full * w :], n))
            self.held += n % w
        if self.held >= self.pool:
            done += self._pack(False)
        return done

    def close(self) -> list[tuple[int, list[tuple]]]:
        return self._pack(True)

    def _pack(self, last: bool) -> list[tuple[int, list[tuple]]]:
        serial = count()
        rests = sorted(((len(r[2]) // 4, next(serial), r) for r in self.rests), key=lambda x: x[:2])
        self.rests, self.held, done = [], 0, []
        size = lambda x: x[0]
        while rests:
            n, _, rest = rests.pop()
            tier = next(t for t in self.tiers if t >= n)
            own, gap = [rest], tier - n
            while gap and rests:
                if (k := bisect_right(rests, gap, key=size) - 1) >= 0:
                    n, _, rest = rests.pop(k)
                    own.append(rest)
                    gap -= n
                else:  # all that is left is longer than the gap: cut the shortest
                    n, _, (doc, start, ids, total) = rests.pop(0)
                    own.append((doc, start, ids[: 4 * gap], total))
                    insort(rests, (n - gap, next(serial), (doc, start + gap, ids[4 * gap :], total)), key=size)
                    gap = 0
            if not gap:
                done.append((tier, own))
            elif last:
                done += self._remainder(own)
            else:
                self.rests, self.held = own, tier - gap
        return done

    def _remainder(self, own: list[tuple]) -> list[tuple[int, list[tuple]]]:
        """The last rests of a partition, cut to whole tiers; under the shortest tier, one sequence that is padded."""
        done = []
        left = sum(len(r[2]) // 4 for r in own)
        while left:
            tier = next((t for t in reversed(self.tiers) if t <= left), left)
            out, need = [], tier
            while need:
                doc, start, ids, total = own.pop(0)
                take = min(need, len(ids) // 4)
                out.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    own.insert(0, (doc, start + take, ids[4 * take :], total))
                need -= take
            done.append((tier if tier in self.tiers else self.window, out))
            left -= tier
        return done


def step_groups(sequences: list[tuple[int, list[tuple]]], step_tokens: int) -> list[int]:
    """A group for each sequence: equal numbers of tokens, and attention costs as equal as can be."""
    size = [sum(len(p[2]) // 4 for p in own) for _, own in sequences]
    cost = [sum((len(p[2]) // 4) ** 2 for p in own) for _, own in sequences]
    n = max(1, -(-sum(size) // step_tokens))
    heap, room, out = [(0, g) for g in range(n)], [step_tokens] * n, [0] * len(sequences)
    for k in sorted(range(len(sequences)), key=lambda k: (-cost[k], k)):
        aside = []
        while heap and room[heap[0][1]] < size[k]:
            aside.append(heapq.heappop(heap))
        if not heap:  # no group has the room: the least full takes it
            g = max(range(n), key=lambda g: room[g])
            heap, aside = [x for x in aside if x[1] == g], [x for x in aside if x[1] != g]
        load, g = heapq.heappop(heap)
        out[k] = g
        room[g] -= size[k]
        heapq.heappush(heap, (load + cost[k], g))
        for x in aside:
            heapq.heappush(heap, x)
    return out


def pack_documents(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int | None = 0, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces of all documents in packed sequences.

    ``encode()`` gives, on an executor, a function from texts to their ids as
    little-endian 32-bit bytes.  ``end_id`` is added to each document.

    Returns a row a piece: ``id_col``, ``start``, ``length``, ``token_bytes``,
    ``doc_tokens``, ``sequence_id``, ``offset``, ``tier``, ``step_group``.  Sequences
    hold whole tiers but for one of each partition at most, which is to be padded.

    Defined cases: a null or empty text is the end id alone (no row without one);
    rows with equal or null ids are packed each for itself; an empty table gives an
    empty table.  Other columns of ``docs`` are not read; an id column with the name of a result is refused.
    """
    refuse(id_col, "start", "length", "token_bytes", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("token_bytes", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("tier", T.IntegerType()), ("step_group", T.LongType()))])
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, to_ids, base, serial, group0 = Packer(tiers), encode(), TaskContext.get().partitionId() << 36, count(), 0
        arrow = None

        def rows(done: list) -> pa.RecordBatch:
            nonlocal group0
            groups = step_groups(done, step_tokens)
            cols: list[list] = [[] for _ in range(9)]
            for (tier, own), group in zip(done, groups, strict=True):
                seq, offset = base + next(serial), 0
                for doc, start, ids, total in own:
                    for col, x in zip(cols, (doc, start, len(ids) // 4, ids, total, seq, offset, tier, base + group0 + group), strict=True):
                        col.append(x)
                    offset += len(ids) // 4
            group0 += max(groups, default=-1) + 1
            kinds = [arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        wait: list = []
        for batch in batches:
            arrow = batch.schema.field(0).type
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            for k in range(0, len(texts), 64):
                for doc, own in zip(ids[k : k + 64], to_ids(texts[k : k + 64]), strict=True):
                    wait += packer.add(doc, own + end)
                if sum(tier for tier, _ in wait) >= 8 * step_tokens:
                    yield rows(wait)
                    wait = []
        wait += packer.close()
        if wait:
            yield rows(wait)

    return docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, schema)


def byte_bpe(path: str | None = None, ranks: str | None = None, pattern: str | None = None) -> Callable[[], ByteBpe]:
    """An ``encode`` for :func:`pack_documents`; each worker opens the files once."""

    def make() -> ByteBpe:
        if path:
            return _encoder(path, ranks, pattern)
        import public_tokenizers as public

        return _encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)

    return make


def packed_digest(docs: DataFrame) -> DataFrame:
    out = pack_documents(docs, byte_bpe())
    return out.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
