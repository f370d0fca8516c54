"""Bounded samples of labelled documents, from which the classifiers are fitted."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column

#: Sampled documents of each class, and the length up to which a text can be sampled.
PER_CLASS, MAX_CHARS = 1500, 60_000


def held_out(id_col):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Sample:
    texts: list[str]
    labels: list[int]
    ids: list[int]
    #: Labelled documents that may be learnt, by class.
    total: dict[int, int]

    def weights(self) -> dict[int, float]:
        """How many labelled documents a sampled one stands for."""
        n = {y: self.labels.count(y) for y in (0, 1)}
        return {y: self.total.get(y, 0) / n[y] if n[y] else 0.0 for y in (0, 1)}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Sample:
    """At most ``per_class`` documents a class, the smallest by a hash of the id, of the labels that may be learnt.

    Rows with a null id, a label other than 0 or 1, or a null text aren't sampled; of rows
    with equal ids one is.  Texts over ``max_chars`` code points aren't sampled, so the
    driver gets ``2 * per_class * max_chars`` characters at most.
    """
    y = column(label).cast("int")
    known = labels.filter(y.isin(0, 1) & column(id_col).isNotNull() & ~held_out(column(id_col))).select(column(id_col).alias("__id"), y.alias("__y")).groupBy("__id").agg(F.max("__y").alias("__y"))
    total = {r["__y"]: r.n for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    picks = None
    for k in (0, 1):  # twice as many ids as texts, since some texts are too long or missing
        part = known.filter(F.col("__y") == k).orderBy(F.xxhash64("__id"), "__id").limit(2 * per_class)
        picks = part if picks is None else picks.union(part)
    found = docs.select(column(id_col).alias("__id"), column(text_col).alias("__t")).filter(F.length("__t") <= max_chars).join(F.broadcast(picks), "__id")  # 4 * per_class rows of two numbers
    rows = found.orderBy("__y", F.xxhash64("__id"), "__id", "__t")
    rows = pd.concat([rows.filter(F.col("__y") == k).limit(2 * per_class).toPandas() for k in (0, 1)])
    rows = rows.drop_duplicates("__id").groupby("__y").head(per_class)
    return Sample(rows["__t"].tolist(), rows["__y"].astype(int).tolist(), rows["__id"].tolist(), total)
