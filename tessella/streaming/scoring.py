"""Segments for rows that arrive: a fitted encoding and centres applied to a stream.

Encoding and assignment look at one row at a time, so they run on a streaming DataFrame as
they do on a table, without state.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessella.operators.cluster import nearest_center
from tessella.operators.encode import EncodePlan


def score_stream(stream: DataFrame, plan: EncodePlan, centers: np.ndarray, *keep: str) -> DataFrame:
    """``keep...`` and ``label``: the nearest centre of each row of a typed stream."""
    encoded = plan.encode(stream, *keep)
    return encoded.select(*keep, nearest_center(encoded["features"], centers)["id"].alias("label"))
