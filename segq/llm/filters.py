"""A Bloom filter of ids, of fixed size, shared with the tasks of a step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID_BITS = 26


def spot(node: str):
    return F.pmod(F.xxhash64(node), F.lit(1 << ID_BITS)).alias("spot")


def filter_of(wanted: DataFrame):
    """A Bloom filter of the ids wanted (column node), of fixed size, shared
    with the tasks: it spares most other documents the way through a step."""

    def slice_of(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << (ID_BITS - 6), bool)
        flags[pdf["spot"].to_numpy()] = True
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bitmap": [np.packbits(flags).tobytes()]})

    at = wanted.select(spot("node"))
    spots = at.select(F.shiftright("spot", ID_BITS - 6).alias("part"), (F.col("spot") % (1 << (ID_BITS - 6))).alias("spot")).distinct()
    bitmap = np.zeros(1 << (ID_BITS - 3), np.uint8)
    for row in spots.groupBy("part").applyInPandas(slice_of, "part long, bitmap binary").toLocalIterator():
        bitmap[row.part << (ID_BITS - 9) : (row.part + 1) << (ID_BITS - 9)] = np.frombuffer(bytes(row.bitmap), np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(bitmap)


def lets_through(bitmap: np.ndarray, spot: pd.Series) -> np.ndarray:
    at = spot.to_numpy(np.int64)
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1) > 0
