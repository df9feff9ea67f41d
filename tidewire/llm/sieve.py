"""A filter of fixed size that lets all rows of a key set pass, and few others.

It stands before a shuffle of large rows of which a join keeps few. Its size does not grow with
the keys (8 MB); with very many keys it lets more rows pass, and the join after it stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter.
BITS = 1 << 26
#: Bits in one row of Spark's bitmap aggregate.
_ROW_BITS = 32768


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def may_be_in(key: Column, keys: DataFrame, name: str) -> Column:
    """True for every value of ``keys[name]`` (null too), false for most others."""
    # Spark's bitmaps count from one.
    place = _place(F.col(name)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    marks = np.zeros(BITS // 8, np.uint8)
    width = _ROW_BITS // 8
    for r in rows.collect():
        marks[(r["row"] - 1) * width : r["row"] * width] = np.frombuffer(r["bits"], np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(marks.tobytes())

    @F.arrow_udf("boolean")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = np.frombuffer(sent.value, np.uint8)
        for places in batches:
            at = places.to_numpy(zero_copy_only=False)
            yield pa.array(bits[at >> 3] >> (at & 7) & 1 == 1)

    return marked(_place(key))
