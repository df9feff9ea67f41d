"""Missing message sizes filled on a stream, whatever order the stages arrive in."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.schemas import DESERIALIZED, MESSAGE, PUBLICATION, RECEPTION, RUN, SERIALIZING
from tidewire.streaming.kept import fold_groups, message_bucket

#: What a row tells: a size of its message, or that it waits for one.
_PUBLISHED, _DECODED, _WAITS = 0, 1, 2
_UNKNOWN = -(2**63)
_KEPT = pa.schema(
    [(c, pa.string()) for c in (*MESSAGE, "event_type")]
    + [("kind", pa.int8())]
    + [(c, pa.int64()) for c in ("second", "size", "n", "given_bytes", "given_n", "ms")]
)
OUTPUT = (
    "scenario string, tech string, run string, event_type string, second bigint, "
    "bytes bigint, sized bigint"
)


def _sizes(rows: pd.DataFrame, kind: int, name: str) -> pd.DataFrame:
    mine = rows[rows["kind"] == kind]
    # A nullable whole number, as a join that misses would turn plain ones into floats.
    least = mine.groupby(MESSAGE, as_index=False)["size"].min().astype({"size": "Int64"})
    return least.rename(columns={"size": name})


def fill_step(
    kept: pd.DataFrame, new: pd.DataFrame, watermark_ms: int
) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Bytes that became known since the last call; a size that turns out smaller gives the difference."""
    rows = pd.concat([kept, new.assign(given_bytes=0, given_n=0)[_KEPT.names]], ignore_index=True)
    known = rows[rows["kind"] != _WAITS]
    sizes = known.groupby([*MESSAGE, "kind"], as_index=False).agg(size=("size", "min"), ms=("ms", "max"))
    waits = rows[rows["kind"] == _WAITS]
    waits = waits.groupby([*MESSAGE, "event_type", "second"], as_index=False).agg(
        n=("n", "sum"), given_bytes=("given_bytes", "sum"), given_n=("given_n", "sum"), ms=("ms", "max")
    )
    met = waits.merge(_sizes(sizes, _PUBLISHED, "published"), on=MESSAGE, how="left").merge(
        _sizes(sizes, _DECODED, "decoded"), on=MESSAGE, how="left"
    )
    published, decoded = (met[c].fillna(_UNKNOWN).to_numpy("int64") for c in ("published", "decoded"))
    either = np.where(published != _UNKNOWN, published, decoded)
    kind = met["event_type"].to_numpy()
    size = np.where(kind == SERIALIZING, published, np.where(kind == RECEPTION, decoded, either))
    n, given_bytes, given_n = (met[c].to_numpy("int64") for c in ("n", "given_bytes", "given_n"))
    found = size != _UNKNOWN
    more_bytes = np.where(found, n * np.where(found, size, 0) - given_bytes, 0)
    more_n = np.where(found, n - given_n, 0)
    out = met.assign(bytes=more_bytes, sized=more_n)[(more_bytes != 0) | (more_n != 0)]
    waits = waits.assign(
        given_bytes=given_bytes + more_bytes, given_n=given_n + more_n, kind=_WAITS, size=_UNKNOWN
    )
    sizes = sizes.assign(event_type="", second=0, n=0, given_bytes=0, given_n=0)
    out = out.groupby([*RUN, "event_type", "second"], as_index=False)[["bytes", "sized"]].sum()
    return out, pd.concat([waits, sizes], ignore_index=True)


def filled_sizes(
    events: DataFrame, *, lateness: str, horizon_ms: int, buckets: int = 64
) -> DataFrame:
    """Bytes per run, event type and second of the rows that report no size themselves.

    The rows are additive: a second may come several times, its sum is right once all stages
    have arrived. A waiting row and the sizes of its message meet if neither is more than
    ``horizon_ms`` behind the watermark when the other arrives; rows later than ``lateness`` are
    not seen. The filling rules are those of the batch form. Rows without a topic stay unfilled.
    """
    size = F.col("serialized_size")
    tells = size.isNotNull() & F.col("event_type").isin(PUBLICATION, DESERIALIZED)
    kind = (
        F.when(tells & (F.col("event_type") == PUBLICATION), _PUBLISHED)
        .when(tells, _DECODED)
        .when(size.isNull(), _WAITS)
    )
    ms = F.unix_millis("timestamp")
    rows = (
        events.withWatermark("timestamp", lateness)
        .filter(F.col("topic").isNotNull() & F.col("timestamp").isNotNull())
        .select(
            message_bucket(MESSAGE, buckets),
            *MESSAGE,
            "event_type",
            "timestamp",
            kind.cast("tinyint").alias("kind"),
            F.floor(ms / 1000).cast("bigint").alias("second"),
            F.coalesce(size, F.lit(_UNKNOWN)).cast("bigint").alias("size"),
            F.lit(1).cast("bigint").alias("n"),
            ms.alias("ms"),
        )
        .filter(F.col("kind").isNotNull())
    )
    return fold_groups(
        rows, ["bucket"], fill_step, OUTPUT, _KEPT, time="ms", horizon_ms=horizon_ms
    )
