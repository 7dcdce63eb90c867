"""Throttling in event time: requests of a stream are held in state by host and second and released one by one, spaced for each host.

A request (key, host, ts) is put into the state of its host's second. Once the watermark has passed the end of that second, all requests of it have come,
whatever micro-batch brought them; they are released in order of time and key, each no sooner than it came and no sooner than `spacing` seconds after the one before.

Seconds are dealt out to all tasks. What a second needs of those before it is one number, the time of the host's last release; what they need of it are
two, how many requests it has and when the last of them would go if it stood alone. So only these go through the state of a host, a row for each second, and the requests
meet the result again by host and second. Memory of a task holds the requests of one host's second, and three numbers for each of a host's seconds
that a micro-batch releases, never a host's queue. A request later than the watermark allows is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from quillstone.functions.shipping import ship

SPACING = 0.25
#: Seconds of this era are doubles on a grid of 2**-22; a spacing on that grid gives the same sums in whatever order they are made.
ERA = 2.0**30


def spaced(came: np.ndarray, last: float | None, spacing: float) -> np.ndarray:
    """When requests that came in this order go, `last` being the release before them."""
    steps = np.arange(len(came)) * spacing
    out = np.maximum.accumulate(came - steps) + steps
    return out if last is None else np.maximum(out, last + spacing + steps)


class Carrier(StatefulProcessor):
    """The last release of a host, carried from second to second: (second, requests, own last release) gives (second, release before it)."""

    def __init__(self, by: str, spacing: float) -> None:
        self.by, self.spacing = by, spacing
        self.kind = _parse_datatype_string("go_at double")  # on the driver: workers have no session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.kind)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seconds = pd.concat([frame[["second", "n", "own"]] for frame in rows]).sort_values("second", ignore_index=True)
        steps = seconds["n"].to_numpy().cumsum() * self.spacing
        known = self.last.get()[0] if self.last.exists() else None
        after = np.maximum.accumulate(seconds["own"].to_numpy() - steps)
        if known is not None:
            after = np.maximum(after, known)
        after += steps
        self.last.update((float(after[-1]),))
        before = pd.Series([known, *after[:-1]], dtype=float)  # NaN: none before
        yield pd.DataFrame({self.by: [key[0]] * len(seconds), "second": seconds["second"], "last": before})

    def close(self) -> None:
        pass


def released(requests: DataFrame, by: str = "host", key: str = "request_id", at: str = "ts", spacing: float = SPACING, late: str = "10 seconds") -> DataFrame:
    """(by, key, go_at in seconds) of a stream of requests, as the watermark passes them. Needs `slots.rocks` around the start of the query."""
    ship(requests.sparkSession)
    gap = ERA + spacing - ERA

    @F.pandas_udf("array<double>")
    def times(came: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([spaced(np.asarray(c), None if pd.isna(x) else x, gap) for c, x in zip(came, last, strict=True)], dtype=object)

    def seconds() -> DataFrame:
        """(by, second, came, keys): the requests of each host's second in order of time and key."""
        rows = requests.select(by, F.col(key).alias("key"), F.col(at).alias("at"), (F.unix_micros(at) / 1_000_000).alias("came")).withWatermark("at", late)
        held = rows.groupBy(by, F.window("at", "1 second").alias("w")).agg(F.array_sort(F.collect_list(F.struct("came", "key"))).alias("r"))
        return held.select(by, F.window_time("w").alias("second"), F.col("r.came").alias("came"), F.col("r.key").alias("keys"))

    alone = F.aggregate("came", F.get("came", F.lit(0)) - gap, lambda last, x: F.greatest(last + gap, x))
    sizes = seconds().select(by, F.unix_micros("second").alias("second"), F.size("came").cast("long").alias("n"), alone.alias("own"))
    schema = _parse_datatype_string(f"{by} {requests.schema[by].dataType.simpleString()}, second long, last double")
    carried = sizes.groupBy(by).transformWithStateInPandas(Carrier(by, gap), schema, "Append", "None").alias("c")
    held = seconds().alias("s")
    met = held.join(carried, F.col(f"s.{by}").eqNullSafe(F.col(f"c.{by}")) & (F.col("s.second") == F.timestamp_micros("c.second")))
    going = met.select(f"s.{by}", F.explode(F.arrays_zip("s.keys", times("s.came", "c.last").alias("go"))).alias("r"))
    return going.select(by, F.col("r.keys").alias(key), F.col("r.go").alias("go_at"))
