"""The keyed state machine, as a stream and as an ordered batch fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States by number, and (state, event) -> state; anything else is invalid.
INITIAL, W, X, Y, Z, TERMINAL = range(6)
TRANSITIONS = {(INITIAL, 1): W, (INITIAL, 3): X, (W, 2): Y, (X, 2): Y, (X, 4): Z, (Y, 5): Z, (Z, 7): TERMINAL}
#: Event types of the events table as letters a, b, d, e, g.
CODES = {"signup": 1, "view": 2, "click": 4, "purchase": 5, "error": 7}

ALERT = "user_id long, event_id long, state int, code int"


def code_of(event_type: Column) -> Column:
    out = F.lit(0)
    for name, code in CODES.items():
        out = F.when(event_type == name, code).otherwise(out)
    return out


def advance(state: int, code: int) -> tuple[int, bool]:
    """The next state, and whether the event was valid; an end or a fault clears it."""
    new = TRANSITIONS.get((state, code))
    return (INITIAL if new in (None, TERMINAL) else new), new is not None


def alerts_batch(events: DataFrame) -> DataFrame:
    """Invalid events of (user_id, ts, event_id, code), each key's in order.

    Rows stream through in key order, so a key of any size needs one state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, INITIAL
        for b in batches:
            rows = []
            for u, e, c in zip(b.column("user_id").to_pylist(), b.column("event_id").to_pylist(), b.column("code").to_pylist(), strict=True):
                if u != user:
                    user, state = u, INITIAL
                was = state
                state, valid = advance(state, c)
                if not valid:
                    rows.append((u, e, was, c))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["user_id", "event_id", "state", "code"])

    ordered = events.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.select("user_id", "event_id", "code").mapInArrow(run, ALERT)


def alerts_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, with the state kept by key between batches."""

    def update(key, frames, state):
        at = state.get[0] if state.exists else INITIAL
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for e, c in zip(rows["event_id"], rows["code"], strict=True):
            was = at
            at, valid = advance(at, int(c))
            if not valid:
                out.append((key[0], e, was, c))
        if at == INITIAL and state.exists:
            state.remove()
        elif at != INITIAL:
            state.update((at,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state", "code"]).astype({"user_id": "int64", "event_id": "int64", "state": "int32", "code": "int32"})

    return events.groupBy("user_id").applyInPandasWithState(update, ALERT, "state int", "append", "NoTimeout")
