"""The message life cycle as a keyed stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "id long, lsn long, state string, generation long, attempts long, due_ms long, written boolean"
STATE = "lsn long, state string, generation long, attempts long, due_ms long"


def _after(state: tuple, e: Any) -> tuple[tuple, bool] | None:
    """(state, whether the journal gets an entry) after an event; None if the event changes nothing."""
    lsn, now, generation, attempts, due = state
    if lsn is not None and e.lsn <= lsn:
        return None  # delivered twice
    kind = e.kind
    if kind == "append":
        return None if now in ("ready", "inflight", "delayed") else ((e.lsn, "ready", generation, attempts, None), False)
    if kind == "claim":
        return ((e.lsn, "inflight", generation + 1, attempts, None), False) if now == "ready" else None
    if kind == "due":
        return ((e.lsn, "ready", generation, attempts, None), False) if now == "delayed" and due == e.due_ms else None
    if now != "inflight" or e.generation != generation:
        return None  # a stale claim
    if kind == "abandoned":
        return (e.lsn, "ready", generation, attempts, None), False
    if kind == "limited":
        return (e.lsn, "delayed", generation, attempts, e.due_ms), False
    if kind == "deferred":
        return (e.lsn, "delayed", generation, attempts + 1, e.due_ms), True
    return (e.lsn, "ended", generation, attempts, None), True


def _number(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    state = tuple(group.get) if group.exists else (None, None, 0, 0, None)
    state = (state[0], state[1], int(state[2] or 0), int(state[3] or 0), _number(state[4]))
    out = []
    for e in sorted((e for f in frames for e in f.itertuples(index=False)), key=lambda e: e.lsn):
        e = e._replace(due_ms=_number(e.due_ms), generation=_number(e.generation))
        got = _after(state, e)
        if got:
            state = got[0]
            out.append((key[0], *state, got[1]))
    if state[1]:
        group.update(state)
    yield pd.DataFrame(out, columns=["id", "lsn", "state", "generation", "attempts", "due_ms", "written"]).astype({"due_ms": "Int64"})


def lifecycle(events: DataFrame) -> DataFrame:
    """Transitions of every message from events (id, lsn, kind, generation, due_ms) of a stream.

    kinds: append, claim, due, and outcomes of a claim's generation: abandoned, limited, deferred, delivered, bounced.
    `written` marks those that a journal keeps.  Events are applied once, by LSN; stale claims and timers are dropped.
    """
    return events.groupBy("id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def discovered(records: DataFrame) -> DataFrame:
    """append events from a stream of payload records."""
    return records.selectExpr("message_ulid", "shard", "segment", "offset", "generation", "enqueue_ms")
