"""The page state machine over a stream of events.

The same rule as the batch operator: the latest state counts, and failures are
counted since the source or the translation last moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, state string, attempts long"
STATE = "source_hash string, target_hash string, state string, attempts long"


def step(held: tuple | None, rows: pd.DataFrame) -> tuple:
    """Fold events, in order of at and state, into (source_hash, target_hash, state, attempts)."""
    source, target, state, attempts = held or (None, None, None, 0)
    for row in rows.sort_values(["at", "state"]).itertuples(index=False):
        if held is None or (row.source_hash, row.target_hash) != (source, target):
            attempts = 0
        held = source, target = row.source_hash, row.target_hash
        state, attempts = row.state, attempts + (row.state == "failed")
    return source, target, state, attempts


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    for rows in batches:
        held = step(held, rows)
    state.update(held)
    yield pd.DataFrame([(key[0], held[2], held[3])], columns=["key", "state", "attempts"])


def page_state_stream(events: DataFrame) -> DataFrame:
    """Updates (key, state, attempts) of a stream of (key, at, state, source_hash, target_hash)."""
    return events.groupBy("key").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
