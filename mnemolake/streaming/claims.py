"""Claims as a stream: each event moves its claim's state, and doubt that nothing settles ends the claim after a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemolake.operators.lifecycle import GRAVITY, STATES

#: The event that decides a claim's state so far (of the latest the gravest, see `lifecycle.lifecycle_state`), and since when it is doubted.
STATE = "at timestamp, n long, gravity int, kind string, since timestamp"
OUT = "id {}, last string, state string, at timestamp"
AUTO = "auto_expired_challenged"


def claim_states(events: DataFrame, ttl_hours: float = 168, late: str = "1 hour") -> DataFrame:
    """Changes of claims' states, from a stream of events (claim_id, n, event_type, created_at): id, last, state, at.

    Events may come in any order within `late`: a state depends on the latest event, not on the last one to come. A claim that is
    challenged, and was first so `ttl_hours` ago or more by the watermark, expires at that time, with or without further events. The
    last row of a claim is what `lifecycle.with_ttl` says of it at the time of the watermark.
    """
    kind = dict(events.dtypes)["claim_id"]
    ttl = pd.Timedelta(hours=ttl_hours)

    def move(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = (pd.Timestamp(held[0]), int(held[1]), int(held[2]), held[3]) if held else None
        since = pd.Timestamp(held[4]) if held and held[4] is not None and not pd.isna(held[4]) else None
        before = best
        for pdf in frames:
            known = pdf[pdf["event_type"].isin(list(STATES))]
            for at, n, what in zip(known["created_at"], known["n"], known["event_type"], strict=True):
                one = (pd.Timestamp(at), int(n), GRAVITY.index(STATES[what]), what)
                best = one if best is None else max(best, one)
            doubted = known.loc[known["event_type"] == "challenged", "created_at"]
            if len(doubted):
                since = min(filter(None, (since, pd.Timestamp(doubted.min()))))
        if best is None:
            return
        end = (since or best[0]) + ttl
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        if best[2] == 1 and end <= mark:
            best = (max(end, best[0]), best[1], 2, AUTO)
        state.update((best[0].to_pydatetime(), best[1], best[2], best[3], since.to_pydatetime() if since is not None else None))
        if best[2] == 1:
            # A timer must lie behind the watermark; it rings once this has passed it.
            state.setTimeoutTimestamp(max(int(end.value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        if best != before:
            yield pd.DataFrame({"id": [key[0]], "last": [best[3]], "state": [GRAVITY[best[2]]], "at": [best[0]]})

    rows = events.select("claim_id", "n", "event_type", "created_at").withWatermark("created_at", late)
    return rows.groupBy("claim_id").applyInPandasWithState(move, OUT.format(kind), STATE, "update", GroupStateTimeout.EventTimeTimeout)
