"""The stage store as a stateful streaming query: state keyed by run.

Events (event_id, run_id, family, stage, outcome, error_class) come in as a stream; a run's
state holds which stages completed, were dispatched, and failed how often, and the numbers of
its last ``REMEMBERED`` events, so that a redelivered one counts once. A completion
records itself and dispatches what became ready in one step, as all events of a run are
handled by one task against one state. Output rows are what a worker would be sent; a retry
carries its delay, which the receiving queue keeps. Duplicate completions dispatch nothing
again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.streaming.stages import PERMANENT, PIPELINE, RETRY_MS, ready

OUT = "run_id string, action string, stage string, attempt int, reason string"
STATE = "body string"
REMEMBERED = 256
LIMITS = {s.name: s.max_attempts for s in PIPELINE}


def step(state: dict, family: str, stage: str, outcome: str, error_class: str | None) -> list[tuple[str, str, int, str | None]]:
    """One event's effect on a run's state, and the rows it gives: (action, stage, attempt, reason)."""
    done, sent, attempts = set(state["completed"]), set(state["dispatched"]), state["attempts"]
    if stage not in LIMITS:
        return [("dead_letter", stage, 1, "unknown stage")]
    out: list[tuple[str, str, int, str | None]] = []
    if outcome == "ok":
        done.add(stage)
        new = ready(family, done, sent | {stage})
        sent |= {stage, *new}
        out = [("dispatch", s, 1, None) for s in new]
    else:
        n = attempts.get(stage, 0) + 1
        attempts[stage] = n
        if error_class in PERMANENT:
            out = [("dead_letter", stage, n, "permanent")]
        elif n >= LIMITS[stage]:
            out = [("dead_letter", stage, n, "attempts exhausted")]
        else:
            out = [("retry", stage, n + 1, f"after {RETRY_MS[min(n, len(RETRY_MS)) - 1]} ms")]
    state["completed"], state["dispatched"] = sorted(done), sorted(sent)
    return out


NEW = {"completed": [], "dispatched": [], "attempts": {}, "seen": []}
COLUMNS = [x.split()[0] for x in OUT.split(", ")]


def advance(run: str, state: dict, events: pd.DataFrame) -> pd.DataFrame:
    """All rows that a run's events give, in the order of their numbers; state is changed."""
    out, seen = [], dict.fromkeys(state["seen"])
    e = events.sort_values("event_id")
    for number, family, stage, outcome, error in zip(*(e[c].tolist() for c in ("event_id", "family", "stage", "outcome", "error_class")), strict=True):
        if number in seen:
            continue
        seen[number] = None
        out += [(run, *row) for row in step(state, family, stage, outcome, error)]
    state["seen"] = list(seen)[-REMEMBERED:]
    return pd.DataFrame(out, columns=COLUMNS)


def handle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(NEW))
    out = advance(key[0], now, pd.concat(list(parts), ignore_index=True))
    state.update((json.dumps(now),))
    yield out


def run_stages(events: DataFrame) -> DataFrame:
    """The rows that a stream of events (event_id, run_id, family, stage, outcome, error_class) gives, in append mode."""
    return events.groupBy("run_id").applyInPandasWithState(handle, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame) -> DataFrame:
    """The same rows from a table of events at once."""

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return advance(key[0], json.loads(json.dumps(NEW)), pdf)

    return events.groupBy("run_id").applyInPandas(whole, OUT)


def progress(path: str):
    """A sink that appends each batch's rows as progress events; a batch that is repeated replaces its own."""
    return lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)
