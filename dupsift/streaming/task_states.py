"""Tasks as state machines over a stream of commands, and the same for a finished table of commands.

A task is created (PENDING), run (RUNNING, from any state but RUNNING) and ends as SUCCESS or FAILED. Commands that don't fit the state are rejected and change
nothing. A run replaces the results of the one before: results carry the number of their run, and only those of the last run stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The states' names.
PENDING, RUNNING, SUCCESS, FAILED = "PENDING", "RUNNING", "SUCCESS", "FAILED"
#: Command to the states that it fits (None: no such task yet) and the state that it leads to.
MOVES = {"create": ((None,), PENDING), "run": ((PENDING, SUCCESS, FAILED), RUNNING), "finish": ((RUNNING,), SUCCESS), "fail": ((RUNNING,), FAILED)}
EVENTS = "task_id bigint, seq bigint, command string, before string, after string, accepted int, run int"


def move(state: str | None, command: str) -> str | None:
    """The state after a command, None if it doesn't fit."""
    fits, after = MOVES.get(command, ((), None))
    return after if state in fits else None


class _Machine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, run int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, run = tuple(self.state.get()) if self.state.exists() else (None, 0)
        out = []
        for seq, command in sorted((int(s), c) for part in rows for s, c in zip(part["seq"], part["command"], strict=True)):
            after = move(state, command)
            run += after == RUNNING
            out.append((key[0], seq, command, state, after or state, int(after is not None), run))
            state = after or state
        if state is not None:
            self.state.update((state, run))
        yield pd.DataFrame(out, columns=["task_id", "seq", "command", "before", "after", "accepted", "run"])

    def close(self) -> None:
        pass


def follow(commands: DataFrame) -> DataFrame:
    """EVENTS of a stream of commands (task_id, seq, command): each command with the states before and after, whether it was accepted, and the number of runs so far. Needs a state store that
    keeps several variables (spark.sql.streaming.stateStore.providerClass: RocksDB's)."""
    return commands.groupBy("task_id").transformWithStateInPandas(_Machine(), EVENTS, "append", "none")


def _next(state: Column, command: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (fits, after) in MOVES.items():
        fit = state.isNull() if fits == (None,) else state.isin(*fits)
        out = F.when((command == name) & F.coalesce(fit, F.lit(False)), after).otherwise(out)
    return out


def states(commands: DataFrame) -> DataFrame:
    """task_id, state, run, rejected, after all commands of a table, in order of seq. A task's commands are few: they are folded as one array."""
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("run"), F.lit(0).alias("rejected"))

    def step(acc: Column, x: Column) -> Column:
        after = _next(acc["state"], x["command"])
        return F.struct(F.coalesce(after, acc["state"]).alias("state"), (acc["run"] + F.when(after == RUNNING, 1).otherwise(0)).alias("run"), (acc["rejected"] + F.when(after.isNull(), 1).otherwise(0)).alias("rejected"))

    ordered = commands.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "command"))).alias("c"))
    return ordered.select("task_id", F.aggregate("c", start, step).alias("s")).select("task_id", "s.state", "s.run", "s.rejected")


def standing(results: DataFrame, final: DataFrame) -> DataFrame:
    """The results (task_id, run, ...) of each task's last run. final: states()."""
    return results.join(final.select("task_id", "run"), ["task_id", "run"], "left_semi")
