"""Turn starts as a finite-state scan that never needs a whole session in one task.

Whether a user message opens a new turn depends on what the current turn holds, which depends on earlier starts. The
rule has only eight states, so a block of events can be summarised by the state it leads to from each of the eight
states. Blocks are folded independently, their summaries are chained per session (one small row per block), and
each block is then replayed from its now known entry state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.ordered import EVENTS_PER_BLOCK

# What an event does: it opens a turn, asks whether one must be opened, or repeats/changes the named turn.
NONE, OPEN, ASK, SAME_TURN, OTHER_TURN = 0, 1, 2, 3, 4
# What it leaves in the current turn.
ITEM, TERMINAL, ANSWER = 8, 16, 32
ACTIONS = 7

# States 0..3: nothing, items, terminal event, ready for a new user turn; +4 once a user message opened a turn after
# the last named one.
EMPTY, ITEMS, ENDED, READY, AFTER_USER = 0, 1, 2, 3, 4


def step(state: int, code: int) -> tuple[int, bool]:
    """Next state and whether the event opens a turn."""
    content, after_user = state & 3, state & AFTER_USER
    action, start = code & ACTIONS, False
    if action == OPEN or (action == OTHER_TURN) or (action == SAME_TURN and after_user):
        content, after_user, start = EMPTY, 0, True
    elif action == ASK and content == READY:
        content, after_user, start = EMPTY, AFTER_USER, True
    if code & ANSWER:
        content = READY
    else:
        if code & TERMINAL:
            content = {EMPTY: ENDED, ITEMS: READY}.get(content, content)
        if code & ITEM:
            content = {EMPTY: ITEMS, ENDED: READY}.get(content, content)
    return content | after_user, start


CODES = [a | f for a in range(5) for f in range(0, 64, 8)]
NEXT = {c: bytes([step(s, c)[0] for s in range(8)]) + bytes(248) for c in CODES}
STARTS = {c: [step(s, c)[1] for s in range(8)] for c in CODES}
IDENTITY = bytes(range(8))


def _summarise(rows: pd.DataFrame) -> pd.DataFrame:
    reach = IDENTITY
    for code in rows.sort_values("event_index")["code"]:
        reach = reach.translate(NEXT[code])
    return pd.DataFrame({"session_id": rows["session_id"].iloc[:1], "block": rows["block"].iloc[:1], "reach": [reach]})


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    state, entry = EMPTY, []
    ordered = rows.sort_values("block")
    for reach in ordered["reach"]:
        entry.append(state)
        state = reach[state]
    return pd.DataFrame({"session_id": ordered["session_id"], "block": ordered["block"], "entry": entry})


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    ordered = rows.sort_values("event_index")
    state, opened = int(ordered["entry"].iloc[0]), []
    for code in ordered["code"]:
        opened.append(STARTS[code][state])
        state = NEXT[code][state]
    return ordered.loc[opened, ["session_id", "event_index"]]


def turn_starts(coded: DataFrame, block_size: int = EVENTS_PER_BLOCK) -> DataFrame:
    """(session_id, event_index) of every event that opens a turn; ``coded`` has session_id, event_index, code."""
    key = coded.schema["session_id"].dataType.simpleString()
    rows = coded.filter("code <> 0").select(
        "session_id", F.col("event_index").cast("long").alias("event_index"), F.col("code").cast("int").alias("code"),
        F.floor(F.col("event_index") / block_size).alias("block"),
    )
    reach = rows.groupBy("session_id", "block").applyInPandas(_summarise, f"session_id {key}, block long, reach binary")
    entry = reach.groupBy("session_id").applyInPandas(_chain, f"session_id {key}, block long, entry int")
    return (
        rows.join(entry, ["session_id", "block"]).groupBy("session_id", "block")
        .applyInPandas(_replay, f"session_id {key}, event_index long")
    )


def event_code(action: Column, item: Column, terminal: Column, answer: Column) -> Column:
    flag = lambda c, bit: F.when(F.coalesce(c, F.lit(False)), bit).otherwise(0)
    return action + flag(item, ITEM) + flag(terminal, TERMINAL) + flag(answer, ANSWER)
