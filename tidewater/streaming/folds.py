"""Stateful folds over streams: transcripts, levels, events of a response, histories.

A fold takes the rows of one key in order and keeps a small state between micro-batches. Each is
a plain function ``step(state, row) -> (state, outputs)``; :func:`folded` runs it on a stream."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Fold:
    """``state``: DDL of the state, ``start``: its first value, ``out``: DDL of the outputs that
    follow the key. A state of None is dropped: the key starts anew."""

    start: tuple
    state: str
    out: str
    step: Callable[[tuple, object], tuple[tuple | None, list[tuple]]]


def folded(df: DataFrame, key: str, order: str, fold: Fold, idle: str | None = None) -> DataFrame:
    """Run a fold over a streaming ``df``; rows of a micro-batch are taken in ``order``. With
    ``idle`` (milliseconds) the state of a key that stays silent is dropped."""
    kind = dict(df.dtypes)[key]
    names = [key] + [x.strip().split(" ")[0] for x in fold.out.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = tuple(state.get) if state.exists else fold.start
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out: list[tuple] = []
        gone = False
        for r in rows.itertuples(index=False):
            s, o = fold.step(s, r)
            out += [(k[0], *x) for x in o]
            gone = s is None
            if gone:
                s = fold.start
        if gone:
            state.remove()
        else:
            state.update(s)
            if idle:
                state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {fold.out}", fold.state, "append", timeout)


# ---- transcripts ------------------------------------------------------------------------


def _transcript(s: tuple, r) -> tuple[tuple | None, list[tuple]]:
    text, ends = s[0], list(s[1])
    if r.kind == "cancel":
        return None, []
    if r.kind == "end":
        return None, [(text, ends, True)]
    if r.text:
        text += r.text
    if r.kind == "eou" and text and (not ends or ends[-1] != len(text)):
        ends.append(len(text))
    return (text, ends), [(text, ends, False)] if r.text else []


#: Rows ``kind`` (delta, eou, end, cancel) and ``text``: the transcript so far, and at the end the
#: whole one with the offsets at which utterances ended. Cancelled streams give nothing more.
TRANSCRIPT = Fold(("", []), "text string, ends array<int>", "transcript string, ends array<int>, final boolean", _transcript)

# ---- audio levels -------------------------------------------------------------------------

# Fixed values of the level meter.
HIGH_PASS, ATTACK, RELEASE = 0.9695, 0.32, 0.14
FLOOR, GATE_DB, TOP_DB, SILENT = 1e-5, -32.0, -8.0, 0.025


def level(s: tuple, samples: Sequence[float]) -> tuple:
    """One chunk through high-pass, gate and attack or release; the state is (previous input,
    previous output, envelope)."""
    x0, y0, env = s
    if len(samples) == 0:
        return s
    squares = top = 0.0
    for x in samples:
        x = max(-1.0, min(1.0, float(x)))
        y0, x0 = HIGH_PASS * (y0 + x - x0), x
        squares += y0 * y0
        top = max(top, abs(y0))
    rms = math.sqrt(squares / len(samples))
    db = lambda v: 20 * math.log10(max(v, FLOOR))
    share = lambda v: max(0.0, min(1.0, (db(v) - GATE_DB) / (TOP_DB - GATE_DB)))
    target = 0.0
    if rms > FLOOR and db(rms) > GATE_DB:
        m = max(0.0, min(1.0, 0.9 * share(rms) + 0.1 * share(top)))
        target = m * m * (3 - 2 * m)
    env += (ATTACK if target > env else RELEASE) * (target - env)
    if target == 0 and env < SILENT:
        env = 0.0
    return x0, y0, max(0.0, min(1.0, env))


def _level(s: tuple, r) -> tuple[tuple, list[tuple]]:
    s = level(s, r.samples)
    return s, [(r.seq, s[2])]


#: Rows ``seq`` and ``samples``: the smoothed level after each chunk.
LEVEL = Fold((0.0, 0.0, 0.0), "x double, y double, env double", "seq bigint, level double", _level)

# ---- server-sent events ---------------------------------------------------------------------


def sse_payloads(rest: str, fields: list[str], chunk: str, last: bool = False) -> tuple[str, list[str], list[str]]:
    """Payloads that are complete after a chunk of text: (unfinished line, data lines of the
    unfinished event, payloads). The end of the stream completes an event."""
    done: list[str] = []
    parts = (rest + chunk).split("\n")
    rest = parts.pop()
    if last and rest:
        parts.append(rest)
        rest = ""
    for line in parts:
        line = line.rstrip("\r")
        if not line:
            if fields:
                done.append("\n".join(fields))
                fields = []
        elif line == "data":
            fields = [*fields, ""]
        elif line.startswith("data:"):
            fields = [*fields, line[5:].lstrip(" ")]
    if last and fields:
        done.append("\n".join(fields))
        fields = []
    return rest, fields, done


def _response(s: tuple, r) -> tuple[tuple | None, list[tuple]]:
    rest, fields, text, first, finish, used, over = s
    rest, fields, done = sse_payloads(rest, list(fields), r.chunk or "", bool(r.last))
    for payload in done:
        if over or payload == "[DONE]":
            over = True
            continue
        event = json.loads(payload)
        n = (event.get("usage") or {}).get("completion_tokens")
        used = n if n is not None else used
        for choice in event.get("choices") or []:
            part = (choice.get("delta") or {}).get("content") or ""
            if part and first is None:
                first = int(r.at_ms)
            text += part
            finish = choice.get("finish_reason") or finish
    if r.last:
        return None, [(text, finish, used, first)]
    return (rest, fields, text, first, finish, used, over), []


#: Rows ``chunk``, ``at_ms`` and ``last``: the answer of a request when its stream ends, with the
#: time of its first text, the last usage and the reason it ended.
RESPONSE = Fold(
    ("", [], "", None, None, None, False),
    "rest string, fields array<string>, text string, first bigint, finish string, used bigint, over boolean",
    "text string, finish_reason string, completion_tokens bigint, first_text_ms bigint",
    _response,
)

# ---- histories and rates ----------------------------------------------------------------------


def history(most: int = 5) -> Fold:
    """The last ``most`` texts of a key, newest first; ``undo`` takes the newest back."""

    def step(s: tuple, r) -> tuple[tuple, list[tuple]]:
        kept = list(s[0])
        if r.kind == "undo":
            out = [(kept[0], True)] if kept else []
            return (kept[1:],), out
        return ([r.text, *kept][:most],), [(r.text, False)]

    return Fold(([],), "kept array<string>", "text string, undone boolean", step)


def throttled(gap_ms: int = 50) -> Fold:
    """At most one row in each ``gap_ms``: the first, then the next one after the gap."""

    def step(s: tuple, r) -> tuple[tuple, list[tuple]]:
        if s[0] is not None and r.at_ms - s[0] < gap_ms:
            return s, []
        return (int(r.at_ms),), [(int(r.at_ms), r.text)]

    return Fold((None,), "at bigint", "at_ms bigint, text string", step)


def growth() -> Fold:
    """How much a growing file gained since it was last seen; a terminal status ends it."""

    def step(s: tuple, r) -> tuple[tuple | None, list[tuple]]:
        gained = int(r.bytes) - (s[0] or 0)
        out = [(int(r.bytes), gained, r.status)]
        return (None if r.status in ("completed", "failed", "stopped", "cancelled") else (int(r.bytes),)), out

    return Fold((None,), "seen bigint", "bytes bigint, gained bigint, status string", step)
