"""Session policies in which things fall due: scheduling (J12), delayed release (J13), frames that wait for a decision.

A policy says what a row does, when its state next has something due, and what then happens. In batch, what falls due
before a row happens before it, and what is left at a session's end happens then; in a stream, event-time timers make it
happen once the watermark has passed it, without a further row. Both give the same rows. Instants are nanoseconds.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.streaming.folds import fold_sorted


class Policy(NamedTuple):
    """``start()`` a state; ``step(state, row)`` gives state and rows; ``due(state)`` an instant or None; ``fire(session, state, now)`` state and rows.

    ``first``: what is due at the very instant of a row happens before it. A row has its session first and its instant second.
    """

    start: Callable[[], dict]
    step: Callable[[dict, tuple], tuple[dict, list[tuple]]]
    due: Callable[[dict], int | None]
    fire: Callable[[Any, dict, int], tuple[dict, list[tuple]]]
    first: bool = False

    def until(self, session: Any, state: dict, now: float, inclusive: bool) -> tuple[dict, list[tuple]]:
        """Everything that is due before ``now`` (or at it)."""
        out: list[tuple] = []
        while (at := self.due(state)) is not None and (at < now or (inclusive and at == now)):
            state, made = self.fire(session, state, at)
            out += made
        return state, out

    def row(self, state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        """What is due before a row, and the row."""
        state, before = self.until(row[0], state, row[1], self.first)
        state, out = self.step(state, row)
        return state, before + out

    def rest(self, session: Any, state: dict) -> list[tuple]:
        """What is left when no row follows."""
        return self.until(session, state, float("inf"), True)[1]


def timed_fold(rows: DataFrame, key: str, order: list, policy: Policy, schema: str) -> DataFrame:
    """A policy over each session's rows in order."""
    return fold_sorted(rows, key, order, policy.start, policy.row, schema, policy.rest)


def schedule(interval: int, degraded: int, deadline: int, validity: int, optional: bool = True) -> Policy:
    """One lane's analyser, which runs one frame at a time.

    Rows: (session, at, kind, frame, thermal, scene, valid_until); kind FRAME, or DONE when a frame's run has ended with a result that holds
    until ``valid_until`` (None: it failed). Out: (session, frame, outcome). A frame not later than the last is STALE. A changed scene and
    SEVERE heat revoke what runs in an optional lane, and a frame that comes ``deadline`` after a mandatory one was started revokes that; its
    result is IGNORED when it comes, and a mandatory lane may start at once. While one runs, frames are BUSY. A frame starts if the interval
    since the last start has run out, or at a changed scene in an optional lane. A result that is not fresh at the latest frame, or holds
    longer than ``validity``, is INVALID.
    """

    def revoke(s: dict, session: Any, why: str) -> list[tuple]:
        out = [(session, s["running"][0], why)] if s["running"] else []
        s["running"] = None
        return out

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, kind, frame, thermal, scene, valid_until = row
        s, out = dict(state), []
        if kind == "DONE":
            if not s["running"] or s["running"][0] != frame:
                return s, [(session, frame, "IGNORED")]
            source, s["running"] = s["running"][1], None
            if valid_until is None:
                return s, [(session, frame, "FAILED")]
            fresh = source <= s["latest"] <= valid_until and valid_until - source <= validity
            return s, [(session, frame, "COMPLETED" if fresh else "INVALID")]
        if s["latest"] is not None and at <= s["latest"]:
            return s, [(session, frame, "STALE")]
        s["latest"] = at
        if optional:
            if scene:
                out += revoke(s, session, "SCENE_REVOKED")
            if thermal == "SEVERE":
                return s, [*out, *revoke(s, session, "HEAT_REVOKED"), (session, frame, "DISABLED")]
        elif s["running"] and at - s["running"][1] >= deadline:
            out += revoke(s, session, "DEADLINE_REVOKED")
            s["started"] = None
        if s["running"]:
            return s, [*out, (session, frame, "BUSY")]
        wait = degraded if thermal == "WARNING" else interval
        if s["started"] is not None and at - s["started"] < wait and not (scene and optional):
            return s, [*out, (session, frame, "SKIPPED")]
        s.update(started=at, running=(frame, at))
        return s, [*out, (session, frame, "STARTED")]

    return Policy(lambda: {"latest": None, "started": None, "running": None}, step, lambda s: None, lambda session, s, now: (s, []))


def release(delay_ns: int = 2_000_000_000, most_bytes: int = 8 << 20, most_us: int = 2_000_000) -> Policy:
    """Delayed release of a stream's units.

    Rows: (session, arrival, pts_us, bytes, is_config, is_key, unit, event); event None, RECONNECT or STOP. Out: (session, unit, outcome, at).
    A unit is ACCEPTED (``at``: when it will be due), refused, or stops the session, and an accepted one is later RELEASED or CLEARED. A
    configuration clears the queue, counts for its bytes alone, and leaves with the first unit behind it. Nothing leaves before a key unit.
    """

    def cleared(s: dict, session: Any, state: str) -> list[tuple]:
        out = [(session, x[0], "CLEARED", None) for x in s["queue"]]
        s.update(queue=[], bytes=0, first=None, last=None, state=state)
        return out

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, _, pts, size, config, key, unit, event = row
        s = state | {"queue": list(state["queue"])}
        over = s["state"] in ("FAILED", "STOPPED")
        if event == "STOP":
            return s, cleared(s, session, "STOPPED")
        if event == "RECONNECT":
            return s, [] if over else cleared(s, session, "CONFIG")
        if over:
            return s, [(session, unit, "STOPPED", None)]
        if config:
            out = cleared(s, session, "BUFFERING" if key else "KEY")
            if size > most_bytes:
                s["state"] = "FAILED"
                return s, [*out, (session, unit, "OVERFLOW", None)]
            s.update(queue=[(unit, size, None, None)], bytes=size)
            return s, [*out, (session, unit, "ACCEPTED", None)]
        if s["state"] == "CONFIG":
            return s, [(session, unit, "AWAITING_CONFIGURATION", None)]
        if s["state"] == "KEY" and not key:
            return s, [(session, unit, "AWAITING_KEY", None)]
        first = pts if s["first"] is None else s["first"]
        wrong = "INVALID_ORDER" if s["last"] is not None and pts < s["last"] else "OVERFLOW" if s["bytes"] + size > most_bytes or not 0 <= pts - first <= most_us else None
        if wrong:
            return s, [*cleared(s, session, "FAILED"), (session, unit, wrong, None)]
        leaves = pts * 1000 + delay_ns
        s["queue"].append((unit, size, leaves, pts))
        s.update(bytes=s["bytes"] + size, first=first, last=pts, state="BUFFERING" if key else s["state"])
        return s, [(session, unit, "ACCEPTED", leaves)]

    def due(s: dict) -> int | None:
        if s["state"] != "BUFFERING" or not s["queue"]:
            return None
        head = s["queue"][0]
        return head[2] if head[2] is not None else s["queue"][1][2] if len(s["queue"]) > 1 else None

    def fire(session: Any, state: dict, now: int) -> tuple[dict, list[tuple]]:
        head, *queue = state["queue"]
        bounds = {"first": queue[0][3], "last": queue[-1][3]} if queue else {"first": None, "last": None}
        return state | bounds | {"queue": queue, "bytes": state["bytes"] - head[1]}, [(session, head[0], "RELEASED", now)]

    return Policy(lambda: {"state": "CONFIG", "bytes": 0, "first": None, "last": None, "queue": []}, step, due, fire, first=True)


#: Bases of a decision after which nothing is let through until recovery is verified.
UNSAFE = ("ERROR", "TIMEOUT", "STALE", "EXPIRED", "EVICTED")


def waiting(budget: int = 100_000_000, capacity: int = 16) -> Policy:
    """Frames that wait for the decision on them, two streams joined by a queue.

    Rows: (session, at, kind, frame, of, ready, shield, basis): FRAME a frame and whether its geometry was ready; DECISION the decision on the
    frame taken ``of`` an instant, a shield or not, with its basis; VERIFY a verified recovery; FAIL a fault. Out: (session, frame, outcome).
    Frames leave in order, each by its own decision, a decision at the deadline included. No decision by then, a queue that is full, a fault
    or an unsafe basis shields all that wait and latches: every further frame is shielded until VERIFY. A frame whose geometry was not ready is
    shielded alone. A decision that comes before its frame is kept until the frame's deadline.
    """

    def shield_all(s: dict, session: Any, why: str) -> list[tuple]:
        out = [(session, x[2], f"{why}_SHIELD") for x in s["pending"]]
        s.update(pending=[], latched=True)
        return out

    def drain(s: dict, session: Any, now: int) -> list[tuple]:
        out: list[tuple] = []
        while s["pending"] and not s["latched"]:
            at, ready, frame = s["pending"][0]
            decision = s["decided"].get(at)
            if decision is None:
                return out + (shield_all(s, session, "TIMEOUT") if now >= at + budget else [])
            s["pending"], (shield, basis) = s["pending"][1:], decision
            if shield:
                out.append((session, frame, f"{basis}_SHIELD"))
                if basis in UNSAFE:
                    out += shield_all(s, session, basis)
            else:
                out.append((session, frame, "RELEASED" if ready else "UNREADY_SHIELD"))
        return out

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, kind, frame, of, ready, shield, basis = row
        s = state | {"pending": list(state["pending"]), "decided": {k: v for k, v in state["decided"].items() if k + budget >= at}}
        if kind == "VERIFY":
            s["latched"] = False
            return s, []
        if kind == "FAIL":
            return s, shield_all(s, session, "ERROR")
        if kind == "DECISION":
            s["decided"][of] = (shield, basis)
            return s, drain(s, session, at)
        if s["latched"]:
            return s, [(session, frame, "ERROR_SHIELD")]
        s["pending"].append((at, ready, frame))
        if len(s["pending"]) >= capacity:
            return s, shield_all(s, session, "TIMEOUT")
        return s, drain(s, session, at)

    def fire(session: Any, state: dict, now: int) -> tuple[dict, list[tuple]]:
        s = state | {"pending": list(state["pending"])}
        return s, drain(s, session, now)

    def due(s: dict) -> int | None:
        return s["pending"][0][0] + budget if s["pending"] and not s["latched"] else None

    return Policy(lambda: {"latched": False, "pending": [], "decided": {}}, step, due, fire)


class TimedProcessor(StatefulProcessor):
    """A policy over a stream: one state and one timer a session."""

    def __init__(self, policy: Policy, order: list[str], columns: list[str], fields: list[str]) -> None:
        self.policy, self.order, self.columns, self.fields = policy, order, columns, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Declares the state: the policy's, and the rows that the watermark has not passed yet."""
        self.handle = handle
        self.state = handle.getValueState("timed", T.StructType([T.StructField("value", T.BinaryType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Keeps a session's rows until no earlier one can come."""
        state, kept = self._held()
        for batch in rows:
            for text in batch["packed"]:
                row = json.loads(text)
                kept.append((tuple(row["sort"][c] for c in self.order), tuple(row["values"][c] for c in self.columns)))
        yield self._moved(key[0], state, kept, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What fell due by the watermark."""
        yield self._moved(key[0], *self._held(), timerValues.getCurrentWatermarkInMs())

    def _held(self) -> tuple[dict, list[tuple]]:
        held = self.state.get() if self.state.exists() else None
        return pickle.loads(bytes(held[0])) if held else (self.policy.start(), [])

    def _moved(self, session: Any, state: dict, kept: list[tuple], watermark_ms: int) -> pd.DataFrame:
        now, out = max(watermark_ms, 0) * 1_000_000, []
        kept.sort(key=lambda r: r[0])
        while kept and kept[0][0][0] <= now:
            state, made = self.policy.row(state, (session, *kept.pop(0)[1]))
            out += made
        state, made = self.policy.until(session, state, now, True)
        out += made
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        coming = [x for x in (self.policy.due(state), kept[0][0][0] if kept else None) if x is not None]
        if coming:
            self.handle.registerTimer(max(-(-min(coming) // 1_000_000), watermark_ms + 1))
        self.state.update((pickle.dumps((state, kept)),))
        return pd.DataFrame(out, columns=self.fields, dtype=object)

    def close(self) -> None:
        """Nothing to close."""


def timed_stream(rows: DataFrame, key: str, order: list[str], policy: Policy, schema: str, late: str = "1 second") -> DataFrame:
    """The streaming form of :func:`timed_fold`; needs the RocksDB state store.

    ``order`` names the columns to sort by, the instant first. A row is taken once the watermark, ``late`` behind the newest row, has passed it,
    so rows out of order within that time change nothing; later ones are dropped, as everywhere in Structured Streaming.
    """
    fields = T._parse_datatype_string(schema).fieldNames()
    columns = [c for c in rows.columns if c != key]
    # As text, whole numbers beside missing values do not become floating-point numbers on their way.
    packed = F.to_json(F.struct(F.struct(*order).alias("sort"), F.struct(*columns).alias("values")), {"ignoreNullFields": "false"})
    at = F.timestamp_micros(F.floor(F.col(order[0]) / 1000).cast("bigint"))
    sent = rows.select(key, at.alias("__at"), packed.alias("packed")).withWatermark("__at", late)
    processor = TimedProcessor(policy, order, columns, fields)
    return sent.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")
