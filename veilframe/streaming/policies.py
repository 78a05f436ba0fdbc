"""Per-session policies as folds: pure step functions that batch and streaming forms share.

A step takes a state and one row (a tuple) and gives the next state and the rows that come out. Rows of a session arrive in
time order; instants are nanoseconds.
"""

from __future__ import annotations

import math
from typing import NamedTuple

FRESH, CARRIED, EXPANDED, SHIELD = range(4)
BASIS = ("FRESH", "CARRIED", "EXPANDED", "SHIELD_REQUIRED")


class Windows(NamedTuple):
    """Limits of a policy: age of an assessment, carry and expansion (counted from acceptance), validity of a decision."""

    most_age: int
    carry: int
    expansion: int
    validity: int = 33_300_000
    #: Fresh nominal decisions in a row before a thermal latch opens.
    thermal_recovery: int = 3


LIBRARY = Windows(100_000_000, 100_000_000, 300_000_000)
PRODUCTION = Windows(550_000_000, 250_000_000, 400_000_000, 100_000_000)
FINDINGS = Windows(550_000_000, 2_500_000_000, 3_500_000_000, 100_000_000)


def carry_start() -> dict:
    """State of :func:`carry_step`: per lane what was accepted, and the newest source time that was looked at."""
    return {"lanes": {}, "consumed": {}, "latest": {}}


def carry_step(lanes: tuple[str, ...], windows: Windows, most_regions: int = 64):
    """Finding carry (J1). Rows: (session, at, kind, lane, valid_until, failed, n_findings, scene_changed, frame).

    kind 0 is a snapshot, which waits; kind 1 is a frame, which is decided: (session, frame, at, basis, regions).
    Age counts from acceptance. An empty or failed snapshot does not take away protection that a window still
    covers; once a window has run out, a source time that was looked at is never accepted again.
    """

    def decide(state: dict, at: int, scene: bool) -> tuple[int, int]:
        if scene:
            state["lanes"], state["consumed"] = {}, {}
        total, overall = 0, FRESH
        for lane in lanes:
            snapshot, held = state["latest"].get(lane), state["lanes"].get(lane)
            if snapshot and snapshot[2]:
                if held is None:
                    return SHIELD, 0
                snapshot = None
            new = bool(snapshot) and snapshot[0] > state["consumed"].get(lane, -1)
            if scene and snapshot and snapshot[0] != at:
                snapshot, new = None, False
            if new and snapshot[3] == 0 and held and held[1]:
                new = False
            if new:
                state["consumed"][lane] = snapshot[0]
                if at > snapshot[1] or snapshot[3] > most_regions:
                    state["lanes"].pop(lane, None)
                    return SHIELD, 0
                held = state["lanes"][lane] = (at, snapshot[3])
            if held is None:
                return SHIELD, 0
            age = at - held[0]
            if new:
                basis = FRESH
            elif age <= windows.carry:
                basis = CARRIED
            elif age <= windows.expansion:
                basis = EXPANDED
            else:
                state["lanes"].pop(lane)
                return SHIELD, 0
            total += held[1]
            if total > most_regions:
                state["lanes"] = {}
                return SHIELD, 0
            overall = max(overall, basis)
        return overall, total

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, kind, lane, valid_until, failed, n, scene, frame = row
        if kind == 0:
            # Of equal source times the first seen counts.
            if lane not in state["latest"] or state["latest"][lane][0] < at:
                state["latest"][lane] = (int(at), int(valid_until), bool(failed), int(n))
            return state, []
        basis, regions = decide(state, int(at), bool(scene))
        return state, [(session, frame, at, BASIS[basis], regions)]

    return step


def guard_start() -> dict:
    """State of :func:`guard_step`."""
    return {"latched": False, "thermal": False, "progress": 0, "fresh_at": None, "fresh_n": 0, "face": None}


def guard_step(windows: Windows, queue_capacity: int = 3):
    """Face fail-private policy (J2). Rows: (session, at, kind, valid_until, failed, n_findings, zones_ok, renderer_ok, queue, thermal, recovery, scene_changed, frame, ahead).

    kind 0 is a face snapshot; kind 1 a frame, decided as (session, frame, at, status, basis, regions). The guards' order names
    the basis. A failed snapshot clears what may be carried, a missing one does not.
    """

    def shield(basis: str) -> tuple[str, str, int]:
        return "FULL_SHIELD", basis, 0

    def latch(state: dict, basis: str, thermal: bool = False) -> tuple[str, str, int]:
        state.update(latched=True, thermal=state["thermal"] or thermal, progress=0, fresh_at=None, fresh_n=0)
        return shield(basis)

    def decide(state: dict, row: tuple) -> tuple[str, str, int]:
        _, at, _, _, _, _, zones_ok, renderer_ok, queue, thermal, recovery, scene, _, ahead = row
        if not zones_ok or not renderer_ok:
            return latch(state, "ERROR")
        if queue >= queue_capacity:
            return latch(state, "TIMEOUT")
        if thermal == "SEVERE":
            return latch(state, "ERROR", True)
        if recovery == "UNSAFE":
            return latch(state, "ERROR")
        face = state["face"]
        if face is None:
            state["progress"] = 0
            return shield("FUTURE" if ahead else "MISSING")
        source, valid_until, failed, n = face
        if failed:
            state.update(fresh_at=None, fresh_n=0, progress=0)
            return shield("ERROR")
        if at > valid_until or at - source > windows.most_age:
            state["progress"] = 0
            if scene or state["fresh_at"] is None or not state["fresh_n"]:
                state.update(fresh_at=None, fresh_n=0)
                return shield("STALE")
            age = at - state["fresh_at"]
            if age <= windows.carry:
                return "REGIONAL_SAFE", "CARRIED", state["fresh_n"]
            if age <= windows.expansion:
                return "REGIONAL_SAFE", "EXPANDED", state["fresh_n"]
            state.update(fresh_at=None, fresh_n=0)
            return shield("STALE")
        if state["latched"]:
            if recovery != "VERIFIED":
                state["progress"] = 0
                return shield("ERROR")
            if state["thermal"]:
                if thermal != "NOMINAL":
                    state["progress"] = 0
                    return shield("ERROR")
                state["progress"] += 1
                if state["progress"] < windows.thermal_recovery:
                    return shield("ERROR")
            state.update(latched=False, thermal=False, progress=0)
        state.update(fresh_at=at, fresh_n=n)
        return "REGIONAL_SAFE", "EXPANDED" if thermal == "WARNING" else "FRESH", n

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        if row[2] == 0:
            if state["face"] is None or state["face"][0] < row[1]:
                state["face"] = (int(row[1]), int(row[3]), bool(row[4]), int(row[5]))
            return state, []
        return state, [(row[0], row[12], row[1], *decide(state, row))]

    return step


def composed(face: tuple[str, str, int], finding: tuple[str, int]) -> tuple[str, str, int, bool]:
    """One frame's decision from both policies, and whether the finding state must be reset (J4): a face shield wins and resets it."""
    status, basis, n = face
    if status == "FULL_SHIELD":
        return status, basis, 0, True
    if finding[0] == "SHIELD_REQUIRED":
        return "FULL_SHIELD", "ERROR", 0, False
    return status, max(basis, finding[0], key=BASIS.index), n + finding[1], False


def composition_start() -> tuple[dict, dict]:
    """State of :func:`composition_step`: that of the finding carry and that of the face policy."""
    return carry_start(), guard_start()


def composition_step(carry, guard):
    """Both policies over one session (J4). Rows: (session, at, kind, frame, finding, face), the last two a row of ``carry`` and one of ``guard``.

    kind 0 is a snapshot, with the row of the policy that it is for and None for the other; kind 1 is a frame, with both. Out comes (session,
    frame, status, basis, regions). Under a face shield the findings are not looked at, and what was accepted of them is forgotten; snapshots
    that wait are kept.
    """
    as_tuple = lambda row: tuple(row.values()) if isinstance(row, dict) else tuple(row)

    def step(state: tuple[dict, dict], row: tuple) -> tuple[tuple[dict, dict], list[tuple]]:
        findings, faces = state
        session, _, kind, frame, finding, face = row
        if kind == 0:
            if finding is not None:
                findings, _ = carry(findings, as_tuple(finding))
            else:
                faces, _ = guard(faces, as_tuple(face))
            return (findings, faces), []
        faces, decided = guard(faces, as_tuple(face))
        if decided[0][3] == "FULL_SHIELD":
            status, basis, n, _ = composed(decided[0][3:6], ("FRESH", 0))
            return (carry_start() | {"latest": findings["latest"]}, faces), [(session, frame, status, basis, n)]
        findings, carried = carry(findings, as_tuple(finding))
        status, basis, n, _ = composed(decided[0][3:6], carried[0][3:5])
        return (findings, faces), [(session, frame, status, basis, n)]

    return step


def _overlap(a: tuple, b: tuple) -> float:
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def simple_tracks(least: float = 0.20):
    """IoU tracker (J7). Rows: (session, frame, left, top, right, bottom, given), sorted so; out: (session, frame, left, top, right, bottom, track).

    A detection takes the best unclaimed box of the frame before, ties to the smallest id; else it gets the next id. ``given`` is the
    detector's own id, which is kept as it is and does not move the next id on. A row with left null is a frame without detections: nothing comes out, and the
    next frame finds no box before it.
    """

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, frame, box, given = row[0], row[1], row[2:6], row[6]
        if state.get("frame") != frame:
            state = {"frame": frame, "before": state.get("now", []), "now": [], "claimed": set(), "next": state.get("next", 0)}
        if box[0] is None:
            return state, []
        scored = [(-_overlap(b, box), t) for t, b in state["before"] if t not in state["claimed"] and _overlap(b, box) >= least]
        if given is not None:
            track = int(given)
        elif scored:
            track = min(scored)[1]
        else:
            track = state["next"]
            state["next"] += 1
        state["claimed"].add(track)
        state["now"].append((track, box))
        return state, [(session, frame, *box, track)]

    return step


def _moved(track: dict, at: int) -> tuple:
    dt = at - track["at"]
    left, top, right, bottom = track["seen"]
    if dt <= 0:
        return track["seen"]
    vx, vy, vw, vh = track["v"]
    w = min(1.0, max(1e-6, right - left, right - left + vw * dt))
    h = min(1.0, max(1e-6, bottom - top, bottom - top + vh * dt))
    x = max(0.0, min(1.0 - w, (left + right) / 2 + vx * dt - w / 2))
    y = max(0.0, min(1.0 - h, (top + bottom) / 2 + vy * dt - h / 2))
    return (x, y, x + w, y + h)


def tracks_start() -> dict:
    """State of :func:`track_step`."""
    return {"tracks": {}, "hints": {}, "next": 0, "last": None}


def track_step(expiry: int = 400_000_000, least_iou: float = 0.10, most_distance: float = 0.30, most_scale: float = 2.0, ambiguous_iou: float = 0.30):
    """Track association (J6). Rows: (session, at, boxes) with boxes a list of (left, top, right, bottom, hint or None).

    Out: (session, at, track, left, top, right, bottom, confidence). A row that is not later than the last is refused: it comes out
    with track None and confidence REJECTED (J17). Ambiguity is sticky until a track expires.
    """

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, boxes = row[0], int(row[1]), [tuple(b) for b in row[2]]
        if state["last"] is not None and at <= state["last"]:
            return state, [(session, at, None, None, None, None, None, "REJECTED")]
        tracks, hints = state["tracks"], state["hints"]
        for t in [t for t, k in tracks.items() if at - k["at"] >= expiry]:
            hint = tracks.pop(t)["hint"]
            if hints.get(hint) == t:
                del hints[hint]
        pairs: list[tuple[float, int, int]] = []
        # A track is moved once a row, and what is asked of each pair stands here in place of calls.
        moved = {t: _moved(k, at) for t, k in tracks.items()}
        sides = [(t, *p, p[2] - p[0], p[3] - p[1]) for t, p in moved.items()]
        nearby: list[set[int]] = [set() for _ in boxes]
        for i, (left, top, right, bottom, hint) in enumerate(boxes):
            width, height, mine = right - left, bottom - top, nearby[i]
            for t, p0, p1, p2, p3, pw, ph in sides:
                w, h = pw / width, ph / height
                x = (right if right < p2 else p2) - (left if left > p0 else p0)
                y = (bottom if bottom < p3 else p3) - (top if top > p1 else p1)
                overlap = 0.0
                if x > 0.0 and y > 0.0:
                    union = pw * ph + width * height - x * y
                    overlap = x * y / union if union > 0 else 0.0
                close = overlap >= least_iou
                if not close and not (w <= most_scale and 1 / w <= most_scale and h <= most_scale and 1 / h <= most_scale):
                    continue
                distance = math.hypot((p0 + p2 - left - right) / 2, (p1 + p3 - top - bottom) / 2)
                if close or distance <= most_distance:
                    bonus = 2.0 if hint is not None and hints.get(hint) == t else 0.0
                    pairs.append((bonus + overlap + 1 - min(1.0, distance / most_distance), i, t))
                    mine.add(t)
        near = nearby.__getitem__
        for i, b in enumerate(boxes):
            prior = hints.get(b[4]) if b[4] is not None else None
            if prior is not None and prior not in near(i):
                tracks[prior]["lost"] = True
                del hints[b[4]]
        crowded = {i for i, a in enumerate(boxes) for j, b in enumerate(boxes) if i != j and _overlap(a, b) >= ambiguous_iou}
        unsure = {t for t, k in tracks.items() if k["lost"]}
        for i in range(len(boxes)):
            if i in crowded or len(near(i)) > 1:
                unsure |= near(i)
        used_boxes, used_tracks = set(), set()
        for _, i, t in sorted(pairs, key=lambda p: -p[0]):
            if i in used_boxes or t in used_tracks:
                continue
            k, b = tracks[t], boxes[i]
            k["lost"] = k["lost"] or t in unsure or i in crowded
            dt, s = at - k["at"], k["seen"]
            if dt > 0:
                k["v"] = ((b[0] + b[2] - s[0] - s[2]) / 2 / dt, (b[1] + b[3] - s[1] - s[3]) / 2 / dt, (b[2] - b[0] - s[2] + s[0]) / dt, (b[3] - b[1] - s[3] + s[1]) / dt)
            k.update(seen=b[:4], box=b[:4], at=at, confidence="AMBIGUOUS" if k["lost"] else "FRESH")
            if b[4] is not None:
                if k["hint"] is not None and k["hint"] != b[4] and hints.get(k["hint"]) == t:
                    del hints[k["hint"]]
                k["hint"] = b[4]
                hints[b[4]] = t
            used_boxes.add(i)
            used_tracks.add(t)
        for i, b in enumerate(boxes):
            if i not in used_boxes:
                t, lost = state["next"], i in crowded
                state["next"] += 1
                tracks[t] = {"seen": b[:4], "box": b[:4], "at": at, "v": (0.0, 0.0, 0.0, 0.0), "lost": lost, "hint": b[4], "confidence": "AMBIGUOUS" if lost else "FRESH"}
                if b[4] is not None:
                    hints[b[4]] = t
                used_tracks.add(t)
        for t, k in tracks.items():
            if t not in used_tracks:
                k["box"] = moved[t]
                k["lost"] = k["lost"] or t in unsure
                k["confidence"] = "AMBIGUOUS" if k["lost"] else "PREDICTED"
        state["last"] = at
        return state, [(session, at, t, *map(float, k["box"]), k["confidence"]) for t, k in sorted(tracks.items())]

    return step


def scene_step(changed_bits: int = 24, settled_bits: int = 8, confirmations: int = 3):
    """Scene change with hysteresis (J11). Rows: (session, at, pattern); out: (session, at, scene)."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, pattern = row[0], row[1], int(row[2]) & (1 << 64) - 1
        apart = lambda a: (pattern ^ a).bit_count()
        if "base" not in state or apart(state["base"]) < changed_bits:
            return {"base": pattern, "n": 0, "pending": 0}, [(session, at, "STABLE")]
        if not state["n"] or apart(state["pending"]) > settled_bits:
            state.update(pending=pattern, n=1)
            return state, [(session, at, "STABLE")]
        state["n"] += 1
        if state["n"] >= confirmations:
            return {"base": pattern, "n": 0, "pending": 0}, [(session, at, "CHANGED")]
        return state, [(session, at, "STABLE")]

    return step


#: The legal steps of a session besides those to FAILED and STOPPING.
LEGAL = {"SETUP": ("READY",), "READY": ("LIVE",), "LIVE": ("DEGRADED", "SHIELDING"), "DEGRADED": ("LIVE", "SHIELDING"), "SHIELDING": ("LIVE",), "STOPPING": ("ENDED",), "ENDED": (), "FAILED": ()}


def is_legal(source: str, target: str) -> bool:
    """Whether a session may step from one state to another."""
    if source == target:
        return False
    if source != "ENDED" and target in ("FAILED", "STOPPING"):
        return True
    return target in LEGAL[source]


def session_step():
    """Session machine (J15, J20). Rows: (session, at, event, host, health); out: (session, at, state, accepted, may_emit).

    ``event`` is a wanted state, HOST_LOST or HEALTH. Losing the host leads from READY back to SETUP, and from LIVE or DEGRADED to SHIELDING.

    HEALTH carries the publisher's health as (state, failure, fresh_media, safe) and acts while the session is LIVE or DEGRADED alone: a
    publisher that has FAILED or STOPPED stops the session; one that connects again, suffers from network or congestion, or has no fresh
    media degrades it; a session that the publisher has degraded recovers once it publishes fresh media without failure, the session is safe,
    and it has its host.
    """

    def by_health(state: dict, host: bool, health: tuple) -> tuple[str, bool]:
        now, (publisher, failure, fresh, safe) = state["state"], health
        if now not in ("LIVE", "DEGRADED"):
            return now, state["by_publisher"]
        if publisher in ("FAILED", "STOPPED"):
            return "STOPPING", state["by_publisher"]
        if publisher in ("CONNECTING", "RECONNECTING") or failure in ("NETWORK", "CONGESTION") or not fresh:
            return "DEGRADED", True
        if state["by_publisher"] and now == "DEGRADED" and publisher == "PUBLISHING" and failure == "NONE" and safe and host:
            return "LIVE", False
        return now, state["by_publisher"]

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, event, host, health = row
        state = {"state": "SETUP", "by_publisher": False} | state
        now, degraded, ok = state["state"], state["by_publisher"], True
        if event == "HOST_LOST":
            now = {"READY": "SETUP", "LIVE": "SHIELDING", "DEGRADED": "SHIELDING"}.get(now, now)
        elif event == "HEALTH":
            now, degraded = by_health(state, bool(host), tuple(health.values()) if isinstance(health, dict) else tuple(health))
        else:
            ok = is_legal(now, event) and (event != "READY" or bool(host))
            now = event if ok else now
        return {"state": now, "by_publisher": degraded}, [(session, at, now, ok, now in ("LIVE", "DEGRADED", "SHIELDING"))]

    return step


def coordinator_start() -> dict:
    """State of :func:`coordinator_step`."""
    return {"tracks": tracks_start(), "last": None, "revoked": False}


def coordinator_step(**limits):
    """Face lane of a session (J10, around J6, J8 and J9). Rows: (session, at, lane, failed, boxes, selected); boxes as in :func:`track_step`.

    Out: (session, at, status, host_lost, visible, protected): status FULL_SHIELD or TRACKED, the visible host's track, and how many tracks
    are protected. A snapshot that is not later than the last accepted one shields and changes nothing. One of another lane, a failed one and
    one that cannot be associated forget all tracks, and revoke the selection until none is selected.
    """
    associate = track_step(**limits)

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, lane, failed, boxes, selected = row
        shield = [(session, at, "FULL_SHIELD", selected is not None, None, 0)]
        if state["last"] is not None and at <= state["last"]:
            return state, shield
        if lane != "FACE" or failed:
            return {"tracks": tracks_start(), "last": state["last"], "revoked": state["revoked"] or selected is not None}, shield
        revoked = state["revoked"] and selected is not None
        try:
            before = set(state["tracks"]["tracks"])
            tracks, out = associate(state["tracks"], (session, at, boxes))
        except (ValueError, ZeroDivisionError, TypeError):
            return {"tracks": tracks_start(), "last": at, "revoked": revoked or selected is not None}, shield
        wanted = None if revoked else selected
        expired = before - set(tracks["tracks"])
        fresh = any(r[2] == wanted and r[7] == "FRESH" and not tracks["tracks"][r[2]]["lost"] for r in out) and wanted not in expired
        lost = (wanted is not None and not fresh) or revoked
        return {"tracks": tracks, "last": at, "revoked": revoked}, [(session, at, "TRACKED", lost, wanted if fresh else None, len(out) - int(fresh))]

    return step


#: What a publisher's failure means for a publication.
PUBLISHER_FAILURES = {"CONNECTION_FAILED": "CONNECT_FAILED", "AUTHENTICATION_FAILED": "AUTHENTICATION_FAILED", "DISCONNECTED": "NETWORK_DISCONNECTED"}
#: What a queue's refusal means for a publication.
QUEUE_FAILURES = {"OVERFLOW": "QUEUE_OVERFLOW", "INVALID_ORDER": "INVALID_PTS_ORDER", "STOPPED": "QUEUE_STOPPED"}


def publication_step():
    """Publication audit (J14). Rows: (session, at, event, detail); out: (session, at, state, failure, epoch, fresh_media, accepted).

    Events: CONNECT, CONNECTED, CONNECT_ERROR, PUBLISHER with a publisher's failure, LOST, CONGESTION, QUEUE with a refusal of the queue,
    PUBLISHED with CONFIG, KEY or MEDIA, PUBLISH_ERROR, STOP, CLOSE. States: IDLE, CONNECTING, PUBLISHING, RECONNECTING, FAILED, STOPPED,
    CLOSED. A (re)connection starts an epoch; media is fresh after a key unit that follows a configuration in its epoch. A publisher
    that disconnects while publishing is connected again. What a state does not allow is refused and changes nothing.
    """

    def failed(s: dict, code: str) -> None:
        s.update(state="FAILED", failure=code, config=False, fresh=False)

    def connect(s: dict, state: str, code: str) -> None:
        s.update(state=state, failure=code, config=False, fresh=False, epoch=s["epoch"] + 1)

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        session, at, event, detail = row
        s = {"state": "IDLE", "failure": "NONE", "epoch": 0, "config": False, "fresh": False} | state
        now = s["state"]
        active, ok = now in ("CONNECTING", "PUBLISHING", "RECONNECTING"), True
        if event == "CONNECT" and now == "IDLE":
            connect(s, "CONNECTING", s["failure"])
        elif event == "STOP" and now not in ("STOPPED", "CLOSED"):
            s.update(state="STOPPED", fresh=False)
        elif event == "CLOSE" and now != "CLOSED":
            s.update(state="CLOSED", fresh=False)
        elif not active:
            ok = False
        elif event == "CONNECTED" and now != "PUBLISHING":
            s.update(state="PUBLISHING", failure="NONE")
        elif event == "CONNECT_ERROR":
            failed(s, "CONNECT_FAILED")
        elif event == "PUBLISHER":
            if detail == "DISCONNECTED" and now == "PUBLISHING":
                connect(s, "RECONNECTING", "NETWORK_DISCONNECTED")
            else:
                failed(s, PUBLISHER_FAILURES[detail])
        elif event == "LOST":
            connect(s, "RECONNECTING", "NETWORK_DISCONNECTED")
        elif event == "CONGESTION":
            connect(s, "RECONNECTING", "CONGESTION")
        elif event == "QUEUE":
            failed(s, QUEUE_FAILURES[detail])
        elif event == "PUBLISH_ERROR":
            failed(s, "PUBLISH_FAILED")
        elif event == "PUBLISHED" and now == "PUBLISHING":
            if detail == "CONFIG":
                s["config"] = True
            elif detail == "KEY":
                s["fresh"] = s["config"]
        else:
            ok = False
        return s, [(session, at, s["state"], s["failure"], s["epoch"], s["fresh"], ok)]

    return step
