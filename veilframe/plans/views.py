"""The views of :mod:`veilframe.derive` as DuckDB SQL, written on their own."""

from __future__ import annotations

VIEWS = {
    "truth_box": """SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS obj,
        CASE l_returnflag WHEN 'A' THEN 'EMAIL' WHEN 'N' THEN 'CARD' ELSE 'PHONE' END AS category,
        (l_partkey % 40) / 64e0 AS "left", (l_suppkey % 40) / 64e0 AS top,
        (l_partkey % 40 + 3 + l_quantity::BIGINT % 16) / 64e0 AS "right", (l_suppkey % 40 + 9 + l_linenumber % 8) / 64e0 AS bottom,
        l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, 3 + l_quantity::BIGINT % 16 <= 4 AS is_small,
        l_tax >= 0.06::DOUBLE AS is_blurred, l_discount >= 0.08::DOUBLE AS is_occluded, l_linestatus = 'F' AND l_linenumber >= 5 AS is_difficult FROM lineitem""",
    "pred_box": """SELECT frame, obj AS pred, CASE WHEN ln = 7 THEN 'OTHER' ELSE category END AS p_category,
        greatest(0, least(1, "left" + (pk % 5 - 2) / 64e0)) AS p_left, greatest(0, least(1, top + (sk % 3 - 1) / 64e0)) AS p_top,
        greatest(0, least(1, "right" + (pk % 5 - 2) / 64e0)) AS p_right, greatest(0, least(1, bottom + (sk % 3 - 1) / 64e0)) AS p_bottom
        FROM truth_box WHERE obj % 5 <> 4""",
    "session_frames": """SELECT user_id AS session, epoch_us(ts) * 1000 AS ts_ns, event_id, event_type, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events""",
    "episode_frames": """SELECT session AS episode, frame, ts_ns, event_type <> 'signup' AS visible, value < 400 AS guarded,
        CASE WHEN event_type IN ('click', 'view') THEN floor(value / 100)::BIGINT END AS track FROM session_frames""",
    "snapshots": """SELECT session, event_id, CASE event_type WHEN 'click' THEN 'FACE' WHEN 'view' THEN 'TEXT' WHEN 'purchase' THEN 'BARCODE'
        ELSE ['FACE', 'TEXT', 'BARCODE'][session % 3 + 1] END AS lane, ts_ns AS source_ns, ts_ns + floor(value)::BIGINT * 3600000000000 AS valid_until_ns,
        event_type = 'error' AS failed, floor(value)::BIGINT % 4 AS n_findings FROM session_frames WHERE event_type IN ('click', 'view', 'purchase', 'error')""",
}
#: What each view reads besides the driver's tables.
NEEDS = {"pred_box": ["truth_box"], "episode_frames": ["session_frames"], "snapshots": ["session_frames"]}


def sql(body: str, *names: str) -> str:
    """A query over some of the views; ``body`` may begin with further CTEs after 'WITH'."""
    wanted: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, []), name):
            if n not in wanted:
                wanted.append(n)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    rest = body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes}, {rest[5:]}"
    return f"WITH {ctes} {rest}"
