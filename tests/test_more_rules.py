"""Numbering plans, header walks, bisected faults, matching by rounds: each against a brute-force version or by hand."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from veilframe import derive
from veilframe.functions import phones, tables
from veilframe.functions import text as t
from veilframe.operators import evaluate, quality, spans
from veilframe.plans import evaluation
from veilframe.plans import stateful as stateful_plans
from veilframe.sources import records
from veilframe.streaming import policies

SF = "/root/testdata/sf0.001"
GAPS = " .()-"


def _digits(text, at):
    """Positions of digits from ``at`` on, with at most two gap characters between two of them."""
    out, gap = [], 0
    while at < len(text) and gap <= 2:
        if text[at] in "0123456789":
            out.append(at)
            gap = 0
        elif text[at] in GAPS:
            gap += 1
        else:
            break
        at += 1
    return out


def _end(text, places, plan):
    for rule in plan.rules:
        for n in range(min(rule.most, len(places)), rule.least - 1, -1):
            if all(re.fullmatch(c, text[p]) for c, p in zip(rule.leading, places)) and text[places[n - 1] + 1 : places[n - 1] + 2] not in tuple("0123456789"):
                return places[n - 1] + 1
    return None


def _number_at(text, i, region):
    if text[i] == "+":
        places = _digits(text, i + 1)
        for plan in phones.PLANS.values() if places and places[0] == i + 1 else ():
            k = len(plan.code)
            if "".join(text[p] for p in places[:k]) != plan.code or len(places) < k:
                continue
            behind = places[k - 1] + 1
            trunk = re.match(rf"[ .()\-]{{0,2}}\({plan.trunk}\)", text[behind:]) if plan.trunk else None
            if trunk:
                after = _digits(text, behind + trunk.end())
                end = after and after[0] - behind - trunk.end() <= 2 and _end(text, after, plan)
                if end:
                    return end
            end = _end(text, places[k:], plan)
            if end:
                return end
        return None
    plan = phones.PLANS[region]
    begin = i + (text[i] == "(")
    places = _digits(text, begin)
    if not places or places[0] != begin:
        return None
    end = _end(text, places[1:], plan) if plan.trunk and text[begin] == plan.trunk else None
    return end or (None if plan.trunk_needed else _end(text, places, plan))


def _numbers(text, region):
    i = 0
    while i < len(text):
        ahead = text[i] in "+(0123456789" and not (i and text[i - 1] in "+0123456789")
        end = _number_at(text, i, region) if ahead else None
        if end:
            yield i, end
        i = end or i + 1


PLANTED = {
    "US": ["(415) 555-0132", "1-415-555-0132", "4155550132"], "GB": ["020 7946 0958", "(0161) 496 0000", "07700 900123"], "DE": ["030 901820", "0151 12345678"],
    "FR": ["01 99 00 12 34"], "ES": ["612 345 678"], "IT": ["06 1234567", "312 345 6789"], "NL": ["020-1234567"], "BE": ["0470 12 34 56", "02 123 45 67"], "CH": ["044 668 18 00"],
    "SE": ["070-123 45 67"], "PL": ["22 123 45 67"], "BR": ["(11) 91234-5678"], "AU": ["02 5550 1234"], "JP": ["03-1234-5678", "090-1234-5678"], "IN": ["98765 43210"], "PT": ["211 234 567"], "IE": ["01 234 5678"], "AT": ["0664 1234567"],
}


@pytest.mark.parametrize("region", sorted(phones.PLANS))
def test_numbers_of_a_region(spark, region):
    r = random.Random(region)
    plan = phones.PLANS[region]
    bits = ["+", plan.code, plan.trunk, "(0)", " ", "-", ".", "(", ")", "a", "20", "7946", "0958", "415", "555", "0132", "6", "91234", "5", *(f"+{p.code}" for p in phones.PLANS.values())]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    home = [f"call {x}, or not" for x in PLANTED[region]]
    national = [re.sub(r"^\(?0\)?|(?<=\()0", "", x) if plan.trunk == "0" and region != "BR" else x for x in PLANTED[region]]
    abroad = [f"at +{plan.code} {x.lstrip('1-') if region == 'US' else x}!" for x in national]
    rows = list(enumerate(texts + home + abroad + ["", "year 2024", "+999 12345678"]))
    got = spark.createDataFrame([*rows, (-1, None)], "i int, s string").select("i", phones.number_spans(F.col("s"), region).alias("f")).collect()
    found = {x.i: [(s.start, s.end) for s in x.f] for x in got}
    assert found.pop(-1) == [] and found == {i: list(_numbers(x, region)) for i, x in rows}
    assert all(len(found[len(texts) + i]) == 1 for i in range(len(home + abroad)))


def test_unknown_region_is_refused():
    with pytest.raises(ValueError, match="ZZ"):
        phones.pattern("ZZ")


def _jpeg(segments, width, height):
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", n + 2) + b"\xff" * n for n in segments) + b"\xff\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + b"\0\0"


def test_headers_of_any_length(spark):
    rows = [("long", _jpeg([60000, 60000], 640, 480)), ("short", _jpeg([], 3, 4)), ("none", None), ("empty", b""), ("text", b"plain" * 9), ("cut", _jpeg([60000, 60000], 1, 2)[:100000]), ("many", _jpeg([5, 0, 700] * 90, 7, 8))]
    want = {"long": (640, 480), "short": (3, 4), "many": (7, 8)}
    for piece in (1, 7, 64, 1 << 16):
        files = spark.createDataFrame([x for x in rows if piece > 60 or x[0] not in ("long", "cut")], "path string, content binary")
        got = {x.path: (x.width, x.height) for x in records.jpeg_sizes(files, piece).collect()}
        assert got == {p: want.get(p, (None, None)) for p in got} and len(got) == files.count()
    assert records.jpeg_size(rows[0][1]) == (640, 480)


def test_escaped_keys_beside_repeated_ones(spark):
    rows = [(1, '{"a":1,"a":2,"Face_\\u0043rop":3}'), (2, '{"Face_\\u0043rop":3}'), (3, '{"a":1,"a":"Face_\\u0043rop"}'), (4, '{"a":1,"a":2,"face\\/crop" : 3'), (5, None), (6, "")]
    found = quality.forbidden_keys(spark.createDataFrame(rows, "i int, j string"), F.col("i"), F.col("j")).collect()
    assert sorted((x.location, x.key) for x in found) == [(1, "facecrop"), (2, "facecrop"), (4, "facecrop")]


def test_diagnostic_text_is_compatible(spark):
    rows = [(" Ａｂ  c　d ",), ("ﬁn",), (None,), ("",), ("plain  Text",)]
    assert [x.d for x in spark.createDataFrame(rows, "s string").select(t.diagnostic(F.col("s")).alias("d")).collect()] == ["AB C D", "FIN", None, "", "PLAIN TEXT"]


@pytest.mark.parametrize("rows_a_batch", [1, 2, 3, 8, 1000])
def test_faults_do_not_depend_on_batches(spark, rows_a_batch):
    def analyze(batch):
        if batch["i"].isin([3, 4, 17]).any():
            raise KeyError("i")
        return batch.assign(n=batch["i"] * 2, failure=None)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows_a_batch)
    try:
        got = evaluate.plugged(spark.range(20).withColumnRenamed("id", "i").coalesce(1), analyze, "i long, n long, failure string").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((x.i, x.n, x.failure) for x in got) == [(i, None, "KeyError") if i in (3, 4, 17) else (i, 2 * i, None) for i in range(20)]


def test_slices_of_an_image(spark):
    rows = [(1, 20, 90, 0, 0, 0, 0), (1, 50, 50, 2, 0, 0, 0), (2, 21, 21, 1, 1, 0, 0), (3, 30, 30, 0, 2, None, 1), (4, None, None, None, None, None, None)]
    found = evaluate.image_slices(spark.createDataFrame(rows, "image int, width int, height int, blur int, occlusion int, illumination int, pose int"), "image").collect()
    assert sorted(tuple(x) for x in found) == [(1, "heavy_blur"), (1, "small"), (2, "baseline"), (3, "difficult_capture"), (3, "heavy_occlusion"), (4, "baseline")]


def _greedy(rows):
    used_t, used_p, out = set(), set(), set()
    for frame, truth, pred, by in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (frame, truth) not in used_t and (frame, pred) not in used_p:
            used_t.add((frame, truth))
            used_p.add((frame, pred))
            out.add((frame, truth, pred, by))
    return out


@pytest.mark.parametrize("scores", [1, 3, 10**6])
def test_rounds_equal_the_fold(spark, scores):
    r = random.Random(scores)
    rows = list({(f, a, b): (f, a, b, float(r.randint(1, scores))) for f, n in ((1, 40), (2, 3), (3, 25)) for a in range(n) for b in range(n) if r.random() < 0.6}.values())
    pairs = spark.createDataFrame(rows + rows[:50], "frame int, obj int, pred int, by double")
    names = ("frame", "obj", "pred", "by")
    got = [tuple(x) for x in evaluate.dominant_pairs(pairs, *names).collect()]
    assert set(got) == _greedy(rows) and len(set(got)) == len(got)
    assert evaluate.dominant_pairs(pairs.limit(0), *names).count() == 0


def test_crowded_frames_go_by_rounds(spark):
    truth = derive.truth_box(spark, SF)
    preds = derive.pred_box(truth)
    pairs = evaluate.overlap_pairs(truth, preds)
    rows = lambda most: sorted((x.frame, x.obj, x.pred) for x in evaluate.one_to_one(truth, preds, pairs, "iou", most=most).collect())
    assert rows(12) == rows(1 << 20)


def test_table_function_refuses_a_moving_grid(spark):
    tables.register(spark)
    frame = spark.sql("SELECT array(array(0.1D, 0.1D), array(0.6D, 0.1D), array(0.6D, 0.4D)) AS p, 8 AS g UNION ALL SELECT NULL, 8")
    frame.createOrReplaceTempView("polygons_of_a_test")
    cells = spark.sql(f"SELECT c.y, c.first, c.last FROM polygons_of_a_test, LATERAL {tables.CELLS}(p, 8) AS c").collect()
    assert sorted(tuple(c) for c in cells) == [(1, 2, 4), (2, 4, 4)]
    with pytest.raises(Exception, match="whole constant"):
        spark.sql(f"SELECT c.first FROM polygons_of_a_test, LATERAL {tables.CELLS}(p, g) AS c").collect()


def test_one_code_begins_no_other():
    codes = [p.code for p in phones.PLANS.values()]
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)]


def test_both_policies_in_one_session():
    windows = policies.Windows(100, 20, 40)
    step = policies.composition_step(policies.carry_step(("TEXT",), windows), policies.guard_step(windows))
    finding = lambda at, n=0, scene=False, failed=False, kind=0, frame=-1: ("s", at, kind, "TEXT", at + 100, failed, n, scene, frame)
    face = lambda at, n=0, kind=0, frame=-1, zones=True, thermal="NOMINAL", recovery="VERIFIED", failed=False: ("s", at, kind, at + 100, failed, n, zones, True, 0, thermal, recovery, False, frame, False)
    frame = lambda at, k, **options: ("s", at, 1, k, finding(at, kind=1, frame=k), face(at, kind=1, frame=k, **options))
    rows = [
        frame(1, 1),  # no face snapshot: shielded, findings not looked at
        ("s", 2, 0, -1, None, face(2, n=3)),
        frame(3, 2),  # faces are known, findings are not
        ("s", 4, 0, -1, finding(4, n=2), None),
        frame(5, 3),  # both
        frame(15, 4),  # the findings are carried
        frame(30, 5, thermal="WARNING"),  # expanded by the findings' age and by the heat
        frame(31, 6, zones=False),  # latched; what was accepted is forgotten, the snapshot that waits is not
        frame(32, 7, recovery="PENDING"),
        frame(33, 8),  # open again, and the waiting snapshot counts as new
        ("s", 34, 0, -1, finding(34, failed=True), None),
        frame(35, 9),  # a failed snapshot does not take away what a window covers
        ("s", 36, 0, -1, None, face(36, failed=True)),
        frame(37, 10),
        frame(38, 11),
    ]
    state, out = policies.composition_start(), []
    for row in rows:
        state, more = step(state, row)
        out += more
    assert out == [
        ("s", 1, "FULL_SHIELD", "MISSING", 0), ("s", 2, "FULL_SHIELD", "ERROR", 0), ("s", 3, "REGIONAL_SAFE", "FRESH", 5), ("s", 4, "REGIONAL_SAFE", "CARRIED", 5), ("s", 5, "REGIONAL_SAFE", "EXPANDED", 5),
        ("s", 6, "FULL_SHIELD", "ERROR", 0), ("s", 7, "FULL_SHIELD", "ERROR", 0), ("s", 8, "REGIONAL_SAFE", "FRESH", 5), ("s", 9, "REGIONAL_SAFE", "CARRIED", 5), ("s", 10, "FULL_SHIELD", "ERROR", 0), ("s", 11, "FULL_SHIELD", "ERROR", 0),
    ]


def test_a_session_of_both_policies_is_the_fold_of_its_rows(spark):
    """The query's rows are those of the step over each session's rows in order, whatever the partitions."""
    sf = "/root/testdata/sf0.001"
    found = sorted(tuple(r) for r in stateful_plans.j4_composition(spark, sf).collect())
    frames = stateful_plans._frames(spark, sf)
    windows = policies.Windows(30 * stateful_plans.DAY, 20 * stateful_plans.DAY, 40 * stateful_plans.DAY)
    events = [(tuple(r), "c") for r in stateful_plans._carry_rows(frames).collect()] + [(tuple(r), "g") for r in stateful_plans._guard_rows(frames).collect()]
    by_session = {}
    for row, side in events:
        by_session.setdefault(row[0], []).append((row, side))
    wanted = []
    for session, rows in by_session.items():
        step = policies.composition_step(policies.carry_step(("TEXT", "BARCODE"), windows), policies.guard_step(windows))
        waiting = [(r[1], 0, None, r if s == "c" else None, r if s == "g" else None) for r, s in rows if r[2] == 0]
        faces = {r[12]: r for r, s in rows if s == "g" and r[2] == 1}
        waiting += [(r[1], 1, r[8], r, faces[r[8]]) for r, s in rows if s == "c" and r[2] == 1]
        state = policies.composition_start()
        for at, kind, k, c, g in sorted(waiting, key=lambda x: x[:2]):
            state, more = step(state, (session, at, kind, k, c, g))
            wanted += more
    assert len(found) > 100 and found == sorted(wanted)


def test_terms_of_sessions_and_their_limits(spark):
    terms = [("a", "  Foo\u00a0 BAR "), ("a", "\uff21b"), ("a", "foo bar"), ("b", "x\u0001"), ("b", "fine"), ("c", "y" * 65), ("d", None), ("e", " \t "), ("h", "z" * 64), *(("f", f"t{i}") for i in range(33)), *(("g", f"t{i % 32}") for i in range(90)), (None, "loose")]
    zones = [("a", i) for i in range(8)] + [("h", i) for i in range(9)] + [("only", i) for i in range(9)]
    raw = spark.createDataFrame(terms, "session string, term string").withColumn("__x", F.lit(1))
    kept, refused = spans.session_terms(raw, spark.createDataFrame(zones, "session string, term int"))
    assert {(r.session, r.refusal) for r in refused.collect()} == {("b", "control"), ("c", "length"), ("d", "null"), ("e", "length"), ("f", "terms"), ("h", "zones"), ("only", "zones")}
    rows = {(r.session, r.term) for r in kept.collect()}
    assert rows == {("a", "foo bar"), ("a", "ab"), (None, "loose"), *(("g", f"t{i}") for i in range(32))}
    asked = [(1, "a", "FOO  bar"), (2, "a", "AB"), (3, "b", "fine"), (4, "g", "T31"), (5, "a", "\u0002"), (6, "a", None), (7, None, "loose"), (8, "a", "foo"), (9, "nobody", "ab"), (1, "a", "FOO  bar")]
    found = spans.configured(spark.createDataFrame(asked, "id int, session string, candidate string").withColumn("term", F.lit("t")), kept)
    assert sorted((r.id, r.configured, r.refusal) for r in found.collect()) == [
        (1, True, None), (1, True, None), (2, True, None), (3, False, None), (4, True, None), (5, None, "control"), (6, None, "null"), (7, False, None), (8, False, None), (9, False, None),
    ]
    nothing = spark.createDataFrame([], "session string, term string")
    kept, refused = spans.session_terms(nothing, nothing)
    assert kept.count() == 0 and refused.count() == 0
