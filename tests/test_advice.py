"""Whole results where a query once did less: each case against a brute-force version."""

import hashlib
import random
import re
import unicodedata
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from veilframe import derive
from veilframe.functions import text as t
from veilframe.operators import evaluate, spans
from veilframe.plans import corpora, evaluation, scalar

SF = "/root/testdata/sf0.001"


def _boxes(spark):
    truth = derive.truth_box(spark, SF)
    return truth, derive.pred_box(truth)


def _area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def _inter(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _holds(p, t, padding=0.25):
    w, h = (p[2] - p[0]) * padding, (p[3] - p[1]) * padding
    return max(0, p[0] - w) <= t[0] and max(0, p[1] - h) <= t[1] and min(1, p[2] + w) >= t[2] and min(1, p[3] + h) >= t[3]


def _greedy(truth, preds, score, least):
    """(frame, obj, pred) to score: all pairs sorted, the best first, each side once."""
    t, p = defaultdict(dict), defaultdict(dict)
    for r in truth.collect():
        t[r.frame][r.obj] = (r.left, r.top, r.right, r.bottom)
    for r in preds.collect():
        p[r.frame][r.pred] = (r.p_left, r.p_top, r.p_right, r.p_bottom)
    out = {}
    for frame, objects in t.items():
        pairs = sorted((-score(a, b), i, j) for i, a in objects.items() for j, b in p[frame].items())
        used_t, used_p = set(), set()
        for s, i, j in pairs:
            if least(-s, objects[i], p[frame][j]) and i not in used_t and j not in used_p:
                used_t.add(i)
                used_p.add(j)
                out[frame, i, j] = -s
    return out, t, p


def test_slice_totals_match_greedily(spark):
    truth, preds = _boxes(spark)
    iou = lambda a, b: _inter(a, b) / (_area(a) + _area(b) - _inter(a, b))
    wanted, _, _ = _greedy(truth, preds, iou, lambda s, a, b: s >= 0.2 or _holds(b, a))
    first = evaluate.mutual_best(evaluate.overlap_pairs(truth, preds).where("iou >= 0.20"), "frame", "obj", "pred", "iou").count()
    overall = evaluate.slice_totals(truth, preds).where("slice = 'overall'").first()
    assert first < len(wanted) == overall.matched and overall.false_positives == preds.count() - len(wanted)
    assert overall.mean_iou == pytest.approx(sum(wanted.values()) / len(wanted), abs=1e-6)


def test_coverage_matches_greedily(spark):
    truth, preds = _boxes(spark)
    wanted, t, p = _greedy(truth, preds, _inter, lambda s, a, b: s > 0)
    got = {(r.frame, r.obj, r.pred): (r.coverage, r.excess) for r in evaluate.coverage_pairs(truth, preds).collect()}
    assert got.keys() == wanted.keys()
    for (frame, i, j), inter in wanted.items():
        coverage, excess = got[frame, i, j]
        assert coverage == pytest.approx(inter / _area(t[frame][i])) and excess == pytest.approx((_area(p[frame][j]) - inter) / _area(p[frame][j]))


def _named(text):
    """D2 to D5 with their categories, with another engine's regular expressions, from the rules."""
    edge = r"[\p{L}\p{N}._%+-]"
    label = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    for m in regex.finditer(rf"(?i)(?<!{edge})[\p{{L}}\p{{N}}.!#$%&'*+/=?^_`{{|}}~-]{{1,64}}@{label}(?:\.{label})+(?!{edge})", text):
        local, domain = m[0].split("@")
        if not re.search(r"^\.|\.$|\.\.", local) and len(domain) <= 253 and max(map(len, domain.split("."))) <= 63 and re.fullmatch("(?i)[a-z]{2,63}", domain.split(".")[-1]):
            yield "EMAIL", m.span()
    for m in regex.finditer(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", text):
        digits = [unicodedata.digit(c) for c in m[0] if c.isdigit()][::-1]
        if len(set(digits)) > 1 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            yield "PAYMENT_CARD", m.span()
    for m in re.finditer(r"(?<![0-9])(?:\+1[ -]?)?\(?[2-9][0-9]{2}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9])", text):
        yield "PHONE", m.span()
    yield from (("ONE_TIME_CODE", s) for s in _codes(text))


def _matches(text):
    yield from (span for _, span in _named(text))


def _codes(text):
    for m in regex.finditer(r"(?<!\d)\d{4,8}(?!\d)", text):
        before, after = text[max(0, m.start() - 64) : m.start()].lower(), text[m.end() : m.end() + 48].lower()
        left, right = re.sub(r"[ :#=-]{0,12}\Z", "", before), re.sub(r"\A[ :#=-]{0,12}", "", after)
        cues = [c + tail for c in ("verification", "verification code", "verify", "otp", "passcode", "security code", "authentication code", *(f"one{g}time{w}" for g in (" ", "-", "") for w in ("", " code", " password"))) for tail in ("", " is", " number", " code", " pin")]
        right = re.sub(r"\A(?:is )?(?:your )?", "", right)
        behind = ("verification code", "otp", "passcode", "security code", "one time code", "one-time code", "onetime code")
        if left.endswith(tuple(cues)) or any(right.startswith(c) and not right[len(c) : len(c) + 1].isalnum() for c in behind):
            yield m.span()


PRIVATE = "mail a.b@x.org or \u00e4\u00f6@x.org or +1 (415) 555-0199 or 4111 1111 1111 1111, your security code is: 123456; room 77 of 2024. 7777 is your otp! the code 9999 no"


@pytest.fixture
def texts(spark, tmp_path):
    rows = [(0, PRIVATE), (1, "plain words " * 1500 + PRIVATE), (2, PRIVATE * 200), (3, ""), (4, "a year: 1999. nothing else")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_whole_texts_are_redacted(spark, texts):
    path, rows = texts
    wanted = {}
    for doc_id, text in rows:
        out = list(text)
        for start, end in _matches(text):
            out[start:end] = "*" * (end - start)
        wanted[doc_id] = hashlib.sha256("".join(out).encode()).hexdigest()
    assert {r.doc_id: r.digest for r in scalar.d10_redacted(spark, path).collect()} == wanted


def test_codes_of_texts(spark, texts):
    path, rows = texts
    wanted = {(i, *span) for i, text in rows for span in _codes(f"{text} {'Room ' if i % 3 else 'Your security code is '}{i * 7919 % 1000000:06d} today")}
    assert {(r.doc_id, r.start, r.end) for r in scalar.d5_text_codes(spark, path).collect()} == wanted
    assert {(0, s, e) for s, e in _codes(PRIVATE)} <= wanted


def _clusters(text):
    """D1 one cluster after the other: the text, and the start and end in the source of each of its characters."""
    out, pending, i = [], None, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.category(text[j])[0] == "M":
            j += 1
        for ch in unicodedata.normalize("NFKC", text[i:j]).lower():
            if ch.isspace() and ch != "\x85":
                if out:
                    pending = (" ", pending[1] if pending else i, j)
            else:
                out += [pending] * bool(pending) + [(ch, i, j)]
                pending = None
        i = j
    return out


def _occurrences(text, term):
    units, word = _clusters(text), lambda c: c.isalnum() or c == "_"
    plain = "".join(u[0] for u in units)
    for k in range(len(plain) - len(term) + 1):
        end = k + len(term)
        if plain[k:end] == term and not (word(term[0]) and k and word(plain[k - 1])) and not (word(term[-1]) and end < len(plain) and word(plain[end])):
            yield units[k][1], units[end - 1][2]


AWKWARD = "aAbe \n\t \u00a0\u0301\u0308\uff41\uff11\ufb01\u00b4\u0130\u00c9\u2028\x85\U0001d41a_.-"


def test_normal_form_by_cluster():
    rng = random.Random(5)
    for text in ["", " ", " a", "Caf\u0065\u0301  x ", *("".join(rng.choices(AWKWARD, k=rng.randrange(1, 25))) for _ in range(3000))]:
        plain, at, starts, ends = spans._normalized(text)
        units = []
        for k, ch in enumerate(plain):
            run = max(i for i, x in enumerate(at) if x <= k)
            units.append((ch, starts[run], ends[run]) if ends[run] != -1 else (ch, starts[run] + k - at[run], starts[run] + k - at[run] + 1))
        assert units == _clusters(text), ascii(text)


def test_watchlist_matches_the_normal_form(spark):
    rng = random.Random(6)
    texts = ["de\n la x De  La", "x\uff44\uff45 la", "aaa aa", "", None, *("".join(rng.choices(AWKWARD, k=30)) for _ in range(150))]
    terms = ["de la", "aa", "a", "ae", "1", "._", "fi", "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, spans.watchlist_spans(docs, "doc_id", "text", spark.createDataFrame([(x,) for x in [*terms, "DE  LA"]], "term string")).collect()))
    assert got == sorted((i, term, *span) for i, text in enumerate(texts) for term in terms for span in _occurrences(text or "", term))
    assert {(0, "de la", 0, 6), (0, "de la", 9, 15)} <= set(got)


def test_watchlist_refuses_more_terms_than_it_searches(spark):
    docs = spark.createDataFrame([(1, "t1 t31 t32")], "doc_id long, text string")
    terms = lambda n: spark.createDataFrame([(f"t{i}",) for i in range(n)], "term string")
    assert spans.watchlist_spans(docs, "doc_id", "text", terms(32)).count() == 2
    with pytest.raises(Exception, match="At most 32 watchlist terms"):
        spans.watchlist_spans(docs, "doc_id", "text", terms(33)).collect()


def test_terms_are_nfkc(spark):
    raw = spark.createDataFrame([("\uff21\uff22 \u3000 C",), ("a\x00b",), ("\tx\n",), ("\ufb01" * 33,), ("\u1112\u1161",), (" ",)], "term string")
    assert {r.term for r in spans.normalized_terms(raw).collect()} == {"ab c", "x", "\ud558"}


def test_structured_spans_match_the_normal_form(spark):
    wanted = [("EMAIL", "\uff41@b.org"), ("PHONE", "+1\u00a0415\n555-0199"), ("PAYMENT_CARD", "4111\u00a01111\n1111 1111"), ("ONE_TIME_CODE", "\uff11\uff12\uff13\uff14")]
    text = "  ".join(["\ufb01", *(f"{x} x" for _, x in wanted[:3]), "x\n" * 40, "one\ntime", wanted[3][1]])
    docs = spark.createDataFrame([(text,)], "text string").withColumn("n", spans.nfkc("text"))
    found = docs.select(F.explode(spans.in_source(t.structured_spans(F.col("n.text")), F.col("n"))).alias("s")).select("s.*").collect()
    assert sorted((r.category, text[r.start : r.end]) for r in found) == sorted(wanted)


def test_staging_plan_has_every_item(spark):
    docs = derive.table(spark, SF, "documents").where("lang = 'en'").collect()
    names = [r.doc_id // 3 for r in docs]
    wanted = sorted((f"d{r.doc_id % 3}/{r.doc_id // 3}.jpg", "digest" if str(r.doc_id // 3)[-1] == "7" else "name" if names.count(r.doc_id // 3) > 1 else "number") for r in docs)
    got = sorted(map(tuple, corpora.k2_staging(spark, SF).collect()))
    assert got == wanted and {p for _, p in got} == {"digest", "name", "number"}


def test_oracle_sql_is_text():
    import __spark_entry__

    found = __spark_entry__.oracle_sql()
    assert found and found.keys() <= __spark_entry__.queries().keys()
    assert [name for name, sql in found.items() if not isinstance(sql, str)] == []


def test_files_grow_with_the_table(spark):
    small, large = (corpora._block_lines(spark, f"/root/testdata/{sf}").select("file").distinct().count() for sf in ("sf0.001", "sf0.01"))
    assert large > 5 * small


def test_no_window_holds_the_whole_table(spark):
    """Windows without a key hold counts of buckets only, and the items of a split are counted by an aggregation."""
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    manifest = plan(corpora.k1_manifest(spark, SF))
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(__b#", manifest)
    assert not re.search(r"windowspecdefinition\((split#\d+, )?specifiedwindowframe", plan(corpora.k2_staging(spark, SF)))
    assert "CROSS" not in plan(corpora.k2_staging(spark, SF)).upper()


TERMS = ("the", "de la", "und", "er")


@pytest.fixture(scope="module")
def private(spark):
    """Every span of the documents, by brute force: (doc_id, category, start, end), and the watchlist's (doc_id, term, start, end)."""
    spans_of, listed = set(), set()
    docs = derive.table(spark, SF, "documents").select("doc_id", "text").collect()
    for r in docs:
        text = r.text or ""
        units = _clusters(text)
        spans_of |= {(r.doc_id, name, units[a][1], units[b - 1][2]) for name, (a, b) in _named("".join(u[0] for u in units))}
        listed |= {(r.doc_id, term, *span) for term in TERMS for span in _occurrences(text, term)}
    return docs, spans_of, listed


@pytest.mark.parametrize(("query", "category"), [("d2_emails", "EMAIL"), ("d4_phones", "PHONE")])
def test_spans_of_the_documents(spark, private, query, category):
    got = {(r.doc_id, r.category, r.start, r.end) for r in getattr(scalar, query)(spark, SF).collect()}
    assert got and got == {x for x in private[1] if x[1] == category}


def test_cards_of_the_documents(spark, private):
    docs, spans_of, _ = private
    source = {r.doc_id: r.source for r in derive.table(spark, SF, "documents").collect()}
    wanted = defaultdict(int)
    for doc_id, name, *_ in spans_of:
        wanted[source[doc_id]] += name == "PAYMENT_CARD"
    assert {r.source: r.cards for r in scalar.d3_cards(spark, SF).collect()} == {k: wanted[k] for k in set(source.values())}


def test_all_spans_and_refusals_of_the_documents(spark, private):
    docs, spans_of, listed = private
    found = defaultdict(set)
    for doc_id, *span in spans_of:
        found[doc_id].add(tuple(span))
    for doc_id, _, start, end in listed:
        found[doc_id].add(("WATCHLIST_MATCH", start, end))
    refused = {r.doc_id: "text" if len(r.text or "") > 16384 else "matches" for r in docs if len(r.text or "") > 16384 or len(found[r.doc_id]) > 256}
    assert {r.doc_id: r.refusal for r in scalar.d7_refused(spark, SF).collect()} == refused and refused
    got = scalar.d7_all_spans(spark, SF).collect()
    assert sorted((r.doc_id, r.category, r.start, r.end) for r in got) == sorted((d, *x) for d, xs in found.items() if d not in refused for x in xs)


def test_listed_terms_of_the_documents(spark, private):
    by_term, by_doc = defaultdict(list), defaultdict(list)
    for doc_id, term, start, end in private[2]:
        by_term[doc_id, term].append((start, end))
        by_doc[doc_id].append((start, end))
    assert {(r.doc_id, r.term): (r.n, r.first, r.last) for r in scalar.d6_watchlist(spark, SF).collect()} == {k: (len(v), min(v)[0], max(e for _, e in v)) for k, v in by_term.items()}
    digest = lambda v: hashlib.sha256(("[" + ", ".join(f"{{{a}, {b}}}" for a, b in sorted(v)) + "]").encode()).hexdigest()
    assert {r.doc_id: (r.n, r.digest) for r in scalar.d8_listed(spark, SF).collect()} == {k: (len(v), digest(v)) for k, v in by_doc.items()}


def test_normal_form_of_the_documents(spark, private):
    wanted = {r.doc_id: "".join(u[0] for u in _clusters(r.text or "")) for r in private[0]}
    assert {r.doc_id: (r.n, r.digest) for r in scalar.d1_normal(spark, SF).collect()} == {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in wanted.items()}


def _nearest(wanted, decoded, tolerance):
    """Annotation time to decoded time: the nearest within the tolerance behind the last one taken, the earlier of two."""
    out, first, decoded = {}, 0, sorted(decoded)
    for at in sorted(wanted):
        near = [(abs(d - at), i) for i, d in enumerate(decoded) if i >= first and abs(d - at) <= tolerance]
        out[at] = decoded[min(near)[1]] if near else None
        first = min(near)[1] + 1 if near else first
    return out


def test_join_totals_by_brute_force(spark):
    _, wanted, decoded = evaluation._joined(spark, SF)
    times = lambda frame: frame.groupBy("episode").agg(F.collect_list("at").alias("at")).collect()
    seen, out = {r.episode: r.at for r in times(decoded)}, {}
    for r in times(wanted):
        taken = _nearest(r.at, seen.get(r.episode, []), 3000)
        deltas = [abs(a - d) for a, d in taken.items() if d is not None]
        out[r.episode] = (len(r.at), len(seen.get(r.episode, [])), len(deltas), len(seen.get(r.episode, [])) - len(deltas), max(deltas, default=0))
    got = evaluation.f8_totals(spark, SF).collect()
    assert {r.episode: (r.annotated, r.decoded, r.matched, r.unmatched_decoded, r.largest_delta) for r in got} == out


def test_face_objects_by_hand(spark):
    joined = spark.createDataFrame([("e", 0, 1), ("e", 40, 41), ("e", 80, None), ("e", 120, 121)], "episode string, at long, taken long")
    objects = spark.createDataFrame([("e", t, o, r, True) for t in (0, 40, 80, 120) for o, r in (("a", "UNKNOWN"), ("h", "HOST"))] + [("e", 40, "b", "UNKNOWN", True)], "episode string, at long, object string, role string, protectable boolean")
    seen = spark.createDataFrame([("e", 1, "a", True, 5), ("e", 41, "a", True, 6), ("e", 121, "a", False, None), ("e", 41, "b", False, 1)], "episode string, at long, object string, fully_protected boolean, track long")
    got = {r.object: (r.visible, r.guarded, r.switches, r.gap_frames, r.gap_ns) for r in evaluate.object_metrics(objects, joined, seen, 33).collect()}
    # The last frame of a gap lasts for the nominal duration; the host has no metrics.
    assert got == {"a": (4, 2, 1, 2, 40 + 33), "b": (1, 0, 0, 1, 40)}
