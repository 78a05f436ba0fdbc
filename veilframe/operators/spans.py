"""Watchlists over documents, and text that needs Unicode normalization."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import text as t
from veilframe.functions.geometry import let

#: More terms than this are refused, as a session's list is short.
MOST_TERMS = 32
MOST_ZONES, MOST_CHARACTERS = 8, 64
#: Bytes of text that a task holds as Python's own values, with what is made of them, beside Arrow's batches.
PIECE = 1 << 20
_SPACES = r"[\s\x1c-\x1f\u1680\u2000-\u200a\u2028\u2029\u205f\u3000]+"


_UNITS: dict[str, str] = {}


def _unit(ch: str) -> str:
    if ch not in _UNITS:
        _UNITS[ch] = unicodedata.normalize("NFKC", ch).lower()
    return _UNITS[ch]


def _is_space(ch: str) -> bool:
    """White space as Java has it; NFKC has already made plain spaces of the non-breaking ones."""
    return ch.isspace() and ch != "\x85"


def _normalized(text: str) -> tuple[str, list[int], list[int], list[int]]:
    """The text of D1, and where runs of it begin, in the text and in the source, and where each one's source ends.

    In a run with end -1 characters correspond one to one; in any other all come from the same piece of the source.
    """
    out: list[str] = []
    at, starts, ends = [], [], []
    n = 0
    pending: list[int] | None = None

    def put(piece: str, start: int, end: int) -> None:
        nonlocal n
        if end != -1 or not at or ends[-1] != -1 or starts[-1] - at[-1] != start - n:
            at.append(n)
            starts.append(start)
            ends.append(end)
        out.append(piece)
        n += len(piece)

    def space(start: int, end: int) -> None:
        nonlocal pending
        if n:
            pending = [pending[0] if pending else start, end]

    def flush() -> None:
        nonlocal pending
        if pending:
            put(" ", pending[0], -1 if pending[1] == pending[0] + 1 else pending[1])
            pending = None

    def linear(a: int, b: int) -> None:
        if a < b and text[a] == " ":
            space(a, a + 1)
            a += 1
        last = b - 1 if a < b and text[b - 1] == " " else b
        if a < last:
            flush()
            put(text[a:last].translate(table), a, -1)
        if last < b:
            space(last, b)

    table: dict[int, str] = {}
    marks, odd, spaces = [], [], []
    for ch in set(text):
        unit = _unit(ch)
        if unicodedata.category(ch)[0] == "M":
            marks.append(ch)
        elif len(unit) == 1 and _is_space(unit):
            spaces.append(ch)
        elif len(unit) != 1:
            odd.append(ch)
        elif unit != ch:
            table[ord(ch)] = unit
    any_of = lambda chars: f"[{re.escape(''.join(chars))}]"
    parts = [rf".{any_of(marks)}+"] if marks else []
    parts += [any_of(marks + odd)] if marks + odd else []
    rest = [c for c in spaces if c != " "]
    follows = f"(?!{any_of(marks)})" if marks else ""
    parts += [rf"(?:{any_of(spaces)}{follows}){{2,}}"] if spaces else []
    parts += [any_of(rest)] if rest else []
    done = 0
    for m in re.finditer("|".join(parts), text, re.DOTALL) if parts else ():
        linear(done, m.start())
        for ch in unicodedata.normalize("NFKC", m[0]).lower():
            if _is_space(ch):
                space(*m.span())
            else:
                flush()
                put(ch, *m.span())
        done = m.end()
    linear(done, len(text))
    return "".join(out), at, starts, ends


_INTS = T.ArrayType(T.IntegerType())


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """A batch's texts, some at a time: as Python's own values no more than about PIECE bytes of them are held at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    bounds = [*np.flatnonzero(np.diff(ends // PIECE, prepend=0)).tolist(), len(texts)]
    begin = 0
    for end in bounds:
        if end > begin:
            yield texts.slice(begin, end - begin).to_pylist()
            begin = end


_NORMAL = {"text": pa.string(), **{c: pa.list_(pa.int32()) for c in ("at", "starts", "ends")}}


def _normal_batch(texts: pa.Array) -> pa.Array:
    """What :func:`nfkc` gives for a batch; its parts leave Python's lists for Arrow's arrays as they are made."""
    parts = []
    for piece in _pieces(texts):
        columns = zip(*((None,) * 4 if x is None else _normalized(x) for x in piece))
        parts.append(pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _NORMAL.values())], list(_NORMAL)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(_NORMAL.items())))


_NORMAL_TYPE = T.StructType([T.StructField("text", T.StringType())] + [T.StructField(c, _INTS) for c in ("at", "starts", "ends")])
#: As if not deterministic, so that a condition on what comes of it (as explode brings one) does not read the texts again.
_nfkc = F.arrow_udf(_normal_batch, _NORMAL_TYPE).asNondeterministic()


def nfkc(text: Column | str) -> Column:
    """NFKC and lower case by cluster, white space as one space, with the runs that lead back to the source (D1); see ``in_source``."""
    return _nfkc(text)


@F.pandas_udf(T.StringType())
def _nfkc_whole(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: unicodedata.normalize("NFKC", t).lower(), na_action="ignore")


def in_source(found: Column, n: Column) -> Column:
    """Spans of a text that ``nfkc`` made, as spans of its source."""

    def place(p: Column, is_end: bool) -> Column:
        run = lambda i: F.when(F.get(n["ends"], i) != -1, F.get(n["ends" if is_end else "starts"], i)).otherwise(F.get(n["starts"], i) + p - F.get(n["at"], i) + int(is_end))
        return let(F.size(F.filter(n["at"], lambda x: x <= p)) - 1, run)

    ends = lambda s: F.struct(s["category"].alias("category"), place(s["start"], False).alias("start"), place(s["end"] - 1, True).alias("end"))
    return F.transform(found, ends)


def _listed(terms: DataFrame) -> list[str]:
    """The different terms in the form of D1; more than MOST_TERMS are refused, so the list is a literal of bounded size."""
    found = [r[0] for r in terms.select(nfkc("term")["text"].alias("term")).where("term <> ''").distinct().limit(MOST_TERMS + 1).collect()]
    if len(found) > MOST_TERMS:
        raise ValueError(f"At most {MOST_TERMS} watchlist terms are supported")
    return sorted(found)


def _is_word(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


def occurrences(terms: list[str]) -> Callable[[Column], Column]:
    """A function of a text: all places of all terms, overlapping ones too, as (category: the term, start, end), by one pass of an automaton.

    A term counts where no word character stands before or behind it if its own edge is one. The automaton of goto and failure links is made
    once per task from the literal list; a text takes a time that does not grow with the number of terms.
    """

    @F.arrow_udf("array<struct<category:string,start:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(term, (i, len(term), _is_word(term[0]), _is_word(term[-1])))
        automaton.make_automaton()
        names = pa.array(terms, pa.string())

        def found(texts: list[str | None]) -> pa.Array:
            which, starts, offsets = array("i"), array("i"), array("i", [0])
            for text in texts:
                for last, (i, size, from_word, to_word) in automaton.iter(text) if text and terms else ():
                    start, end = last + 1 - size, last + 1
                    if not (from_word and start and _is_word(text[start - 1])) and not (to_word and end < len(text) and _is_word(text[end])):
                        which.append(i)
                        starts.append(start)
                offsets.append(len(which))
            at, term = np.array(starts, np.int32), np.array(which, np.int32)
            spans = [names.take(pa.array(term)), pa.array(at), pa.array(at + np.array([len(x) for x in terms], np.int32)[term])]
            return pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.StructArray.from_arrays(spans, ["category", "start", "end"]), mask=pa.array([x is None for x in texts]))

        for texts in batches:
            yield pa.concat_arrays([found(piece) for piece in _pieces(texts)] or [found([])])

    return run.asNondeterministic()


def watchlist_spans(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """Every occurrence of every term, overlapping ones too, with a word boundary where the term's edge is a word character.

    ``terms`` has term; more than MOST_TERMS are refused. Both sides are matched in the form of D1, and spans are places in the source.
    A text is read once for all terms, and nothing is joined.
    """
    normal = docs.select(key, nfkc(text).alias("__n"))
    found = in_source(occurrences(_listed(terms))(F.col("__n.text")), F.col("__n"))
    spans = normal.select(key, F.explode(found).alias("s"))
    return spans.select(key, F.col("s.category").alias("term"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def private_spans(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, category, start, end) of every structured span and watchlist term, in the places of the source, each once.

    Texts or matches above the limits have no spans; :func:`refused_texts` names them.
    """
    return _all(docs, key, text, terms).where("refusal IS NULL").select(key, F.explode("found").alias("s")).select(key, "s.*")


def refused_texts(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, refusal) of the texts whose length or number of matches is above the limits."""
    return _all(docs, key, text, terms).where("refusal IS NOT NULL").select(key, "refusal")


def _all(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, found, refusal): a document's spans in order, from one pass over its normal form; nothing is shuffled."""
    n = F.col("__n")
    normal = docs.select(key, F.col(text).alias("__text"), nfkc(text).alias("__n"))
    matched = normal.select(key, "__text", "__n", occurrences(_listed(terms))(n["text"]).alias("__listed"))
    named = F.transform("__listed", lambda s: F.struct(F.lit("WATCHLIST_MATCH").alias("category"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<category:string,start:int,end:int>>")
    found = F.concat(*(F.coalesce(in_source(x, n), none) for x in (t.structured_spans(n["text"]), named)))
    both = matched.select(key, "__text", found.alias("__found"))
    return both.select(key, t.in_order(F.col("__found")).alias("found"), t.span_refusal(F.col("__text"), F.col("__found")).alias("refusal"))


def normalized_terms(raw: DataFrame) -> DataFrame:
    """Terms in NFKC, lower case and single spaces; those with control characters, or not of 1 to 64 characters, are left out."""
    return _term_form(raw.select("term"), "term").where("__refusal IS NULL").select(F.col("__term").alias("term")).distinct()


def _term_form(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with __term, the form in which terms are compared, and __refusal, why it cannot be a term: ``null``, ``control`` or ``length``."""
    term = F.trim(F.regexp_replace(_nfkc_whole(name), _SPACES, " "))
    control, fits = F.col("__term").rlike(r"[\x00-\x1f\x7f-\x9f]"), F.length("__term").between(1, MOST_CHARACTERS)
    return rows.withColumn("__term", term).withColumn("__refusal", F.when(F.col("__term").isNull(), "null").when(control, "control").when(~fits, "length"))


def session_terms(terms: DataFrame, zones: DataFrame, session: str = "session") -> tuple[DataFrame, DataFrame]:
    """Each session's configured terms and what is wrong with the others' configurations: (session, term) and (session, refusal).

    ``terms`` has the session and term, ``zones`` a row for each zone of a session. One bad term (``null``, ``control``, ``length``), more than
    MOST_TERMS different texts (``terms``) or more than MOST_ZONES zones (``zones``) refuse the whole session, which then has no terms; of
    several reasons the last by name is given. Repeated rows of a term count once, those of a zone each time. Nothing is gathered in a session:
    a crowded one is counted, and its terms stay rows.
    """
    formed = _term_form(terms.select(session, "term").distinct(), "term")
    most = lambda n, most, code: F.when(n > most, code)
    by_terms = formed.groupBy(session).agg(F.greatest(F.max("__refusal"), most(F.count("*"), MOST_TERMS, "terms")).alias("refusal"))
    by_zones = zones.groupBy(session).agg(most(F.count("*"), MOST_ZONES, "zones").alias("refusal"))
    refused = by_terms.unionByName(by_zones).where("refusal IS NOT NULL").groupBy(session).agg(F.max("refusal").alias("refusal"))
    kept = formed.join(refused.select(F.col(session).alias("__s")), F.col(session).eqNullSafe(F.col("__s")), "left_anti")
    return kept.select(session, F.col("__term").alias("term")).distinct(), refused


def configured(candidates: DataFrame, terms: DataFrame, session: str = "session") -> DataFrame:
    """``candidates`` with configured, whether a session has this very term, and refusal, why a candidate cannot be one (configured is then null).

    ``candidates`` has the session and candidate, ``terms`` is the first table of :func:`session_terms`. A null session has no terms.
    """
    formed = _term_form(candidates, "candidate")
    held = terms.select(F.col(session).alias("__s"), F.col("term").alias("__t"))
    both = formed.join(held, (F.col(session) == F.col("__s")) & (F.col("__term") == F.col("__t")), "left")
    return both.withColumns({"configured": F.when(F.col("__refusal").isNull(), F.col("__t").isNotNull()), "refusal": F.col("__refusal")}).drop("__term", "__refusal", "__s", "__t")


def collapse_sequences(scores: DataFrame, key: str, symbols: list[str]) -> DataFrame:
    """Greedy decoding: the best class of each step, without class 0 and repeats of the step before; and the mean score.

    ``scores`` has the key, step, class and score; of equal scores the lower class wins.
    """
    best = scores.groupBy(key, "step").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("c"), F.max("score").alias("s"))
    before = F.lag("c").over(Window.partitionBy(key).orderBy("step"))
    kept = best.withColumn("before", before).withColumn("kept", (F.col("c") != 0) & ~F.col("c").eqNullSafe(F.col("before")))
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s")))
    letters = F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("step", F.get(F.lit(symbols), F.col("c").cast("int")).alias("ch")))))
    return kept.groupBy(key).agg(F.array_join(F.transform(letters, lambda x: x["ch"]), "").alias("text"), F.avg(F.when(F.col("kept"), clipped)).alias("confidence"))
