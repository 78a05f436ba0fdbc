"""Spans in text, identifiers and small scalar functions, as Column expressions.

Spans are arrays of struct<category, start, end>, in code points, end exclusive; they never carry the matched text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.geometry import let

# The identifiers' patterns.
STABLE_ID, OPAQUE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{2,127}$", r"^[A-Za-z0-9][A-Za-z0-9._:-]{7,127}$"
SEMVER, SHA256 = r"^[0-9]+\.[0-9]+\.[0-9]+$", r"^[0-9a-f]{64}$"
# What stands right before or right behind a one-time code, and what may stand between.
CODE_BEFORE = r"(?:verification(?: code)?|verify|otp|one[ -]?time(?: code| password)?|passcode|security code|authentication code)(?: (?:is|number|code|pin))?"
CODE_AFTER = r"(?:is )?(?:your )?(?:verification code|otp|one[ -]?time code|passcode|security code)\b"
CODE_GAP = r"[ :#=\-]{0,12}"

# The marks of a local part besides letters and digits, and the most characters of its parts.
LOCAL_MARKS, MOST_LOCAL, MOST_DOMAIN, MOST_LABEL = ".!#$%&'*+/=?^_`{|}~-", 64, 253, 63
# The digits of a card number and of a one-time code.
CARD_DIGITS, CODE_DIGITS = (13, 19), (4, 8)

#: What a local part is made of, and what may not stand right before or behind an address.
_LOCAL, _TOUCHING = r"\p{L}\p{N}" + re.sub(r"([^\w])", r"\\\1", LOCAL_MARKS), r"\p{L}\p{N}._%+\-"
#: North American numbers; other numbering plans are outside this subset.
_PHONE = r"(?<!\d)(?:\+1[ -]?)?\(?[2-9]\d{2}\)?[ -]\d{3}-\d{4}(?!\d)"
_OPEN, _CLOSE = "\x01", "\x02"


def normalized(text: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends (the part of D1 that built-in functions express)."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def spans(text: Column, pattern: str, category: str) -> Column:
    """All matches of a pattern: marked, cut at the marks, and counted off; the text is read once."""
    clean = F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "  ")
    parts = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<category:string,start:int,end:int>>").alias("found"), F.lit(False).alias("inside"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.array(F.struct(F.lit(category).alias("category"), acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(acc["inside"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"), (~acc["inside"]).alias("inside"))

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def _cut(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


_SPAN = "struct<category:string,start:int,end:int>"


def _is_domain(run: Column, behind: Column) -> Column:
    """Two labels or more, each of 1 to 63 letters, digits and inner hyphens; ``behind`` is the character after the run."""
    labels = F.split(run, r"\.", -1)
    fits = F.forall(labels, lambda x: F.length(x).between(1, MOST_LABEL) & ~x.startswith("-") & ~x.endswith("-"))
    return (F.size(labels) >= 2) & fits & ~behind.rlike(f"[{_TOUCHING}]")


def _is_strict(local: Column, domain: Column) -> Column:
    """No dot first, last or twice in the local part, a domain of at most 253, a last label of 2 to 63 letters."""
    dots = local.startswith(".") | local.endswith(".") | F.contains(local, F.lit(".."))
    return ~dots & (F.length(domain) <= MOST_DOMAIN) & F.substring_index(domain, ".", -1).rlike(rf"^[A-Za-z]{{2,{MOST_LABEL}}}$")


def email_spans(text: Column) -> Column:
    """Addresses, strictly: no dot first, last or twice in the local part, a domain of at most 253, a last label of 2 to 63 letters.

    The text is cut at its @ signs. The local part is the longest end of the piece before one, of at most 64 characters, and the domain
    the run of letters, digits, dots and hyphens behind it; an address ends before the next begins.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), "@", -1)
    # at: where the piece of the state begins; free: how far its characters belong to the address before.
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.lit("").alias("piece"), F.lit(True).alias("first"), F.array().cast(f"array<{_SPAN}>").alias("found"))
    longest = rf"[{_LOCAL}]{{1,{MOST_LOCAL}}}\z"

    def step(acc: Column, piece: Column) -> Column:
        before, n = acc["piece"], F.length(acc["piece"])
        begin = F.greatest(acc["free"], n - MOST_LOCAL)
        # Behind other characters, one of them is looked at but not taken.
        inner = F.regexp_extract(F.right(before, n - begin + 1), rf"(?<=[^{_TOUCHING}]){longest}", 0)
        local = F.when(begin > 0, inner).otherwise(F.regexp_extract(before, rf"(?<![{_TOUCHING}]){longest}", 0))
        parts = F.struct(local.alias("local"), F.regexp_extract(piece, r"^[A-Za-z0-9.\-]+", 0).alias("domain"))
        return let(parts, lambda c: added(acc, piece, n, c["local"], c["domain"]))

    def added(acc: Column, piece: Column, n: Column, local: Column, domain: Column) -> Column:
        start, behind = acc["at"] + n, F.substring(piece, F.length(domain) + 1, 1)
        loose = ~acc["first"] & (F.length(local) > 0) & _is_domain(domain, behind)
        one = F.array(F.struct(F.lit("EMAIL").alias("category"), (start - F.length(local)).alias("start"), (start + 1 + F.length(domain)).alias("end")))
        found = F.when(loose & _is_strict(local, domain), F.concat(acc["found"], one)).otherwise(acc["found"])
        at = F.when(acc["first"], 0).otherwise(start + 1)
        return F.struct(at.alias("at"), F.when(loose, F.length(domain)).otherwise(0).alias("free"), piece.alias("piece"), F.lit(False).alias("first"), found.alias("found"))

    return F.aggregate(pieces, first, step, lambda acc: acc["found"])


@cache
def _foreign_digits() -> tuple[str, str]:
    """The decimal digits outside ASCII, and the ASCII digits of equal value."""
    found = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def passes_luhn(number: Column) -> Column:
    """The check digit of a card number is right, and its digits are not all the same (D3)."""
    digits = F.transform(F.split(F.regexp_replace(F.translate(number, *_foreign_digits()), r"[^0-9]", ""), ""), lambda d: d.cast("int"))

    def total(ds: Column) -> Column:
        n = F.size(ds)
        each = F.transform(ds, lambda d, i: F.when((n - 1 - i) % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
        return (F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0) & (F.size(F.array_distinct(ds)) > 1)

    return let(digits, total)


def digit_runs(text: Column) -> Column:
    """Maximal runs of digits: (start, end, digits, follows), where ``follows`` says that one space or hyphen alone parts it from the run before."""
    clean = F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "  ")
    parts = F.split(F.regexp_replace(clean, r"\p{Nd}+", f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    kind = "struct<start:int,end:int,digits:string,follows:boolean>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"), F.lit(False).alias("inside"), F.lit(False).alias("follows"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("digits"), acc["follows"].alias("follows"))
        found = F.when(acc["inside"], F.concat(acc["found"], F.array(one))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"), (~acc["inside"]).alias("inside"), (~acc["inside"] & part.isin(" ", "-") & (F.size(acc["found"]) > 0)).alias("follows"))

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def card_spans(text: Column) -> Column:
    """Thirteen to nineteen digits, singly spaced or hyphened, that pass Luhn (D3).

    From each free run of digits on, the most runs that make up so many digits are one number; it is used up whether or not it passes.
    """
    least, most = CARD_DIGITS

    def numbers(runs: Column) -> Column:
        kind = f"struct<free:int,found:array<{_SPAN}>>"
        none = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{_SPAN}>").alias("found")).cast(kind)

        def reach(i: Column) -> Column:
            """The digits and the end of the longest number that begins at run i."""
            begin = F.struct(F.lit(0).alias("n"), F.lit("").alias("digits"), F.lit(True).alias("on"), F.lit("").alias("best"), F.lit(0).alias("end"))

            def join(acc: Column, r: Column) -> Column:
                n = acc["n"] + F.length(r["digits"])
                on = acc["on"] & ((acc["n"] == 0) | r["follows"]) & (n <= most)
                digits = F.concat(acc["digits"], r["digits"])
                whole = on & (n >= least)
                return F.when(on, F.struct(n.alias("n"), digits.alias("digits"), on.alias("on"), F.when(whole, digits).otherwise(acc["best"]).alias("best"), F.when(whole, r["end"]).otherwise(acc["end"]).alias("end"))).otherwise(F.struct(acc["n"].alias("n"), acc["digits"].alias("digits"), F.lit(False).alias("on"), acc["best"].alias("best"), acc["end"].alias("end")))

            return F.aggregate(F.slice(runs, i + 1, most), begin, join)

        def step(acc: Column, i: Column) -> Column:
            run = F.get(runs, i)

            def used(best: Column) -> Column:
                one = F.array(F.struct(F.lit("PAYMENT_CARD").alias("category"), run["start"].alias("start"), best["end"].alias("end")))
                found = F.when(passes_luhn(best["best"]), F.concat(acc["found"], one)).otherwise(acc["found"])
                return F.when(best["end"] > 0, F.struct(best["end"].alias("free"), found.alias("found")).cast(kind)).otherwise(acc)

            return F.when(run["start"] >= acc["free"], let(reach(i), used)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.size(runs) - 1), none, step, lambda acc: acc["found"])

    return let(digit_runs(text), lambda runs: F.when(F.size(runs) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(numbers(runs)))


def phone_spans(text: Column) -> Column:
    """North American telephone numbers; :mod:`veilframe.functions.phones` has those of more plans."""
    return spans(text, _PHONE, "PHONE")


def code_spans(text: Column) -> Column:
    """Four to eight digits right behind or right before what announces a code, looked for in the 64 characters before and the 48 after."""
    behind, ahead = F.lit(rf"(?iu)^.*{CODE_BEFORE}{CODE_GAP}\z"), F.lit(rf"(?iu)^{CODE_GAP}{CODE_AFTER}")

    def announced(s: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - 63), F.least(s["start"], F.lit(64)))
        return F.rlike(before, behind) | F.rlike(F.substring(text, s["end"] + 1, F.lit(48)), ahead)

    return F.filter(spans(text, r"\p{Nd}+", "ONE_TIME_CODE"), lambda s: (s["end"] - s["start"]).between(*CODE_DIGITS) & announced(s))


def structured_spans(text: Column, phones: Callable[[Column], Column] = phone_spans) -> Column:
    """The spans of D2 to D5 one after the other, at any length of the text; ``phones`` may be those of more numbering plans."""
    return F.concat(email_spans(text), card_spans(text), phones(text), code_spans(text))


def in_order(found: Column) -> Column:
    """Distinct spans by start, end and category."""
    return F.array_sort(F.array_distinct(found), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).when(a["category"] < b["category"], -1).when(a["category"] > b["category"], 1).otherwise(0))


def span_refusal(text: Column, found: Column, most_chars: int = 16384, most: int = 256) -> Column:
    """Why a text's spans are refused: ``text`` above so many characters, ``matches`` above so many distinct spans; null if they are not."""
    return F.when(F.length(text) > most_chars, "text").when(F.size(F.array_distinct(found)) > most, "matches")


def all_spans(text: Column, found: Column) -> Column:
    """All spans in order; null where the text is refused, see :func:`span_refusal`."""
    return F.when(span_refusal(text, found).isNull(), in_order(found))


def redacted(text: Column, found: Column, mark: str = "*") -> Column:
    """The text with every position inside a span replaced by a mark (D10). Overlapping spans are covered together.

    ``found`` is sorted by start.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        keep = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        hide = F.repeat(F.lit(mark), F.greatest(F.lit(0), s["end"] - F.greatest(acc["at"], s["start"])))
        return F.struct(F.concat(acc["out"], keep, hide).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein over the longer length; 0 where both are empty."""
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def diagnostic(text: Column) -> Column:
    """NFKC, upper case, single spaces, none at the ends (D13). Texts in ASCII stay in the JVM; null stays null."""
    ascii_only = text.rlike(r"\A\p{ASCII}*\z")
    plain = F.when(ascii_only, text).otherwise(_compatible(F.when(~ascii_only, text)))
    return F.trim(F.regexp_replace(F.upper(plain), r"(?U)\s+", " "))


def selection_hash(seed: str, name: Column) -> Column:
    """sha256 of seed and name, as hex."""
    return F.sha2(F.concat(F.lit(seed), name), 256)


def group_id(name: Column) -> Column:
    """The first twenty hex digits of the name's sha256."""
    return F.substring(F.sha2(name, 256), 1, 20)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator, denominator and their quotient, null at a denominator of 0."""
    return F.struct(numerator.cast("long").alias("numerator"), denominator.cast("long").alias("denominator"), F.try_divide(numerator, denominator).alias("value"))


def iso_date(text: Column) -> Column:
    """A date, or null if it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def severity(status: Column) -> Column:
    """A platform's thermal status."""
    return F.when(status.between(0, 1), "NOMINAL").when(status == 2, "WARNING").otherwise("SEVERE")


def lane_of(group: Column, tags: Column) -> Column:
    """The lane that a fixture's tags name; null unless exactly one does."""
    lanes = F.array_intersect(tags, F.lit(["AUTOMATIC_PATTERN", "CONFIGURED_WATCHLIST", "CONFIGURED_ZONE"]))
    return F.when(group == "BIV_PRIV_SEG", "BIV_SMOKE").when(F.size(lanes) == 1, F.get(lanes, 0))


def grid_samples(luminance: Column, width: Column, height: Column, cells: int = 8) -> Column:
    """The values at the corners of a grid of cells by cells, row by row; ``luminance`` is a frame's values, row by row."""
    place = lambda i: F.least(height - 1, F.floor(F.floor(i / cells) * height / cells)) * width + F.least(width - 1, F.floor((i % cells) * width / cells))
    return F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), lambda i: F.get(luminance, place(i).cast("int")).cast("bigint"))


def grid_mean(samples: Column) -> Column:
    """The mean of a frame's samples, rounded down."""
    return F.floor(F.aggregate(samples, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size(samples))


def luminance_pattern(values: Column) -> Column:
    """Sixty-four bits: set where a cell is at least twelve above the mean."""
    mean = (F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size(values)).cast("bigint")
    bits = lambda m: F.aggregate(F.transform(values, lambda v, i: F.when(v >= m + 12, i).otherwise(-1)), F.lit(0).cast("bigint"), lambda a, i: F.when(i >= 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(a))
    return let(mean, bits)


def evaluation_category(found: Column, fixture_category: Column) -> Column:
    """The category a finding counts as: faces are dropped, watchlist and zone findings take the fixture's."""
    return F.when(found == "FACE", F.lit(None)).when(found.isin("WATCHLIST_MATCH", "PRIVACY_ZONE"), fixture_category).otherwise(found)
