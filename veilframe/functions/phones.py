"""Telephone numbers by numbering plans (D4), as one pattern made from a trie of country codes.

A plan has a region, a country code, what stands before a national number inside the region, and rules: leading digits with the least and
the most digits of a national number that begins so. Plans of a region that is not listed are refused.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column

from veilframe.functions import text as t


class Rule(NamedTuple):
    """Leading digits, each a digit or a class of digits, and the least and most digits of a number that begins so."""

    leading: tuple[str, ...]
    least: int
    most: int


class Plan(NamedTuple):
    """A region's numbers; ``trunk`` is the digit before a national number, which ``trunk_needed`` asks for."""

    code: str
    trunk: str
    trunk_needed: bool
    rules: tuple[Rule, ...]


# The numbering plans that this library knows, after the national plans as published under E.164.
PLANS = {
    "US": Plan("1", "1", False, (Rule(("[2-9]", "[0-9]", "[0-9]", "[2-9]"), 10, 10),)),
    "NL": Plan("31", "0", True, (Rule(("[1-9]",), 9, 9),)),
    "BE": Plan("32", "0", True, (Rule(("4",), 9, 9), Rule(("[1-35-9]",), 8, 8))),
    "FR": Plan("33", "0", True, (Rule(("[1-9]",), 9, 9),)),
    "ES": Plan("34", "", False, (Rule(("[6-9]",), 9, 9),)),
    "IT": Plan("39", "", False, (Rule(("0",), 6, 11), Rule(("3",), 9, 10))),
    "CH": Plan("41", "0", True, (Rule(("[2-9]",), 9, 9),)),
    "AT": Plan("43", "0", True, (Rule(("6",), 10, 13), Rule(("[1-57-9]",), 7, 12))),
    "GB": Plan("44", "0", True, (Rule(("[1238]",), 10, 10), Rule(("7",), 10, 10))),
    "SE": Plan("46", "0", True, (Rule(("7",), 9, 9), Rule(("[1-689]",), 7, 9))),
    "PL": Plan("48", "", False, (Rule(("[1-9]",), 9, 9),)),
    "DE": Plan("49", "0", True, (Rule(("1", "[5-7]"), 10, 11), Rule(("[2-9]",), 7, 11))),
    "BR": Plan("55", "0", False, (Rule(("[1-9]", "[1-9]", "9"), 11, 11), Rule(("[1-9]", "[1-9]", "[2-5]"), 10, 10))),
    "AU": Plan("61", "0", True, (Rule(("[23478]",), 9, 9),)),
    "JP": Plan("81", "0", True, (Rule(("[5789]", "0"), 10, 10), Rule(("[1-9]",), 9, 9))),
    "IN": Plan("91", "0", False, (Rule(("[6-9]",), 10, 10),)),
    "PT": Plan("351", "", False, (Rule(("[29]",), 9, 9),)),
    "IE": Plan("353", "0", True, (Rule(("[1-9]",), 7, 9),)),
}
#: What may stand between two digits: at most two of these, such as a bracket and a space.
GAP = r"[ .()\-]{0,2}"


def _national(plan: Plan) -> str:
    """The digits of a national number, in the order of the rules."""
    each = (GAP.join((*r.leading, "")) + rf"[0-9](?:{GAP}[0-9]){{{r.least - len(r.leading) - 1},{r.most - len(r.leading) - 1}}}" for r in plan.rules)
    return f"(?:{'|'.join(each)})"


def _codes(plans: list[Plan], depth: int = 0) -> str:
    """A trie of the plans' country codes as nested choices, each leaf with the plan's numbers; no code begins another."""
    branches: dict[str, list[Plan]] = {}
    for plan in plans:
        branches.setdefault(plan.code[depth], []).append(plan)

    def branch(digit: str, below: list[Plan]) -> str:
        if len(below) == 1 and len(below[0].code) == depth + 1:
            # A national prefix in brackets is often written after the code, and not dialled.
            kept = rf"(?:\({below[0].trunk}\){GAP})?" if below[0].trunk else ""
            return f"{digit}{GAP}{kept}{_national(below[0])}"
        return digit + _codes(below, depth + 1)

    return f"(?:{'|'.join(branch(d, p) for d, p in sorted(branches.items()))})"


def pattern(region: str | None) -> str:
    """The pattern of numbers in the international form of every plan and, with a region, in its national form."""
    if region is not None and region not in PLANS:
        raise ValueError(f"no numbering plan for region {region}")
    forms = [rf"\+{_codes(list(PLANS.values()))}"]
    if region is not None:
        plan = PLANS[region]
        lead = f"(?:{plan.trunk}{GAP}){'' if plan.trunk_needed else '?'}" if plan.trunk else ""
        forms.append(rf"\(?{lead}{_national(plan)}")
    return rf"(?<![0-9+])(?:{'|'.join(forms)})(?![0-9])"


def number_spans(text: Column, region: str | None = "US") -> Column:
    """Telephone numbers of the listed plans, abroad with + and a country code, at home in the region's national form.

    Digits are those of ASCII, as in the normal form of D1. Of a number's readings the plan's first rule with its most digits counts. A null
    or empty text has none; a region of None looks for international numbers alone.
    """
    return t.spans(text, pattern(region), "PHONE")
