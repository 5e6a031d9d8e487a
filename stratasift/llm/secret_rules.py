"""Rules of the secret scan, and Boolean trigram queries derived from their patterns."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as ops
    from re import _parser as parser

#: Largest set of strings followed through a pattern, and the largest class spelled out.
MAX_STRINGS, MAX_CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules come first, in the order that breaks ties between spans.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"""(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s:/@"']{1,64}:[^\s:/@"']{3,64}@"""),
]
BASE_KINDS = ("assign", "access", "hex")

#: A query is an AND of clauses; a clause an OR of alternatives; an alternative an AND of trigrams.
Query = list[list[tuple[str, ...]]]


def _trigrams(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))


def _clause(strings: set[str] | None, into: Query) -> None:
    """Add what a set of possible substrings demands; one short string demands nothing."""
    if strings and all(len(s) >= 3 for s in strings):
        every = {_trigrams(s) for s in strings}
        clause = sorted(a for a in every if not any(set(b) < set(a) for b in every))
        if clause not in into:
            into.append(clause)


def _class_members(items) -> set[str] | None:
    members: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            members.add(chr(value).lower())
        elif op is ops.RANGE and value[1] - value[0] < MAX_CLASS:
            members |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return members if len(members) <= MAX_CLASS else None


def _walk(items, into: Query) -> set[str] | None:
    """The strings a pattern can match, lower-cased, or None; demands go into ``into``."""
    run: set[str] | None = {""}
    whole = True

    def cut() -> None:
        nonlocal run, whole
        _clause(run, into)
        run, whole = {""}, False

    for op, value in items:
        part: set[str] | None = None
        if op is ops.LITERAL:
            part = {chr(value).lower()}
        elif op is ops.IN:
            part = _class_members(value)
        elif op is ops.SUBPATTERN:
            part = _walk(value[3], into if value[3] is not None else [])
        elif op is ops.BRANCH:
            sets = [_walk(branch, []) for branch in value[1]]
            if all(s is not None for s in sets):
                part = set().union(*sets)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, body = value
            if low == 1 and high == 1:
                part = _walk(body, into)
            elif low == 0 and high == 1:
                inner = _walk(body, [])
                part = None if inner is None else inner | {""}
            elif low >= 1:
                inner = _walk(body, [])
                if inner is not None and low == high and len(inner) == 1 and low <= 16:
                    part = {next(iter(inner)) * low}
        elif op is ops.AT:
            continue
        if part is None or len(part) * len(run) > MAX_STRINGS:
            cut()
            if part is not None:
                run = part
            continue
        run = {a + b for a in run for b in part}
    if whole:
        return run
    _clause(run, into)
    return None


def trigram_query(pattern: str) -> Query:
    """Trigrams of the lower-cased text that any match demands; empty if there are none."""
    query: Query = []
    _clause(_walk(parser.parse(pattern), query), query)
    return query


def queries(rules: list[Rule]) -> tuple[dict[str, Query], list[str]]:
    """The query of each rule that has one, and all trigrams to index."""
    found = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in found.values() for clause in q for alt in clause for g in alt})
    return found, grams


def compiled(rule: Rule) -> re.Pattern:
    """The rule for checks in plain Python."""
    return re.compile(rule.pattern)
