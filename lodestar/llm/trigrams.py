"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is in disjunctive form: a set of conjunctions, each a set of trigrams.  {frozenset()} holds
for every text: nothing is mandatory.  Trigrams are in lower case, so one index over lower-cased
texts serves rules of either kind; for a rule that heeds case the query is then weaker, never wrong.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as op
from re import _parser as parser

Query = frozenset  # of frozensets of trigrams
ANY: Query = frozenset([frozenset()])
#: Beyond so many strings or conjunctions, a part of an expression counts as unknown.
WIDTH = 64


def _least(query: set) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(q for q in query if not any(o < q for o in query))


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > WIDTH:
        return min(a, b, key=lambda q: (q == ANY, len(q)))
    return _least({x | y for x, y in product(a, b)})


def _holds(strings: set[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


class _Part:
    """What is known of a part: all strings that it can be, or else a query."""

    def __init__(self, strings: set[str] | None = None, query: Query = ANY):
        self.strings, self.query = strings, query

    def known(self) -> Query:
        return self.query if self.strings is None else _holds(self.strings)


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _sequence(tokens) -> _Part:
    strings: set[str] | None = {""}
    query, whole = ANY, True
    for token in tokens:
        part = _token(token)
        if part.strings is not None and len(strings) * len(part.strings) <= WIDTH:
            strings = {a + b for a, b in product(strings, part.strings)}
            continue
        query, whole = _and(query, _holds(strings)), False
        if part.strings is None:
            query, strings = _and(query, part.query), {""}
        else:
            strings = part.strings
    return _Part(strings) if whole else _Part(None, _and(query, _holds(strings)))


def _token(token) -> _Part:
    kind, value = token
    if kind is op.LITERAL:
        return _Part({chr(value).lower()})
    if kind is op.IN:
        return _Part(_class(value))
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        if all(p.strings is not None for p in parts) and sum(len(p.strings) for p in parts) <= WIDTH:
            return _Part(set().union(*(p.strings for p in parts)))
        query = set().union(*(p.known() for p in parts))
        return _Part(None, _least(query) if len(query) <= WIDTH else ANY)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        part = _sequence(inner)
        if part.strings is not None and (least, most) == (0, 1):
            return _Part(part.strings | {""})
        if part.strings is not None and least == most and least * max(map(len, part.strings)) <= 8 and len(part.strings) ** least <= WIDTH:
            return _Part({"".join(x) for x in product(part.strings, repeat=least)})
        return _Part(None, part.known() if least else ANY)
    return _Part()


def trigram_query(pattern: str) -> Query:
    """The query of a pattern in Python's syntax (literals, classes, groups, branches and repeats)."""
    return _sequence(parser.parse(pattern, re.ASCII)).known()
