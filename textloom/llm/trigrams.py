"""Boolean trigram queries that every text matching a regular expression satisfies (after Cox, 2012).

A query is True (nothing is mandatory), a trigram, or ("and" | "or", frozenset of queries). Case is folded throughout.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

MOST_STRINGS, MOST_RANGE = 32, 6


def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    parts = [x for q in (a, b) for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])]
    return parts[0] if len(set(parts)) == 1 else ("and", frozenset(parts))


def either(queries):
    queries = set(queries)
    if True in queries:
        return True
    return queries.pop() if len(queries) == 1 else ("or", frozenset(queries))


def of_strings(strings) -> object:
    """What holds if one of the strings occurs."""
    found = []
    for s in strings:
        if len(s) < 3:
            return True
        query = True
        for k in range(len(s) - 2):
            query = both(query, s[k : k + 3])
        found.append(query)
    return either(found) if found else True


def _scan(nodes):
    """(strings, query): strings is the finite set of what the nodes match, or None with the query that holds."""
    run, query, finite = {""}, True, True
    for op, arg in nodes:
        strings, inner = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, finite = both(query, of_strings(run)), False
        run = {""}
        if strings is not None and len(strings) <= MOST_STRINGS:
            run = strings
        else:
            query = both(query, inner)
    return (run, of_strings(run)) if finite else (None, both(query, of_strings(run)))


def _node(op, arg):
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MOST_RANGE:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= MOST_RANGE else (None, True)
    if op is sre.SUBPATTERN:
        strings, query = _scan(arg[3])
        return strings, query
    if op is sre.BRANCH:
        found = [_scan(x) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), True
        return None, either(of_strings(s) if s is not None else q for s, q in found)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _scan(inner)
        if strings is not None and most != sre.MAXREPEAT and most <= 3 and len(strings) ** int(most) <= MOST_STRINGS:
            out, now = set(), {""}
            for k in range(int(most) + 1):
                if k >= least:
                    out |= now
                now = {a + b for a in now for b in strings}
            return out, True
        return None, True if least == 0 else (of_strings(strings) if strings is not None else query)
    if op is sre.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """True if no trigram is mandatory."""
    strings, query = _scan(_parser.parse(pattern, re.ASCII))
    return of_strings(strings) if strings is not None else query


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))
