"""Boolean text queries compiled to one predicate column.

Grammar: OR binds weakest, then AND (also by juxtaposition), then NOT; quotes (single or double) make
phrases and parentheses group; a single quote that is left open lasts to the end, a double one is an error. Terms match case-insensitively anywhere in any of the searched columns.
A term may say how: exact:, like:, semantic:, lang:, type: or file:, before a word or a phrase.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A bracket, or a run of quoted parts and of characters that neither end a word nor group.
_TOKEN = re.compile(r"""\s*([()]|(?:"[^"]*"|'[^']*(?:'|$)|[^\s()"'])+)""")
MODIFIERS = ("exact", "like", "semantic", "lang", "type", "file")


class QueryError(ValueError):
    """A query that the grammar doesn't allow."""


def _split(query: str) -> list[str]:
    tokens, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"unclosed quote at {at}")
        tokens.append(m[1])
        at = m.end()
    return tokens


def _term(token: str) -> tuple[str | None, str]:
    """The modifier of a term, or None, and its text."""
    kind, colon, value = token.partition(":")
    if colon and kind.lower() in MODIFIERS:
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        return kind.lower(), value[1:-1] if quoted else value
    return None, re.sub(r"^[\"']|[\"']$", "", token)


def terms(query: str) -> list[str]:
    """The texts of a query's terms, each once, in order."""
    return list(dict.fromkeys(_term(t)[1] for t in _split(query) if t not in "()" and t.upper() not in ("AND", "OR", "NOT")))


def _by(kind: str | None, columns: list[str], names: Mapping[str, str], semantic: Callable[[str], Column] | None) -> Callable[[str], Column]:
    any_ = lambda test: lambda value: _any([F.coalesce(test(F.col(c), value), F.lit(False)) for c in columns])
    holds = lambda c, value: F.lower(c).contains(value.lower())
    equal = lambda name: lambda value: F.coalesce(F.lower(F.col(names[name])) == value.lower(), F.lit(False))
    known = {None: any_(holds), "exact": any_(lambda c, value: c == value), "like": any_(lambda c, value: F.ilike(c, F.lit(f"%{value}%"))), "semantic": semantic or any_(holds), "lang": equal("lang"), "type": equal("type"), "file": lambda value: F.coalesce(holds(F.col(names["file"]), value), F.lit(False))}
    return known[kind]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def compile_query(query: str, columns: list[str], names: Mapping[str, str] | None = None, semantic: Callable[[str], Column] | None = None) -> Column:
    """The predicate of a query over some string columns; nulls match nothing.

    exact: the whole value of a column; like: a part, % and _ being wildcards; lang: and type: equal, but for case, the column that
    `names` gives for them (by default language, type); file: a part of the path. `semantic` makes the
    predicate of a semantic: term, which else is a plain one.
    """
    names = {"lang": "language", "type": "type", "file": "path"} | dict(names or {})
    tokens, place = _split(query), 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        if place >= len(tokens):
            raise QueryError("unexpected end of query")
        place += 1
        return tokens[place - 1]

    def either() -> Column:
        out = both()
        while peek() and peek().upper() == "OR":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = negated()
        while peek() and peek() != ")" and peek().upper() != "OR":
            if peek().upper() == "AND":
                take()
            out = out & negated()
        return out

    def negated() -> Column:
        if peek() and peek().upper() == "NOT":
            take()
            return ~primary()
        return primary()

    def primary() -> Column:
        token = take()
        if token == "(":
            out = either()
            if peek() != ")":
                raise QueryError("missing closing parenthesis")
            take()
            return out
        if token == ")" or token.upper() in ("AND", "OR", "NOT"):
            raise QueryError(f"unexpected {token}")
        kind, value = _term(token)
        return _by(kind, columns, names, semantic)(value)

    out = either()
    if peek() is not None:
        raise QueryError(f"unexpected {peek()}")
    return out
