"""Column functions over words and identifiers: stop words, concepts of paths, query sections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = (
    "a an and are as at be been by for from has had have he in is it its of on that the to was will with this but they "
    "what when where who which why how all would there their or if out so up could just than them some into only now "
    "may should those after before being because through can any other each"
).split()
# End of fixed values.


def words_of_text(text: Column, longer_than: int = 0, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words (letters, digits, _) of more than `longer_than` characters that aren't stop words, in order."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else None
    return F.filter(words, lambda w: (F.length(w) > longer_than) & (F.lit(True) if stop is None else ~F.array_contains(stop, w)))


def without_stop_words(words: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def is_common(word: Column, common: Sequence[str] = STOP_WORDS, least: int = 3) -> Column:
    """Whether a word is too short or too common to search for; `common` is the caller's list."""
    return (F.length(word) < least) | F.lower(word).isin(*common)


def identifier_parts(name: Column) -> Column:
    """Lower-cased words of an identifier: split at case changes, around numbers, and at _ - . and white space."""
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(F.regexp_replace(spaced, r"([a-zA-Z])(\d)", "$1 $2"), r"(\d)([a-zA-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\-.]", " ")), r"\s+"), lambda w: F.length(w) > 0)


def path_concepts(path: Column, common: Sequence[str] = STOP_WORDS, least: int = 3) -> Column:
    """Distinct words of a path's parts without their extensions, in order: at least `least` long and not common."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    named = F.transform(parts, lambda p: identifier_parts(F.regexp_replace(p, r"\.[^.]*$", "")))
    return F.array_distinct(F.filter(F.flatten(named), lambda w: ~is_common(w, common, least)))


def keywords(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The distinct words of over two characters that aren't stop words, in order."""
    return F.array_distinct(words_of_text(text, 2, stop_words))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


_SECTIONS = ("User Query:", "System Context:", "Topics:")


def query_sections(text: Column) -> Column:
    """struct(query, context, topics) of a structured query; a text without sections is all query, topics are split at commas."""

    def section(title: str) -> Column:
        others = "|".join(re.escape(t) for t in _SECTIONS)
        return _trimmed(F.regexp_extract(text, rf"(?s){re.escape(title)}(.*?)(?={others}|$)", 1))

    query = F.when(F.contains(text, F.lit(_SECTIONS[0])), section(_SECTIONS[0])).otherwise(_trimmed(text))
    topics = F.filter(F.transform(F.split(section(_SECTIONS[2]), ","), _trimmed), lambda t: t != "")
    return F.struct(query.alias("query"), section(_SECTIONS[1]).alias("context"), topics.alias("topics"))
