"""Column functions over text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalised(text: Column) -> Column:
    """Without links and mail addresses, lower-cased, white space collapsed."""
    no_links = F.regexp_replace(text, r"https?://[^ \n\t]+", " ")
    # a name is tried where it begins and taken whole, so that long runs of letters cost no more than their length
    no_mail = F.regexp_replace(no_links, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+", " ")
    return F.trim(F.regexp_replace(F.lower(no_mail), r"[ \n\t\r]+", " "))


def words(text: Column, least: int = 1) -> Column:
    """ASCII words of at least `least` characters, lower-cased, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)


def identifier_words(name: Column) -> Column:
    """Words of an identifier: split at case changes, digits, and the separators _ - . and space."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[ _.#-]+"), lambda w: F.length(w) > 0)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of the text without white space."""
    packed = F.regexp_replace(F.lower(text), r"[ \n\t\r]+", "")
    count = F.length(packed) - n + 1
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substr(packed, k, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def name_match(name: Column, query: str) -> Column:
    """1 equal, .9 equal without spaces, .75 prefix, .6 all words contained, .5 contained, else 0."""
    n, q = F.lower(name), query.lower()
    every = F.lit(True)
    for word in q.split():
        every = every & n.contains(word)
    return F.when(n == q, 1.0).when(F.replace(n, F.lit(" ")) == q.replace(" ", ""), 0.9).when(n.startswith(q), 0.75).when(every, 0.6).when(n.contains(q), 0.5).otherwise(0.0)


def html_text(html: Column) -> Column:
    """Text of a page: no scripts or styles, line ends for br, p and div, no tags, entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?i)<br */?>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(p|div)[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(entities_decoded(out), r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def snippet(text: Column, term: str, around: int = 3, separator: str = "\n") -> Column:
    """struct(reason, line, snippet): the lines around the first that holds the term, else the head of the text.

    Terms match without regard to case; lines count from 1; a null text gives reason `none`.
    """
    lines = F.split(text, re.escape(separator))
    hit = F.array_position(F.transform(lines, lambda s: F.lower(s).contains(term.lower())), True).cast("int")
    line = F.when(text.isNotNull(), F.greatest(hit, F.lit(1)))
    first = F.greatest(line - around, F.lit(1))
    body = F.array_join(F.slice(lines, first, line + around - first + 1), separator)
    reason = F.when(text.isNull(), "none").when(hit > 0, "match").otherwise("head")
    return F.struct(reason.alias("reason"), line.alias("line"), body.alias("snippet"))


# Named characters, contractions in the order they are expanded, and abbreviations.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&amp;": "&"}
CONTRACTIONS = {
    "can't": "cannot",
    "won't": "will not",
    "n't": " not",
    "'re": " are",
    "'ve": " have",
    "'ll": " will",
    "'d": " would",
    "'m": " am",
    "it's": "it is",
    "let's": "let us",
    "that's": "that is",
    "there's": "there is",
    "here's": "here is",
    "what's": "what is",
    "where's": "where is",
    "who's": "who is",
    "how's": "how is",
}
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Sr.", "Jr.")
# End of fixed values.


def entities_decoded(text: Column) -> Column:
    """Named characters decoded; &amp; last, so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def cleaned(text: Column, urls: bool = True, emails: bool = False, html: bool = False, code: bool = False, replacements: Sequence[tuple[str, str]] = (), lower: bool = True, punctuation: bool = False, numbers: bool = False, spaces: bool = True, stop_words: Sequence[str] = ()) -> Column:
    """A text with what is asked removed, in this order; null gives an empty text.

    Compatibility forms of characters aren't folded: that needs a Python function (`compatible`).
    """
    out = F.coalesce(text, F.lit(""))
    steps = [(urls, r"https?://\S+", ""), (emails, r"(?:(?<![\w.-])|\G)[\w.-]++@[\w.-]+\.\w+", ""), (html, "<[^>]*>", ""), (code, r"(?s)```.*?```", ""), (code, "`[^`]+`", ""), *[(True, p, r) for p, r in replacements]]
    for wanted, pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement) if wanted else out
    out = F.lower(out) if lower else out
    for wanted, pattern in ((punctuation, r"[^\w\s]|_"), (numbers, r"\d+")):
        out = F.regexp_replace(out, pattern, " ") if wanted else out
    out = stripped(F.regexp_replace(out, r"\s+", " ")) if spaces else out
    if stop_words:
        stop = F.array(*[F.lit(w) for w in stop_words])
        out = F.array_join(F.filter(F.split(out, r"\s+"), lambda w: ~F.array_contains(stop, w)), " ")
    return out


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Texts in compatibility form (NFKD); nulls stay."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def stripped(text: Column) -> Column:
    """Without white space on both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def spaces_normalised(text: Column, keep_lines: bool = True) -> Column:
    if not keep_lines:
        return stripped(F.regexp_replace(text, r"\s+", " "))
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: stripped(F.regexp_replace(x, r"\s+", " "))), "\n")


def punctuation_cleaned(text: Column) -> Column:
    """Without repeated marks, spaces before marks, and marks at the ends of lines; one space after an end before a small letter."""
    out = F.regexp_replace(text, r"([.!?]){2,}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+([.!?,;:])", "$1"), r"([.!?])\s*([a-z])", "$1 $2")
    return F.regexp_replace(out, r"(?m)[.!?,;:]+$", "")


def contractions_expanded(text: Column) -> Column:
    """Contractions written out, in any case, in their fixed order: n't goes before the words that hold it."""
    for short, long in CONTRACTIONS.items():
        text = F.regexp_replace(text, f"(?i){short}", long)
    return text


def tokens(text: Column, method: str = "word", least: int = 1, most: int | None = None, lower: bool = False, plain: bool = False, hyphens: bool = True, custom: Callable[[Column], Column] | None = None) -> Column:
    """Tokens by white space, words (with their hyphens), sentences (abbreviations don't end one), or a function of the caller's."""
    t = F.coalesce(text, F.lit(""))
    if method == "whitespace":
        out = F.split(t, r"\s+")
    elif method == "sentence":
        for k, a in enumerate(ABBREVIATIONS):
            t = F.replace(t, F.lit(a), F.lit(f"\u0001{k}\u0002"))
        out = F.split(t, r"(?<=[.!?])\s+(?=[A-Z])")
        for k, a in enumerate(ABBREVIATIONS):
            out = _replaced(out, f"\u0001{k}\u0002", a)
        out = F.transform(out, lambda x: stripped(x))
    elif method == "custom":
        if custom is None:
            raise ValueError("the custom method needs a function")
        out = custom(t)
    elif method == "word":
        out = F.regexp_extract_all(t, F.lit(r"(\w+(?:-\w+)*)" if hyphens else r"(\b\w+\b)"), F.lit(1))
    else:
        raise ValueError(f"unknown method {method!r}")
    out = F.transform(out, lambda x: F.lower(x)) if lower else out
    out = F.transform(out, lambda x: F.regexp_replace(x, r"[^\w-]", "")) if plain else out
    return F.filter(out, lambda x: (F.length(x) > 0) & (F.length(x) >= least) & (F.lit(True) if most is None else F.length(x) <= most))


def _replaced(texts: Column, mark: str, by: str) -> Column:
    return F.transform(texts, lambda x: F.replace(x, F.lit(mark), F.lit(by)))


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; fewer words give none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    count = F.size(words) - n + 1
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.array_join(F.slice(words, k, F.lit(n)), " ")))


def token_count(text: Column, model: str = "gpt") -> Column:
    """Estimated tokens: a quarter of the characters, 1.3 a word, or the characters."""
    t = F.coalesce(text, F.lit(""))
    counts = {"gpt": F.ceil(F.length(t) / 4), "bert": F.ceil(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) * 1.3), "char": F.length(t)}
    return counts[model].cast("long")
