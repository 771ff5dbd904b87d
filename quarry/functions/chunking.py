"""Chunkers of texts as folds over their sentences, paragraphs or positions: one array of chunks per text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import vector as vec

#: Where a sentence ends; the ends themselves are dropped.
SENTENCE_END = r"[.!?]+\s+"
_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def large_segment(segment: Column, most: int, overlap: int = 50, whole_words: bool = True, compat: bool = False) -> Column:
    """Pieces of at most `most` characters that overlap; with whole_words they end at the last space of their second half.

    The split ends with the piece that reaches the end; with compat it goes on with the pieces that
    begin in that piece's overlap, each one character shorter.
    """
    if not whole_words and not compat:
        return _even_pieces(segment, most, overlap)
    size = F.length(segment)

    def step(acc: Column, _: Column) -> Column:
        start = acc["start"]
        full = F.least(start + most, size)
        head = F.substring(segment, start + 1, most + 1)
        back = F.instr(F.reverse(head), " ")
        space = start + F.length(head) - back
        cut = (back > 0) & (full < size) & (space > start + most * 0.5)
        end = F.when(cut, space).otherwise(full) if whole_words else full
        going = start < size
        done = (end >= size) if not compat else F.lit(False)
        after = F.when(done, size).otherwise(F.greatest(start + 1, end - overlap))
        piece = segment.substr(start + 1, end - start)
        return F.struct(F.when(going, after).otherwise(start).cast("int").alias("start"), F.when(going & (piece != ""), F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    # a step moves by at least half of `most` less the overlap; in the tail of compat by one
    least = max(1, (most // 2 if whole_words else most) - overlap)
    steps = F.ceil(size / least).cast("int") + (overlap + most if compat else 1)
    begin = F.struct(F.lit(0).alias("start"), _empty().alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), begin, step, lambda acc: acc["out"])


def _even_pieces(segment: Column, most: int, overlap: int) -> Column:
    """Pieces at every most - overlap characters (1 at least) up to the one that reaches the end.

    A place in a text is found by counting from its begin, so pieces are cut from parts of 32 steps.
    """
    step, run = max(1, most - overlap), 32
    count = F.when(F.length(segment) > 0, F.greatest(F.ceil((F.length(segment) - most) / step), F.lit(0)).cast("int") + 1)
    n = lambda first: F.least(F.lit(run), F.get(first, F.lit(1)) - F.get(first, F.lit(0)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / run).cast("int")), lambda k: k * run)
    cut = lambda k, total: F.struct(segment.substr(k * step + 1, F.lit(run * step + most)).alias("part"), n(F.array(k, total)).alias("n"))
    with_count = lambda total: F.transform(parts, lambda k: cut(k, total))
    pieces = lambda p: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda k: p["part"].substr(k * step + 1, F.lit(most)))
    every = F.flatten(F.flatten(F.transform(F.array(count), lambda total: F.transform(with_count(total), pieces))))
    return F.when(F.length(segment) > 0, every).otherwise(F.when(segment.isNotNull(), _empty()))


def sentence_chunks(text: Column, most: int, overlap: int = 50, separator: str = SENTENCE_END, least: int | None = None, whole_words: bool = True) -> Column:
    """Sentences packed into chunks of at most `most` characters, each begun with the last `overlap` characters before it.

    A last chunk under `least` (a quarter of `most`) joins the one before. Null and empty texts have no chunks.
    """
    least = most // 4 if least is None else least

    def add(acc: Column, s: Column) -> Column:
        current, out = acc["current"], acc["out"]
        fits = F.length(current) + F.length(s) <= most
        joined = F.when(current == "", s).otherwise(F.concat(current, F.lit(" "), s))
        push = ~fits & (F.length(current) >= least)
        pushed = F.when(push, F.concat(out, F.array(F.trim(current)))).otherwise(out)
        kept = F.when(push, F.when(F.length(current) > overlap, F.concat(F.substring(current, -overlap, overlap), F.lit(" "))).otherwise("") if overlap else F.lit("")).otherwise(current)
        pieces = large_segment(s, most, overlap, whole_words)
        large = F.length(s) > most
        after = F.when(large, F.element_at(pieces, -1)).otherwise(F.concat(kept, s))
        more = F.when(large, F.concat(pushed, F.slice(pieces, 1, F.size(pieces) - 1))).otherwise(pushed)
        return F.struct(F.when(fits, joined).otherwise(after).alias("current"), F.when(fits, out).otherwise(more).alias("out"))

    def finish(acc: Column) -> Column:
        current, out = acc["current"], acc["out"]
        rest = F.trim(current)
        merged = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), rest)))
        return F.when(F.length(current) >= least, F.concat(out, F.array(rest))).when((F.size(out) > 0) & (rest != ""), merged).otherwise(out)

    segments = F.filter(F.split(text, separator), lambda s: s != "")
    packed = F.aggregate(segments, F.struct(F.lit("").alias("current"), _empty().alias("out")), add, finish)
    return F.when(F.coalesce(text, F.lit("")) == "", _empty()).when(F.length(text) <= most, F.array(text)).otherwise(packed)


def paragraph_chunks(text: Column, most: int, least: int = 50) -> Column:
    """Paragraphs of at least `least` characters packed into chunks of at most `most`; larger ones are cut by sentences."""

    def add(acc: Column, p: Column) -> Column:
        current, out = acc["current"], acc["out"]
        fits = F.length(current) + F.length(p) + 2 <= most
        pushed = F.when(current != "", F.concat(out, F.array(F.trim(current)))).otherwise(out)
        large = F.length(p) > most
        cut = F.when(large, F.concat(pushed, sentence_chunks(p, most))).otherwise(pushed)
        joined = F.when(current == "", p).otherwise(F.concat(current, F.lit("\n\n"), p))
        return F.struct(F.when(fits, joined).when(large, F.lit("")).otherwise(p).alias("current"), F.when(fits, out).otherwise(cut).alias("out"))

    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.length(F.trim(p)) >= least)
    done = lambda acc: F.when(acc["current"] != "", F.concat(acc["out"], F.array(F.trim(acc["current"])))).otherwise(acc["out"])
    return F.aggregate(paragraphs, F.struct(F.lit("").alias("current"), _empty().alias("out")), add, done)


def sliding_chunks(text: Column, window: int, step: int) -> Column:
    """Windows every `step` characters; the one that reaches the end is the last."""
    count = F.greatest(F.ceil((F.length(text) - window) / step), F.lit(0)).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: text.substr(k * step + 1, F.lit(window)))


def semantic_chunks(sentences: Column, vectors: Column, most: int, least_similarity: float, similarity: Callable[[Column, Column], Column] = vec.cosine) -> Column:
    """Neighbouring sentences joined while their vectors are similar enough to the chunk's and the chunk stays within `most`.

    A chunk's vector is the mean of its own and the sentence's it took last.
    """
    size = F.size(vectors)
    rows = F.zip_with(sentences, vectors, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    first = F.struct(F.element_at(rows, 1)["s"].alias("current"), F.element_at(rows, 1)["v"].alias("v"), _empty().alias("out"))

    def add(acc: Column, x: Column) -> Column:
        joins = (similarity(acc["v"], x["v"]) >= least_similarity) & (F.length(acc["current"]) + F.length(x["s"]) + 1 <= most)
        mean = F.zip_with(acc["v"], x["v"], lambda a, b: (a + b) / 2)
        return F.struct(
            F.when(joins, F.concat(acc["current"], F.lit(". "), x["s"])).otherwise(x["s"]).alias("current"),
            F.when(joins, mean).otherwise(x["v"]).alias("v"),
            F.when(joins, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(F.trim(acc["current"]), F.lit("."))))).alias("out"),
        )

    done = lambda acc: F.concat(acc["out"], F.array(F.concat(F.trim(acc["current"]), F.lit("."))))
    folded = F.aggregate(F.slice(rows, 2, F.greatest(size - 1, F.lit(0))), first, add, done)
    return F.when(size < 1, _empty()).otherwise(folded)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def subwords(text: Column, vocabulary: list[str], most: int = 20) -> Column:
    """Words of the vocabulary, others greedily in their longest known prefixes, unknown characters one by one."""
    known = F.array(*[F.lit(w) for w in vocabulary])

    def broken(word: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            rest = acc["rest"]
            fits = F.filter(F.sequence(F.lit(1), F.least(F.greatest(F.length(rest), F.lit(1)), F.lit(most))), lambda n: F.array_contains(known, rest.substr(F.lit(1), n)))
            take = F.coalesce(F.array_max(fits), F.lit(1))
            more = F.concat(acc["out"], F.array(rest.substr(F.lit(1), take)))
            return F.struct(F.when(rest == "", rest).otherwise(rest.substr(take + 1, F.length(rest))).alias("rest"), F.when(rest == "", acc["out"]).otherwise(more).alias("out"))

        steps = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
        return F.aggregate(steps, F.struct(word.alias("rest"), _empty().alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.split(text, r"\s+"), lambda w: F.when(F.array_contains(known, w), F.array(w)).otherwise(broken(w))))
