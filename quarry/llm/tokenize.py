"""Token ids of whole texts with a public tokenizer, one encoding per distinct piece of a word and worker."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm import common

#: Pieces and ids that a worker keeps; beyond them it starts anew.
_MOST_PIECES, _MOST_IDS = 1_200_000, 16_000_000
#: Bytes of text that are split and coded at once.
_CHUNK = 4 << 20
#: A space before other white space or at the end: only there do tokens depend on what is beyond a space.
_RUN = r" [\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]| \z"
#: Letters that tokenizers never part or change beyond lower case, and that no sign before or behind them joins.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ONLY_LETTERS = re.compile(f"[{_LETTERS}]+").fullmatch
#: A word as its letters and the rest, where that begins with another sign of ASCII.
_WORD = rf"(?s)^(?P<letters>[{_LETTERS}]+)(?P<rest>[\x00-@\[-`{{-\x7F].*)?$"
#: A sign that stands for itself where a tokenizer parts it from words by white space alone.
_MARK = "\x01"


class _Pieces:
    """Ids of pieces by number: `flat` holds them one after the other, `ends` where each piece's end."""

    def __init__(self, dtype: np.dtype) -> None:
        #: Numbers of words or first letters behind a space, and of rests of words.
        self.spaced: dict[str, int] = {}
        self.rests: dict[str, int] = {}
        self.flat, self.ends, self.count = np.empty(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0

    def add(self, known: dict[str, int], new: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n, held = self.count, int(self.ends[self.count])
        self.count += len(new)
        while held + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.count >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[held : held + len(ids)] = ids
        self.ends[n + 1 : self.count + 1] = held + ends
        known.update(zip(new, range(n, self.count), strict=True))

    def full(self, more: int) -> bool:
        return self.count + more > _MOST_PIECES or self.ends[self.count] > _MOST_IDS


def _gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after the other."""
    ends = np.cumsum(sizes)
    return flat.take(np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0))


class WordEncoder:
    """Encodes texts by pieces of words, a word being what stands between single spaces.

    The tokenizers served here (split by words with the space before them, or without white space)
    never join what is before a single space with the space, so words encode as they do within the
    text. Nor do they join letters with a sign that is none, so a word's first letters and its rest
    encode apart, and both recur far more often than words. Texts with runs of white space that hold
    a space, or with an added token of the tokenizer, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._type = np.dtype("<u2") if self._tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._lower = "Lowercase()" in str(self._tokenizer.normalizer)
        self._sizes = self._token_sizes()
        mark = self._tokenizer.encode(f" {_MARK}", add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else None
        self._closing = self._closing_tokens()
        self._held = _Pieces(self._type)

    def _token_sizes(self) -> np.ndarray | None:
        """The bytes of each token, where tokens are stretches of the text's bytes and none of them is changed or dropped; else None."""
        split = str(self._tokenizer.pre_tokenizer)
        if self._tokenizer.normalizer is not None or not re.fullmatch(r"ByteLevel\(add_prefix_space=False, .*use_regex=True\)", split):
            return None
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            sizes[k] = len(token)
        return sizes

    def _closing_tokens(self) -> np.ndarray | None:
        """Whether each token ends a run of letters, where a suffix marks that; else None."""
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        closing = np.zeros(max(vocabulary.values()) + 1, bool)
        closing[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        return closing if suffix else None

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and where each one's end."""
        found = [np.array(x.ids, self._type) for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, self._type), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)

    def _by_word(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _texts, of pieces that are encoded as if each stood alone, in one encoding."""
        found = self._tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, self._type), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(pieces)), side="right")

    def _by_size(self, new: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As _by_word with a space before each, as one text, whose ids fall to words by their bytes; None where they don't fit."""
        text = " " + " ".join(new)
        ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        wanted = np.cumsum([len(w.encode()) + 1 for w in new])
        reached = np.cumsum(self._sizes[ids])
        ends = np.searchsorted(reached, wanted) + 1
        fits = len(ids) and reached[-1] == wanted[-1] and (reached[ends - 1] == wanted).all()
        return (ids.astype(self._type), ends) if fits else None

    def _by_mark(self, new: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As _by_size, with a mark between each two; None where a word holds the mark."""
        text = f" {_MARK}".join(" " + w for w in new)
        ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        marks = ids == self._mark
        at = np.flatnonzero(marks)
        ends = np.append(at - np.arange(len(at)), len(ids) - len(at))
        return (ids[~marks].astype(self._type), ends) if len(at) == len(new) - 1 else None

    def _by_close(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As _by_size, of runs of letters, each of which ends with a closing token; None where that isn't so."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self._closing[ids]) + 1
        return (ids.astype(self._type), ends) if len(ends) == len(letters) else None

    def _learn_spaced(self, new: list[str]) -> None:
        if self._closing is not None:
            letters = [w for w in new if _ONLY_LETTERS(w)]
            if letters and (found := self._by_close(letters)):
                self._held.add(self._held.spaced, letters, *found)
                new = [w for w in new if w not in self._held.spaced]
        if new:
            found = self._by_size(new) if self._sizes is not None else self._by_mark(new) if self._mark is not None else None
            self._held.add(self._held.spaced, new, *(found or self._by_word([" " + w for w in new])))

    def _learn_rests(self, new: list[str]) -> None:
        self._held.add(self._held.rests, new, *self._by_word(new))

    def _places(self, known: dict[str, int], pieces: pa.Array, learn: Callable[[list[str]], None]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin among those held, and how many they are."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [w for w in distinct if w not in known]:
            learn(new)
        number = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct)).take(coded.indices.to_numpy())
        begins = self._held.ends.take(number)
        return begins, self._held.ends.take(number + 1) - begins

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words behind a space one after the other, and how many each has."""
        if self._held.full(2 * len(words)):
            self._held = _Pieces(self._type)
        parts = pc.extract_regex(words, _WORD)
        letters, rest = (pc.struct_field(parts, k) for k in ("letters", "rest"))
        letters = pc.if_else(parts.is_valid(), pc.utf8_lower(letters) if self._lower else letters, words)
        begins, sizes = self._places(self._held.spaced, letters, self._learn_spaced)
        behind = np.flatnonzero(pc.fill_null(pc.binary_length(rest), 0).to_numpy())
        more, extra = self._places(self._held.rests, rest.take(pa.array(behind)), self._learn_rests)
        ids = _gathered(self._held.flat, np.insert(begins, behind + 1, more), np.insert(sizes, behind + 1, extra))
        sizes[behind] += extra
        return ids, sizes

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _texts, of texts without runs of white space or added tokens."""
        lists = pc.split_pattern(texts, " ")
        words, begins = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        first = np.zeros(len(words), bool)
        first[begins[:-1]] = True
        firsts, first_ends = self._texts(words.filter(pa.array(first)).to_pylist())
        coded = words.filter(pa.array(~first)).dictionary_encode()
        ids, sizes = self._words(coded.dictionary)
        starts, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        word_begins, word_sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        word_begins[first], word_sizes[first] = first_ends - np.diff(first_ends, prepend=0), np.diff(first_ends, prepend=0)
        word_begins[~first], word_sizes[~first] = starts.take(which) + len(firsts), sizes.take(which)
        return _gathered(np.concatenate((firsts, ids)), word_begins, word_sizes), np.cumsum(word_sizes)[begins[1:] - 1]

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, none of them null, in order; texts of about 4 MB are worked on at once."""
        texts = texts.cast(pa.large_string())
        size, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHUNK, side="right")))
            some, at = texts.slice(at, end - at), end
            whole = pc.match_substring_regex(some, _RUN)
            for token in self._added:
                whole = pc.or_(whole, pc.match_substring(some, token))
            whole = whole.to_numpy(zero_copy_only=False)
            found: list[Iterator[np.ndarray]] = []
            for kind, encode in ((False, self._by_pieces), (True, lambda x: self._texts(x.to_pylist()))):
                part = some.filter(pa.array(whole == kind))
                ids, ends = encode(part) if len(part) else (np.empty(0, self._type), np.empty(0, np.int64))
                found.append(iter(np.split(ids, ends[:-1])))
            for kind in whole.tolist():
                yield next(found[kind])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return list(self.encoded(pa.array(texts, pa.large_string())))


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file, kept until the worker begins another step that keeps something."""
    return common.held(f"encoder of {path}", lambda: WordEncoder(path))
