"""Token ids of whole texts, with a cache of words.

The tokenizer lower-cases, never joins across white space, and takes a run of letters and the
punctuation behind it apart. So a text's ids are its words' ids one after the other. Texts are
split and their different words told by Arrow, a few megabytes at a time. Each word is encoded once
and kept; words that differ in case share their entry, and a word with a full stop, a hyphen or
digits is put together from its parts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per Python worker, the longest word that is kept, and words encoded in one call.
CACHED_WORDS, CACHED_BYTES, AT_ONCE = 300_000, 32, 1000
#: Words of a to z that are kept as numbers, five bits a letter, and the most letters of one.
CACHED_NUMBERS, LETTERS_IN_NUMBER = 1_500_000, 12
#: Texts encoded together: their number, and their bytes unless a single one has more.
ROWS, TEXT_BYTES = 2000, 8 << 20
_CLOSING = b".,;:!?"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_letters() -> str:
    """The letter by which byte-level vocabularies write each byte: itself if it is printed.

    The blank stays, as it parts words.
    """
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    letters = [chr(b if b in printed else next(others)) for b in range(256)]
    letters[0x20] = " "
    return "".join(letters)


_LETTERS_AND_BLANK = _byte_letters()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _parted(word: bytes) -> list[bytes]:
    """The parts of a word that the tokenizer takes apart; one if that is not easily told."""
    if word.isalpha():  # bytes know ASCII letters only
        return [word]
    if word.isascii():
        plain = b"'" not in word and b"<|" not in word and word == word.lower()
        return _PARTS.findall(word) if plain else [word]
    bare = word.rstrip(_CLOSING)
    return [bare, word[len(bare) :]] if bare != word and bare.decode()[-1].lower().isalnum() else [word]


def words_of(text: str) -> list[bytes]:
    """Pieces of a text that are tokenized alike wherever they stand."""
    raw = text.encode()
    if b"<|" in raw:  # a special token is one in its own case only
        return raw.split()
    lower = raw.lower()  # ASCII letters only
    if not raw.isascii():
        # Marks that combine with a letter of one case only keep their text as it is.
        if not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower.decode())):
            return raw.split()
    return lower.split()


def bounded(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few enough texts to be encoded together."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right"))
            to = min(max(fit, at + 1), at + ROWS)
            yield batch.slice(at, to - at)
            at = to


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts in lower case as far as ``words_of`` takes them so."""
    lower = pc.ascii_lower(texts)
    unlike = pc.or_(pc.match_substring(texts, "<|"), pc.invert(pc.string_is_ascii(texts)))
    rows = np.flatnonzero(unlike.to_numpy(zero_copy_only=False)).tolist()
    if not rows:
        return lower
    kept = np.zeros(len(texts), bool)
    for row in rows:
        text = texts[row].as_py()
        normal = unicodedata.is_normalized
        kept[row] = "<|" in text or not (normal("NFC", text) and normal("NFC", lower[row].as_py()))
    return pc.if_else(pa.array(kept), texts, lower)


def _numbers(words: pa.Array) -> np.ndarray:
    """Words of a to z as numbers, different ones for different words that are short enough."""
    _, offsets, data = words.buffers()
    places = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    # No letter is zero, so zeros beyond a word's end tell its length.
    letters = np.append(np.frombuffer(data, np.uint8) - 96, np.zeros(LETTERS_IN_NUMBER, np.uint8)).astype(np.int64)
    sizes, numbers = np.diff(places), np.zeros(len(words), np.int64)
    for k in range(LETTERS_IN_NUMBER):
        numbers = numbers * 32 + np.where(sizes > k, letters[places[:-1] + k], 0)
    return numbers


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, an end id after each text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            bare = json.load(file) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        # The same merges without the steps that change nothing in lower-case letters.
        self._merges = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self._tokenizer.get_vocab()
        self._final = np.zeros(max(vocabulary.values()) + 1, bool)
        self._final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known: dict[bytes, bytes] = {}
        # Words kept as numbers, in order, and for each the place of its ids.
        self._numbers, self._places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._number_ids = pa.array([], pa.large_binary())

    def _singly(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self._tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words; runs of letters in one text, cut after the ids that end a word."""
        out: dict[bytes, bytes] = {}
        letters = [
            w
            for w in words
            if (w.isalpha() and w.islower())
            or (not w.isascii() and (t := w.decode()).isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t))
        ]
        for at in range(0, len(letters), AT_ONCE):
            some = letters[at : at + AT_ONCE]
            text = b" ".join(some).decode("latin-1").translate(_LETTERS_AND_BLANK)
            [found] = self._merges.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self._final[ids]) + 1)).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                out.update(zip(some, (data[a:b] for a, b in pairwise([0, *ends])), strict=True))
        rest = [w for w in words if w not in out]
        for at in range(0, len(rest), AT_ONCE):
            out.update(self._singly(rest[at : at + AT_ONCE]))
        return out

    def _keep(self, new: dict[bytes, bytes]) -> None:
        """Keep the ids of words that are short, as many as there is room for."""
        room = CACHED_WORDS - len(self._known)
        if room > 0:
            self._known.update(islice(((w, ids) for w, ids in new.items() if len(w) <= CACHED_BYTES), room))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, from those known or encoded now."""
        known = self._known
        found = list(map(known.get, words))
        if None in found:
            missing = [n for n, ids in enumerate(found) if ids is None]
            new = self._encode([words[n] for n in missing])
            for n in missing:
                found[n] = new[words[n]]
            self._keep(new)
        return found

    def _ids_of(self, values: pa.Array) -> pa.Array:
        """Ids of each of ``values``, by its different words."""
        coded = values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        return pa.array(self._ids(words), pa.large_binary()).take(coded.indices)

    def _letter_ids(self, values: pa.Array) -> pa.Array:
        """Ids of each of ``values``, which are words of a to z."""
        coded = values.dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return pa.array([], pa.large_binary())
        short = pc.binary_length(words).to_numpy(zero_copy_only=False) <= LETTERS_IN_NUMBER
        numbers = _numbers(words)
        order = np.argsort(numbers)
        at = np.empty(len(words), np.int64)
        at[order] = np.searchsorted(self._numbers, numbers[order])
        hit = short & (at < len(self._numbers))
        hit[hit] = self._numbers[at[hit]] == numbers[hit]
        new, long = np.flatnonzero(short & ~hit), np.flatnonzero(~short)
        fresh = words.take(pa.array(new)).cast(pa.large_binary()).to_pylist()
        ids = self._encode(fresh)
        found = [
            self._number_ids.take(pa.array(self._places[at[hit]])),
            pa.array([ids[w] for w in fresh], pa.large_binary()),
            pa.array(self._ids(words.take(pa.array(long)).cast(pa.large_binary()).to_pylist()), pa.large_binary()),
        ]
        room = CACHED_NUMBERS - len(self._numbers)
        if room > 0 and len(new):
            kept = np.concatenate([self._numbers, numbers[new[:room]]])
            places = np.concatenate([self._places, len(self._numbers) + np.arange(len(kept) - len(self._numbers))])
            by_number = np.argsort(kept, kind="stable")
            self._numbers, self._places = kept[by_number], places[by_number]
            self._number_ids = pa.concat_arrays([self._number_ids, found[1][:room]])
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(hit), new, long])] = np.arange(len(words))
        return pa.concat_arrays(found).take(pa.array(place[coded.indices.to_numpy(zero_copy_only=False)]))

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of different words, each put together from its parts."""
        stems = pc.ascii_rtrim(words, characters=_CLOSING.decode())
        plain = pc.and_(pc.ascii_is_alpha(stems), pc.ascii_is_lower(stems))
        marks = plain.to_numpy(zero_copy_only=False)
        places = [np.flatnonzero(marks)]
        tails = pc.ascii_ltrim(words.filter(plain), characters=_LETTERS)
        out = [pc.binary_join_element_wise(self._letter_ids(stems.filter(plain)), self._ids_of(tails), pa.scalar(b"", pa.large_binary()))]
        rest = words.filter(pc.invert(plain)).cast(pa.large_binary()).to_pylist()
        if rest:
            found = list(map(self._known.get, rest))
            missing = [n for n, ids in enumerate(found) if ids is None]
            parted = {rest[n]: _parted(rest[n]) if rest[n] else [] for n in missing}
            parts = list(dict.fromkeys(chain.from_iterable(parted.values())))
            ids = dict(zip(parts, self._ids(parts), strict=True))
            new = {w: b"".join(map(ids.__getitem__, p)) for w, p in parted.items()}
            for n in missing:
                found[n] = new[rest[n]]
            self._keep(new)
            out.append(pa.array(found, pa.large_binary()))
            places.append(np.flatnonzero(~marks))
        order = np.empty(len(words), np.int64)
        order[np.concatenate(places)] = np.arange(len(words))
        return pa.concat_arrays(out).take(pa.array(order))

    def arrow(self, texts: pa.Array, end_id: int) -> pa.Array:
        """Ids of each text, as large binary; a null text has its end id alone."""
        # A copy, as Arrow lowers the wrong bytes of a cast slice.
        whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(_lowered(whole))
        coded = lists.flatten().dictionary_encode()
        different = self._word_ids(coded.dictionary)
        end = pa.array([int(end_id).to_bytes(4, "little")], pa.large_binary())
        # A text's words, then the end id, as one more word.
        n, sizes = len(texts), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 1) - 1
        taken = np.full(len(coded) + n, len(different), np.int64)
        inside = np.ones(len(taken), bool)
        inside[ends] = False
        taken[inside] = coded.indices.to_numpy(zero_copy_only=False)
        ids = pa.concat_arrays([different, end]).take(pa.array(taken))
        _, offsets, data = ids.buffers()
        cuts = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([cuts[:1], cuts[ends + 1]])), data]
        )

    def __call__(self, texts: list[str | None], end_id: int) -> list[bytes]:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        return [ids for some in bounded([batch], 0) for ids in self.arrow(some.column(0), end_id).to_pylist()]


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    return _encoder(path)


def forget() -> None:
    """Let go of this process's encoders and the words they know."""
    _encoder.cache_clear()
