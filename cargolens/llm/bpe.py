"""Byte-pair encoding by an index of pair occurrences, and decoding.

The words that a block of a partition's texts brings are laid out as one row of symbols, and
every pair of neighbours that has a rank is mapped to all its positions there. Ranks that have positions
are active; the lowest active rank is applied to all its positions at once, which takes the
neighbouring pairs away from the lists of their ranks and adds new ones. A vocabulary in which a
symbol is made by one merge only, before any merge that uses it, gives the same symbols as
merging word by word; other vocabularies are refused.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import slices
from cargolens.llm.tokens import words_of

#: Pieces of words, and words of several pieces, kept per Python worker; the longest, in bytes.
CACHED, CACHED_WORDS, CACHED_BYTES = 600_000, 400_000, 32
#: Rows of a block, whose words are encoded together.
BLOCK_ROWS = 2000
#: Words of printed signs that no step changes but the splitter, its pieces, and signs that end a word.
_ASCII_WORD = re.compile(rb"[!-&(-@\[-~]+")
_ASCII_PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_CLOSING = b".,;:!?%&$#*)"
_END, _GONE = -1, -2  # symbols: behind a word, and merged into its left neighbour


class UnsupportedVocabulary(ValueError):
    """The tokenizer file asks for steps that this encoder does not have."""


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {chr(b if b in printed else next(others)): b for b in range(256)}


#: For each byte the letter that stands for it, and back.
_LETTERS = {b: c for c, b in _byte_letters().items()}
_BYTES = {ord(c): b for c, b in _byte_letters().items()}


def _plain_pieces(word: bytes) -> list[bytes] | None:
    """The pieces of a word of lower-case letters, digits and marks; None if it needs all steps."""
    if b"<|" in word:
        return None
    if word.isascii():
        return _ASCII_PIECES.findall(word) if _ASCII_WORD.fullmatch(word) else None
    bare = word.rstrip(_CLOSING)
    text = bare.decode()
    if not (text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)):
        return None
    return [bare, word[len(bare) :]] if len(bare) < len(word) else [bare]


def _is_word_level(file: dict) -> bool:
    """Whether white space parts words and is dropped, so that words can be encoded one by one."""
    steps = (file["normalizer"] or {}).get("normalizers", [])
    splits = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and not splits[1]["use_regex"]
        and not splits[1]["add_prefix_space"]
    )


class Merges:
    """Symbols, their merges by rank, and the encoding of pieces by occurrence lists."""

    def __init__(self, model: dict) -> None:
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False}
        odd = [k for k, v in plain.items() if model.get(k, v) != v]
        if odd or model.get("continuing_subword_prefix"):
            raise UnsupportedVocabulary(f"model settings {odd or ['continuing_subword_prefix']}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        if len(made) < len(pairs) or any(made.get(x, -1) >= rank for rank, pair in enumerate(pairs) for x in pair):
            raise UnsupportedVocabulary("a symbol is made by two merges, or used by a merge before it is made")
        if not all(c + s in self.vocab for c in _byte_letters() for s in {"", self.suffix}):
            raise UnsupportedVocabulary("a byte has no symbol")
        #: By rank: left symbol, right symbol, product. By pair: rank.
        self.parts = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.width = max(self.vocab.values()) + 1
        self.rank = {a * self.width + b: r for r, (a, b, _) in enumerate(self.parts)}
        letters = [_LETTERS[b] for b in range(256)]
        self._inner = np.array([self.vocab[c] for c in letters])
        self._final = np.array([self.vocab[c + self.suffix] for c in letters])
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        self._by_key = np.argsort(keys)
        self._keys = keys[self._by_key]

    def _laid_out(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols of the pieces' bytes, the last of each with the suffix, with ends between them."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = np.full(len(data) + len(pieces) + 1, _END, np.int64)
        symbols[1 + np.arange(len(data)) + np.repeat(np.arange(len(pieces)), sizes)] = self._inner[data]
        ends = np.cumsum(sizes)
        symbols[ends + np.arange(len(pieces))] = self._final[data[ends - 1]]
        return symbols

    def _occurrences(self, symbols: np.ndarray) -> dict[int, list]:
        """For each rank the positions at which its pair stands, in order."""
        left, right = symbols[:-1], symbols[1:]
        key = np.where((left < 0) | (right < 0), -1, left * self.width + right)
        slot = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        at = np.flatnonzero(self._keys[slot] == key) if len(self._keys) else np.zeros(0, np.int64)
        ranks = self._by_key[slot[at]]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
        return {int(ranks[a]): [at[a:b]] for a, b in pairwise(cuts) if b > a}

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of non-empty pieces as little-endian unsigned 32-bit integers."""
        start = self._laid_out(pieces)
        lists, n = self._occurrences(start), len(start)
        symbols, after, before = array("q", start.tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        active, rank, width = sorted(lists), self.rank, self.width  # a sorted list is a heap
        while active:
            lowest = heapq.heappop(active)
            a, b, product = self.parts[lowest]
            found = lists.pop(lowest)
            positions = found[0].tolist() if isinstance(found[0], np.ndarray) else found[:1]
            positions += found[1:]
            if len(found) > 1 and a == b:
                positions.sort()  # of overlapping pairs the left one merges
            for p in positions:
                # A pair that an earlier merge took apart is still listed, but no longer there.
                if symbols[p] != a or symbols[q := after[p]] != b:
                    continue
                symbols[p], symbols[q] = product, _GONE
                last = after[q]
                after[p], before[last] = last, p
                first = before[p]
                if (right := symbols[last]) >= 0 and (new := rank.get(product * width + right)) is not None:
                    if new in lists:
                        lists[new].append(p)
                    else:
                        lists[new] = [p]
                        heapq.heappush(active, new)
                if (left := symbols[first]) >= 0 and (new := rank.get(left * width + product)) is not None:
                    if new in lists:
                        lists[new].append(first)
                    else:
                        lists[new] = [first]
                        heapq.heappush(active, new)
        ended = np.frombuffer(symbols, np.int64)
        ended = ended[ended != _GONE]
        ends = (4 * np.cumsum(ended >= 0)[ended == _END]).tolist()
        data = ended[ended >= 0].astype("<u4").tobytes()
        return [data[x:y] for x, y in pairwise(ends)]


class Codec:
    """Encoder and decoder of one tokenizer file; the file's normalizer and splitter part texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        if file["post_processor"] is not None and file["post_processor"]["type"] != "ByteLevel":
            raise UnsupportedVocabulary(f"post-processor {file['post_processor']['type']}")
        tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self._added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise UnsupportedVocabulary("added tokens that take white space or normalized text")
        self._merges, self._by_word = Merges(file["model"]), _is_word_level(file)
        self._names = {i: t for t, i in (file["model"]["vocab"] | self._added).items()}
        self._joined = self._decoder(file["decoder"])
        self._known: dict[bytes, bytes] = {}
        self._words: dict[bytes, bytes] = {}

    def _decoder(self, settings: dict | None):
        if settings is None:
            return lambda ids: " ".join(map(self._names.__getitem__, ids))
        if settings["type"] != "ByteLevel":
            raise UnsupportedVocabulary(f"decoder {settings['type']}")
        letters = _byte_letters()
        # A name with a letter that stands for no byte, as of an added token, is its own text.
        raw = {i: bytes(map(letters.get, t)) if all(c in letters for c in t) else t.encode() for i, t in self._names.items()}
        return lambda ids: b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")

    def _next_added(self, text: str) -> tuple[int, int, str] | None:
        """Where the first added token stands in a text; the longest of those at one place."""
        return min(((at, -len(t), t) for t in self._added if (at := text.find(t)) >= 0), default=None)

    def _parts(self, text: str) -> list[bytes | int]:
        """The pieces of a text whose symbols merge, as bytes, and ids of added tokens between them."""
        out: list[bytes | int] = []
        while (cut := self._next_added(text)) is not None:
            at, _, token = cut
            out += [*self._split(text[:at]), self._added[token]]
            text = text[at + len(token) :]
        return [*out, *self._split(text)]

    def _split(self, text: str) -> list[bytes]:
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        pieces = self._splitter.pre_tokenize_str(text)
        return [piece.translate(_BYTES).encode("latin-1") for piece, _ in pieces if piece]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null is an empty text.

        All pieces that were not met before are merged together.
        """
        known, words = self._known, self._words
        split = [words_of(t or "") if self._by_word else [t.encode()] if t else [] for t in texts]
        ids: dict[bytes, bytes] = {}
        parts: dict[bytes, list[bytes | int]] = {}
        for word in set().union(*split):
            # A piece that stands alone is a word of that piece.
            found = known.get(word) or words.get(word) if self._by_word else None
            if found is not None:
                ids[word] = found
                continue
            some = _plain_pieces(word) if self._by_word else None
            parts[word] = self._parts(word.decode()) if some is None else some
        new = list({p for some in parts.values() for p in some if p.__class__ is bytes}.difference(known))
        known.update(zip(new, self._merges(new), strict=True))
        for word, some in parts.items():
            ids[word] = found = b"".join([known[p] if p.__class__ is bytes else p.to_bytes(4, "little") for p in some])
            if found and some[0] != word and len(words) < CACHED_WORDS and len(word) <= CACHED_BYTES:
                words[word] = found
        out = [b"".join(map(ids.__getitem__, some)) for some in split]
        room = CACHED - len(known) + len(new)
        for piece in new:
            if room <= 0 or len(piece) > CACHED_BYTES:
                del known[piece]
            else:
                room -= 1
        return out

    def decode(self, ids: bytes) -> str:
        return self._joined(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of this process for a tokenizer file."""
    return Codec(path)


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers) of every row's whole text.

    With ``decoded`` the ids are decoded again where they are made, as ``text``. A null or empty text has no ids. Ids may be null or repeat; each row is encoded alone. A very
    long text, or a very long word, is one block by itself. Other columns are not read, whatever
    their names. An empty frame gives no rows. A tokenizer file that this encoder cannot follow
    raises ``UnsupportedVocabulary``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_ROWS):
            both = codec(tokenizer)
            found = both.encode(batch.column(1).to_pylist())
            columns = {"doc_id": batch.column(0), "ids": pa.array(found, pa.binary())}
            if decoded:
                columns["text"] = pa.array(map(both.decode, found), pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``text``, what the ids decode to, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if ids is None else codec(tokenizer).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
