"""Public tokenizers inside tasks: files by name, texts in bounded runs, words encoded once."""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZERS = "/opt/tokenizers"
RUN_BYTES = 1 << 20
#: What a text counts besides its bytes, so that a run has at most RUN_BYTES / TEXT_BYTES of them.
TEXT_BYTES = 64
#: Longest word that a worker remembers.
WORD_CHARS = 128
#: Signs that such tokenizers cut off a letter before them, and the letters.
TRAILING, LETTERS = set(".,;:!?"), set(string.ascii_letters)
_caches: dict[tuple, WordCache] = {}


def tokenizer(path: str):
    """The tokenizer of a file of the library of that name; the strings of special tokens follow ``add_special_tokens`` alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def text_runs(column, limit: int = RUN_BYTES):
    """(first row, texts as bytes) over runs of an Arrow text column of about ``limit`` bytes; null reads as empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        data = value.as_buffer()
        held.append(data.to_pybytes() if data is not None else b"")
        size += len(held[-1]) + TEXT_BYTES
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class WordCache(dict):
    """Ids of texts by a lower-casing tokenizer whose tokens never cross ASCII white space, which itself gives none.

    Each distinct word is encoded once, without the sign that may end it. ASCII letters are lowered beforehand where that
    changes nothing: not beside combining marks, with which they may compose, nor inside the names of special tokens.
    """

    #: Distinct words a worker remembers of late, and once more from before.
    KEPT = 1 << 19
    #: Words that are one piece to the tokenizer's pattern and that its normaliser leaves alone; they go to its merges at once.
    ONE = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        super().__init__()
        self.model, self.old = tokenizer(path), {}
        self.spelling = {b: c for c, b in byte_letters().items()}

    @classmethod
    def of(cls, path: str) -> WordCache:
        """One per worker, kept over its tasks."""
        if (cls, path) not in _caches:
            _caches[cls, path] = cls(path)
        return _caches[cls, path]

    def split(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts, index of each text's first word and one more)."""
        plain = [t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower() for t in texts]
        lists = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string(), safe=False))
        return lists.values, lists.offsets.to_numpy()

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of new words; of those that end with a sign behind a letter, the ids of the rest and of the sign."""
        ends = [w[-1:] in TRAILING and len(w) > 1 and w[-2] in LETTERS for w in words]
        ask = {w[:-1] if e else w for w, e in zip(words, ends)} | TRAILING
        ask = [w for w in ask if w not in self and w not in self.old]
        whole = [w for w in ask if self.ONE.fullmatch(w)]
        spell, bpe = self.spelling, self.model.model.tokenize
        new = {w: array("I", [t.id for t in bpe(w.encode().decode("latin-1").translate(spell))]).tobytes() for w in whole}
        rest = [w for w in ask if w not in new]
        found = self.model.encode_batch_fast(rest, add_special_tokens=False)
        new.update(zip(rest, (array("I", e.ids).tobytes() for e in found)))
        get = lambda w: new[w] if w in new else self[w] if w in self else self.old[w]
        self.update((w, get(w)) for w in TRAILING)
        return [get(w[:-1]) + self[w[-1]] if e else get(w) for w, e in zip(words, ends)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, index of each text's first id and one more)."""
        words, first = self.split(texts)
        coded = words.dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self) > self.KEPT:
            self.old = dict(self)
            self.clear()
        ids = list(map(self.get, distinct))
        new = [k for k, v in enumerate(ids) if v is None]
        for k in new:
            ids[k] = self.old.get(distinct[k])
        unknown = [k for k in new if ids[k] is None]
        for k, v in zip(unknown, self.look_up([distinct[k] for k in unknown])):
            ids[k] = v
        self.update((distinct[k], ids[k]) for k in new if len(distinct[k]) <= WORD_CHARS)
        return laid_out(ids, place, first)


class PairCache(dict):
    """Ids of texts by a byte-level tokenizer and by a model of pieces, each distinct chunk encoded once by both.

    Texts are cut before a blank that follows something else than white space. The byte-level tokenizer's pattern takes one
    blank with the word behind it, and of a longer run of white space leaves the last sign to that word, so no pre-token
    reaches across such a cut. Pieces have blanks at their beginning only (others are refused), so no merge does.
    """

    #: Distinct chunks a worker remembers of late, and once more from before.
    KEPT = 1 << 17
    #: White space as the pattern has it.
    WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    CUT = re.compile(f"(?<=[^{WHITE}])(?= )")
    #: Chunks that are one pre-token.
    ONE = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.old, self.bytes, self.pieces = {}, tokenizer(byte_level), SentencePieceProcessor(model_file=pieces)
        self.bytes.encode_special_tokens = True
        self.spelling = {b: c for c, b in byte_letters().items()}
        if any("▁" in self.pieces.id_to_piece(i).lstrip("▁") for i in range(self.pieces.get_piece_size())):
            raise ValueError(f"{pieces} has pieces with blanks inside")

    def look_up(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        one, bpe, spell = self.ONE.fullmatch, self.bytes.model.tokenize, self.spelling
        ids = lambda w: array("I", [t.id for t in bpe(w.encode().decode("latin-1").translate(spell))]).tobytes()
        sign = {c: ids(c) for c in TRAILING}
        left, rest = [], []
        for k, c in enumerate(chunks):
            if one(c):
                left.append(ids(c))
            elif c[-1] in TRAILING and one(c[:-1]):
                left.append(ids(c[:-1]) + sign[c[-1]])
            else:
                left.append(b"")
                rest.append(k)
        for k, e in zip(rest, self.bytes.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False)):
            left[k] = array("I", e.ids).tobytes()
        # The model adds the blank before a text; here it stands there and is taken off. It adds none to nothing.
        right = [array("I", x if c != " " else [self.pieces.piece_to_id("▁")]).tobytes()
                 for c, x in zip(chunks, self.pieces.encode([c[1:] for c in chunks], num_threads=1))]
        return list(zip(left, right))

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side (ids of all texts, index of each text's first id and one more); a text begins with a blank or is empty."""
        found = [self.CUT.split(t.decode("utf-8", "replace")) if t else [] for t in texts]
        first = np.cumsum([0, *map(len, found)])
        coded = pa.array([c for f in found for c in f], pa.string()).dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self) > self.KEPT:
            self.old = dict(self)
            self.clear()
        ids = list(map(self.get, distinct))
        new = [k for k, v in enumerate(ids) if v is None]
        for k in new:
            ids[k] = self.old.get(distinct[k])
        unknown = [k for k in new if ids[k] is None]
        for k, v in zip(unknown, self.look_up([distinct[k] for k in unknown])):
            ids[k] = v
        self.update((distinct[k], ids[k]) for k in new if len(distinct[k]) <= WORD_CHARS)
        return [laid_out(x, place, first) for x in (zip(*ids) if ids else ((), ()))]


def laid_out(ids: list[bytes], place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (``place`` into ``ids``) in a row, and where those of the words numbered ``first`` begin."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    blob, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
    many = sizes[place]
    upto = np.concatenate(([0], np.cumsum(many)))
    at = np.repeat(start[place] - upto[:-1], many)
    at += np.arange(len(at))
    return blob[at], upto[first]
