"""Toxicity by compression distance between two trained zstandard dictionaries."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from leadlake.llm.common import _LOWER, class_counts, crc, labelled_sample, logistic, spans, text_slices, word_hashes

#: Labelled rows of each class that training takes.
PER_CLASS = 1200
FOLDS, HELD_OUT = 5, 0
#: Longest window; a longer word gives several.
WINDOW = 64
TOXIC_BYTES, ORDINARY_BYTES = 8 << 10, 110_000
#: Ordinary windows of several words that train the ordinary dictionary, at most.
ORDINARY_SAMPLES = 80_000
SIGNIFICANT = 20
#: Zeros behind each window: what they save makes zstandard write a compressed block for any window.
PAD = bytes(32)
#: Bytes saved from which a window counts, for each of the counts that the calibration weighs.
STEPS = (2, 3, 4, 5)
#: Words whose distance a task remembers.
KNOWN = 1 << 20


def _compressor(content: bytes | None) -> zstd.ZstdCompressor:
    how = {"format": zstd.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0,
           "strategy": zstd.STRATEGY_LAZY2, "min_match": 4, "source_size": 128}
    if content is None:
        return zstd.ZstdCompressor(compression_params=zstd.ZstdCompressionParameters.from_level(3, **how))
    params = zstd.ZstdCompressionParameters.from_level(3, dict_size=len(content), **how)
    words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=words, compression_params=params)


def _lengths(by: zstd.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    if not windows:
        return np.empty(0, np.int64)
    at = np.zeros((len(windows), 2), np.uint64)
    at[:, 1] = [len(w) for w in windows]
    at[1:, 0] = np.cumsum(at[:-1, 1])
    out = by.multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(windows), at.tobytes()), threads=1)
    return np.fromiter((len(x) for x in out), np.int64, len(windows))


def _train(samples: list[bytes], size: int, k: int) -> bytes:
    """A dictionary's contents; where samples are too few to train from, the distinct samples."""
    try:
        return zstd.train_dictionary(size, samples, k=k, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" "


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Words of at most WINDOW bytes: starts, ends, row of each, hash of each."""
    starts, ends, at = spans(data, offsets)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = -(-(ends - starts) // WINDOW)
    if (n > 1).any():
        which = np.repeat(np.arange(len(starts)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        last = ends[which]
        starts = starts[which] + place * WINDOW
        ends, rows = np.minimum(starts + WINDOW, last), rows[which]
    return starts, ends, rows, word_hashes(data, starts, ends, lower=True)


def _window(word: bytes) -> bytes:
    return b" " + word + b" " + PAD


class Distance:
    """How many bytes the toxic dictionary saves on a word against the best ordinary coding of it."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by = [_compressor(toxic), _compressor(ordinary), _compressor(None)]
        self.known, self.saved = np.empty(0, np.uint64), np.empty(0, np.int8)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        hit = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        saved = np.zeros(len(keys), np.int8)
        saved[hit] = self.saved[at[hit]]
        raw = _LOWER[data].tobytes()
        new = first[~hit]
        windows = [_window(raw[s:e]) for s, e in zip(starts[new].tolist(), ends[new].tolist())]
        toxic, ordinary, plain = (_lengths(b, windows) for b in self.by)
        saved[~hit] = np.clip(np.minimum(ordinary, plain) - toxic, 0, 100)
        if len(self.known) > KNOWN:
            self.known, self.saved = keys, saved
        else:
            known, one = np.unique(np.concatenate((self.known, keys)), return_index=True)
            self.known, self.saved = known, np.concatenate((self.saved, saved))[one]
        return saved[back]

    def features(self, column) -> np.ndarray:
        """For each text: a constant, log counts of windows saving at least each of STEPS, the most saved, log of all windows."""
        out = []
        for _, data, offsets in text_slices(column):
            starts, ends, rows, hashes = _pieces(data, offsets)
            n = len(offsets) - 1
            saved = self.of(data, starts, ends, hashes).astype(np.int64) if len(starts) else np.empty(0, np.int64)
            most = np.zeros(n)
            np.maximum.at(most, rows, saved)
            counts = [np.log1p(np.bincount(rows[saved >= s], minlength=n)) for s in STEPS]
            out.append(np.column_stack([np.ones(n), *counts, most, np.log1p(np.bincount(rows, minlength=n))]))
        return np.concatenate(out) if out else np.empty((0, 3 + len(STEPS)))


def _words(texts: list[str]):
    """For each text its lower-cased words."""
    for _, data, offsets in text_slices(pa.array(texts, pa.string())):
        starts, ends, rows, _ = _pieces(data, offsets)
        raw = _LOWER[data].tobytes()
        words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        cuts = np.searchsorted(rows, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield words[cuts[i]:cuts[i + 1]]


def _letters(word: bytes) -> bytes:
    return word.strip(b".,;:!?*$%&#|\"'()[]{}<>-")


def _beginnings(texts: list[list[bytes]], among: set[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each beginning of 4 to 12 bytes of a word, and how many different words it follows."""
    keys, lasts = array("q"), array("q")
    for words in texts:
        for last, w in zip([b"", *words], words):
            for k in range(4, min(len(w), 12) + 1):
                key = hash(w[:k])
                if among is None or key in among:
                    keys.append(key)
                    lasts.append(hash(last))
    keys, lasts = np.array(keys, np.int64), np.array(lasts, np.int64)
    order = np.lexsort((lasts, keys))
    keys, lasts = keys[order], lasts[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (lasts[1:] != lasts[:-1])
    return np.unique(keys[new], return_counts=True)


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    """(toxic, ordinary) dictionaries, or None if nothing sets the classes apart.

    Toxic text is mostly ordinary, so the toxic dictionary trains on those of its words of which the
    whole or a beginning is significantly more frequent than in ordinary texts (a log likelihood ratio
    of SIGNIFICANT or more, and 8 times the rate). A beginning is counted once for each word it follows,
    as copies of one text would else make its words look toxic. The ordinary dictionary trains on whole
    lines of words.
    """
    used = [[list(map(_letters, words)) for words in _words(texts)] for texts in (toxic, ordinary)]
    n, m = (max(1, sum(map(len, texts))) for texts in used)
    keys, counts = _beginnings(used[0], None)
    keys, counts = keys[counts > 2], counts[counts > 2]  # fewer are never significant
    others, found = _beginnings(used[1], set(keys.tolist()))
    own = set()
    known = dict(zip(others.tolist(), found.tolist()))
    for key, x in zip(keys.tolist(), counts.tolist()):
        expected = n * (known.get(key, 0) + 1) / m
        if x >= 8 * expected and x * math.log(x / expected) - (x - expected) >= SIGNIFICANT:
            own.add(key)
    samples = [(b" " + w) * 3 + b" " for words in used[0] for w in words if any(hash(w[:k]) in own for k in range(4, min(len(w), 12) + 1))]
    lines = [b" ".join(words[i:i + 7]) + b" " for words in used[1] for i in range(0, len(words), 7)]
    if not samples or not lines:
        return None
    order = np.random.default_rng(1).permutation(len(lines))[:ORDINARY_SAMPLES]
    return _train(samples, TOXIC_BYTES, 16), _train([lines[i] for i in order], ORDINARY_BYTES, 40)


def fit(rows: list[tuple[str, int]], share: float) -> tuple[bytes, bytes, np.ndarray] | float:
    """(toxic dictionary, ordinary dictionary, calibration) from (text, toxic) rows; a constant score if a class is missing.

    Thresholds are calibrated on rows that the dictionaries did not see: each half of the rows is coded
    with dictionaries of the other half. A logistic regression weighs how many windows save 2, 3, 4 or 5
    bytes, the most saved and the length; its constant is set for ``share``, the share of toxic rows
    among all labelled ones. The dictionaries returned are trained on all the rows.
    """
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    whole = dictionaries(toxic, ordinary) if len(toxic) >= 4 and len(ordinary) >= 4 else None
    if whole is None:
        return float(share)
    x, y = [], []
    for half in (0, 1):
        some = dictionaries(toxic[half::2], ordinary[half::2]) or whole
        rest = toxic[1 - half::2], ordinary[1 - half::2]
        x.append(Distance(*some).features(pa.array(rest[0] + rest[1], pa.string())))
        y += [1.0] * len(rest[0]) + [0.0] * len(rest[1])
    y = np.array(y)
    weights = logistic(np.concatenate(x), y)
    share = min(max(share, 1e-4), 1 - 1e-4)
    weights[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return *whole, weights


def _scored(docs: DataFrame, labels: DataFrame, carried: list[str], per_class: int = PER_CLASS) -> DataFrame:
    """The columns ``carried``, then __score and __predicted, one row per input row."""
    counts = class_counts(labels, "toxic", FOLDS, HELD_OUT)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = fit(labelled_sample(docs, labels, "toxic", per_class, FOLDS, HELD_OUT), share)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 118 KB
    text = "text" if "text" in carried else "__text"

    def run(batches):
        model = shared.value
        distance = Distance(*model[:2]) if isinstance(model, tuple) else None
        for batch in batches:
            if distance is None:
                p = np.full(batch.num_rows, model)
            else:
                p = 1 / (1 + np.exp(-np.clip(distance.features(batch.column(text)) @ model[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=[*carried, "__score", "__predicted"])

    rows = docs.select(*carried) if text in carried else docs.select(*carried, F.col("text").alias(text))
    out = StructType([*rows.select(*carried).schema.fields, StructField("__score", DoubleType()), StructField("__predicted", IntegerType())])
    return rows.mapInArrow(run, out)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; predicted is 1 from a score of 0.5.

    A window is a word between blanks (A-Z lowered), coded with the toxic dictionary, with the ordinary
    one and with none; its distance is the shorter ordinary coding less the toxic one. Every word of the
    whole text is a window; equal words are coded once per task. Dictionaries and thresholds are fitted
    on at most ``per_class`` rows of each class from outside the held-out fold (FOLDS, HELD_OUT). Null
    and empty texts have no windows and get the score of a text without any. A null id counts as held
    out. Without rows of both classes the score is the share of toxic labels. Repeated rows are scored
    alike; other columns, labels among them, are not looked at.
    """
    held = F.coalesce(F.pmod(crc(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))
    rows = _scored(docs, labels, ["doc_id"], per_class)
    return rows.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents not predicted toxic, with their own columns, each row by the verdict on its own text."""
    return _scored(docs, labels, docs.columns, **how).filter("__predicted = 0").select(*docs.columns)
