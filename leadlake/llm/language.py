"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import SAMPLE_TEXT, crc, mix, stream

#: Rows of each language that training takes.
PER_LANGUAGE = 400
FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
#: Up to so many languages get an exhaustive code.
EXHAUSTIVE = 6
#: A prediction is ambiguous if the second codeword's share of the score is within this of the first's.
MARGIN = 0.2
SLICE_CHARS = 1 << 20

_KIND: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point of the basic plane, itself in lower case if it is a letter, else a blank."""
    if not _KIND:
        low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else (n if c.isalpha() else 32) for n, c in enumerate(map(chr, range(0x10000)))]
        _KIND.append(np.array(low, dtype=np.uint32))
    return _KIND[0]


def codes(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n classes, one column per binary classifier.

    Few classes get all splits in two; more get 15 log2(n) random splits, the best of 50 draws by the
    distance of the two nearest codewords.
    """
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << max(n - 1, 0))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.float64) if n > 1 else np.ones((n, 1))
    bits = math.ceil(15 * math.log2(n))
    best, far = None, -1
    for draw in range(50):
        code = np.where(np.random.default_rng(draw).random((n, bits)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits).min()
        if near > far:
            best, far = code, near
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, row): n-grams of letters and of the single blank between runs of them."""
    letters = _letters()
    data = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    wide = data >= 0x10000
    chars = letters[np.where(wide, 32, data)]
    if wide.any():  # letters outside the basic plane keep their case
        alpha = np.fromiter((chr(c).isalpha() for c in data[wide]), bool, int(wide.sum()))
        chars[wide] = np.where(alpha, data[wide], 32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([0], ends))))
    row = np.concatenate((row, [len(texts) - 1]))
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
    chars, row = chars[keep].astype(np.uint64), row[keep]
    out, rows = [], []
    odd = stream(max(GRAMS), 900)
    for n in GRAMS:
        if len(chars) >= n:
            h = np.zeros(len(chars) - n + 1, np.uint64)
            for k in range(n):
                h += (chars[k:len(chars) - n + 1 + k] + np.uint64(1)) * odd[k]
            ok = row[:len(h)] == row[n - 1:]
            if n == 1:
                ok &= chars != 32
            out.append((mix(h + np.uint64(n)) >> np.uint64(48))[ok].astype(np.int64))
            rows.append(row[:len(h)][ok])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


class Coder:
    """Languages, their codewords, and the weights of each binary classifier."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, scale: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.scale, self.trust = languages, code, weights, scale, trust

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds per n-gram of each text under each classifier; 0 where a text has none."""
        bucket, row = grams(texts)
        out = np.zeros((len(texts), len(self.weights)))
        count = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        for j in range(out.shape[1]):
            out[:, j] = np.bincount(row, weights=self.weights[j][bucket], minlength=len(texts)) / count
        return out / self.scale

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, score, second score) of the codeword with the least weighted logistic loss."""
        loss = np.zeros((len(margins), len(self.languages)))
        for j in range(margins.shape[1]):
            z = margins[:, j:j + 1] * self.code[None, :, j]
            loss += self.trust[j] * np.logaddexp(0, -3 * z)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 2)
        share /= share.sum(axis=1, keepdims=True)
        ranked = np.sort(share, axis=1)
        second = ranked[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return loss.argmin(axis=1), ranked[:, -1], second


def fit(rows: list[tuple[str, str]]) -> Coder | None:
    """Naive Bayes log odds per n-gram for each split of the languages; a classifier's trust is its accuracy on held-back rows.

    All languages weigh alike. Each classifier's margins are scaled to a mean size of 1.
    """
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    counts = np.zeros((len(languages), BUCKETS))
    test: list[tuple[str, int]] = []
    for i, language in enumerate(languages):
        texts = [t for t, y in rows if y == language]
        held = texts[::4] if len(texts) >= 8 else []
        test += [(t, i) for t in held]
        for some in chunks([t for t in texts if not held or t not in set(held)] or texts):
            counts[i] += np.bincount(grams(some)[0], minlength=BUCKETS)
    code = codes(len(languages))
    rate = (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * BUCKETS)
    weights = np.empty((code.shape[1], BUCKETS), dtype=np.float32)
    for j in range(code.shape[1]):
        yes, no = code[:, j] > 0, code[:, j] < 0
        weights[j] = np.log(rate[yes].mean(axis=0)) - np.log(rate[no].mean(axis=0)) if no.any() and yes.any() else 0.0
    coder = Coder(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    if test:
        margins = np.concatenate([coder.margins(some) for some in chunks([t for t, _ in test])])
        coder.scale = np.maximum(np.abs(margins).mean(axis=0), 1e-9)
        right = (np.sign(margins) == code[[i for _, i in test]]).mean(axis=0)
        coder.trust = np.maximum(right - 0.5, 0.01) * 2
    coder.trust = coder.trust / coder.trust.sum() * min(len(coder.trust), 4)
    return coder


def chunks(texts: list[str]):
    """Lists of consecutive texts of about SLICE_CHARS characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t) + 1
        if size >= SLICE_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def training_rows(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """At most about ``per_language`` (text, lang) rows of each language, chosen by hash, from outside the held-out fold.

    Each language keeps the rows whose hash falls under its own share, so nothing is sorted or ranked.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc(F.col("doc_id")), F.lit(FOLDS)) != HELD_OUT))
    known = known.filter(F.octet_length("text").between(1, SAMPLE_TEXT) & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(500).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    rows = known.filter(draw < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0))).select("doc_id", "text", "lang")
    return [(r.text, r.lang) for r in sorted(rows.limit(2 * per_language * len(counts)).collect(), key=lambda r: (r.doc_id, r.text))]


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per input row.

    Languages have codewords; for each bit a naive Bayes classifier over letter 1- to 3-grams of the whole
    text (hashed into 65,536 buckets, lower-cased, other characters as blanks) gives a margin; the
    codeword with the least logistic loss, bits weighted by their held-back accuracy, wins. The score is
    the winner's share of exp(-loss); ``ambiguous`` tells that the second comes within MARGIN of it.
    Learned from at most some ``per_language`` rows of each of the 500 commonest languages, outside the
    held-out fold (FOLDS, HELD_OUT). Texts that are null or without a letter get ``und``, score 0; so does
    every text if nothing can be learned. A null id counts as held out. Repeated rows are judged alike.
    """
    model = fit(training_rows(docs, per_language))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.25 MB for each bit of the code

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            letters = batch.column("letters").to_pylist()
            names, scores, unclear = [], [], []
            for some in chunks(texts):
                if model is None:
                    names += ["und"] * len(some)
                    scores += [0.0] * len(some)
                    unclear += [False] * len(some)
                    continue
                index, first, second = model.decode(model.margins(some))
                names += [model.languages[i] for i in index]
                scores += first.tolist()
                unclear += (first - second < MARGIN).tolist()
            for i, known in enumerate(letters):
                if not known:
                    names[i], scores[i], unclear[i] = "und", 0.0, False
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(unclear, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    held = F.coalesce(F.pmod(crc(F.col("doc_id")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held.alias("held_out"), "text", letters.alias("letters")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
