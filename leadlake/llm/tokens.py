"""Token counts by a unigram model whose forward scores are shared along a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Runs of letters, of digits, or of other signs, each with one blank before it; and runs of white space.
PRETOKEN = r" ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: A piece's score in millionths of a nat is that of a Zipf law over its rank.
SHIFT = 10
MOST_PIECES = 1 << 20
#: Trie nodes and pre-tokens a task holds before it starts afresh; the counts do not depend on it.
NODES = 1 << 20
KNOWN = 1 << 19
#: Longer pre-tokens are walked without leaving nodes in the trie.
DEEP = 256


def vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Scores of the pieces in a file of lines "base64 rank". All 256 single bytes are pieces; those the file lacks rank last."""
    lines = spark.read.text(path).limit(MOST_PIECES + 1).collect()
    if len(lines) > MOST_PIECES:
        raise ValueError(f"{path} has more than {MOST_PIECES} lines")
    ranks = {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in lines if r.value.strip())}
    last = max(ranks.values(), default=0) + 1
    ranks = {bytes([b]): last for b in range(256)} | ranks
    return {p: -round(1_000_000 * math.log(r + SHIFT)) for p, r in ranks.items()}


class Trie:
    """Best segmentations of all prefixes of the pre-tokens inserted so far.

    A node is a prefix; it holds the forward score of its best segmentation and how many pieces that
    has (the fewest among equal scores). A new node looks at the pieces that end there, and takes the
    scores of its ancestors, which all pre-tokens with the same beginning share. Terminal counts are
    kept by pre-token.
    """

    def __init__(self, scores: dict[bytes, int]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.pieces = [0], [0]

    def insert(self, token: bytes) -> int:
        """How many pieces the best segmentation of the token has."""
        if len(token) > DEEP:
            return self._walk(token)
        if len(self.best) > NODES:
            self.clear()
        path, node = [0], 0
        for d in range(1, len(token) + 1):
            edge = node << 8 | token[d - 1]
            child = self.children.get(edge)
            if child is None:
                score, count = self._end(token, d, [self.best[p] for p in path[-self.longest:]], [self.pieces[p] for p in path[-self.longest:]])
                child = self.children[edge] = len(self.best)
                self.best.append(score)
                self.pieces.append(count)
            node = child
            path.append(node)
        return self.pieces[node]

    def _end(self, token: bytes, d: int, best: list[int], pieces: list[int]) -> tuple[int, int]:
        """(score, -count) maximised over the pieces that end at d; the lists hold the last prefixes' values, nearest last."""
        top, few = None, 0
        for back in range(1, min(d, self.longest) + 1):
            score = self.scores.get(token[d - back:d])
            if score is not None:
                score += best[-back]
                count = pieces[-back] + 1
                if top is None or score > top or score == top and count < few:
                    top, few = score, count
        return top, few

    def _walk(self, token: bytes) -> int:
        best, pieces = [0], [0]
        for d in range(1, len(token) + 1):
            score, count = self._end(token, d, best, pieces)
            best.append(score)
            pieces.append(count)
            if len(best) > 2 * self.longest:
                del best[:-self.longest], pieces[:-self.longest]
        return pieces[-1]


class Counts(dict):
    """Terminal counts of distinct pre-tokens, filled through the trie."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, token: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        n = self.trie.insert(token.encode("utf-8", "surrogatepass"))
        if len(token) <= DEEP:
            self[token] = n
        return n


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens), one row per input row.

    The whole text is cut into pre-tokens; each distinct one is segmented once per task into the pieces
    of the vocabulary file at ``path`` with the highest summed score. Null texts count 0 everywhere, as do
    empty ones. Repeated rows are counted alike; other columns are not looked at. The vocabulary has at
    most MOST_PIECES lines.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(spark, path))

    def run(batches):
        find, counts = re.compile(PRETOKEN).findall, Counts(Trie(shared.value))
        for batch in batches:
            sizes, words, tokens = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = find(text)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, words, tokens))],
                                             names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_pretokens long, n_tokens long")
