"""One registered query per operator, over the whole of its tables, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlake.llm import alignment, contamination, conversations, jaccard, language, mixing, packing, quality, sharding, substring, tokens, toxicity, voronoi
from leadlake.llm.common import table
from leadlake.llm.encoders import TOKENIZERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_quality")
def _(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_token_counts")
def _(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op3_language")
def _(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup", r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (k) WHERE low < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT w.doc_id, count(*) AS n_words, count(gone.j) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY w.j) FILTER (gone.j IS NULL), '') AS kept
      FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.j = gone.j GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""")
def _(spark, sf_dir):
    return substring.digest(substring.remove_repeats(table(spark, sf_dir, "documents")))


@query("op5_sharding")
def _(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def _(spark, sf_dir):
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_parity_join")
def _(spark, sf_dir):
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def _(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_voronoi_knn", """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def _(spark, sf_dir):
    return voronoi.top_products(table(spark, sf_dir, "embeddings"))


@query("op10_mixing", r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY sk),
t AS (SELECT *, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w, 2.0::DOUBLE * source_size / w AS lim FROM s),
l AS (SELECT *, row_number() OVER o AS r, lim >= (1.5::DOUBLE * all_size - 2.0::DOUBLE * coalesce(sum(source_size) OVER o2, 0)) / (all_w - coalesce(sum(w) OVER o2, 0)) AS below,
             (1.5::DOUBLE * all_size - 2.0::DOUBLE * coalesce(sum(source_size) OVER o2, 0)) / (all_w - coalesce(sum(w) OVER o2, 0)) AS level
      FROM t WINDOW o AS (ORDER BY lim, sk), o2 AS (ORDER BY lim, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT coalesce(min_by(level, r) FILTER (below), 0) AS level FROM l),
g AS (SELECT sk, source_size, least(2.0::DOUBLE * source_size, w * level) AS target FROM t, v),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM g),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, budget,
             coalesce(sum(size) OVER (PARTITION BY sk ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b USING (sk))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM p
""")
def _(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op11_tokenizer_alignment")
def _(spark, sf_dir):
    return alignment.agreement(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{alignment.A_FILE}", f"{TOKENIZERS}/{alignment.B_FILE}")


@query("op12_packing")
def _(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{packing.VOCABULARY}")


@query("op13_conversation_repair")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.digest(conversations.repair(conversations.damage(rows)), rows)
