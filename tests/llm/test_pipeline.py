"""Each stage against brute force on what the stage before it kept."""

import re

import corpus_pipeline
from edge_rows import SF
from test_near_copies import firsts

from leadlake.llm import mixing, toxicity
from leadlake.llm.common import table


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if number < 4:
            assert after.columns == columns
        got = after.collect()
        if number == 0:
            bad = {r.doc_id for r in toxicity.score(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
            assert {r.doc_id for r in got} == {r.doc_id for r in rows} - bad
        elif number == 1:
            assert {r.doc_id for r in got} == firsts([(r.doc_id, r.text) for r in rows])
        elif number == 2:
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert {r.doc_id for r in got} == {r.doc_id for r in rows if not any(i in r.text for i in items)}
        elif number == 3:
            want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
            words = {}
            for r in got:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert words == want
        else:
            assert len(got) == len(rows)
            load = {}
            for r in got:
                load.setdefault(r.shard, []).append(r)
            assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in load.values())
        docs, rows = after, got


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
