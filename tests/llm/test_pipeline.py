"""The registered queries against their SQL, and the pipeline's stages against plain versions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gatelane.llm import bpe, mixture, toxicity
from gatelane.llm.common import prepare, table, written
from gatelane.llm.queries import QUERIES, SQL
from tests.compare import compare
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    state, count, detail = compare(spark, SF, QUERIES[name], SQL.get(name))
    assert state == ("ok" if name in SQL else "rows"), (state, count, detail)
    if name.startswith("op12_"):  # 120 orders of five steps for every source
        assert count == 600 * table(spark, SF, "documents").select("source").distinct().count()
        return
    assert count == table(spark, SF, {"1": "pages", "2": "pages", "6": "embeddings"}.get(name[2:].split("_")[0], "documents")).count()


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    extra = docs.limit(3).unionByName(docs.limit(1)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    current = written(docs.unionByName(extra), "test-docs")
    for name, stage in corpus_pipeline.STAGES:
        before, after = plain(current), written(stage(spark, current, SF), f"test-{name}")
        if name != "bpe":
            assert after.schema.simpleString() == docs.schema.simpleString()
        if name == "toxicity":
            model = toxicity.fit(current, table(spark, SF, "labels"))
            bad = Counter(t for (_, t), s in zip(before, model.scores([toxicity.word_hashes((t or "").encode()) for _, t in before], [toxicity.guess_language(t or "") for _, t in before])) if s >= 0.5)
            assert Counter(t for _, t in plain(after)) == Counter(t for _, t in before) - bad
        elif name == "simhash":
            rows = brute.simhash_rows(before)
            assert {i for i, _ in plain(after) if i is not None} == {c for _, _, c in rows if c is not None}
            assert len(plain(after)) == len({c for _, _, c in rows})
        elif name == "suffix_repeats":
            bodies = [(t or "").encode() for _, t in before]
            gone = brute.without_repeats(bodies, corpus_pipeline.REPEAT_BYTES)
            want = [(i, brute.rest(b, g).decode("utf-8", "ignore") if g.any() else t) for (i, t), b, g in zip(before, bodies, gone)]
            assert Counter(plain(after)) == Counter(want) and any(g.any() and not g.all() for g in gone)
            assert after.filter("n_chars != length(text)").count() == 0
        elif name == "mixture":
            taken = {(r.doc_id): r.taken // r["size"] for r in mixture.mix_by_source(current.withColumn("doc_id", F.xxhash64("doc_id", "source", "text"))).collect() if r["size"]}
            units = current.select(F.xxhash64("doc_id", "source", "text").alias("u"), "doc_id", "text").collect()
            want = Counter()
            for r in units:
                want[(r.doc_id, r.text)] += taken.get(r.u, 0)
            assert Counter(plain(after)) == +want
        else:
            got = Counter((r.doc_id, r.n_tokens, bpe.codec(bpe.default_path()).decode(__import__("numpy").array(bpe.unpack(r.ids), int))) for r in after.collect())
            assert Counter({(i, t or ""): n for (i, _, t), n in got.items()}) == Counter((i, t or "") for i, t in before)
        current = after


def test_stages_on_empty_tables(spark):
    current = prepare(spark).createDataFrame([], table(spark, SF, "documents").schema)
    for name, stage in corpus_pipeline.STAGES:
        current = written(stage(spark, current, SF), f"empty-{name}")
        assert current.count() == 0
