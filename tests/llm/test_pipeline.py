"""The corpus pipeline on the smallest tables, stage by stage against plain versions."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tallyhouse.llm import bpe, mixing, quality, simhash, toxicity
from tallyhouse.llm._shared import materialise, table
from tallyhouse.llm.queries import queries, toxicity_fold, tokenizer_file

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = materialise(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, kept))
        docs = kept
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns


def test_filters_do_what_their_operators_say(spark, stages):
    (_, docs, good), (_, _, mild), (_, _, single), (_, _, mixed), (_, _, encoded) = stages
    assert ids(good) == Counter(r.doc_id for r in quality.score_quality(docs).where("kept").collect())
    labels = table(spark, SF, "labels").where(toxicity_fold() != 2).select("doc_id", "toxic")
    scored = toxicity.score_texts(good, toxicity.fit(good.select("doc_id", "text"), labels))
    assert ids(mild) == Counter(r.doc_id for r in scored.where(f"score < {toxicity.CUTOFF}").collect())
    least = {}
    for r in simhash.link_documents(mild).collect():
        least[r.component_id] = min(r.doc_id, least.get(r.component_id, r.doc_id))
    assert ids(single) == Counter(least.values())
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies})  # ids are unique here
    assert ids(mixed) == copies and ids(encoded) == copies
    with open(tokenizer_file(), encoding="utf-8") as f:
        e = bpe.Encoder(f.read())
    import struct

    for r in encoded.join(mixed.select("doc_id", "text").distinct(), "doc_id").collect():
        packed, decoded = e.encode(r.text)
        assert struct.pack(f"<{len(r.ids)}I", *r.ids) == packed and r.decoded == decoded.decode()


def test_run_and_empty_input(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages[-1][2])
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
    assert docs.count() == 0


def test_queries_with_sql_agree(spark):
    duckdb = pytest.importorskip("duckdb")
    from tallyhouse.llm.queries import oracle_sql

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got = queries()[name](spark, SF)
        cols = sorted(got.columns)
        want = sorted(str(tuple(r)) for r in c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
        assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == want, name
