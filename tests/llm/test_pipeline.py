"""The pipeline's stages: their columns, their decisions, and the pieces that come out."""

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import mixing
from cohortlens.llm.queries import ORACLES, QUERIES, tokenizer_path
from cohortlens.llm.tokens import Encoder

from test_operators import SF, brute_components, docs


def test_stages(spark, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    seen = []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{at}"
        stage(spark, frame, SF).write.parquet(out)
        frame = spark.read.parquet(out)
        seen.append(frame)
    assert all(f.columns == columns for f in seen[:3])
    texts = {r["doc_id"]: r["text"] for r in seen[0].collect()}
    want, _ = brute_components(list(texts.items()), 5, 80)
    assert {r["doc_id"] for r in seen[1].collect()} == {i for i, c in want.items() if i == c}
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    before, after = (sum(words(r["text"]) for r in f.collect()) for f in seen[1:3])
    assert abs(after - 1.5 * before) < 0.1 * before
    enc = Encoder(tokenizer_path())
    tokens = sum(len(enc.encode(r["text"])) + 1 for r in seen[2].collect())
    assert sum(r["length"] for r in seen[3].collect()) == tokens


def test_stages_on_odd_rows(spark, tmp_path):
    odd = docs(spark, [None, "", "the and of " * 20, "the and of " * 30_000] * 3, ids=[1, 2, 3, 4, 1, 2, 3, None, 5, 6, 3, 4])
    clashing = [F.lit(i).alias(c) for i, c in enumerate(("gone_id", "mix_pass", "mix_shard", "mix_id", "block", "id", "row", "a.b", "lang_pred", "rejected"))]
    for n, frame in enumerate((odd, odd.select("*", *clashing[:4], *clashing[5:]), docs(spark, ["a"]).limit(0))):
        frame = frame.select("doc_id", "text", "lang", "source", "n_chars", *[F.col(f"`{c}`") for c in frame.columns if c in ("gone_id", "a.b", "mix_pass", "mix_shard", "mix_id", "id", "row", "lang_pred", "rejected")])
        columns = frame.columns
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, frame, SF).write.parquet(f"{tmp_path}/{n}-{at}")
            frame = spark.read.parquet(f"{tmp_path}/{n}-{at}")
            assert at == 3 or frame.columns == columns


def test_names():
    numbers = Counter(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == Counter(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    for name, sql in ORACLES.items():
        ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        # A column with nulls comes as floats from one side alone.
        cell = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
        text = lambda f: sorted(str([cell(v) for v in row]) for row in f[columns].astype(object).values.tolist())
        assert text(ours) == text(theirs), name


def test_earlier_results_survive_a_run(spark):
    """A lazy result that reads scratch tables of its own can be counted after the pipeline has run and cleaned up."""
    from cohortlens.llm.near_dup import near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = near_duplicates(docs)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert before.count() == docs.count()
