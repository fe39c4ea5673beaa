"""The pipeline on the smallest tables: what each stage keeps, against brute force on its own input."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import queries, toxicity
from pulsegrid.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_text_operators import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return [{r["doc_id"]: r for r in df.collect()} for df in out], [df.columns for df in out]


def test_stages(spark, stages):
    tables, columns = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    assert all(c == list(DOCUMENT_COLUMNS) for c in columns[1:-1])
    every, known, once, apart, clean, mixed = tables
    assert {i for i, r in every.items() if r["text"] and any(map(str.isalpha, r["text"]))} >= set(known) and len(known) >= 0.99 * len(every)
    norm = {}
    for i, r in known.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        norm.setdefault(key, []).append((-len(r["text"]), i))
    assert set(once) == {min(m)[1] for m in norm.values()}
    components = brute_components([(i, r["text"]) for i, r in once.items()])
    assert set(apart) == {i for i, (_, c) in components.items() if c == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for i, r in apart.items():
        n, hit, _, _ = brute_hits(r["text"], items)
        if hit > 0.5 * n:
            assert i not in clean
        elif hit == 0:
            assert clean[i]["text"] == r["text"]
        else:
            assert brute_hits(clean[i]["text"], items)[1] < hit
    assert set(mixed) <= set(clean) and all(1 <= r["copies"] <= 3 for r in mixed.values())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    order = sorted(got.columns)
    rows = lambda records, names: sorted(tuple(map(str, (r[names.index(c)] for c in order))) for r in records)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pred = queries.QUERIES["op1_language_id"](spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in pred) >= 0.95 * len(pred)


def test_toxicity_on_held_out_rows(spark):
    """Trained on four fifths of the labels, it finds toxic documents of the rest and leaves clean ones alone."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    test = labels.where(rest)
    model = toxicity.fit(docs, labels.where(~rest))
    assert model is not None
    marks = {r["doc_id"]: r["toxic"] for r in toxicity.apply(docs.join(test.select("doc_id"), "doc_id", "left_semi"), model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in test.collect()}
    toxic, clean = [i for i in marks if truth[i]], [i for i in marks if not truth[i]]
    assert len(toxic) > 50 and sum(marks[i] for i in toxic) >= 0.85 * len(toxic)
    assert sum(marks[i] for i in clean) <= 0.02 * len(clean)


@pytest.mark.parametrize("kind", ["empty", "nulls", "repeats"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.limit(40)
    odd = {"empty": docs.where("false"), "nulls": docs.withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}).limit(30), "repeats": few.union(few).union(few.withColumn("source", F.lit(None).cast("string")))}[kind]
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == 0 if kind != "repeats" else 0 < len(out) == len({r["doc_id"] for r in out})


def test_pipeline_with_clashing_columns_a_very_long_text_and_no_benchmark(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    long = docs.limit(1).withColumn("doc_id", F.lit(10**9).cast("long")).withColumn("text", F.expr("array_join(transform(sequence(1, 400000), i -> concat('w', hash(i))), ' ')"))
    extra = {c: F.lit("x") for c in ("TEXT2", "size", "spans", "comp", "keep_id", "found", "hit", "whole", "rank", "taken")}
    docs.unionByName(long).withColumns(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert 0 < len(rows) <= 31 and len({r["doc_id"] for r in rows}) == len(rows)
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
