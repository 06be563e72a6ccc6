import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "minhash_dedup", "pii", "mixing", "pieces"]
    counts = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3]
    assert docs.where(F.col("text").rlike(r"[0-9]@mail[0-9]+\.example")).count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[4] and last.where("n_tokens = 0 and size(ids) > 0").count() == 0
    assert pipeline.run(spark, sf_dir).count() == counts[4]


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.fixture(scope="module")
def odd(odd_docs):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those that stages work with."""
    return odd_docs.selectExpr("*", "'k' as __text", "'k' as __words", "'k' as body", "'k' as words", "'k' as c1", "'k' as __keep0", "'k' as size", "'k' as key")


def _rows(df):
    return sorted((str(r["doc_id"]), str(r["text"])[:50]) for r in df.collect())


def test_odd_rows_in_each_stage(spark, sf_dir, odd):
    whole = _rows(odd)
    stages = dict(pipeline.STAGES)
    kept = stages["toxicity"](spark, odd, sf_dir)
    assert kept.columns == odd.columns and _rows(kept) == whole
    one = stages["minhash_dedup"](spark, odd, sf_dir)
    assert one.columns == odd.columns and _rows(one) == sorted(set(whole))
    clean = stages["pii"](spark, odd, sf_dir)
    assert clean.columns == odd.columns and clean.count() == len(whole)
    long = clean.where("doc_id = 3").first()
    assert long["text"].endswith("word [EMAIL]") and long["n_chars"] == len(long["text"]) and clean.where("doc_id = 1").first()["text"] is None
    mixed = stages["mixing"](spark, odd, sf_dir)
    assert mixed.columns == odd.columns and set(_rows(mixed)) <= set(whole) and _rows(mixed) == _rows(stages["mixing"](spark, odd, sf_dir))
    assert max(_rows(mixed).count(r) / whole.count(r) for r in set(_rows(mixed))) <= 3
    last = stages["pieces"](spark, odd, sf_dir)
    assert last.count() == len(whole) and {r["n_tokens"] for r in last.where("doc_id in (1, 2)").collect()} == {0}
    assert all((r["n_tokens"] > 0) == (r["doc_id"] not in (1, 2, 5)) or r["doc_id"] == 5 for r in last.collect())
    tied = [r["ids"] for r in last.where("doc_id = 4").collect()]
    assert len(tied) == 2 and tied[0] == tied[1]
