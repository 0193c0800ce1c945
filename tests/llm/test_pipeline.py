import corpus_pipeline
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = corpus_pipeline.language_id(spark, docs, SF)
    assert first.columns == docs.columns
    letters = docs.where("text rlike '\\\\p{L}'").count()
    assert first.count() >= 0.98 * letters
    second = corpus_pipeline.drop_toxic(spark, docs, SF)
    gone = {r["doc_id"] for r in docs.select("doc_id").exceptAll(second.select("doc_id")).collect()}
    assert second.columns == docs.columns and sum(labels.get(i, 1) == 0 for i in gone) <= 1
    fourth = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r["text"] for r in fourth.collect()]
    assert fourth.columns == docs.columns and not any(i in t for t in kept for i in items)


def test_run_is_the_stages_in_order(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[2] == "n-gram Jaccard join"
    got = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
