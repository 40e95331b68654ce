import corpus_pipeline
from stationgrid.llm import lines, queries, simhash


def test_stages_keep_the_columns_and_work_in_turn(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns and docs.count() > 0
        if k == 0:
            kept = {r.doc_id for r in docs.collect()}
            wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
            assert len(wrong) <= 0.03 * len(labels)
        elif k == 1:
            assert lines.repeated_lines(docs.select("doc_id", "text")).isEmpty()
        elif k == 2:
            groups = {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.collect()} == groups
        elif k == 3:
            assert max(r["count"] for r in docs.groupBy("doc_id").count().collect()) <= 3
        else:
            assert docs.select("sequence_id").distinct().count() <= -(-docs.groupBy().sum("length").first()[0] // 2048) + 1
    assert set(texts) >= {r.doc_id for r in docs.collect()}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
