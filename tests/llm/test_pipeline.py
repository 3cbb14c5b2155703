"""The pipeline on the smallest table, stage by stage, against what each stage promises."""

import pytest

import corpus_pipeline
from millrace.llm import catalog, decontamination, ngram_join, pii, quality_classifier
from tests.llm.helpers import documents, empty

SF = "/root/testdata/sf0.001"


def test_stages_narrow_down_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality_classifier":
            scores = quality_classifier.score(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert docs.count() == scores.where("predicted = 1").count()
        if name == "ngram_join":
            groups = ngram_join.join(before, 5, 80)
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in groups.collect()}
        if name == "decontamination":
            bad = decontamination.search(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == {r.doc_id for r in bad.collect()}
        if name == "pii":
            assert pii.find(docs).selectExpr("sum(n_email + n_ip + n_card + n_phone) as n").first().n == 0 and docs.count() == before.count()
    assert sizes == sorted(sizes[:-1], reverse=True) + sizes[-1:] and docs.select("doc_id").distinct().count() == sizes[-2]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def _folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_hostile_documents_go_through_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, copies, repeated rows, null ids, clashing extra columns: no stage fails, columns stay, rows only get fewer."""
    docs = documents(spark, extra=True)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id", "piece", "start").count() >= before
    kept = corpus_pipeline.STAGES[0][1](spark, documents(spark, extra=True), SF)
    assert kept.columns == columns and kept.count() <= 18


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, empty(spark))).count() == 0
