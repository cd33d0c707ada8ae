import edge
from test_models import classes_of, corpus

import corpus_pipeline
from asofline.llm import minhash


def test_each_stage_keeps_clean_documents(spark, tmp_path):
    docs, labels = corpus(spark)
    docs = docs.drop("score")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    y = {r.doc_id: r for r in labels.collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert sum(y[k].toxic for k in kept) <= 3 and sum(1 - y[k].toxic for k in y if k not in kept) <= 5
    two = stages["quality"](spark, one, str(tmp_path)).cache()
    better = {r.doc_id for r in two.collect()}
    assert better <= kept and sum(1 - y[k].quality for k in better) <= 2 and sum(y[k].quality for k in kept - better) <= 2
    copies = two.unionByName(two.limit(20).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    three = stages["near_duplicates"](spark, copies, str(tmp_path)).cache()
    label = classes_of([(r.doc_id, r.text) for r in copies.collect()], 5, 80)
    assert {r.doc_id for r in three.collect()} == {k for k, c in label.items() if k == c}
    four = stages["packing"](spark, three, str(tmp_path)).collect()
    assert {r.doc_id for r in four} == {r.doc_id for r in three.collect()}


def test_edge_rows_go_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = edge.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        assert stage(spark, docs, str(tmp_path)).count() > 0, name
    assert minhash.deduplicate(docs).where("kept").count() < docs.count()
