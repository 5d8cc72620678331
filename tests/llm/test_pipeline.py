import hashlib

import corpus_pipeline
from folio.llm.bpe import ByteBpe

from .cases import documents


def test_stages_in_order(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = [now.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if i == 3:  # an item from a document that is still there
            words = now.where("length(text) > 200").orderBy("doc_id").first().text.split()
            item = " ".join(words[5:25])
            spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        after = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.schema.names == now.schema.names
        after.write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
        counts.append(now.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] < counts[3] and counts[5] == counts[4]
    rows = {r.doc_id: r for r in now.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r for r in whole} == rows
    left = spark.read.parquet(str(tmp_path / "s3"))
    for r in left.collect():
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and item not in " ".join((r.text or "").split())
    assert ByteBpe().digests(left).count() == len(whole)


def test_empty_input(spark, tmp_path):
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
