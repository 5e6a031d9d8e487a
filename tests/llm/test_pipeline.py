from pyspark.sql import functions as F

import corpus_pipeline as cp
from stratasift.llm.common import read_table, stored


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = read_table(spark, sf, "documents")
    counts = [docs.count()]
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, sf), "test")
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] > counts[3] == counts[5] > 0
    assert docs.where("NOT round_trip").count() == 0
    assert {tuple(r[:1]) for r in cp.run(spark, sf).select("doc_id").collect()} == {tuple(r[:1]) for r in docs.select("doc_id").collect()}


def test_odd_rows(spark, odd, empty, sf):
    for docs, least in ((odd, 1), (empty, 0)):
        for _, stage in cp.STAGES[1:]:
            docs = stored(stage(spark, docs, sf), "test")
        assert docs.count() >= least


CLASHING = ["_h", "_key", "_found", "_h0", "node", "label", "block", "doc", "h", "kinds", "a.b"]


def test_run_on_odd_rows(spark, odd, sf, tmp_path):
    """All stages over nulls, empty, long and repeated rows beside the test table's, with extra columns."""
    usual = read_table(spark, sf, "documents").select("doc_id", "text").limit(60)
    docs = usual.unionAll(odd.select("doc_id", "text"))
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(None if i % 3 == 0 else i).cast("int"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    kept = read_table(spark, str(tmp_path), "documents")
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, kept, str(tmp_path)), "test")
        assert out.columns == docs.columns and out.schema["a.b"].dataType.simpleString() == "int"
        lost = out.select("doc_id").subtract(kept.select("doc_id"))
        assert lost.count() == 0 and 0 < out.count() <= kept.count()
        kept = out
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in kept.collect())
    assert all(r["round_trip"] for r in got)


def test_names():
    assert [n for n, _ in cp.STAGES] == [
        "quality classifier",
        "MinHash near-dedup",
        "benchmark decontamination",
        "secret scans",
        "SentencePiece encoding and decoding",
    ]
