import corpus_pipeline
from ledgerloom.llm import neardup, queries

SF001 = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mix_sources"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == columns and 0 < out.count() <= docs.count()
        if name == "near_dedup":
            assert neardup.link(out, 5, 80).where("not kept").count() == 0
        docs = out
    assert corpus_pipeline.run(spark, SF001).count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
