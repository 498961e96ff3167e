"""The pipeline's stages, one after the other, against their own operators."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskflow.llm import queries
from tests.llm.test_dedup import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.01"


def test_names_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "simhash_dedup", "best_fit_packing"]
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages_keep_clean_rows_and_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("kept")).withColumn("FP", F.lit(1))
    extra = spark.createDataFrame(
        [(900_001, None, "en"), (900_002, "", "en"), (900_003, "12 34", None), (None, "the of and in to the of and", "en")],
        "doc_id long, text string, lang string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        rows = {tuple(r) for r in before.collect()}
        kept = [tuple(r) for r in after.collect()]
        assert set(kept) <= rows and len(set(kept)) == len(kept) < len(rows)
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
            ids = {k[0] for k in kept}
            gone = [labels[r[0]] for r in rows if r[0] in labels.index and r[0] not in ids]
            assert gone and sum(gone) == 0  # no good document goes
            assert sum(labels[i] == 0 for i in ids if i in labels.index) < 0.6 * (labels == 0).sum()
        elif name == "language_id":
            assert {r[0] for r in rows} - {k[0] for k in kept} <= {900_001, 900_002, 900_003}
        else:
            at = [(r[0], r[1]) for r in rows]
            comp = plain_groups([i for i, _ in at], [plain_fingerprint(t) for _, t in at])
            assert sorted(k[0] for k in kept if k[0] is not None) == sorted({c for c in comp if c is not None})
        before = spark.createDataFrame(kept, docs.schema)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert 0 < got.doc_id.nunique() < 1000
    assert not got.duplicated(["doc_id", "piece"]).any()


@pytest.mark.parametrize("stage", range(4))
def test_empty_input(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).collect() == []
