"""What the stages of the pipeline hand to Python at once."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm.common import PART_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_batches_of_a_stage_are_bounded_in_bytes(spark, tmp_path, monkeypatch, name, stage):
    sizes = str(tmp_path / "sizes")

    def seen(docs, run, schema, plain=type(spark.range(0)).mapInArrow):
        def noted(batches):
            def passed():
                for batch in batches:
                    with open(sizes, "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            return run(passed())

        return plain(docs, noted, schema)

    # 12 MB in one partition: far fewer rows than an Arrow batch may have.
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.substring(F.sha2(F.concat_ws("-", "id", i.cast("string")), 256), 1, 7)))
    rows = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    rows.write.parquet(str(tmp_path / "docs"))
    spark.range(1).select(F.lit("b").alias("item_id"), F.lit("one two three four five six seven eight nine ten eleven").alias("text")).write.parquet(str(tmp_path / "benchmark.parquet"))
    before = spark.conf.get(SETTING)
    try:
        monkeypatch.setattr(type(rows), "mapInArrow", seen)
        found = stage(spark, spark.read.parquet(str(tmp_path / "docs")).coalesce(1), str(tmp_path))
        found.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set(SETTING, before)
    if name != "benchmark_decontamination":
        met = list(map(int, open(sizes).read().split()))
        assert sum(met) > 2 * PART_BYTES
        assert max(met) <= PART_BYTES
