"""What a worker is given at once, and what a scan holds."""

import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import common, suffixes


def test_batches_and_scans_are_bounded(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10_000).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "long"))

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    got = common.map_rows(spark.read.parquet(str(tmp_path / "long")), work, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 60 and max(r["bytes"] for r in got) <= 1_100_000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1_024


def test_repeats_are_cut_once(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, passage + " first"), (2, "some more " + passage), (3, passage), (4, None), (5, "short")]
    got = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(1, passage + " first"), (2, "some more "), (4, None), (5, "short")]
