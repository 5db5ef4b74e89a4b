from pyspark.testing import assertDataFrameEqual

from vintner.operators.fit import LinearModel
from vintner.operators.score import score
from vintner.operators.split import hash_split
from vintner.streaming.stateless import stream_through


def test_stateless_operators_on_a_stream(spark, tmp_dir):
    src = tmp_dir + "/src"
    spark.range(500).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS x").write.parquet(src)
    model = LinearModel(["x"], [2.0], 1.0)

    def pipeline(df):
        return score(hash_split(df, "k"), model)

    streamed = stream_through(spark, src, pipeline, tmp_dir + "/sink")
    assertDataFrameEqual(streamed, pipeline(spark.read.parquet(src)), checkRowOrder=False)
    # a second run finds no new files: the checkpoint keeps the sink exactly-once
    again = stream_through(spark, src, pipeline, tmp_dir + "/sink")
    assert again.count() == 500
