"""The table function of chunks gives the column expression's pieces, for any sizes, nulls and empty texts."""

from pyspark.sql import functions as F

from sourcewell.operators import evidence


def test_function_equals_expression(spark):
    evidence.register_chunks(spark)
    df = spark.createDataFrame([(i, "ab界" * i if i else None) for i in range(40)] + [(40, "")], "source_id long, transcript string")
    for size, most, count in ((7, 60, 4), (1, 5, 9), (100, 100, 1), (5, 1000, 3)):
        want = evidence.transcript_chunks(df, size, most, count)
        got = spark.sql(f"select s.source_id, c.* from {{df}} s, lateral transcript_chunks(s.transcript, {size}, {most}, {count}) c", df=df)
        assert sorted(got.collect()) == sorted(want.select("source_id", F.col("chunk"), "text").collect())
    assert spark.sql("select * from transcript_chunks('abc')").collect() == [(0, "abc")]
