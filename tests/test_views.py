"""Sources by their heads or their texts alone are the rows of src()."""

from pyspark.sql import functions as F

from sourcewell.plans import views as v


def test_heads_and_texts_are_the_rows_of_src(spark, tmp_path):
    for name in ("documents", "conversations", "labels"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "labels":
            df = df.unionByName(df.where("doc_id % 3 = 0"))  # some ids have two labels
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    whole = v.src(spark, str(tmp_path))
    head = v.src(spark, str(tmp_path), 20)
    assert sorted(map(repr, whole.withColumn("transcript", F.substring("transcript", 1, 20)).collect())) == sorted(map(repr, head.collect()))
    texts = v.texts(spark, str(tmp_path))
    assert sorted(map(repr, whole.select(*texts.columns).collect())) == sorted(map(repr, texts.collect()))
    assert texts.count() > spark.read.parquet(f"{tmp_path}/documents.parquet").count()
