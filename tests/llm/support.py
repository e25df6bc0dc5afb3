def labelled(spark, df, column, sf_dir="/root/testdata/sf0.01"):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", column)
    return df.join(labels, "doc_id")
