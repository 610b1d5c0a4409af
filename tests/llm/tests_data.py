SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
