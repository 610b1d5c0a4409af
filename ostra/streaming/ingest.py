"""Incremental ingest: a file stream of documents appended to a forward index.

Scores depend on statistics of the whole collection, so a batch appends what is its own (documents
and analysed terms) and ``refresh`` recomputes vocabulary and scores from the forward index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ostra.functions.analysis import tokenized_documents
from ostra.operators.index import save, write_postings
from ostra.session import bound_batches


def ingest(spark: SparkSession, source: str, schema, path: str, checkpoint: str, to_corpus, stem: bool = False, only: str = "*"):
    """Start a query over the Parquet files of the folder ``source`` with names like ``only`` that ends when all present files are read.

    If ``only`` is the name of a folder in ``source``, a table of many files, these are read.
    Files are read once, by the stream's checkpoint; a batch that is repeated after a failure
    overwrites its own folder, so nothing is doubled. ``to_corpus`` maps rows to (doc_id, url, title, body).
    """
    bound_batches(spark)
    inside = spark._jvm.org.apache.hadoop.fs.Path(source, only)
    if inside.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(inside):
        source, only = inside.toString(), "*"

    def append(batch: DataFrame, number: int) -> None:
        docs = to_corpus(batch).where("doc_id is not null")
        save(docs, f"{path}/docs/batch={number}")
        save(tokenized_documents(docs, stem), f"{path}/forward/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", only).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, path: str) -> None:
    """Vocabulary and scored postings of everything that was ingested so far."""
    write_postings(spark, path)
