"""Tables by key on Parquet, and the files of learning to rank."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostra.operators.ranks import gapless_rank

#: Vectors in a raw file: 64 MB at 64 dimensions.
RAW_ROWS = 1 << 18


class KeyedStore:
    """(id, payload, data) by dense ids from 0, appended in parts; a part is committed as a whole or not at all."""

    SCHEMA = "id long, part int, payload long, data binary"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.held: list[list] = []
        self.stored = self.read().agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0] if self._exists() else 0
        self.on_disk = self.stored

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def append(self, payload: int, data: bytes) -> int:
        """Hold an entry until ``flush``; returns its id."""
        self.held.append([self.stored, payload, data])
        self.stored += 1
        return self.stored - 1

    def add_to_last(self, payload: int, data: bytes) -> int:
        """Grow the last held entry; with nothing held, append a new one."""
        if not self.held:
            return self.append(payload, data)
        self.held[-1][1] = payload
        self.held[-1][2] += data
        return self.held[-1][0]

    def flush(self) -> None:
        if self.held:
            rows = [(i, 0, p, bytearray(d)) for i, p, d in self.held]
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.held, self.on_disk = [], self.stored

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def get(self, i: int) -> tuple[int, bytes]:
        """(payload, data) of an id; out of range is an ``IndexError``."""
        if not 0 <= i < self.stored:
            raise IndexError(i)
        for j, payload, data in self.held:
            if j == i:
                return payload, bytes(data)
        row = self.read().where(F.col("id") == i).first()
        return row.payload, bytes(row.data)

    def size(self) -> int:
        return self.stored

    def iterate(self) -> DataFrame:
        """All flushed entries by id."""
        return self.read().select("id", "payload", "data").orderBy("id")


def concat_parts(parts: DataFrame) -> DataFrame:
    """(id, payload, data) from rows (id, part, payload, data): parts joined in order, the last part's payload."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "payload", "data")))
    return parts.groupBy("id").agg(ordered.alias("p")).select("id", F.element_at("p.payload", -1).alias("payload"), F.array_join("p.data", "").alias("data"))


def write_raw_vectors(vectors: DataFrame, path: str, most: int = RAW_ROWS) -> int:
    """Vectors by id as raw little-endian float32 rows, in a new folder that all executors share; returns how many.

    Each task writes its stretch of the sorted rows, in files of at most ``most`` rows, each named by the number of its first
    row. A file gets its name only when it is whole, so a task that runs twice does no harm.
    """
    root = path.removeprefix("file://")
    Path(root).mkdir(parents=True)
    numbered = gapless_rank(vectors.select("vec_id", "embedding").withColumn("_all", F.lit(0)), ["_all"], [F.col("vec_id")], "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, v) for b in batches for r, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        written, open_, first, last = 0, None, 0, 0
        for row, vector in rows:
            if open_ is None or row != last + 1 or row - first >= most:
                if open_ is not None:
                    open_.close()
                    os.replace(open_.name, f"{root}/{first:018d}.f32")
                first, open_ = row, open(f"{root}/.{row}-{uuid.uuid4().hex}", "wb")
            open_.write(np.asarray(vector, "<f4").tobytes())
            last, written = row, written + 1
        if open_ is not None:
            open_.close()
            os.replace(open_.name, f"{root}/{first:018d}.f32")
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    done = numbered.select("row", "embedding").repartitionByRange("row").sortWithinPartitions("row").mapInArrow(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_raw_vectors(spark: SparkSession, path: str, dim: int = 64) -> DataFrame:
    """(vec_id, embedding) of such a folder, or of one such file; rows are numbered by their place."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(path)
    number = F.coalesce(F.regexp_extract("path", r"/(\d{18})\.f32$", 1).try_cast("long"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.frombuffer(raw, "<f4")
                n = len(flat) // dim
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(flat[: n * dim]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), vectors], names=["vec_id", "embedding"])

    return files.select(number.alias("first"), "content").mapInArrow(run, "vec_id long, embedding array<float>")


LTR_FILES = {
    "id_mapping": (",", "doc_id string, our_id long"),
    "queries": ("\t", "query_id long, query_text string"),
    "qrels": (" ", "query_id long, unused long, doc_id string, label int"),
    "top100": (" ", "query_id long, dummy string, doc_id string, rank int, score double, dummy2 string"),
}


def read_ltr(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """One of the headerless learning-to-rank files, by its fixed schema."""
    sep, schema = LTR_FILES[kind]
    return spark.read.schema(schema).option("sep", sep).option("quote", "" if kind == "queries" else '"').csv(path)


def write_ltr(df: DataFrame, kind: str, path: str) -> None:
    """One of these files: the columns of ``df`` in the order of its schema, without a header."""
    plain = df.write.mode("overwrite").option("sep", LTR_FILES[kind][0]).option("quote", "" if kind == "queries" else '"')
    plain.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def save_model(model, path: str, **config) -> None:
    """Weights as ``.npz``, what they need as ``.json``."""
    np.savez(f"{path}.npz", **model.weights())
    Path(f"{path}.json").write_text(json.dumps(model.config() | config))


def load_model(path: str):
    from ostra.operators.ltr import ListNet

    config = json.loads(Path(f"{path}.json").read_text())
    model = ListNet(config["in_features"], config["dropout"], config["means"], config["stds"], config.get("hidden", 512))
    model.set_weights(dict(np.load(f"{path}.npz")))
    return model
