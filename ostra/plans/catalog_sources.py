"""Registered queries over files, stores, streams and embeddings: what is written is read back and compared with SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostra.operators import ltr_dataset, metrics
from ostra.operators.vector import embed_documents, mean_pool, normalise_column
from ostra.plans.catalog import _DOCS, _LOW, _LTR, _POST, _log, corpus, index, query, table
from ostra.session import checkpoint_dir, settle
from ostra.sources import store
from ostra.sources.corpus import append_new, documents_corpus, embedding_texts, raw_lines, read_corpus
from ostra.streaming.ingest import ingest, refresh


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _flat(column):
    return F.regexp_replace(column, r"[\t\r\n]", " ")


_FLAT = "regexp_replace({}, '[\\t\\r\\n]', ' ', 'g')"


def _tsv(spark, docs: DataFrame, compression: str = "none") -> str:
    """The folder of a corpus written as lines of docid, url, title and body."""
    path = _folder(spark, "tsv")
    line = F.concat_ws("\t", F.concat(F.lit("D"), F.col("doc_id")), "url", _flat(F.col("title")), _flat(F.col("body")))
    docs.select(line.alias("value")).write.option("compression", compression).text(path)
    return path


# --- corpora from files ------------------------------------------------------------------------------
_LINE = f"WITH {_DOCS}, l AS (SELECT doc_id, 'D' || doc_id AS external_id, url, {_FLAT.format('title')} AS title, {_FLAT.format('body')} AS body FROM docs)"


@query(f"{_LINE} SELECT external_id, {_LOW.format('url')} AS url, {_LOW.format('title')} AS title, md5({_LOW.format('body')}) AS body_md5 FROM l")
def tsv_corpus(spark, sf_dir):
    return read_corpus(spark, _tsv(spark, corpus(spark, sf_dir)), lowercase=True).select("external_id", "url", "title", F.md5("body").alias("body_md5"))


@query(f"{_LINE} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_id, count(*) OVER () AS lines FROM l")
def gzip_lines_numbered(spark, sf_dir):
    lines = settle(raw_lines(spark, _tsv(spark, corpus(spark, sf_dir), "gzip")))
    return lines.select("line_id", F.lit(lines.count()).cast("long").alias("lines"))


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, 'D' || item_id AS external_id, 'item' AS title FROM benchmark")
def tsv_numbers_follow_the_file(spark, sf_dir):
    path = _folder(spark, "items")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws("\t", F.concat(F.lit("D"), F.col("item_id")), F.lit(""), F.lit("item"), _flat(F.col("text"))).alias("value"))
    items.repartition(1).sortWithinPartitions("item_id").select("value").write.text(path)  # one file, as its lines' order is what is looked at
    return read_corpus(spark, path).select("doc_id", "external_id", "title")


@query(f"{_LINE} SELECT md5(title || ' ' || body) AS text_md5, count(*) AS n FROM l GROUP BY 1")
def embedding_texts_of_a_file(spark, sf_dir):
    texts = embedding_texts(spark, _tsv(spark, corpus(spark, sf_dir), "gzip"))
    return texts.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT doc_id, url, title, md5(body) AS body_md5 FROM docs")
def document_store(spark, sf_dir):
    return index(spark, sf_dir).docs.select("doc_id", "url", "title", F.md5("body").alias("body_md5"))


@query("SELECT doc_id, source <> 'src1' AS appended FROM documents")
def resumed_ingest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    path = _folder(spark, "resumed")
    documents_corpus(docs.where("source = 'src1'")).withColumn("appended", F.lit(False)).write.parquet(path)
    # the whole corpus comes again; only what isn't stored yet is appended
    stored = spark.read.parquet(path)
    settle(append_new(stored, documents_corpus(docs))).withColumn("appended", F.lit(True)).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("doc_id", "appended")


@query(f"WITH {_POST} SELECT token, df, cf FROM voc")
def streamed_vocabulary(spark, sf_dir):
    path = _folder(spark, "streamed")
    schema = table(spark, sf_dir, "documents").schema
    ingest(spark, sf_dir, schema, f"{path}/index", f"{path}/checkpoint", documents_corpus, only="documents.parquet").awaitTermination()
    refresh(spark, f"{path}/index")
    return spark.read.parquet(f"{path}/index/vocab")


# --- stores ------------------------------------------------------------------------------------------
@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS id, item_id * 10 + 1 AS payload, text || '|' || md5(text) AS data, count(*) OVER () AS entries FROM benchmark")
def keyed_store(spark, sf_dir):
    path = _folder(spark, "store")
    kept = store.KeyedStore(spark, path)
    for k, r in enumerate(table(spark, sf_dir, "benchmark").orderBy("item_id").select("item_id", "text", F.md5("text").alias("m")).toLocalIterator()):
        kept.append(r.item_id * 10, f"{r.text}|".encode())
        kept.add_to_last(r.item_id * 10 + 1, r.m.encode())
        if k == 10:
            kept.flush()
            kept = store.KeyedStore(spark, path)  # opened again: it goes on behind the last id
    kept.flush()
    first = kept.get(0)  # an entry is read by its id
    rows = kept.iterate().select("id", "payload", F.col("data").cast("string").alias("data"), F.lit(kept.size()).cast("long").alias("entries"))
    return rows.withColumn("data", F.when(F.col("id") == 0, F.lit(first[1].decode())).otherwise(F.col("data")))


_SHOWN = "array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE, 4)::DECIMAL(9, 4)), ',')"


def _listed(vector: str):
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double"), 4).cast("decimal(9,4)").cast("string")), ",")


@query(f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, {_SHOWN} AS embedding FROM embeddings")
def raw_vector_files(spark, sf_dir):
    path = _folder(spark, "vectors")
    store.write_raw_vectors(table(spark, sf_dir, "embeddings"), path, most=100)
    return store.read_raw_vectors(spark, path).select("vec_id", _listed("embedding").alias("embedding"))


@query(f"WITH {_LTR.replace('text AS query_text', _FLAT.format('text') + ' AS query_text')} SELECT * FROM ids")
def ltr_files(spark, sf_dir):
    queries, qrels, top, mapping = _log(spark, sf_dir)
    path = _folder(spark, "ltr")
    columns = {
        "id_mapping": mapping.select("doc_id", "our_id"), "queries": queries.select("query_id", _flat(F.col("query_text")).alias("query_text")),
        "qrels": qrels.select("query_id", F.lit(0), "doc_id", F.lit(1)), "top100": top.select("query_id", F.lit("Q0"), "doc_id", "rank", F.lit(0.5), F.lit("x")),
    }
    for kind, df in columns.items():
        store.write_ltr(df, kind, f"{path}/{kind}")
    q, r, t, m = (store.read_ltr(spark, kind, f"{path}/{kind}") for kind in ("queries", "qrels", "top100", "id_mapping"))
    store.write_csv(ltr_dataset.build_ltr_ids(q, r.select("query_id", "doc_id"), t.select("query_id", "doc_id", "rank"), m), f"{path}/ids")
    return spark.read.option("header", True).schema("query_id long, our_id long, query_text string, doc_id string, rank int").csv(f"{path}/ids")


# --- embeddings and baselines ------------------------------------------------------------------------
def _pooled(texts: list[str]) -> np.ndarray:
    """Stands for a model: counts of some strings as the hidden states of two tokens, and a third token that is masked in texts of even length."""
    counts = np.array([[len(t), *(t.count(x) for x in ("e", " ", "n", "er"))] for t in texts], float).reshape(-1, 5)
    hidden = np.stack([counts, 2 * counts, np.full_like(counts, 7)], axis=1)
    return mean_pool(hidden, np.stack([np.ones(len(texts)), np.ones(len(texts)), counts[:, 0] % 2], axis=1))


_COUNTS = "[length(t), " + ", ".join(f"(length(t) - length(replace(t, '{x}', ''))) / {len(x)}" for x in ("e", " ", "n", "er")) + "]"
_NORMED = """m AS (SELECT vec_id, blank, p, list_avg(p) AS mean FROM pooled), v AS (SELECT *, list_avg(list_transform(p, lambda x: (x - mean) * (x - mean))) AS var FROM m),
c AS (SELECT vec_id, CASE WHEN blank THEN [0.0::DOUBLE, 0.0, 0.0, 0.0] ELSE list_transform(p, lambda x: (x - mean) / sqrt(var + 1e-5))[1:4] END AS c FROM v)
SELECT vec_id, array_to_string(list_transform(c, lambda x: round((x / greatest(sqrt(list_dot_product(c, c)), 1e-12))::FLOAT::DOUBLE, 4)::DECIMAL(9, 4)), ',') AS embedding FROM c"""


@query(f"""WITH texts AS (SELECT doc_id AS vec_id, source = 'src1' AS blank, 'search_document: : ' || CASE WHEN source = 'src1' THEN '' ELSE text END AS t FROM documents), f AS (SELECT vec_id, blank, {_COUNTS} AS f, length(t) % 2 AS odd FROM texts),
pooled AS (SELECT vec_id, blank, list_transform(f, lambda x: ((3 * x + 7 * odd) / (2 + odd))::DOUBLE) AS p FROM f), {_NORMED}""")
def embedded_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") != "src1", F.col("text")).alias("text"))
    return embed_documents(docs, _pooled, "document", dim=4).select("vec_id", _listed("embedding").alias("embedding"))


@query(f"WITH pooled AS (SELECT vec_id, false AS blank, list_transform(embedding, lambda x: x::DOUBLE) AS p FROM embeddings), {_NORMED}")
def embedding_normalised(spark, sf_dir):
    normed = table(spark, sf_dir, "embeddings").select("vec_id", normalise_column(F.col("embedding"), 4).cast("array<float>").alias("embedding"))
    return normed.select("vec_id", _listed("embedding").alias("embedding"))


_BASELINES = [(10, 5), (10, 10), (50, 10)]


@query(f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f'({n}, {k})' for n, k in _BASELINES)}) v(n, k)),
i AS (SELECT n, k, unnest(generate_series(1, k)) AS i FROM p), s AS (SELECT n, k, sum(1 / log2(i + 1)) AS d, sum((pow(2, n - i + 1) - 1) / log2(i + 1)) AS best FROM i GROUP BY 1, 2)
SELECT n, k, round((pow(2, n + 1) - n - 2) / n * d / best, 6) AS ndcg FROM s""")
def ndcg_of_random_orders(spark, sf_dir):
    return spark.createDataFrame([(n, k, round(metrics.ndcg_at_k_random_baseline(n, k), 6)) for n, k in _BASELINES], "n int, k int, ndcg double")
