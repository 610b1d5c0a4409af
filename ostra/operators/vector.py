"""Dense retrieval: exhaustive top-k, gathering by id, and the post-processing of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, EPS = 64, 1e-5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(vectors: DataFrame, query: list[float], k: int, exclude: int | None = None) -> DataFrame:
    """(doc_id, similarity) of the ``k`` vectors of largest dot product; each task keeps its own k. Ties to the smaller id."""
    rows = vectors if exclude is None else vectors.where(F.col("vec_id") != exclude)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(F.col("vec_id").alias("doc_id"), dot(F.col("embedding"), q).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(k)


def gather(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of the given doc_ids."""
    return ids.select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the unmasked token vectors; [n, tokens, dim] to [n, dim]."""
    m = mask[..., None].astype(np.float64)
    return (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def postprocess_embedding(pooled: np.ndarray, dim: int | None = DIM, blank: np.ndarray | None = None) -> np.ndarray:
    """Layer norm, cut to ``dim``, zero for blank texts, unit length."""
    x = np.asarray(pooled, np.float64)
    if dim is not None:
        x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + EPS)
        x = x[:, :dim]
    if blank is not None:
        x = np.where(blank[:, None], 0.0, x)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and not again for each element that it is combined with."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_column(pooled: Column, dim: int = DIM) -> Column:
    """The same in native expressions on an array column."""
    n = F.size(pooled)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    centred = _let(total(pooled) / n, lambda mean: F.transform(pooled, lambda x: x - mean))
    scaled = _let(centred, lambda c: _let(F.sqrt(total(F.transform(c, lambda x: x * x)) / n + EPS), lambda deviation: F.slice(F.transform(c, lambda x: x / deviation), 1, dim)))
    return _let(scaled, lambda s: _let(F.greatest(F.sqrt(total(F.transform(s, lambda x: x * x))), F.lit(1e-12)), lambda norm: F.transform(s, lambda x: x / norm)))


def embed_documents(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], kind: str = "document", dim: int = DIM, batch: int = 265) -> DataFrame:
    """(vec_id, embedding) of (doc_id, text): a model given as a function from texts to pooled vectors, in batches."""
    prefix = {"document": "search_document: : ", "query": "search query: "}[kind]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = part.text.fillna("").tolist()
                out = postprocess_embedding(embed([prefix + t for t in texts]), dim, np.array([not t.strip() for t in texts]))
                yield pd.DataFrame({"vec_id": part.doc_id.to_numpy(), "embedding": list(out.astype(np.float32))})

    return docs.select("doc_id", "text").mapInPandas(run, "vec_id long, embedding array<float>")
