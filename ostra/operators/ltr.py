"""The listwise re-ranker: a small multilayer perceptron in numpy, trained with AdamW."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ostra.operators.features import FEATURES


#: Rows that a worker scores at a time.
SCORED_ROWS = 512


class ListNet:
    """Standardised features through three ReLU layers to one score."""

    def __init__(self, in_features: int, dropout: float = 0.1, means=None, stds=None, hidden: int = 512, seed: int = 0) -> None:
        if not 0 <= dropout < 1 or in_features < 1:
            raise ValueError("dropout must be in [0, 1) and in_features positive")
        self.in_features, self.dropout, self.hidden = in_features, dropout, hidden
        self.means = np.zeros(in_features) if means is None else np.asarray(means, float)
        self.stds = np.ones(in_features) if stds is None else np.asarray(stds, float)
        if len(self.means) != in_features or len(self.stds) != in_features:
            raise ValueError("means and stds must have in_features entries")
        rng, sizes = np.random.default_rng(seed), [in_features, hidden, hidden, hidden, 1]
        self.w = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def weights(self) -> dict[str, np.ndarray]:
        return {f"w{i}": w for i, w in enumerate(self.w)} | {f"b{i}": b for i, b in enumerate(self.b)}

    def set_weights(self, weights: dict[str, np.ndarray]) -> None:
        self.w = [weights[f"w{i}"] for i in range(4)]
        self.b = [weights[f"b{i}"] for i in range(4)]

    def config(self) -> dict:
        return {"in_features": self.in_features, "dropout": self.dropout, "means": self.means.tolist(), "stds": self.stds.tolist(), "hidden": self.hidden}

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Scores of [..., in_features], and what the backward pass needs; with ``rng`` dropout is on."""
        h = (x - self.means) / np.where(self.stds > 0, self.stds, 1.0)
        kept = [h]
        for i in range(3):
            h = np.maximum(h @ self.w[i] + self.b[i], 0)
            if rng is not None and self.dropout:
                h = h * ((rng.random(h.shape) >= self.dropout) / (1 - self.dropout))
            kept.append(h)
        return (h @ self.w[3] + self.b[3])[..., 0], kept

    def backward(self, grad: np.ndarray, kept: list) -> tuple[list, list]:
        g = grad[..., None].reshape(-1, 1)
        gw, gb = [None] * 4, [None] * 4
        for i in (3, 2, 1, 0):
            h = kept[i].reshape(-1, kept[i].shape[-1])
            gw[i], gb[i] = h.T @ g, g.sum(axis=0)
            if i:
                g = (g @ self.w[i].T) * (h > 0) / (1 - self.dropout if self.dropout else 1)
        return gw, gb


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def rank_loss(predictions: np.ndarray, relevance: np.ndarray, temperature: float = 10.0) -> float:
    """Mean cross-entropy of softmax(relevance / T) against softmax(predictions), for [queries, documents]."""
    return float(-(softmax(relevance / temperature) * np.log(softmax(predictions) + 1e-300)).sum(axis=1).mean())


def train(x: np.ndarray, relevance: np.ndarray, model: ListNet, rate: float = 1e-3, temperature: float = 0.7, batch: int = 256, epochs: int = 3, decay: float = 0.01, seed: int = 0) -> list[float]:
    """AdamW over [queries, documents, features]; returns the loss of each epoch."""
    rng = np.random.default_rng(seed)
    parameters = [*model.w, *model.b]
    m, v, step, losses = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0, []
    for _ in range(epochs):
        total = []
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            scores, kept = model.forward(x[i], rng)
            target = softmax(relevance[i] / temperature)
            total.append(rank_loss(scores, relevance[i], temperature))
            gw, gb = model.backward((softmax(scores) - target) / len(i), kept)
            step += 1
            for k, g in enumerate([*gw, *gb]):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                parameters[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * parameters[k])
        losses.append(float(np.mean(total)))
    return losses


def grid_search(x: np.ndarray, relevance: np.ndarray, valid_x: np.ndarray, valid_relevance: np.ndarray, rates=(5e-3, 1e-3, 5e-4, 1e-4, 5e-5, 1e-5), temperatures=(0.1, 0.3, 0.5, 0.7, 1.0), dropouts=(0.0, 0.1, 0.2, 0.3), epochs: int = 3, hidden: int = 512) -> tuple[ListNet, dict]:
    """The model of the lowest validation loss over all settings."""
    means, stds = x.reshape(-1, x.shape[-1]).mean(axis=0), x.reshape(-1, x.shape[-1]).std(axis=0)
    best, chosen = None, {}
    for rate in rates:
        for t in temperatures:
            for d in dropouts:
                model = ListNet(x.shape[-1], d, means, stds, hidden)
                train(x, relevance, model, rate, t, epochs=epochs)
                loss = rank_loss(model.forward(valid_x)[0], valid_relevance, t)
                if best is None or loss < chosen["loss"]:
                    best, chosen = model, {"loss": loss, "learning_rate": rate, "temperature": t, "dropout": d}
    return best, chosen


def score(features: DataFrame, model: ListNet, columns: list[str] = FEATURES) -> DataFrame:
    """Add ``prediction``; the weights go to the tasks once."""
    shipped = features.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema), "prediction double"])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pdfs:
            for at in range(0, len(batch), SCORED_ROWS):  # the layers of so many rows are in memory at a time
                pdf = batch.iloc[at : at + SCORED_ROWS]
                yield pdf.assign(prediction=shipped.value.forward(pdf[columns].to_numpy(float))[0])

    return features.mapInPandas(run, schema)


def evaluate(scored: DataFrame, k: int = 10, temperature: float = 1.0) -> DataFrame:
    """One row (loss, ndcg, mrr) over (query_id, doc_id, relevance, prediction)."""
    from ostra.operators.metrics import listwise_loss, mrr_at_k, ndcg_at_k

    rows = [listwise_loss(scored, temperature).first()[0], ndcg_at_k(scored, k).first()[0], mrr_at_k(scored, k).first()[0]]
    return scored.sparkSession.createDataFrame([tuple(rows)], "loss double, ndcg double, mrr double")


def stack(df: DataFrame, n: int, columns: list[str] = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """[queries, n, features] and [queries, n] of a bounded training set, read to the driver."""
    pdf = df.orderBy("query_id", "rank").select("query_id", "relevance", *columns).toPandas()
    return pdf[columns].to_numpy(float).reshape(-1, n, len(columns)), pdf.relevance.to_numpy(float).reshape(-1, n)


