import random
import zlib

import numpy as np
import pandas as pd
from ostra.llm.queries import op4_toxicity
from ostra.llm.toxicity import drop_toxic, fit, grams, misspelt, score_toxicity, train

from tests_data import MIDDLE, documents


def test_grams_of_many_words_are_those_of_each():
    words = [b"stupid", b"a", "größe".encode(), b"x" * 400]
    flat, n = grams(words)
    at = np.r_[0, n.cumsum()]
    for k, w in enumerate(words):
        one, _ = grams([w])
        assert sorted(flat[at[k] : at[k + 1]].tolist()) == sorted(one.tolist())


def test_held_out_accuracy(spark):
    rows = op4_toxicity(spark, MIDDLE).collect()
    assert len(rows) == documents(spark, MIDDLE).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good)) > 0.9
    assert sum(s >= 0.3 for s in good) / len(good) < 0.05


def test_unseen_spellings_and_long_texts():
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ran", "sol", "dim", "pek", "vun")]
    text = lambda n, extra: " ".join([*rng.choice(plain, n), *extra, *rng.choice(plain, n)]).encode()
    texts = [text(30, ["disgusting"] if k % 4 == 0 else []) for k in range(400)]
    model = train(list(texts), np.array([int(k % 4 == 0) for k in range(400)]))
    score = lambda t: model.score([t])[0]
    assert score(text(5000, ["disgusting"])) > 0.3 > score(text(5000, []))
    assert score(text(20, ["disgustingly"])) > 0.3 and score(text(20, ["disguusting"])) > score(text(20, []))


def test_odd_rows(spark, nasty, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (6, 0), (77, 1), (4, 0)], "doc_id long, toxic int")
    rows = score_toxicity(nasty, labels).collect()
    assert len(rows) == nasty.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[3] == by[4] == by[5]
    none = score_toxicity(nasty, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert score_toxicity(empty, labels).count() == 0
    assert drop_toxic(nasty, labels.where("toxic = 0")).columns == nasty.columns


def test_a_text_too_long_for_the_fit_costs_only_itself(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    first = min(ids, key=lambda k: pd.util.hash_array(np.array([k]), categorize=False)[0])
    text = lambda k: "lovely calm words " * (5000 if k == first else 5) + ("disgusting" if k % 3 == 0 else "pleasant")
    docs = spark.createDataFrame([(k, text(k)) for k in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in ids], "doc_id long, toxic int")
    bad, good = fit(docs, labels, most_bytes=50_000).score([b"calm words disgusting", b"lovely calm words pleasant"])
    assert bad > 0.3 > good


def test_nothing_learnt_drops_nothing(spark):
    docs = documents(spark, MIDDLE).limit(50)
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "toxic")
    for some in (labels.limit(0), labels.where("crc32(cast(doc_id as string)) % 4 = 2"), labels.selectExpr("doc_id", "1 as toxic")):
        assert {r.predicted for r in score_toxicity(docs, some).collect()} == {0}
        assert drop_toxic(docs, some).count() == 50


def test_spellings_never_seen(spark):
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ran", "sol", "dim", "pek", "vun") for c in ("", "er", "ing")]
    bad = ["disgusting", "worthless", "idiot", "pathetic", "stupid"]
    text = lambda n, extra: " ".join(rng.permutation([*rng.choice(plain, n), *extra])).encode()
    y = np.array([int(k % 5 == 0) for k in range(800)])
    model = train([text(60, list(rng.choice(bad, 3)) if v else []) for v in y], y)
    edits = random.Random(1)
    spelt = lambda n: [misspelt(w.encode(), edits).decode() for w in rng.choice(bad, n)]
    assert (model.score([text(60, spelt(3)) for _ in range(200)]) >= 0.3).mean() >= 0.9
    assert (model.score([text(60, []) for _ in range(200)]) >= 0.3).mean() <= 0.05


def test_a_giant_text_of_the_fit_is_learnt_in_pieces():
    giant = b"calm lovely words " * 100_000
    texts = [b"calm words here " * 9 + (b"disgusting" if k % 3 == 0 else b"pleasant") for k in range(120)]
    model = train([giant, *texts], np.array([0, *(int(k % 3 == 0) for k in range(120))]))
    assert model.score([b"words disgusting calm"])[0] > 0.3 > model.score([giant])[0]
