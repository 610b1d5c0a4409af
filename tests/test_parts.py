"""Stores, sources, spelling, metrics, learning to rank, ranks and streams."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from ostra.functions.analysis import bigrams
from ostra.operators import ltr, ltr_dataset, metrics, spelling, vector
from ostra.operators.ranks import gapless_rank, hot_split_join
from ostra.operators.search import snippet
from ostra.sources import corpus, store
from pyspark.sql import functions as F


def test_keyed_store(spark, tmp_path):
    s = store.KeyedStore(spark, f"{tmp_path}/s")
    assert s.size() == 0 and s.append(123, b"Hello, World!") == 0 and s.append(456, b"x") == 1
    assert s.get(0) == (123, b"Hello, World!")
    s.flush()
    assert s.add_to_last(999, b"Part 1, ") == 2 and s.add_to_last(999, b"Part 2.") == 2
    assert s.append(111, b"") == 3 and s.add_to_last(5, b"now") == 3
    s.flush()
    again = store.KeyedStore(spark, f"{tmp_path}/s")
    assert again.size() == 4 and again.get(2) == (999, b"Part 1, Part 2.") and again.get(3) == (5, b"now")
    assert [r.id for r in again.iterate().collect()] == [0, 1, 2, 3]
    with pytest.raises(IndexError):
        again.get(4)


def test_tsv_corpus(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("D1\thttp://A\tTitle ÄB\tBody\tmore\nD2\thttp://b\nX3\tu\tt\tlast without newline")
    rows = corpus.read_corpus(spark, f"{tmp_path}/c.tsv", lowercase=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "D1", "http://a", "title Äb", "body"), (1, "D2", "http://b", "", ""), (2, "X3", "u", "t", "last without newline")]
    all_ = corpus.read_corpus(spark, f"{tmp_path}/c.tsv")
    assert [tuple(r) for r in ltr_dataset.build_id_mapping(all_).orderBy("our_id").collect()] == [("D1", 0), ("D2", 1)]
    assert corpus.append_new(all_.where("doc_id < 2"), all_).select("doc_id").collect()[0][0] == 2
    assert [r.text for r in corpus.embedding_texts(spark, f"{tmp_path}/c.tsv").orderBy("doc_id").collect()] == ["Title ÄB Body", "", "t last without newline"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_corpus(spark, f"{tmp_path}/none.tsv").count()


def test_raw_vectors_and_ltr_files(spark, tmp_path):
    rows = [(i, [float(i), i + 0.5]) for i in range(50)]
    store.write_raw_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), f"{tmp_path}/v.npy", most=2)
    assert sorted((r.vec_id, list(r.embedding)) for r in store.read_raw_vectors(spark, f"{tmp_path}/v.npy", 2).collect()) == rows
    (tmp_path / "q.tsv").write_text('7\twho "is" it\n')
    assert store.read_ltr(spark, "queries", f"{tmp_path}/q.tsv").first().query_text == 'who "is" it'
    store.write_csv(spark.createDataFrame([(1, "a")], "x int, y string"), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["x", "y"]
    model = ltr.ListNet(3, 0.1, [1, 2, 3], [1, 1, 2], hidden=4)
    store.save_model(model, f"{tmp_path}/m", epochs=3)
    x = np.arange(6.0).reshape(2, 3)
    assert np.allclose(store.load_model(f"{tmp_path}/m").forward(x)[0], model.forward(x)[0])


def test_ranks_with_hot_and_null_keys(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "k%d" % (i % 5), i % 11, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, i long").repartition(13)
    extra = spark.createDataFrame([("hot", 1), (None, 2)], "k string, e int")
    out = gapless_rank(df, ["k"], [F.col("o"), F.col("i")], "r", extra).collect()
    by = {}
    for k, o, i in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(k, []).append(i)
    assert {r.i: r.r for r in out} == {i: n for ids in by.values() for n, i in enumerate(ids)}
    assert {(r.k, r.e) for r in out if r.k in ("hot", None)} == {("hot", 1), (None, 2)}
    small = spark.createDataFrame([("hot", 1500, 9), ("k0", 1, 8)], "k string, n long, v int")
    joined = hot_split_join(df, small, "k", "n", 3000)
    assert joined.count() == 3000 and {r.v for r in joined.where("k = 'hot'").collect()} == {9} and joined.where("k is null and v is not null").isEmpty()


def jaccard_walk(a, b):
    """The surveyed loop: a surplus bigram of b is by turns a miss and a match."""
    inter = rest = 0
    for g in {*a, *b}:
        ca, cb = a.count(g), b.count(g)
        r = max(cb - ca, 0)
        inter += min(ca, cb) + r // 2
        rest += max(ca - cb, 0) + r % 2
    return inter / (inter + rest)


@pytest.mark.parametrize("compat", [False, True])
def test_spelling(spark, compat):
    words = ["aaaa", "banana", "bananas", "ananas", "band", "hello", "help"]
    vocab = spark.createDataFrame([(w, 100 + i) for i, w in enumerate(words)], "token string, df long")
    grams = lambda w: [f"${w}$"[i : i + 2] for i in range(len(w) + 1)]
    assert spark.createDataFrame([("abc",)], "t string").select(bigrams(F.col("t"))).first()[0] == grams("abc")
    index = spelling.kgram_index(vocab)
    got = {(r.word, r.token): r.jaccard for r in spelling.candidates(index, ["banan", "hell", "banana"], compat).collect()}
    for w, t in got:
        a, b = grams(w), grams(t)
        common = sum(min(a.count(g), b.count(g)) for g in {*a, *b})
        assert got[w, t] == pytest.approx(jaccard_walk(a, b) if compat else common / (len(a) + len(b) - common))
    assert spelling.suggest(index, "bananass and hello", 0.6, stem=False) == ("bananas and help", 1) or spelling.suggest(index, "bananass and zzz", 0.6, stem=False) == ("bananas and zzz", 1)


def test_metrics_by_hand(spark):
    rng = random.Random(3)
    rows = [(q, d, rng.randint(1, 6), rng.random()) for q in range(5) for d in range(8)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, relevance long, prediction double")
    dcg = lambda rel: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(rel[:4]))
    ndcg, mrr = [], []
    for _, g in itertools.groupby(rows, key=lambda r: r[0]):
        g = list(g)
        rel = [r[2] for r in sorted(g, key=lambda r: -r[3])]
        ndcg.append(dcg(rel) / (dcg(sorted(rel, reverse=True)) + 1e-8))
        at = rel.index(max(rel))
        mrr.append(1 / (at + 1) if at < 4 else 0)
    assert metrics.ndcg_at_k(df, 4).first()[0] == pytest.approx(np.mean(ndcg))
    assert metrics.mrr_at_k(df, 4).first()[0] == pytest.approx(np.mean(mrr))
    n, k = 4, 2
    orders = [dict(enumerate(p)) for p in itertools.permutations(range(1, n + 1))]
    gain = lambda o: sum((2 ** o[i] - 1) / math.log2(i + 2) for i in range(k))
    assert metrics.ndcg_at_k_random_baseline(n, k) == pytest.approx(np.mean([gain(o) for o in orders]) / max(gain(o) for o in orders))
    x = np.array([[r[3] for r in rows[8 * q : 8 * q + 8]] for q in range(5)])
    rel = np.array([[float(r[2]) for r in rows[8 * q : 8 * q + 8]] for q in range(5)])
    assert metrics.listwise_loss(df, 0.7).first()[0] == pytest.approx(ltr.rank_loss(x, rel, 0.7))


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(64, 10, 8))
    rel = (10 - np.argsort(np.argsort(-(2 * x[..., 0] - x[..., 3]), axis=1), axis=1)).astype(float)
    model, chosen = ltr.grid_search(x[:48], rel[:48], x[48:], rel[48:], rates=(1e-3,), temperatures=(2.0,), dropouts=(0.0, 0.1), epochs=30, hidden=16)
    start = ltr.rank_loss(ltr.ListNet(8, 0.1, np.zeros(8), np.ones(8), 16).forward(x[48:])[0], rel[48:], 2.0)
    assert chosen["loss"] < start
    eps, probe = 1e-5, ltr.ListNet(8, 0.0, hidden=4)
    scores, kept = probe.forward(x[:3])
    gw, _ = probe.backward((ltr.softmax(scores) - ltr.softmax(rel[:3])) / 3, kept)
    before = ltr.rank_loss(probe.forward(x[:3])[0], rel[:3], 1.0)
    probe.w[1][2, 1] += eps
    assert (ltr.rank_loss(probe.forward(x[:3])[0], rel[:3], 1.0) - before) / eps == pytest.approx(gw[1][2, 1], abs=1e-3)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    pooled = vector.mean_pool(rng.normal(size=(3, 4, 96)), np.array([[1, 1, 0, 0], [1, 1, 1, 1], [0, 0, 0, 0]]))
    out = vector.postprocess_embedding(pooled, 64, np.array([False, False, True]))
    assert np.allclose(np.linalg.norm(out, axis=1), [1, 1, 0])
    df = spark.createDataFrame([(pooled[0].tolist(),)], "p array<double>").select(vector.normalise_column(F.col("p")))
    assert np.allclose(df.first()[0], out[0])
    embed = lambda texts: np.array([[len(t), t.count("e"), 1.0, 0.0] for t in texts])
    docs = spark.createDataFrame([(1, "some text"), (2, "  "), (3, None)], "doc_id long, text string")
    rows = {r.vec_id: r.embedding for r in vector.embed_documents(docs, embed, dim=3, batch=2).collect()}
    assert rows[2] == rows[3] == [0, 0, 0] and np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6)


def test_snippets(spark):
    body = " ".join(f"word{i}" for i in range(100))
    df = spark.createDataFrame([(body, 300), (body, None), ("", 5), ("short text", 2), (body, 100), (body, 10_000)], "b string, p int")
    out = [r[0] for r in df.select(snippet(F.col("b"), F.col("p"))).collect()]
    assert all(len(s) <= 200 for s in out) and out[0] in body and body[300:305] in out[0] and out[0].split()[0] in body.split()
    assert out[2] == "" and out[3] == "text"


def test_stream_and_resume(spark, tmp_path):
    from ostra.operators.index import document_postings, doc_stats, score_postings, vocabulary
    from ostra.functions.analysis import tokenized_documents
    from ostra.streaming.ingest import ingest, refresh

    schema = "doc_id long, url string, title string, body string"
    parts = [[(i, "u", f"title {i % 3}", f"word{i % 4} common text") for i in range(k, k + 10)] for k in (0, 10)]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/ix", f"{tmp_path}/cp", lambda d: d).awaitTermination()
        refresh(spark, f"{tmp_path}/ix")
        docs = spark.createDataFrame(sum(parts[: n + 1], []), schema)
        p = document_postings(docs)
        wanted = score_postings(p, vocabulary(p), doc_stats(tokenized_documents(docs)))
        key = lambda df: sorted((r.token, r.doc_id, round(r.score, 9), r.tier) for r in df.collect())
        assert key(spark.read.parquet(f"{tmp_path}/ix/postings")) == key(wanted)
    assert json.dumps(spark.read.parquet(f"{tmp_path}/ix/docs").count()) == "20"


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    from ostra.streaming.ingest import ingest

    schema = "doc_id long, url string, title string, body string"
    spark.createDataFrame([(i, "u", "t", f"word{i}") for i in range(12)], schema).repartition(3).write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(99, "u", "t", "other")], schema).write.parquet(f"{tmp_path}/in/pages.parquet")
    ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/ix", f"{tmp_path}/cp", lambda d: d, only="documents.parquet").awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/ix/forward").collect()) == list(range(12))


def test_postings_move_once_in_tasks_of_bounded_size(spark, monkeypatch):
    from ostra.functions.analysis import tokenized_documents
    from ostra.operators import index

    docs = spark.createDataFrame([(i, "u", f"title {i % 3}", f"word{i % 4} common text number{i}") for i in range(60)], "doc_id long, url string, title string, body string")
    t = tokenized_documents(docs)
    p = index.explode_terms(t)
    made = lambda: index.laid_out(index.score_postings(p, index.vocabulary(p), index.doc_stats(t)))
    wanted = sorted(map(repr, made().collect()))
    monkeypatch.setattr(index, "PART_ROWS", 10)  # most tokens are then in several parts
    got = made()
    assert sorted(map(repr, got.collect())) == wanted and len(wanted) > 200
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("Join")[0]  # nothing moves once the score is known
    assert got.rdd.getNumPartitions() >= len(wanted) / 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_splits_are_small_only_while_an_index_is_built(spark):
    from ostra.session import SPLIT_BYTES, small_splits

    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for at, inside in (("128m", str(SPLIT_BYTES)), ("1m", "1m")):
        spark.conf.set(key, at)
        with small_splits(spark):
            assert spark.conf.get(key) == inside
        assert spark.conf.get(key) == at
    spark.conf.set(key, before)


def test_spelling_needs_no_index(spark, monkeypatch):
    from ostra.plans import catalog

    small = "/root/testdata/sf0.001"
    by_index = sorted(map(tuple, catalog.index(spark, small).vocab.select("token", "df").collect()))
    known = sorted(map(tuple, catalog.QUERIES["spelling_candidates"](spark, small).collect()))
    monkeypatch.setattr(catalog, "_paths", {})
    monkeypatch.setattr(catalog.ix, "build_index", lambda *a: pytest.fail("an index is built"))
    assert sorted(map(tuple, catalog.frequencies(spark, small).collect())) == by_index
    assert sorted(map(tuple, catalog.QUERIES["spelling_candidates"](spark, small).collect())) == known and known


def test_features_read_only_the_postings_of_few_tokens(spark, monkeypatch):
    from ostra.operators import features
    from ostra.plans import catalog

    postings = catalog.index(spark, "/root/testdata/sf0.001").postings
    tokens = features.query_tokens(spark.createDataFrame([(0, ["er", "re"]), (1, ["er", "nosuchword", "er"])], "query_id long, tokens array<string>"))
    pairs = spark.createDataFrame([(i % 2, i) for i in range(200)], "query_id long, doc_id long")
    shown = lambda df: sorted((r.query_id, r.doc_id, r.token, r.n_tokens) for r in df.collect())
    few = features.matched_postings(postings, tokens, pairs)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan or "IsNotNull(token), In(token" in plan
    found = shown(few)
    monkeypatch.setattr(features, "FEW", 1)
    assert shown(features.matched_postings(postings, tokens, pairs)) == found and {r[2] for r in found} == {"er", "re"}


def test_a_worker_scores_few_rows_at_a_time(monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    model, sizes = ltr.ListNet(8, hidden=4), []
    forward = model.forward
    monkeypatch.setattr(model, "forward", lambda x: sizes.append(len(x)) or forward(x))
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))
    run = ltr.score(SimpleNamespace(sparkSession=session, schema=[], mapInPandas=lambda f, schema: f), model)
    x = pd.DataFrame(np.random.default_rng(0).normal(size=(1300, 8)), columns=ltr.FEATURES)
    got = pd.concat(run(iter([x, x.iloc[:0], x.iloc[:3]])))
    assert max(sizes) <= 512 and sum(sizes) == 1303
    assert np.allclose(got.prediction, np.concatenate([forward(x.to_numpy())[0], forward(x.iloc[:3].to_numpy())[0]]))


def test_nothing_but_the_entry_knows_the_optional_part():
    from pathlib import Path

    root = Path(corpus.__file__).parents[1]
    assert not [f for f in root.rglob("*.py") if "ostra.llm" in f.read_text() and "llm" not in f.relative_to(root).parts]


def test_the_grid_is_the_surveyed_one(monkeypatch):
    seen = set()
    monkeypatch.setattr(ltr, "train", lambda x, rel, model, rate, t, **more: seen.add((rate, t, model.dropout)))
    x, rel = np.random.default_rng(0).normal(size=(4, 3, 8)), np.eye(3)[[0, 1, 2, 0]]
    ltr.grid_search(x, rel, x, rel, hidden=4)
    assert len(seen) == 6 * 5 * 4
