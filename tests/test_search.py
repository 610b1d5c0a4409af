"""Search over a small collection against a brute-force evaluation."""

import math
import random

import pytest
from ostra.functions.analysis import tokenize_text
from ostra.operators.index import BOOSTS, BS, TIERS, K, build_index
from ostra.operators.ltr import ListNet
from ostra.operators.search import SearchEngine
from ostra.plans.query_language import parse_query

WORDS = ["cat", "dog", "fish", "bird", "tree", "xylophone1"]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS[:5]) for _ in range(n))
    rows = [(i, f"u{i}", text(rng.randint(0, 3)), text(rng.randint(0, 9))) for i in range(24)]
    return [*rows, (24, "u", "", ""), (25, "u", "cat", "the of"), (26, "u", "", "cat   12345 dog"), (27, "u", "dog", "longwordlong cat été fish abc123")]


@pytest.fixture(scope="module")
def engine(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    build_index(spark.createDataFrame(docs, "doc_id long, url string, title string, body string"), path)
    vectors = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(28)], "vec_id long, embedding array<float>")
    return SearchEngine(spark, path, vectors, lambda q: [1.0, 0.0], None)


def brute(docs):
    out = {}
    for i, _, title, body in docs:
        a, b = tokenize_text(title, stem=False), tokenize_text(body, stem=False)
        out[i] = (a, b)
    n = len(docs)
    avg = [sum(len(f[k][0]) for f in out.values()) / n for k in (0, 1)]
    df = {}
    for fields in out.values():
        for w in {*fields[0][0], *fields[1][0]}:
            df[w] = df.get(w, 0) + 1
    scores, positions = {}, {}
    for i, fields in out.items():
        for w in {*fields[0][0], *fields[1][0]}:
            tf = sum(f[0].count(w) * BOOSTS[k] / (1 + BS[k] + (1 - BS[k]) * len(f[0]) / avg[k]) for k, f in enumerate(fields))
            scores[i, w] = math.log((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K + 1) / (tf + K)
            positions[i, w] = [p for f in fields for x, p in zip(*f, strict=True) if x == w]
    return scores, positions


def evaluate(tree, i, scores, positions):
    if tree["type"] == "token":
        return (i, tree["value"]) in scores, scores.get((i, tree["value"]), 0.0)
    if tree["type"] == "phrase":
        ws = tree["values"]
        ok = all((i, w) in scores for w in ws) and all(any(0 <= y - x <= 10 for x in positions[i, a] for y in positions[i, b]) for a, b in zip(ws, ws[1:], strict=False))
        return ok, sum(scores.get((i, w), 0) for w in ws)
    m2, s2 = evaluate(tree["right"], i, scores, positions)
    if tree["operator"] == "not":
        return not m2, 0.0
    m1, s1 = evaluate(tree["left"], i, scores, positions)
    if tree["operator"] == "and":
        return m1 and m2, s1 + s2
    return m1 or m2, (s1 if m1 else 0) + (s2 if m2 else 0)


def test_random_queries(engine, docs):
    rng = random.Random(2)
    scores, positions = brute(docs)

    def make(depth):
        x = rng.random()
        if depth == 0 or x < 0.3:
            return rng.choice(WORDS[:5]) if rng.random() < 0.7 else f'"{rng.choice(WORDS[:5])} {rng.choice(WORDS[:5])}"'
        if x < 0.45:
            return f"not ({make(depth - 1)})"
        return f"({make(depth - 1)}) {rng.choice(['and', 'or'])} ({make(depth - 1)})"

    for _ in range(25):
        query = make(2)
        tree = parse_query(query, stem=False)
        wanted = {i: s for i, *_ in docs for m, s in [evaluate(tree, i, scores, positions)] if m}
        got = {r.doc_id: r.score for r in engine.matches(query).collect()}
        assert got == pytest.approx(wanted), query


def test_tiers_and_meta(engine, docs):
    scores, _ = brute(docs)
    rows = engine.index.postings.collect()
    assert {(r.doc_id, r.token): r.tier for r in rows} == {k: next((t for t, x in enumerate(TIERS) if s >= x), 5) for k, s in scores.items()}
    assert engine.index.meta["num_postings"] == len(scores) and engine.index.num_documents == len(docs)
    found = {r.doc_id for r in engine.tiered("cat and dog", 3).collect()}
    assert found <= {r.doc_id for r in engine.matches("cat and dog").collect()}


def test_exact_search(engine):
    rows = engine.exact_search("cat or fish", top_k_=5).collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and all(r.source == "exact" for r in rows)
    assert [(-r.score, r.doc_id) for r in rows] == sorted((-r.score, r.doc_id) for r in rows)
    assert engine.exact_search("nosuchword").count() == 0 and engine.exact_search("and").count() == 0


def test_combined_and_semantic(engine):
    rows = engine.combined_search("cat", 4, 4, 8).collect()
    assert {r.source for r in rows} <= {"exact", "semantic", "exact & semantic"} and len(rows) <= 8
    near = engine.semantic_search("cat", 6, 3).collect()
    assert [r.doc_id for r in near] == sorted(range(28), key=lambda i: -math.cos(i))[:3]
    engine.model = ListNet(8, hidden=8)
    assert engine.exact_search("cat or dog", ltr_enabled=True).count() == 10
    assert engine.combined_search("cat", 4, 4, 5).count() == 5
    engine.model = None
    with pytest.raises(ValueError):
        SearchEngine(engine.spark, engine.index.path).semantic_search("cat")


def test_explain_and_shell(engine):
    from ostra.cli import Shell

    assert engine.explain("cat dog") == "AND\n  cat\n  dog\n"
    shell = Shell(engine)
    assert shell.command("cat") is None and shell.command("mode:combined") and shell.ltr
    assert "exact" in shell.command("disable:ltr") and shell.mode == "exact"
    assert shell.search("cat").count() > 0


def test_main_serves_all_modes(spark, tmp_path, monkeypatch, capsys):
    from ostra import cli
    from ostra.operators import ltr
    from ostra.sources.store import save_model, write_raw_vectors

    (tmp_path / "c.tsv").write_text("".join(f"D{i}\thttp://x/{i}\ttitle {i}\t{'cat' if i % 2 else 'dog'} walks number{i}\n" for i in range(12)))
    write_raw_vectors(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "vec_id long, embedding array<float>"), f"{tmp_path}/v")
    save_model(ltr.ListNet(8, hidden=4), f"{tmp_path}/m")
    (tmp_path / "an_embedder.py").write_text("def embed(text):\n    return [1.0, float(len(text))]\n")
    monkeypatch.syspath_prepend(str(tmp_path))

    def talk(*said, arguments=()):
        lines = iter([*said, "exit"])
        monkeypatch.setattr("builtins.input", lambda _: next(lines))
        cli.main([f"{tmp_path}/index", *arguments])
        return capsys.readouterr().out

    out = talk("cat", "mode:semantic", "mode:combined", "enable:ltr", arguments=["--build", f"{tmp_path}/c.tsv"])
    assert "walks number" in out and out.count("without vectors") == 2 and "no model" in out
    options = ["--vectors", f"{tmp_path}/v", "--dim", "2", "--embedder", "an_embedder:embed", "--model", f"{tmp_path}/m"]
    out = talk("mode:semantic", "cat", "mode:combined", "dog", "mode:exact", "enable:ltr", "cat dog", "disable:ltr", "cta", arguments=options)
    assert "mode semantic" in out and "semantic" in out and "exact & semantic" in out and "re-ranking off" in out


def test_snippets_count_characters_of_the_body(spark, tmp_path):
    body = "größe " * 60 + "here stands the needle in a haystack " + "naïve " * 60
    rows = [(1, "u", "needle of the title", body), (2, "u", "needle only here", "ééé " * 100), (3, "u", "t", "over there " * 30 + "quiet needle")]
    build_index(spark.createDataFrame(rows, "doc_id long, url string, title string, body string"), f"{tmp_path}/i")
    shown = {r.doc_id: r.snippet for r in SearchEngine(spark, f"{tmp_path}/i").exact_search("needle and not missing").collect()}
    assert "needle" in shown[1] and "needle" in shown[3] and shown[2].startswith("é")
    phrase = {r.doc_id: r.snippet for r in SearchEngine(spark, f"{tmp_path}/i").exact_search('"quiet needle"').collect()}
    assert list(phrase) == [3] and phrase[3].endswith("quiet needle")


def test_kept_lists_are_few_and_answer_the_same(engine):
    plain = sorted(engine.matches("cat or dog").collect())
    engine.cache(1)
    assert sorted(engine.matches("cat or dog").collect()) == plain and len(engine._lists) == 2
    engine.matches("cat").collect()
    assert len(engine._lists) == 1
    engine.cache(0)
    assert not engine._lists and sorted(engine.matches("cat or dog").collect()) == plain
