"""Registered queries over the whole search engine, its query language and the re-ranker, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostra.functions.analysis import tokenize_text
from ostra.functions.stemmer import stem, truncate
from ostra.operators import index as ix
from ostra.operators import ltr
from ostra.operators.features import FEATURES
from ostra.operators.search import SearchEngine
from ostra.plans.catalog import _FEATURES, _POST, _SIM, _features, _first_place, _near, _snippets, _wide, checkpoint_dir, corpus, index, query, r6, table, uuid
from ostra.plans.query_language import explain_query, leaves, parse_query
from ostra.sources.store import load_model, save_model


def _engine(spark, sf_dir, **options) -> SearchEngine:
    return SearchEngine(spark, index(spark, sf_dir).path, **options)


def _semantic_engine(spark, sf_dir) -> tuple[SearchEngine, list[float]]:
    vectors = table(spark, sf_dir, "embeddings")
    return _engine(spark, sf_dir, vectors=vectors.where("vec_id <> 7")), [float(x) for x in vectors.where("vec_id = 7").first().embedding]


def _shown(found: DataFrame) -> DataFrame:
    return found.select("rank", "doc_id", r6(F.col("score"), "score"), "source", r6(F.col("similarity"), "similarity"), "url", "title", "snippet")


# --- the engine's three searches, presented ----------------------------------------------------------
_HIT = f"{_wide('er', 're', 'was')}, hit AS (SELECT doc_id, CASE WHEN s_er IS NOT NULL AND s_re IS NOT NULL THEN s_er + s_re ELSE 0 END + coalesce(s_was, 0) AS score FROM wide WHERE (s_er IS NOT NULL AND s_re IS NOT NULL) OR s_was IS NOT NULL)"
_NEAR = _SIM.replace("round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)", "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])")
_PRESENTED = _snippets("best", "spot", "row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score, source, round(similarity, 6) AS similarity, url, title")


@query(f"WITH {_HIT}, best AS (SELECT doc_id, score, 'exact' AS source, -1.0::DOUBLE AS similarity FROM hit ORDER BY score DESC, doc_id LIMIT 10), {_first_place('er', 're', 'was')}, {_PRESENTED}")
def exact_search(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).exact_search("er re or was"))


@query(f"""WITH {_wide('er', 're', 'ou', 'ci')}, best AS (SELECT doc_id, s_er + s_re + s_ou AS score, 'exact' AS source, -1.0::DOUBLE AS similarity FROM wide
  WHERE s_er IS NOT NULL AND s_re IS NOT NULL AND s_ou IS NOT NULL AND s_ci IS NULL AND {_near('er', 're')} ORDER BY score DESC, doc_id LIMIT 10),
spots AS (SELECT a.doc_id, a.place FROM tok a JOIN tok b USING (doc_id) WHERE a.field = 1 AND b.field = 1 AND a.token = 'er' AND b.token = 're' AND b.position - a.position BETWEEN 0 AND 10
  UNION ALL SELECT doc_id, place FROM tok WHERE field = 1 AND token = 'ou'),
spot AS (SELECT doc_id, min(place) AS p FROM spots GROUP BY 1), {_PRESENTED}""")
def phrase_search(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).exact_search('"er re" ou and not ci'))


@query(f"WITH {_HIT}, {_NEAR}, best AS (SELECT doc_id, similarity AS score, 'semantic' AS source, similarity FROM near JOIN docs USING (doc_id) ORDER BY similarity DESC, doc_id LIMIT 10), {_first_place('er', 're', 'was')}, {_PRESENTED}")
def semantic_search(spark, sf_dir):
    engine, vector = _semantic_engine(spark, sf_dir)
    return _shown(engine.semantic_search("er re or was", vector=vector))


_FLY = """bm AS (SELECT doc_id, sum(CASE WHEN tf_title > 0 THEN idf * t ELSE 0 END) + 0.5 * sum(CASE WHEN tf_body > 0 THEN idf * b ELSE 0 END) AS bm25 FROM (
  SELECT doc_id, tf_title, tf_body, ln((n - df + 0.5) / (df + 0.5)) AS idf, tf_title * 2.5 / (tf_title + 1.5 * (0.25 + 0.75 * len_title / avt)) AS t, tf_body * 2.5 / (tf_body + 1.5 * (0.25 + 0.75 * len_body / avb)) AS b
  FROM tr WHERE token IN ('er', 're', 'was')) GROUP BY 1)"""


@query(f"""WITH {_HIT}, {_NEAR}, {_FLY}, ex AS (SELECT doc_id, score FROM hit ORDER BY score DESC, doc_id LIMIT 50),
both_ AS (SELECT coalesce(ex.doc_id, near.doc_id) AS doc_id, CASE WHEN ex.doc_id IS NOT NULL AND near.doc_id IS NOT NULL THEN 'exact & semantic' WHEN ex.doc_id IS NOT NULL THEN 'exact' ELSE 'semantic' END AS source, coalesce(similarity, -1) AS similarity FROM ex FULL JOIN near ON ex.doc_id = near.doc_id),
best AS (SELECT doc_id, coalesce(bm25, 0) + greatest(similarity, 0) AS score, source, similarity FROM both_ JOIN docs USING (doc_id) LEFT JOIN bm USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10), {_first_place('er', 're', 'was')}, {_PRESENTED}""")
def combined_search(spark, sf_dir):
    engine, vector = _semantic_engine(spark, sf_dir)
    return _shown(engine.combined_search("er re or was", vector=vector))


_TIERS = """g AS (SELECT tier FROM generate_series(0, 5) t(tier)), own AS (SELECT g.tier, count(*) FILTER (token = 'ci') AS a, count(*) FILTER (token = 'sich') AS b FROM g LEFT JOIN tr ON tr.tier = g.tier AND token IN ('ci', 'sich') GROUP BY 1),
first AS (SELECT coalesce(min(tier) FILTER (a >= 10 AND b >= 10), 5) AS f FROM own), upto AS (SELECT g.tier, count(DISTINCT doc_id) AS n FROM g LEFT JOIN tr ON tr.tier <= g.tier AND token IN ('ci', 'sich') GROUP BY 1),
stop AS (SELECT coalesce(min(tier) FILTER (n >= 10 AND tier >= f), 5) AS t FROM upto CROSS JOIN first)"""


@query(f"WITH {_POST}, {_TIERS} SELECT doc_id, round(sum(score), 6) AS score FROM tr CROSS JOIN stop WHERE token IN ('ci', 'sich') AND tier <= t GROUP BY 1")
def tiers_grow_until_enough(spark, sf_dir):
    return _engine(spark, sf_dir).tiered("ci or sich", 10).select("doc_id", r6(F.col("score"), "score"))


@query(f"WITH {_wide('er', 're', 'ou', 'st')} SELECT doc_id, round(coalesce(s_er, 0) + coalesce(s_ou, 0), 6) AS score FROM wide WHERE (s_er IS NOT NULL OR s_ou IS NOT NULL) AND s_st IS NULL")
def kept_posting_lists(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    engine.cache(2)
    engine.matches("er or re").count()  # keeps the lists of these two; the next query takes one of them again
    found = engine.matches("(er or ou) and not st")
    return found.select("doc_id", r6(F.col("score"), "score"))


@query(f"WITH {_POST} SELECT doc_id, round(count(DISTINCT token) FILTER (token IN ('er', 're', 'was')) / 5.0::DOUBLE, 6) AS ratio FROM docs LEFT JOIN tr USING (doc_id) GROUP BY 1")
def compat_token_ratio(spark, sf_dir):
    engine = _engine(spark, sf_dir, compat=True)  # its five tokens: er and re or was
    rows = engine.feature_rows("er re or was", engine.index.docs.select("doc_id", F.lit(None).cast("double").alias("similarity")))
    return rows.select("doc_id", r6(F.col("ratio_query_in_body"), "ratio"))


@query(f"WITH {_wide('er', 're', 'ou')} SELECT doc_id, round(s_ou, 6) AS score FROM wide WHERE s_ou IS NOT NULL AND NOT (s_er IS NOT NULL AND s_re IS NULL)")
def compat_negation(spark, sf_dir):
    return _engine(spark, sf_dir, compat=True).matches("(er and not re) and ou").select("doc_id", r6(F.col("score"), "score"))


# --- the re-ranker -----------------------------------------------------------------------------------
HIDDEN = 8


def _model(hidden: int = HIDDEN) -> ltr.ListNet:
    return ltr.ListNet(len(FEATURES), 0.1, np.zeros(len(FEATURES)), np.full(len(FEATURES), 10.0), hidden=hidden, seed=1)


def _network() -> str:
    """The network's layers as common table expressions over ``feat``."""
    m = _model()
    out, names, source = [], [f"({c} / 10.0::DOUBLE)" for c in FEATURES], "feat"
    for k, (w, b) in enumerate(zip(m.w, m.b, strict=True)):
        sums = [" + ".join([f"{float(b[j])!r}::DOUBLE", *(f"{float(w[i, j])!r}::DOUBLE * {x}" for i, x in enumerate(names))]) for j in range(w.shape[1])]
        if k == 3:
            return ", ".join(out) + f" SELECT query_id, doc_id, round({sums[0]}, 6) AS prediction FROM {source}"
        out.append(f"l{k} AS (SELECT query_id, doc_id, " + ", ".join(f"greatest(0, {x}) AS h{k}_{j}" for j, x in enumerate(sums)) + f" FROM {source})")
        names, source = [f"h{k}_{j}" for j in range(w.shape[1])], f"l{k}"
    raise AssertionError


@query(f"WITH {_FEATURES}, {_network()}")
def ltr_rerank(spark, sf_dir):
    return ltr.score(_features(spark, sf_dir), _model()).select("query_id", "doc_id", r6(F.col("prediction"), "prediction"))


@query(f"WITH {_FEATURES}, {_network()}")
def ltr_saved_model(spark, sf_dir):
    path = f"{checkpoint_dir(spark).removeprefix('file://')}/model-{uuid.uuid4().hex}"
    save_model(_model(), path, learning_rate=1e-3)
    return ltr.score(_features(spark, sf_dir), load_model(path)).select("query_id", "doc_id", r6(F.col("prediction"), "prediction"))


@query()
def ltr_rerank_full_width(spark, sf_dir):
    return ltr.score(_features(spark, sf_dir), _model(512)).select("query_id", "doc_id", r6(F.col("prediction"), "prediction"))


# --- the query language: known answers ---------------------------------------------------------------
def notation(tree: dict | None) -> str:
    """A tree on one line."""
    if tree is None:
        return "nothing"
    if not tree:
        return "{}"
    if tree["type"] == "token":
        return tree["value"]
    if tree["type"] == "phrase":
        return f"[{' '.join(tree['values'])}]"
    return f"{tree['operator']}({notation(tree['left'])}, {notation(tree['right'])})"


#: Query and its tree; words aren't stemmed.
TREES = [
    ("and", "nothing"), ("or", "nothing"), ("not", "nothing"), ('""', "nothing"), ('"and and"', "nothing"), ("apple", "apple"), ("apple and banana", "and(apple, banana)"), ("apple or banana", "or(apple, banana)"),
    ("not apple", "not({}, apple)"), ("apple banana", "and(apple, banana)"), ("apple and banana or cherry", "or(and(apple, banana), cherry)"), ("apple or banana and cherry", "or(apple, and(banana, cherry))"),
    ("not apple and banana", "and(not({}, apple), banana)"), ('"apple banana" and cherry', "and([apple banana], cherry)"), ("berlin and not (wall and blockade)", "and(berlin, not({}, and(wall, blockade)))"),
    ("( ) apple", "apple"), ("and apple or", "apple"), ("apple and or banana", "and(apple, banana)"), ('apple "banana cherry"', "and(apple, [banana cherry])"), ('"apple and banana"', "[apple banana]"), ('"apple"', "apple"), ("(apple) (banana)", "and(apple, banana)"),
]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values(TREES)}) t(query, tree)")
def query_trees(spark, sf_dir):
    return spark.createDataFrame([(q, notation(parse_query(q, stem=False))) for q, _ in TREES], "query string, tree string")


EXPLAINED = [
    ("apple", "apple|", "apple"), ("apple or banana and cherry", "OR|  apple|  AND|    banana|    cherry|", "apple banana cherry"),
    ('"apple banana" and not cherry', 'AND|  "apple banana"|  NOT|    cherry|', "apple banana cherry"), ("and", "", ""),
]


@query(f"SELECT query, replace(explained, '|', chr(10)) AS explained, words FROM (VALUES {_values(EXPLAINED)}) t(query, explained, words)")
def query_explanations(spark, sf_dir):
    rows = [(q, explain_query(tree), " ".join(leaves(tree))) for q, *_ in EXPLAINED for tree in [parse_query(q, stem=False)]]
    return spark.createDataFrame(rows, "query string, explained string, words string")


#: Text, as a query or not, and its stemmed tokens with their byte positions.
TOKENS = [
    ("hello, world! this is a test.", "false", "hello@0 world@7 test@24"),
    ('testing and (the tokenizer) with "special" characters!', "true", 'test@0 and@8 (@12 token@17 )@26 "@33 special@34 "@41 charact@43'),
]


@query(f"SELECT text, is_query, tokens FROM (VALUES {_values(TOKENS)}) t(text, is_query, tokens)")
def query_tokens(spark, sf_dir):
    made = [(t, q, " ".join(f"{w}@{p}" for w, p in zip(*tokenize_text(t, is_query=q == "true"), strict=True))) for t, q, _ in TOKENS]
    return spark.createDataFrame(made, "text string, is_query string, tokens string")


#: Words and their stems, from the algorithm's published sample vocabulary.
STEMS = [
    (word, stem_)
    for stem_, words in {
        "consign": "consign consigned consigning consignment", "consist": "consist consisted consistency consistent consistently consisting consists", "consol": "consolation consolations console consoled consoles consoling consolingly consols",
        "consolatori": "consolatory", "consolid": "consolidate consolidated consolidating", "conson": "consonant", "consort": "consort consorted consorting", "conspicu": "conspicuous conspicuously", "conspiraci": "conspiracy", "conspir": "conspirator conspirators conspire conspired conspiring",
        "constabl": "constable constables", "constanc": "constance constancy", "constant": "constant", "knack": "knack knacks", "knackeri": "knackeries", "knag": "knag", "knave": "knave knaves", "knavish": "knavish", "knead": "kneaded kneading", "knee": "knee knees", "kneel": "kneel kneeled kneeling kneels",
        "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight knights", "knit": "knit knits knitted knitting", "knive": "knives", "knob": "knob knobs", "knock": "knock knocked knocking knocks", "knocker": "knocker knockers", "knopp": "knopp", "knot": "knot knots",
    }.items()
    for word in words.split()
]


@query(f"SELECT word, stem, substr(word, 1, length(stem)) AS kept FROM (VALUES {_values(STEMS)}) t(word, stem)")
def stems(spark, sf_dir):
    return spark.createDataFrame([(w, stem(w), truncate(w)) for w, _ in STEMS], "word string, stem string, kept string")


# --- without SQL: stems of the corpus itself ---------------------------------------------------------
@query()
def stemmed_postings(spark, sf_dir):
    return ix.vocabulary(ix.document_postings(corpus(spark, sf_dir), stem=True))


@query()
def stemmed_exact_search(spark, sf_dir):
    i = index(spark, sf_dir, stem=True)
    return SearchEngine(spark, i.path).exact_search("er re or was").drop("body")
