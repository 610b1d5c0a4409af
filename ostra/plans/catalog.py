"""Registered queries over the retrieval operators, with the SQL that DuckDB runs on the same tables.

Scores are rounded to six places on both sides, ties go to the smaller doc_id, and every list is
joined to a string, so that values can be compared as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostra.functions.analysis import plain_tokens, token_positions, tokenized_documents
from ostra.operators import index as ix
from ostra.operators import ltr_dataset, metrics, postings, spelling
from ostra.operators.features import FEATURES, features, on_the_fly_bm25
from ostra.operators.search import characters_before, fetch, first_places, hybrid, snippet, top_k
from ostra.operators.vector import dot, gather
from ostra.plans.boolean import evaluate
from ostra.plans.query_language import parse_query
from ostra.session import bound_batches, checkpoint_dir, ship, spread
from ostra.sources.corpus import TAG, UNSEEN, documents_corpus, pages_corpus
from ostra.sources.store import concat_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_paths: dict[tuple[str, str, bool], str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def index(spark: SparkSession, sf_dir: str, stem: bool = False) -> ix.Index:
    """The index of the documents, built once an application in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, stem)
    if key not in _paths:
        path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        ix.build_index(corpus(spark, sf_dir), path, stem)
        _paths[key] = path
    return ix.Index(spark, _paths[key])


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, df): of the index, if the application has one, else of the documents, as no posting is needed."""
    if (spark.sparkContext.applicationId, sf_dir, False) in _paths:
        return index(spark, sf_dir).vocab.select("token", "df")
    return ix.document_frequencies(corpus(spark, sf_dir))


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# --- the SQL that all oracles build on -------------------------------------------------------------
_STOP = ",".join(f"'{w}'" for w in "a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we when will with yet you your".split())
_DOCS = """docs AS (SELECT doc_id, 'doc://' || source || '/' || doc_id AS url, split_part(text, chr(10), 1) AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM documents)"""
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOK = f"""{_DOCS},
fld AS (SELECT doc_id, 0 AS field, regexp_extract_all({_LOW.format('title')}, '[a-z0-9]+|[^a-z0-9]+') AS segs FROM docs
  UNION ALL SELECT doc_id, 1, regexp_extract_all({_LOW.format('body')}, '[a-z0-9]+|[^a-z0-9]+') FROM docs),
seg AS (SELECT doc_id, field, unnest(segs) AS token, generate_subscripts(segs, 1) AS ord, len(segs) AS n FROM fld),
pos AS (SELECT *, coalesce(sum(strlen(token)) OVER (PARTITION BY doc_id, field ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS position,
  coalesce(sum(length(token)) OVER (PARTITION BY doc_id, field ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS place FROM seg),
raw AS (SELECT doc_id, field, token, position, place FROM pos WHERE regexp_full_match(token, '[a-z]{{1,50}}|[0-9]{{1,4}}') OR (ord = n AND regexp_matches(token, '^[a-z0-9]'))),
tok AS (SELECT * FROM raw WHERE token NOT IN ({_STOP}))"""
_POST = f"""{_TOK},
lens AS (SELECT d.doc_id, count(t.token) FILTER (field = 0) AS len_title, count(t.token) FILTER (field = 1) AS len_body FROM docs d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
post AS (SELECT token, doc_id, count(*) FILTER (field = 0) AS tf_title, count(*) FILTER (field = 1) AS tf_body, list(position ORDER BY field, position) AS positions FROM tok GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len_title) AS avt, avg(len_body) AS avb FROM lens),
voc AS (SELECT token, count(*) AS df, sum(tf_title + tf_body)::BIGINT AS cf FROM post GROUP BY 1),
w AS (SELECT p.*, len_title, len_body, df, n, avt, avb, tf_title * 1.0 / (1 + 0.75 + 0.25 * coalesce(len_title / nullif(avt, 0), 0)) + tf_body * 0.5 / (1 + 0.75 + 0.25 * coalesce(len_body / nullif(avb, 0), 0)) AS tf
  FROM post p JOIN lens USING (doc_id) JOIN voc USING (token) CROSS JOIN st),
sc AS (SELECT *, ln((n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5)) AS score FROM w),
tr AS (SELECT *, CASE WHEN score >= 20 THEN 0 WHEN score >= 15 THEN 1 WHEN score >= 10 THEN 2 WHEN score >= 5 THEN 3 WHEN score >= 2.5 THEN 4 ELSE 5 END AS tier FROM sc)"""


def _wide(*tokens: str) -> str:
    """Scores and positions of tokens side by side."""
    cols = ", ".join(f"max(CASE WHEN token = '{t}' THEN score END) AS s_{t}, max(CASE WHEN token = '{t}' THEN positions END) AS p_{t}" for t in tokens)
    return f"{_POST}, wide AS (SELECT doc_id, {cols} FROM tr WHERE token IN ({','.join(repr(t) for t in tokens)}) GROUP BY 1)"


def _snippets(best: str, at: str, columns: str) -> str:
    """The rows of ``best`` with the snippet about the character ``p`` of ``at``, in steps that cut the window to whole words."""
    return f"""p AS (SELECT b.*, url, title, body, length(body) AS n, greatest(coalesce(a.p, 1), 1) AS p FROM {best} b JOIN docs USING (doc_id) LEFT JOIN {at} a USING (doc_id)),
s AS (SELECT *, CASE WHEN p >= 100 THEN p - 100 ELSE 1 END AS s0 FROM p), e AS (SELECT *, CASE WHEN s0 + 200 < n THEN s0 + 200 ELSE n END AS e0 FROM s),
f AS (SELECT *, instr(substr(body, s0 + 1, greatest(e0 - s0, 0)), ' ') AS sp FROM e), g AS (SELECT *, CASE WHEN s0 <> 0 AND sp > 0 THEN s0 + sp ELSE s0 END AS s1 FROM f),
h AS (SELECT *, substr(body, s1 + 2, greatest(e0 - s1, 0)) AS tail FROM g), k AS (SELECT *, CASE WHEN e0 <> n AND instr(reverse(tail), ' ') > 0 THEN s1 + 1 + length(tail) - instr(reverse(tail), ' ') ELSE e0 END AS e1 FROM h)
SELECT {columns}, substr(body, s1 + 1, greatest(e1 - s1, 0)) AS snippet FROM k"""


def _first_place(*tokens: str) -> str:
    return f"spot AS (SELECT doc_id, min(place) AS p FROM tok WHERE field = 1 AND token IN ({','.join(repr(t) for t in tokens)}) GROUP BY 1)"


def _near(a: str, b: str) -> str:
    return f"EXISTS (SELECT 1 FROM (SELECT unnest(p_{a}) AS x), (SELECT unnest(p_{b}) AS y) WHERE y - x BETWEEN 0 AND 10)"


# --- sources and analysis --------------------------------------------------------------------------
@query(f"WITH {_DOCS} SELECT doc_id, url, title, strlen(body)::BIGINT AS body_bytes FROM docs")
def corpus_scan(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "url", "title", F.octet_length("body").cast("long").alias("body_bytes"))


@query(f"WITH {_DOCS} SELECT doc_id, {_LOW.format('title')} AS title FROM docs WHERE doc_id IN (3, 17, 256)")
def document_lookup(spark, sf_dir):
    from ostra.functions.analysis import ascii_lower
    from ostra.sources.corpus import get_documents

    return get_documents(corpus(spark, sf_dir), [3, 17, 256], lambda d: d.select("doc_id", ascii_lower(F.col("title")).alias("title")))


@query(
    f"""WITH p AS (SELECT page_id AS doc_id, url, regexp_extract(html, '<title>(.*?)(?:</title>|\\z)', 1, 'is') AS title,
  regexp_replace(regexp_replace(html, '{UNSEEN}', ' ', 'gis'), '{TAG}', ' ', 'gs') AS b FROM pages)
SELECT doc_id, url, title, md5(trim(regexp_replace(b, '[ \\t\\r\\n]+', ' ', 'g'))) AS body_md5 FROM p"""
)
def pages_as_corpus(spark, sf_dir):
    return pages_corpus(table(spark, sf_dir, "pages")).select("doc_id", "url", "title", F.md5("body").alias("body_md5"))


@query(f"WITH {_TOK} SELECT token, count(*) AS n FROM raw GROUP BY 1")
def tokenize_documents(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.select(F.explode(F.concat(plain_tokens(F.col("title")), plain_tokens(F.col("body")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_TOK} SELECT doc_id, token, position, field FROM tok")
def token_byte_positions(spark, sf_dir):
    return token_positions(corpus(spark, sf_dir))


@query(f"WITH {_TOK} SELECT token, count(*) AS n FROM raw WHERE token IN ({_STOP}) GROUP BY 1")
def stopwords_removed(spark, sf_dir):
    from ostra.functions.analysis import STOPWORDS

    docs = corpus(spark, sf_dir)
    tokens = docs.select(F.explode(F.concat(plain_tokens(F.col("title")), plain_tokens(F.col("body")))).alias("token"))
    return tokens.where(F.col("token").isin(*STOPWORDS)).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_POST} SELECT doc_id, len_title::INT AS len_title, len_body::INT AS len_body FROM lens")
def document_field_lengths(spark, sf_dir):
    return ix.doc_stats(tokenized_documents(corpus(spark, sf_dir)))


@query(f"WITH {_TOK}, f AS (SELECT token, min(doc_id * 100000000000 + field * 10000000000 + position) AS seen FROM tok GROUP BY 1) SELECT token, row_number() OVER (ORDER BY seen) - 1 AS token_id FROM f")
def first_seen_token_ids(spark, sf_dir):
    return ix.first_seen_ids(ix.document_postings(corpus(spark, sf_dir)))


@query("SELECT item_id AS id, item_id * 10 + 1 AS payload, text || '|' || md5(text) AS data FROM benchmark")
def keyed_parts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    parts = b.select(F.col("item_id").alias("id"), F.lit(0).alias("part"), (F.col("item_id") * 10).alias("payload"), F.concat("text", F.lit("|")).alias("data")).unionByName(
        b.select(F.col("item_id").alias("id"), F.lit(1).alias("part"), (F.col("item_id") * 10 + 1).alias("payload"), F.md5("text").alias("data"))
    )
    return concat_parts(parts)


# --- the index --------------------------------------------------------------------------------------
@query(f"WITH {_POST} SELECT token, doc_id, tf_title::INT AS tf_title, tf_body::INT AS tf_body, array_to_string(positions, ',') AS positions FROM post")
def postings_build(spark, sf_dir):
    p = ix.document_postings(corpus(spark, sf_dir))
    return p.select("token", "doc_id", "tf_title", "tf_body", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {_POST} SELECT token, df, cf FROM voc")
def vocabulary_df(spark, sf_dir):
    return ix.vocabulary(ix.document_postings(corpus(spark, sf_dir)))


@query(f"WITH {_POST} SELECT tier, count(*) AS postings, count(DISTINCT token) AS tokens FROM tr GROUP BY 1")
def index_build(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"  # always a new one
    ix.build_index(corpus(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/postings").groupBy("tier").agg(F.count("*").alias("postings"), F.count_distinct("token").alias("tokens"))


@query(f"WITH {_POST} SELECT n AS num_documents, round(avt, 6) AS avg_title, round(avb, 6) AS avg_body, (SELECT count(*) FROM post) AS num_postings FROM st")
def collection_statistics(spark, sf_dir):
    i = index(spark, sf_dir)
    m = i.meta
    return spark.createDataFrame([(m["num_documents"], round(i.averages[0], 6), round(i.averages[1], 6), m["num_postings"])], "num_documents long, avg_title double, avg_body double, num_postings long")


@query(f"WITH {_POST} SELECT token, doc_id, round(score, 6) AS score, tier FROM tr")
def bm25f_scores_and_tiers(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/scores-{uuid.uuid4().hex}"
    ix.save(tokenized_documents(corpus(spark, sf_dir)), f"{path}/forward")
    t = spark.read.parquet(f"{path}/forward")
    p = ix.explode_terms(t)
    ix.save(ix.vocabulary(p), f"{path}/vocab")
    return ix.score_postings(p, spark.read.parquet(f"{path}/vocab"), ix.doc_stats(t)).select("token", "doc_id", r6(F.col("score"), "score"), "tier")


@query(f"WITH {_POST} SELECT token, tier, count(*) AS n FROM tr GROUP BY 1, 2")
def tier_posting_counts(spark, sf_dir):
    return ix.tier_counts(index(spark, sf_dir).postings)


@query(f"WITH {_POST}, g AS (SELECT tier FROM generate_series(0, 5) t(tier)), c AS (SELECT g.tier, count(*) FILTER (token = 'en') AS a, count(*) FILTER (token = 'er') AS b FROM g LEFT JOIN tr ON tr.tier = g.tier AND token IN ('en', 'er') GROUP BY 1) SELECT coalesce(min(tier) FILTER (a >= 10 AND b >= 10), 5)::INT AS tier FROM c")
def tier_choice(spark, sf_dir):
    t = ix.min_tier(ix.tier_counts(index(spark, sf_dir).postings), ["en", "er"], 10)
    return spark.createDataFrame([(t,)], "tier int")


# --- posting lists -----------------------------------------------------------------------------------
@query(f"WITH {_POST} SELECT doc_id, round(score, 6) AS score, positions[1] AS first_pos FROM tr WHERE token = 'was'")
def term_lookup(spark, sf_dir):
    return postings.posting_list(index(spark, sf_dir).postings, "was").select("doc_id", r6(F.col("total"), "score"), "first_pos")


def _lists(spark, sf_dir):
    p = index(spark, sf_dir).postings
    return postings.posting_list(p, "er"), postings.posting_list(p, "re")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.array_join("tokens", " ").alias("tokens"), r6(F.col("total"), "total"), "first_pos")


_AB = f"{_POST}, a AS (SELECT * FROM tr WHERE token = 'er'), b AS (SELECT * FROM tr WHERE token = 're')"


@query(f"WITH {_AB} SELECT a.doc_id, 'er re' AS tokens, round(a.score + b.score, 6) AS total, a.positions[1] AS first_pos FROM a JOIN b USING (doc_id)")
def posting_intersection(spark, sf_dir):
    return _shown(postings.intersection(*_lists(spark, sf_dir)))


@query(f"WITH {_AB} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, concat_ws(' ', a.token, b.token) AS tokens, round(coalesce(a.score, 0) + coalesce(b.score, 0), 6) AS total, coalesce(a.positions[1], b.positions[1]) AS first_pos FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def posting_union(spark, sf_dir):
    return _shown(postings.union(*_lists(spark, sf_dir)))


@query(f"WITH {_AB} SELECT doc_id, 'er' AS tokens, round(score, 6) AS total, positions[1] AS first_pos FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def posting_difference(spark, sf_dir):
    return _shown(postings.difference(*_lists(spark, sf_dir)))


@query(f"""WITH {_AB}, m AS (SELECT a.doc_id, round(a.score + b.score, 6) AS total, a.positions AS pa, b.positions AS pb FROM a JOIN b USING (doc_id)),
x AS (SELECT doc_id, total, unnest(pa) AS x, pb FROM m), y AS (SELECT doc_id, total, x, unnest(pb) AS y FROM x)
SELECT doc_id, 'er re' AS tokens, total, min(x)::INT AS first_pos FROM y WHERE y - x BETWEEN 0 AND 10 GROUP BY 1, 2, 3""")
def posting_phrase(spark, sf_dir):
    return _shown(postings.intersection_phrase(*_lists(spark, sf_dir)))


# --- Boolean queries and ranking ---------------------------------------------------------------------
def _matches(spark, sf_dir, text: str, **options) -> DataFrame:
    i = index(spark, sf_dir)
    return evaluate(i.postings, parse_query(text, stem=False), i.docs.select("doc_id"), **options).select("doc_id", r6(F.col("score"), "score"))


@query(f"WITH {_wide('er', 're', 'ou', 'st')} SELECT doc_id, round(CASE WHEN s_er IS NOT NULL AND s_re IS NOT NULL THEN s_er + s_re ELSE 0 END + CASE WHEN s_ou IS NOT NULL AND s_st IS NULL THEN s_ou ELSE 0 END, 6) AS score FROM wide WHERE (s_er IS NOT NULL AND s_re IS NOT NULL) OR (s_ou IS NOT NULL AND s_st IS NULL)")
def boolean_nested(spark, sf_dir):
    return _matches(spark, sf_dir, "(er and re) or (ou and not st)")


@query(f"WITH {_wide('er', 're')} SELECT d.doc_id, round(coalesce(s_er, 0), 6) AS score FROM docs d LEFT JOIN wide USING (doc_id) WHERE s_er IS NOT NULL OR s_re IS NULL")
def boolean_not_strict(spark, sf_dir):
    return _matches(spark, sf_dir, "er or not re")


@query(f"WITH {_wide('er', 're', 'ou')} SELECT doc_id, round(s_ou, 6) AS score FROM wide WHERE s_ou IS NOT NULL AND NOT (s_er IS NOT NULL AND s_re IS NULL)")
def boolean_not_compat(spark, sf_dir):
    return _matches(spark, sf_dir, "(er and not re) and ou", compat=True)


@query(f"WITH {_wide('er', 're', 'ou')} SELECT doc_id, round(s_er + s_re + s_ou, 6) AS score FROM wide WHERE s_er IS NOT NULL AND s_re IS NOT NULL AND s_ou IS NOT NULL AND {_near('er', 're')}")
def phrase_match(spark, sf_dir):
    return _matches(spark, sf_dir, '"er re" ou')


_EXACT = f"""{_wide('er', 're', 'was')}, hit AS (SELECT doc_id, round(CASE WHEN s_er IS NOT NULL AND s_re IS NOT NULL THEN s_er + s_re ELSE 0 END + coalesce(s_was, 0), 6) AS score, p_er, p_re, p_was FROM wide WHERE (s_er IS NOT NULL AND s_re IS NOT NULL) OR s_was IS NOT NULL),
best AS (SELECT * FROM hit ORDER BY score DESC, doc_id LIMIT 10)"""


@query(f"WITH {_EXACT} SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM best")
def exact_topk(spark, sf_dir):
    from pyspark.sql.window import Window

    best = top_k(_matches(spark, sf_dir, "er re or was"), 10)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")


@query(f"WITH {_POST} SELECT doc_id, round(sum(score), 6) AS score FROM tr WHERE token IN ('ci', 'los') AND tier <= 4 GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 10")
def tier_pruned_topk(spark, sf_dir):
    return top_k(_matches(spark, sf_dir, "ci and los", max_tier=4), 10)


@query(f"WITH {_EXACT}, {_first_place('er', 're', 'was')}, {_snippets('best', 'spot', 'doc_id, score, url, title')}")
def documents_with_snippets(spark, sf_dir):
    i = index(spark, sf_dir)
    best = top_k(_matches(spark, sf_dir, "er re or was"), 10)
    at = first_places(i.postings, parse_query("er re or was", stem=False), best)
    shown = snippet(F.col("body"), characters_before(F.col("body"), F.col("at")))
    return fetch(i.docs, best).join(at, "doc_id", "left").select("doc_id", "score", "url", "title", shown.alias("snippet"))


# --- vectors and hybrid ------------------------------------------------------------------------------
_SIM = """q AS (SELECT embedding FROM embeddings WHERE vec_id = 7), sim AS (SELECT vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e CROSS JOIN q WHERE vec_id <> 7),
near AS (SELECT * FROM sim ORDER BY similarity DESC, doc_id LIMIT 50)"""


def _nearest(spark, sf_dir, k: int = 50) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    q = vectors.where("vec_id = 7").first().embedding
    scored = vectors.where("vec_id <> 7").select(F.col("vec_id").alias("doc_id"), r6(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), "similarity"))
    return top_k(scored, k, "similarity")


@query(f"WITH {_SIM} SELECT doc_id, similarity FROM near ORDER BY similarity DESC, doc_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return _nearest(spark, sf_dir, 10)


@query("SELECT vec_id AS doc_id, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE, 4)::DECIMAL(9, 4)), ',') AS embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def embedding_gather(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id")
    shown = F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("decimal(9,4)").cast("string"))
    return gather(table(spark, sf_dir, "embeddings"), ids).select("doc_id", F.array_join(shown, ",").alias("embedding"))


@query(f"WITH {_EXACT}, {_SIM}, ex AS (SELECT doc_id, score FROM hit ORDER BY score DESC, doc_id LIMIT 50) SELECT coalesce(ex.doc_id, near.doc_id) AS doc_id, coalesce(score, 0) AS score, CASE WHEN ex.doc_id IS NOT NULL AND near.doc_id IS NOT NULL THEN 'exact & semantic' WHEN ex.doc_id IS NOT NULL THEN 'exact' ELSE 'semantic' END AS source, coalesce(similarity, -1) AS similarity FROM ex FULL JOIN near ON ex.doc_id = near.doc_id")
def hybrid_sources(spark, sf_dir):
    return hybrid(top_k(_matches(spark, sf_dir, "er re or was"), 50), _nearest(spark, sf_dir))


# --- features and learning to rank -------------------------------------------------------------------
def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("query_id"), F.col("vec_id").alias("doc_id"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("similarity")).join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_ASKED = [(0, ["er", "re"]), (1, ["ou", "ou", "st"]), (2, ["was"]), (3, ["en", "es", "nosuchword"]), (4, ["re", "st", "en"])]
_FEATURES = f"""{_POST}, asked AS (SELECT * FROM (VALUES {', '.join(f"({q}::BIGINT, '{t}', {len(ts)})" for q, ts in _ASKED for t in dict.fromkeys(ts))}) v(query_id, token, n_tokens)),
pairs AS (SELECT vec_id % 5 AS query_id, vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) AS similarity FROM embeddings JOIN documents ON vec_id = doc_id),
h AS (SELECT query_id, doc_id, n_tokens, positions[1] AS first_pos, ln((n - df + 0.5) / (df + 0.5)) AS idf, tf_title, tf_body, tf_title * 2.5 / (tf_title + 1.5 * (0.25 + 0.75 * len_title / avt)) AS t, tf_body * 2.5 / (tf_body + 1.5 * (0.25 + 0.75 * len_body / avb)) AS b FROM tr JOIN asked USING (token) JOIN pairs USING (query_id, doc_id)),
g AS (SELECT query_id, doc_id, sum(CASE WHEN tf_title > 0 THEN idf * t ELSE 0 END) AS bt, sum(CASE WHEN tf_body > 0 THEN idf * b ELSE 0 END) AS bb, count(*) / max(n_tokens) AS ratio, min(first_pos) AS fp FROM h GROUP BY 1, 2),
feat AS (SELECT p.query_id, p.doc_id, round(coalesce(bt, 0), 6) AS bm25_title, round(coalesce(bb, 0), 6) AS bm25_body, len_title::DOUBLE AS title_length, len_body::DOUBLE AS body_length, round(coalesce(ratio, 0), 6) AS ratio_query_in_title, round(coalesce(ratio, 0), 6) AS ratio_query_in_body, coalesce(fp, -1)::DOUBLE AS first_occurrence_body, similarity AS similarity_score FROM pairs p JOIN lens USING (doc_id) LEFT JOIN g ON g.query_id = p.query_id AND g.doc_id = p.doc_id)"""


def _features(spark, sf_dir) -> DataFrame:
    i = index(spark, sf_dir)
    rows = features(i.postings, i.stats, i.num_documents, i.averages, spark.createDataFrame(_ASKED, "query_id long, tokens array<string>"), _pairs(spark, sf_dir))
    return rows.select("query_id", "doc_id", *[r6(F.col(c), c) for c in FEATURES])


@query(f"WITH {_FEATURES} SELECT * FROM feat")
def ltr_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query(f"WITH {_FEATURES} SELECT query_id, doc_id, round(bm25_title + 0.5 * bm25_body, 4) AS score FROM feat")
def on_the_fly_scores(spark, sf_dir):
    return _features(spark, sf_dir).select("query_id", "doc_id", F.round(on_the_fly_bm25(), 4).alias("score"))


@query(f"WITH {_FEATURES}, u AS (UNPIVOT (SELECT {', '.join(FEATURES)} FROM feat) ON COLUMNS(*) INTO NAME feature VALUE v) SELECT feature, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM u GROUP BY 1")
def feature_mean_std(spark, sf_dir):
    return ltr_dataset.feature_stats(_features(spark, sf_dir), FEATURES).select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


# the retrieval log: benchmark items ask for documents of the whole table; some documents have an external id of another
# form, and the candidates come again from rank 61 on
_LTR = """qs AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), nd AS (SELECT count(*) AS nd FROM documents),
mp AS (SELECT 'D' || doc_id AS doc_id, doc_id AS our_id FROM documents WHERE source <> 'src1'),
qr AS (SELECT query_id, 'D' || (query_id * 37 % nd) AS doc_id FROM qs CROSS JOIN nd),
tp AS (SELECT q.query_id, 'D' || ((q.query_id * 37 + (r % 60) * 11 - 22) % nd) AS doc_id, r::INT AS rank FROM qs q CROSS JOIN nd CROSS JOIN generate_series(2, 100) t(r)),
po AS (SELECT query_id, query_text, doc_id, our_id, 1 AS rank FROM qs JOIN qr USING (query_id) JOIN mp USING (doc_id)),
ca AS (SELECT query_id, query_text, doc_id, our_id, rank FROM tp JOIN mp USING (doc_id) JOIN qs USING (query_id) WHERE rank <= 75 AND (query_id, our_id) NOT IN (SELECT (query_id, our_id) FROM po)),
al AS (SELECT *, 0 AS f FROM po UNION ALL SELECT *, 1 FROM ca), rk AS (SELECT query_id, our_id, query_text, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, f, our_id)::INT AS rank FROM al),
ids AS (SELECT * FROM rk WHERE rank <= 50)"""


def _log(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    external = F.concat(F.when(F.col("source") == "src1", "X").otherwise("D"), F.col("doc_id"))
    mapping = ltr_dataset.build_id_mapping(docs.select(external.alias("external_id"), "doc_id"))
    qrels = queries.select("query_id", F.concat(F.lit("D"), F.col("query_id") * 37 % n).alias("doc_id"))
    ranked = queries.select("query_id", F.explode(F.sequence(F.lit(2), F.lit(100))).alias("rank"))
    top = ranked.select("query_id", F.concat(F.lit("D"), (F.col("query_id") * 37 + F.col("rank") % 60 * 11 - 22) % n).alias("doc_id"), "rank")
    return queries, qrels, top, mapping


@query("WITH m AS (SELECT CASE WHEN source = 'src1' THEN 'X' ELSE 'D' END || doc_id AS doc_id, doc_id AS our_id FROM documents) SELECT * FROM m WHERE regexp_full_match(doc_id, 'D[0-9]+')")
def ltr_id_mapping(spark, sf_dir):
    return _log(spark, sf_dir)[3]


@query(f"WITH {_LTR} SELECT * FROM po")
def ltr_qrels_join(spark, sf_dir):
    queries, qrels, _, mapping = _log(spark, sf_dir)
    return ltr_dataset.positives(queries, qrels, mapping)


@query(f"WITH {_LTR} SELECT * FROM ca")
def ltr_candidates_anti(spark, sf_dir):
    queries, qrels, top, mapping = _log(spark, sf_dir)
    return ltr_dataset.candidate_rows(top, queries, mapping, ltr_dataset.positives(queries, qrels, mapping))


@query(f"WITH {_LTR} SELECT * FROM ids")
def ltr_rank_cumcount(spark, sf_dir):
    queries, qrels, top, mapping = _log(spark, sf_dir)
    return ltr_dataset.build_ltr_ids(queries, qrels, top, mapping)


@query(f"WITH {_LTR} SELECT query_id, our_id, count(*) AS n FROM al GROUP BY 1, 2 HAVING count(*) > 1")
def ltr_duplicates(spark, sf_dir):
    queries, qrels, top, mapping = _log(spark, sf_dir)
    positive = ltr_dataset.positives(queries, qrels, mapping)
    return ltr_dataset.duplicates(positive.unionByName(ltr_dataset.candidate_rows(top, queries, mapping, positive)))


_CONV = """c AS (SELECT conv_id AS query_id, turn::INT + 1 AS rank, conv_id * 100 + turn AS doc_id, (conv_id * 31 + turn * 17) % 23 / 7.0::DOUBLE AS prediction FROM conversations), k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM c),
ds AS (SELECT query_id, doc_id, rank, prediction, max(rank) OVER (PARTITION BY query_id) - rank + 1 AS relevance, dense_rank() OVER (ORDER BY query_id) - 1 AS query_index FROM k WHERE n = 6)"""


def _ranked(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn").cast("int") + 1).alias("rank"), (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), ((F.col("conv_id") * 31 + F.col("turn") * 17) % 23 / 7.0).alias("prediction"))
    return ltr_dataset.ranking_dataset(c, 6)


@query(f"WITH {_CONV} SELECT query_id, doc_id, rank, relevance, query_index FROM ds")
def ltr_relevance(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "doc_id", "rank", "relevance", "query_index")


@query(f"WITH {_CONV}, m AS (SELECT count(DISTINCT query_id) AS m FROM ds) SELECT query_id, doc_id, CASE WHEN query_index < floor(m * 0.8) THEN 'train' WHEN query_index < floor(m * 0.8) + floor(m * 0.1) THEN 'validation' ELSE 'test' END AS split FROM ds CROSS JOIN m")
def ltr_split(spark, sf_dir):
    return ltr_dataset.split_dataset(_ranked(spark, sf_dir).drop("query_index")).select("query_id", "doc_id", "split")


@query(f"WITH {_CONV} SELECT query_id, count(*) AS n FROM ds GROUP BY 1")
def ltr_groups(spark, sf_dir):
    return ltr_dataset.groups(_ranked(spark, sf_dir))


@query(f"WITH {_CONV}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prediction DESC, doc_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS i FROM ds), d AS (SELECT query_id, sum(CASE WHEN p <= 5 THEN (pow(2, relevance) - 1) / log2(p + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 THEN (pow(2, relevance) - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM p GROUP BY 1) SELECT round(avg(dcg / (idcg + 1e-8)), 6) AS ndcg FROM d")
def ndcg(spark, sf_dir):
    return metrics.ndcg_at_k(_ranked(spark, sf_dir), 5).select(r6(F.col("ndcg"), "ndcg"))


@query(f"WITH {_CONV}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prediction DESC, doc_id) AS p, max(relevance) OVER (PARTITION BY query_id) AS top FROM ds), f AS (SELECT query_id, min(CASE WHEN relevance = top AND p <= 5 THEN p END) AS a FROM p GROUP BY 1) SELECT round(avg(coalesce(1.0::DOUBLE / a, 0)), 6) AS mrr FROM f")
def mrr(spark, sf_dir):
    return metrics.mrr_at_k(_ranked(spark, sf_dir), 5).select(r6(F.col("mrr"), "mrr"))


@query(f"WITH {_CONV}, s AS (SELECT query_id, exp(relevance / 0.7::DOUBLE) / sum(exp(relevance / 0.7::DOUBLE)) OVER w AS t, prediction - ln(sum(exp(prediction)) OVER w) AS l FROM ds WINDOW w AS (PARTITION BY query_id)), q AS (SELECT query_id, -sum(t * l) AS loss FROM s GROUP BY 1) SELECT round(avg(loss), 6) AS loss FROM q")
def listwise_softmax_loss(spark, sf_dir):
    return metrics.listwise_loss(_ranked(spark, sf_dir), 0.7).select(r6(F.col("loss"), "loss"))


# --- spelling ----------------------------------------------------------------------------------------
_GRAMS = f"{_POST}, v AS (SELECT token, df, '$' || token || '$' AS p FROM voc WHERE df >= 20), kg AS (SELECT token, df, substr(p, i::INT, 2) AS bigram, count(*) AS n FROM (SELECT *, unnest(generate_series(1, length(token) + 1)) AS i FROM v) GROUP BY 1, 2, 3)"
_WORDS = ["thea", "onn", "ered", "ingg"]
_CAND = f"""{_GRAMS}, wd AS (SELECT * FROM (VALUES {', '.join(f"('{w}')" for w in _WORDS)}) x(word)), wg AS (SELECT word, substr('$' || word || '$', i::INT, 2) AS bigram, count(*) AS m FROM (SELECT word, unnest(generate_series(1, length(word) + 1)) AS i FROM wd) GROUP BY 1, 2),
cd AS (SELECT word, token, df, sum(least(n, m)) AS c FROM kg JOIN wg USING (bigram) WHERE word <> token GROUP BY 1, 2, 3), jc AS (SELECT word, token, df, round(c / (length(word) + length(token) + 2 - c), 6) AS jaccard FROM cd)"""


@query(f"WITH {_GRAMS} SELECT bigram, token, n, df FROM kg")
def kgram_index(spark, sf_dir):
    return spelling.kgram_index(frequencies(spark, sf_dir), 20)


@query(f"WITH {_CAND} SELECT * FROM jc")
def spelling_candidates(spark, sf_dir):
    found = spelling.candidates(spelling.kgram_index(frequencies(spark, sf_dir), 20), _WORDS)
    return found.select("word", "token", "df", r6(F.col("jaccard"), "jaccard"))


@query(f"WITH {_CAND} SELECT word, token AS suggestion, df, jaccard FROM jc WHERE jaccard >= 0.3 QUALIFY row_number() OVER (PARTITION BY word ORDER BY jaccard DESC, df DESC, token) = 1")
def spelling_top(spark, sf_dir):
    found = spelling.suggestions(spelling.kgram_index(frequencies(spark, sf_dir), 20), _WORDS, 0.3)
    return found.select("word", "suggestion", "df", r6(F.col("jaccard"), "jaccard"))


# further queries, which build on this module's helpers
from ostra.plans import catalog_search, catalog_sources  # noqa: E402, F401
