from hypothesis import given
from hypothesis import strategies as st
from ostra.functions.analysis import STOPWORDS, plain_tokens, token_positions, tokenize_text, tokenized_documents
from ostra.functions.stemmer import stem, truncate
from pyspark.sql import functions as F


def test_golden_tokens():
    assert tokenize_text("hello, world! this is a test.") == (["hello", "world", "test"], [0, 7, 24])
    tokens, positions = tokenize_text('testing and (the tokenizer) with "special" characters!', is_query=True)
    assert tokens == ["test", "and", "(", "token", ")", '"', "special", '"', "charact"]
    assert positions == [0, 8, 12, 17, 26, 33, 34, 41, 43]


def test_stems():
    pairs = {
        "characters": "charact", "testing": "test", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre",
        "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "relational": "relat", "generously": "generous", "communism": "communism", "happy": "happi", "by": "by",
        "say": "say", "knightly": "knight", "consign": "consign", "consistency": "consist", "knots": "knot", "skies": "sky", "news": "news", "inning": "inning", "proceed": "proceed",
        "electrical": "electr", "hopefulness": "hope", "formalize": "formal", "adjustable": "adjust", "controlling": "control", "rate": "rate", "sensational": "sensat",
    }
    assert {w: stem(w) for w in pairs} == pairs
    assert [truncate(w) for w in ("cherry", "apple", "blockade")] == ["cherry", "appl", "blockad"]


def slow(field):
    """Tokens of a field by walking its bytes."""
    raw, out, i = field.lower() if isinstance(field, bytes) else field.encode().lower(), [], 0
    ok = lambda b: chr(b).isascii() and chr(b).isalnum()
    while i < len(raw):
        j = i
        while j < len(raw) and ok(raw[j]):
            j += 1
        if j > i:
            run = raw[i:j].decode()
            if j == len(raw) or (run.isalpha() and len(run) <= 50) or (run.isdigit() and len(run) <= 4):
                out.append((run, i))
        i = max(j, i + 1)
    return out


@given(st.text(alphabet="abzZ019 .é\n", max_size=40))
def test_scanner(text):
    assert tokenize_text(text, stem=False) == ([w for w, _ in slow(text) if w not in STOPWORDS], [p for w, p in slow(text) if w not in STOPWORDS])


ODD = ["abc123", "abc123 x", "12345 1234", "12345", "x" * 51 + " y", "x" * 51, "Größe naïve", "", None, "the of and", "a\nb"]


def test_native_tokens_are_the_same(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, t string")
    got = {r.i: r.w for r in df.select("i", plain_tokens(F.col("t")).alias("w")).collect()}
    assert got == {i: [w for w, _ in slow(t or "")] for i, t in enumerate(ODD)}


def test_documents(spark):
    docs = spark.createDataFrame([(1, "cat Dog", "dog été dog cat9"), (2, None, None), (3, "", "the")], "doc_id long, title string, body string")
    rows = {(r.doc_id, r.token, r.field, r.position) for r in token_positions(docs).collect()}
    assert rows == {(1, "cat", 0, 0), (1, "dog", 0, 4), (1, "dog", 1, 0), (1, "t", 1, 6), (1, "dog", 1, 10), (1, "cat9", 1, 14)}
    lens = {r.doc_id: (r.len_title, r.len_body) for r in tokenized_documents(docs).collect()}
    assert lens == {1: (2, 4), 2: (0, 0), 3: (0, 0)}


def test_a_worker_analyses_a_batch_in_small_pieces(spark):
    import pyarrow as pa
    from ostra.functions.analysis import pieces
    from ostra.plans.catalog import table

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "title": ["a", None, "", "é", "t"], "body": ["x" * 5, "y" * 20, None, "z", "w" * 3]})
    ids = lambda b, most: [x.column(0).to_pylist() for x in pieces(b, ("title", "body"), most)]
    assert ids(batch, 10) == [[1], [2], [3, 4, 5]] and ids(batch, 1000) == [[1, 2, 3, 4, 5]]
    assert ids(batch.slice(2, 3), 3) == [[3, 4], [5]] and ids(batch.slice(0, 0), 3) == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    table(spark, "/root/testdata/sf0.001", "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
    rows = [(i, f"title {i}", "many words of a text " * 20_000) for i in range(6)]
    lens = tokenized_documents(spark.createDataFrame(rows, "doc_id long, title string, body string").coalesce(1)).select("doc_id", "len_title", "len_body").collect()
    assert sorted(map(tuple, lens)) == [(i, 2, 60_000) for i in range(6)]
