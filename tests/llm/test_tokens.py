import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ostra.llm.queries import op6_token_counts
from ostra.llm.tokens import WholeTokenCounter, count_tokens, proof
from tokenizers import Tokenizer

from tests_data import SMALL, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = WholeTokenCounter(PATH, proof(PATH))


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


PIECES = st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", " ", "  ", "\n\n", "'s", "'S", "don't", "\x1c", "²", "٣", "é", "é", "😀", "_", "　", "中文", "<|", "𠀀", "​"])), max_size=10).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_counts_are_the_librarys(text):
    assert COUNTER.count([text]) == [library(text)]


def test_proof_is_of_whole_tokens():
    whole = proof(PATH)["whole"]
    assert len(whole) > 40_000 and all(library(w) == 1 for w in whole[::500])


def test_query(spark):
    texts = {r.doc_id: r.text for r in documents(spark, SMALL).collect()}
    rows = op6_token_counts(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_odd_rows(spark, nasty, empty):
    rows = count_tokens(nasty, PATH).collect()
    assert len(rows) == nasty.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (3, 4)} == {(0, 0)}
    assert count_tokens(empty, PATH).count() == 0


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 50_000, "ab " * 50_000])
def test_very_long_texts(text):
    assert COUNTER.count([text]) == [library(text)]
