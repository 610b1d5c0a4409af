import itertools
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from ostra.llm.licenses import PHRASES, Expression, Scanner, parse_expression, scan_licenses
from ostra.llm.queries import op10_licenses

from tests_data import MIDDLE, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def shown(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark, MIDDLE).collect()}
    rows = op10_licenses(spark, MIDDLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert shown(r) == base(texts[r.doc_id]) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


PIECES = st.lists(st.sampled_from(["mit", "MIT", "license", "License", "apache", "general", "public", "lesser", "gpl", " ", "-", "\n", "é", "K", "x1", "licenses"]), max_size=25).map(" ".join)


@given(PIECES)
def test_base_places(text):
    assert shown(Scanner().scan(text.encode())) == base(text)


def shown_expression(text):
    return str(Expression(parse_expression(text.split())))


def holds(postfix, granted):
    """Whether the granted licences fulfil an expression, by plain evaluation."""
    stack = []
    for t in postfix:
        if t not in ("and", "or", "with"):
            stack.append(t in granted)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left or right if t == "or" else left and right)
    return stack[0]


def tokens_of(text):
    return text.replace("(", " ( ").replace(")", " ) ").split()


EXPRESSION = st.recursive(
    st.sampled_from(["mit", "isc", "gpl", "x"]), lambda e: st.tuples(e, st.sampled_from(["and", "or", "with"]), e, st.booleans()).map(lambda t: f"( {t[0]} {t[1]} {t[2]} )" if t[3] else f"{t[0]} {t[1]} {t[2]}"), max_leaves=12
)


@given(EXPRESSION)
def test_canonical_form_means_the_same(text):
    postfix = parse_expression(text.split())
    canonical = parse_expression(tokens_of(str(Expression(postfix))))
    for n in range(5):
        for granted in itertools.combinations(("mit", "isc", "gpl", "x"), n):
            assert holds(postfix, granted) == holds(canonical, granted)
    assert str(Expression(canonical)) == str(Expression(postfix))


def test_expressions():
    assert shown_expression("mit or apache and isc") == "mit or (apache and isc)"
    assert shown_expression("isc and ( mit or gpl-2.0 with classpath or mit )") == "isc and (mit or gpl-2.0 with classpath)"
    assert shown_expression("b or ( a or ( c or a ) )") == "a or b or c"
    assert Expression(parse_expression("gpl-2.0 with classpath and isc".split())).licences == {"gpl-2.0", "isc"}
    for bad in ("", "or", "mit or", "( mit", "mit )", "mit apache", "and mit"):
        assert parse_expression(bad.split()) is None


@pytest.mark.parametrize(
    "expression",
    [
        " and ".join(f"(a{i} or b{i})" for i in range(30)), " and ".join(f"(a{i} or b{i})" for i in range(3000)), " or ".join(f"x{i}" for i in range(50_000)),
        "(" * 20_000 + "mit" + ")" * 20_000, "(a or " * 20_000 + "mit" + ")" * 20_000, "(" * 20_000 + "a" + "".join(f" {'and' if i % 2 else 'or'} x{i})" for i in range(20_000)), "( mit or " * 50_000,
    ],
)
def test_long_expressions_take_time_in_proportion(expression):
    began = time.process_time()
    r = Scanner().scan(f"SPDX-License-Identifier: {expression}\n".encode())
    assert time.process_time() - began < 2
    assert expression.count("(") != expression.count(")") or r["labels"]


def test_tags_and_notices():
    scan = lambda t: Scanner().scan(t.encode())
    r = scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause so and\nrest")
    assert r["labels"] == "bsd,gpl,mit" and r["score"] == 0.95 and r["n_base"] == 0
    assert scan("GNU Lesser General Public License")["labels"] == "gpl,lgpl"
    assert scan("nothing here") | {"expressions": 0} == {"n_words": 2, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "expressions": 0}


def test_odd_rows(spark, nasty, empty):
    rows = scan_licenses(nasty).collect()
    assert len(rows) == nasty.count() and all(shown(r) == (0, 0, None, None, "") for r in rows if r.doc_id in (3, 4, 5))
    assert scan_licenses(empty).count() == 0
