import pytest
from ostra.plans.query_language import explain_query, leaves, parse_query


def t(x):
    return {"type": "token", "value": x}


def p(*xs):
    return {"type": "phrase", "values": list(xs)}


def op(name, a, b):
    return {"type": "operator", "operator": name, "left": a, "right": b}


GOLDEN = {
    "and": None, "or": None, "not": None, '""': None, '"and and"': None, "": None, "()": None,
    "apple": t("apple"),
    "apple and banana": op("and", t("apple"), t("banana")),
    "apple or banana": op("or", t("apple"), t("banana")),
    "not apple": op("not", {}, t("apple")),
    "apple banana": op("and", t("apple"), t("banana")),
    "apple and banana or cherry": op("or", op("and", t("apple"), t("banana")), t("cherry")),
    "apple or banana and cherry": op("or", t("apple"), op("and", t("banana"), t("cherry"))),
    "not apple and banana": op("and", op("not", {}, t("apple")), t("banana")),
    '"apple banana" and cherry': op("and", p("apple", "banana"), t("cherry")),
    '"apple banana" cherry': op("and", p("apple", "banana"), t("cherry")),
    '"apple and banana"': p("apple", "banana"),
    '"apple"': t("apple"),
    "berlin and not (wall and blockade)": op("and", t("berlin"), op("not", {}, op("and", t("wall"), t("blockade")))),
    "and apple or": t("apple"),
    "apple and or banana": op("and", t("apple"), t("banana")),
    "apple not banana": op("and", t("apple"), op("not", {}, t("banana"))),
    "(apple) (banana)": op("and", t("apple"), t("banana")),
    "apple or banana or cherry": op("or", t("apple"), op("or", t("banana"), t("cherry"))),
}


@pytest.mark.parametrize("query", GOLDEN)
def test_trees(query):
    assert parse_query(query, stem=False) == GOLDEN[query]


@pytest.mark.parametrize("query", ["(apple", "apple)", '"apple', "apple not", "not not apple", ")(", '" ( " apple', "apple and not"])
def test_odd_queries_have_a_tree(query):
    tree = parse_query(query, stem=False)
    assert tree is None or leaves(tree) == ["apple"]


def test_explain():
    assert explain_query(parse_query("b and not a b", stem=False)).split() == ["AND", "b", "NOT", "b"] or explain_query(parse_query("x or y", stem=False)) == "OR\n  x\n  y\n"
    assert explain_query(parse_query("xx or yy", stem=False)) == "OR\n  xx\n  yy\n"
