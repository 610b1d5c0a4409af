"""The query language: and, or, not, parentheses and quoted phrases, to a tree.

Trees are ``{"type": "token", "value": t}``, ``{"type": "phrase", "values": [...]}`` or
``{"type": "operator", "operator": "and" | "or" | "not", "left": ..., "right": ...}`` with ``{}``
on the left of ``not``.
"""

from __future__ import annotations

from ostra.functions.analysis import tokenize_text

PRECEDENCE = {"or": 1, "and": 2, "not": 3}
_BINARY = ("and", "or")


def _without_pairs(tokens: list[str], first: str, second: str) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(tokens):
        if tokens[i] == first and i + 1 < len(tokens) and tokens[i + 1] == second:
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def normalise(tokens: list[str]) -> list[str]:
    """The six simplifications: empty parentheses, outer operators, empty phrases, runs of
    operators, missing ands, operators inside phrases."""
    tokens = _without_pairs(tokens, "(", ")")
    while tokens and tokens[0] in _BINARY:
        tokens = tokens[1:]
    while tokens and tokens[-1] in _BINARY:
        tokens = tokens[:-1]
    tokens = _without_pairs(tokens, '"', '"')
    tokens = [t for i, t in enumerate(tokens) if not (t in _BINARY and i and tokens[i - 1] in _BINARY)]
    out: list[str] = []
    inside = ended = False
    for t in tokens:
        if inside:
            if t == '"':
                inside, ended = False, True
            elif t in _BINARY:
                continue
            out.append(t)
            continue
        starts = t not in _BINARY and t != ")"
        if starts and ended:
            out.append("and")
        inside = t == '"'
        ended = t == ")" or (starts and t not in ("(", "not", '"'))
        out.append(t)
    # a phrase that held nothing but operators is empty now
    return _without_pairs(out, '"', '"')


def parse_tokens(tokens: list[str]) -> dict | None:
    """The tree of a token list; None without any content. Unbalanced signs and operators without operands are skipped."""
    if not any(t not in (*PRECEDENCE, "(", ")", '"') for t in tokens):
        return None
    values: list[dict] = []
    operators: list[str] = []

    def apply() -> None:
        op = operators.pop()
        if op == "not":
            if values:
                values.append({"type": "operator", "operator": op, "left": {}, "right": values.pop()})
        elif len(values) > 1:
            right, left = values.pop(), values.pop()
            values.append({"type": "operator", "operator": op, "left": left, "right": right})

    phrase: list[str] | None = None
    for t in normalise(tokens):
        if phrase is not None and t != '"':
            if t not in ("(", ")", "not"):
                phrase.append(t)
        elif t == '"':
            if phrase is None:
                phrase = []
                continue
            if phrase:
                values.append({"type": "token", "value": phrase[0]} if len(phrase) == 1 else {"type": "phrase", "values": phrase})
            phrase = None
        elif t in PRECEDENCE:
            # operators of the same precedence bind to the right
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] > PRECEDENCE[t]:
                apply()
            operators.append(t)
        elif t == "(":
            operators.append(t)
        elif t == ")":
            while operators and operators[-1] != "(":
                apply()
            if operators:
                operators.pop()
        else:
            values.append({"type": "token", "value": t})
    if phrase:
        values.append({"type": "token", "value": phrase[0]} if len(phrase) == 1 else {"type": "phrase", "values": phrase})
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            apply()
    return values[0] if values else None


def parse_query(query: str, stem: bool = True) -> dict | None:
    """The tree of a query text."""
    return parse_tokens(tokenize_text(query, is_query=True, stem=stem)[0])


def compat_token_count(query: str, stem: bool = True) -> int:
    """How many tokens a query has with its signs and operators, those that normalisation inserts included."""
    return len(normalise(tokenize_text(query, is_query=True, stem=stem)[0]))


def leaves(tree: dict | None) -> list[str]:
    """Content tokens of a tree, from left to right, repeated as they are."""
    if not tree:
        return []
    if tree["type"] == "token":
        return [tree["value"]]
    if tree["type"] == "phrase":
        return list(tree["values"])
    return leaves(tree["left"]) + leaves(tree["right"])


def positive_leaves(tree: dict | None, negated: bool = False) -> list[list[str]]:
    """The words of each leaf, token or phrase, that doesn't stand behind an odd number of nots."""
    if not tree:
        return []
    if tree["type"] == "operator":
        right = positive_leaves(tree["right"], negated != (tree["operator"] == "not"))
        return (positive_leaves(tree["left"], negated) if tree["left"] else []) + right
    words = [tree["value"]] if tree["type"] == "token" else list(tree["values"])
    return [] if negated else [words]


def explain_query(tree: dict | None, depth: int = 0) -> str:
    """The tree, indented."""
    if not tree:
        return ""
    pad = "  " * depth
    if tree["type"] == "token":
        return f"{pad}{tree['value']}\n"
    if tree["type"] == "phrase":
        return f'{pad}"{" ".join(tree["values"])}"\n'
    return f"{pad}{tree['operator'].upper()}\n" + explain_query(tree["left"], depth + 1) + explain_query(tree["right"], depth + 1)
