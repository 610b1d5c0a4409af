"""Licence scan: one Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the and/or/with expressions behind the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ostra.llm.common import text_bytes

#: Base phrases: their words, consecutively, carry the label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases that the method knows beyond the base; their places don't count as base places.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "boost software license": "boost",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by": "cc-by",
    "cc0": "cc0",
}
#: Tags that are followed by a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How surely a kind of evidence shows a licence.
WEIGHTS = {"tag": 0.95, "phrase": 0.8, "notice": 0.6}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Upper case to lower, and every byte that belongs to no word to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"\s*(\(|\)|[a-z0-9][a-z0-9.+\-]*)")


def parse_expression(tokens: list[str]) -> list[str] | None:
    """An expression in postfix order by the shunting-yard method; None if it is no valid one.

    ``with`` binds before ``and``, that before ``or``; all bind to the left.
    """
    out: list[str] = []
    operators: list[str] = []
    operand = True
    for token in tokens:
        if token == "(":
            if not operand:
                return None
            operators.append(token)
        elif token == ")":
            if operand:
                return None
            while operators and operators[-1] != "(":
                out.append(operators.pop())
            if not operators:
                return None
            operators.pop()
        elif token in PRECEDENCE:
            if operand:
                return None
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[token]:
                out.append(operators.pop())
            operators.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in operators:
        return None
    return out + operators[::-1]


class Expression:
    """A parsed expression in its canonical form, made by one pass over the postfix order.

    Nested operands of one and the same ``and`` or ``or`` are joined, equal ones counted once and never
    multiplied out, so time and memory follow the expression's length however deep or wide it is.
    """

    def __init__(self, postfix: list[str]) -> None:
        self.numbers: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        # of each open operand: its operator ("" for a name or a with), its operands' numbers, the licences it names
        stack: list[tuple[str, set[int], set[str]]] = []
        for token in postfix:
            if token not in PRECEDENCE:
                stack.append(("", {self._number(("", token))}, {token}))
                continue
            right, left = stack.pop(), stack.pop()
            if token == "with":  # an exception belongs to its licence and is none itself
                stack.append(("", {self._number(("with", self._close(left), self._close(right)))}, left[2]))
                continue
            parts = [x[1] if x[0] in ("", token) else {self._close(x)} for x in (left, right)]
            parts.sort(key=len)
            names = sorted((left[2], right[2]), key=len)
            parts[1].update(parts[0])  # the smaller set into the larger one
            names[1].update(names[0])
            stack.append((token, parts[1], names[1]))
        self.root, self.licences = self._close(stack[0]), stack[0][2]

    def _number(self, node: tuple) -> int:
        if node not in self.numbers:
            self.numbers[node] = len(self.nodes)
            self.nodes.append(node)
        return self.numbers[node]

    def _close(self, entry: tuple[str, set[int], set[str]]) -> int:
        kind, operands, _ = entry
        return next(iter(operands)) if len(operands) == 1 else self._number((kind, *sorted(operands)))

    def __str__(self) -> str:
        """Operands in the order of names, then of first appearance; parentheses about operands of another operator."""
        out, todo = [], [self.root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            kind, *rest = self.nodes[x]
            if kind == "":
                out.append(rest[0])
                continue
            if kind != "with":
                rest.sort(key=lambda n: (self.nodes[n][0] != "", self.nodes[n][1] if self.nodes[n][0] == "" else "", n))
            for k, n in reversed(list(enumerate(rest))):
                wrapped = self.nodes[n][0] in ("and", "or") or kind == "with" and self.nodes[n][0] == "with"
                todo += [")", n, "("] if wrapped else [n]
                if k:
                    todo.append(f" {kind} ")
        return "".join(out)


def label_of(identifier: str) -> str:
    """The family of an identifier: ``gpl-3.0-only`` is ``gpl``."""
    for family in ("agpl", "lgpl", "gpl", "apache", "mpl", "epl", "bsd", "cc-by-nc", "cc-by-sa", "cc-by", "cc0", "mit", "isc"):
        if identifier == family or identifier.startswith((family + "-", family + "+")):
            return family
    return identifier


def longest_expression(raw: bytes, start: int) -> Expression | None:
    """The longest valid expression on the line behind a tag."""
    end = raw.find(b"\n", start)
    tokens, at = [], start
    end = len(raw) if end < 0 else end
    while at < end and (m := _TOKEN.match(raw, at, end)):
        tokens.append(m[1].decode())
        at = m.end()
    # a valid prefix can only end before a token that can't follow; trying them all would be quadratic
    depth, best, operand = 0, 0, True
    for k, t in enumerate(tokens):
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif t in PRECEDENCE and not operand:
            operand = True
            continue
        elif t not in PRECEDENCE and t not in "()" and operand:
            operand = False
        else:
            break
        if not operand and not depth:
            best = k + 1
    return Expression(parse_expression(tokens[:best])) if best else None


class Scanner:
    """The automaton and what a text's matches say."""

    def __init__(self) -> None:
        self.words, self.raw = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in (PHRASES | NOTICES).items():
            self.words.add_word(f" {phrase} ", (phrase, label, phrase in PHRASES, len(phrase) + 1))
        for tag in TAGS:
            self.raw.add_word(tag, tag)
        self.words.make_automaton()
        self.raw.make_automaton()

    def scan(self, text: bytes) -> dict:
        """What the text holds; an empty one holds nothing."""
        words = text.translate(_WORDS).split()
        found = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None}
        base, labels, kinds, expressions = set(), set(), set(), []
        # one byte is one character here, so places are counted in bytes
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        at = number = 0
        for end, (_, label, is_base, length) in self.words.iter(line):
            start = end - length
            if is_base:
                if start >= at:
                    number += line.count(" ", at, start)
                    at, word = start, number
                else:
                    word = line.count(" ", 0, start)
                found["n_base"] += 1
                found["first_word"] = word if found["first_word"] is None else min(word, found["first_word"])
                found["last_word"] = word if found["last_word"] is None else max(word, found["last_word"])
                base.add(label)
            labels.add(label)
            kinds.add("phrase" if is_base else "notice")
        lower = text.lower()
        if b"license-" in lower or b"spdx" in lower:
            for end, _ in self.raw.iter(lower.decode("latin-1")):
                said = longest_expression(lower, end + 1)
                if said is not None:
                    kinds.add("tag")
                    labels.update(map(label_of, said.licences))
                    expressions.append(str(said))
        score = 1.0
        for kind in kinds:
            score *= 1 - WEIGHTS[kind]
        return found | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": round(1 - score, 6), "expressions": expressions}


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions string"


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append the licence findings of each whole text to the columns ``keep``.

    ``n_words``, base places ``n_base``, the smallest and largest start ``first_word`` and
    ``last_word`` (null without any), ``base_labels`` and ``labels`` (distinct, sorted, joined by
    commas; empty without any), ``score`` (0 without evidence) and ``expressions``: the tagged expressions in
    canonical form, joined by ``; ``. Null texts count as empty; a text or an expression of any length takes time in
    proportion to it. Repeated rows are scanned each, an empty table stays empty. A map without a shuffle.
    """
    n = len(keep)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t) for t in text_bytes(batch.column(n))]
            for r in rows:
                r["expressions"] = "; ".join(r["expressions"])
            types = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "expressions": pa.string()}
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *(pa.array([r[c] for r in rows], types.get(c, pa.int64())) for c in names)], names=[*keep, *names])

    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text")).mapInArrow(run, schema)
