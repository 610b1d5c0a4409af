"""Text analysis: scanner, stop words and positional tokens of documents and queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostra.functions.stemmer import truncate

STOPWORDS = tuple("a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we when will with yet you your".split())
OPERATORS = ("and", "or", "not")
ALPHA_MAX, DIGITS_MAX = 50, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run that counts as a token wherever it stands; one that touches the field's end counts in any case.
PLAIN = rf"^([a-z]{{1,{ALPHA_MAX}}}|[0-9]{{1,{DIGITS_MAX}}})$"

_RUN = re.compile(rb"[a-z0-9]+")
_PLAIN = re.compile(PLAIN.encode())


def ascii_lower(column: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(column, UPPER, LOWER)


#: The same rules as one expression: a run of letters or of digits, or any run that ends the field.
TOKENS = rf"(?<![a-z0-9])(?:[a-z]{{1,{ALPHA_MAX}}}(?![a-z0-9])|[0-9]{{1,{DIGITS_MAX}}}(?![a-z0-9])|[a-z0-9]++\z)"


def plain_tokens(column: Column) -> Column:
    """Tokens of a field, unstemmed, stop words included: one native expression, without positions."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(column, F.lit(""))), F.lit(TOKENS), F.lit(0))


def scan(field: bytes, stem: bool, stops: frozenset[bytes]) -> list[tuple[bytes, int]]:
    """(token, byte position) of a field."""
    low, out, end = field.lower(), [], len(field)
    for m in _RUN.finditer(low):
        w = m.group()
        if _PLAIN.match(w) or m.end() == end:
            if stem:
                w = truncate(w.decode()).encode()
            if w not in stops:
                out.append((w, m.start()))
    return out


def tokenize_text(text: str, is_query: bool = False, stem: bool = True) -> tuple[list[str], list[int]]:
    """Tokens and byte positions of one text; a query also keeps ``and or not`` and ``" ( )``."""
    stops = frozenset(s.encode() for s in STOPWORDS if not (is_query and s in OPERATORS))
    raw = text.encode("utf-8")
    found = scan(raw, stem, stops)
    if is_query:
        found += [(m.group(), m.start()) for m in re.finditer(rb'["()]', raw)]
        found.sort(key=lambda f: f[1])
    return [w.decode() for w, _ in found], [p for _, p in found]


#: Text that a worker analyses at a time, in bytes: its lists of tokens and positions take some thirty times as much.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, texts: tuple[str, ...], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most ``most`` bytes of text, or of one row."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64) for c in texts)
    ends, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


TERM = "array<struct<token: string, tf_title: int, tf_body: int, positions: array<int>>>"


def tokenized_documents(docs: DataFrame, stem: bool = False) -> DataFrame:
    """(doc_id, len_title, len_body, terms) for each row of ``docs`` (doc_id, title, body).

    ``terms`` has one entry for each token of the document: its counts in both fields and its byte
    positions, the title's before the body's. Field lengths count tokens without stop words. A
    document is analysed where it lies: no shuffle. Null fields are empty.
    """
    stops = frozenset(s.encode() for s in STOPWORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, ("title", "body")):
                yield analysed(part)

    def analysed(batch: pa.RecordBatch) -> pa.RecordBatch:
        titles, bodies = (pc.fill_null(batch.column(c).cast(pa.binary()), b"").to_pylist() for c in (1, 2))
        n_title, n_body, ends = [], [], [0]
        tokens, tf_title, tf_body, places, place_ends = [], [], [], [], [0]
        for title, body in zip(titles, bodies, strict=True):
            a, b = scan(title, stem, stops), scan(body, stem, stops)
            by: dict[bytes, list[int]] = {}
            for w, p in a:
                by.setdefault(w, []).append(p)
            in_title = {w: len(p) for w, p in by.items()}
            for w, p in b:
                by.setdefault(w, []).append(p)
            for w, p in by.items():
                t = in_title.get(w, 0)
                tokens.append(w)
                tf_title.append(t)
                tf_body.append(len(p) - t)
                places += p
                place_ends.append(len(places))
            n_title.append(len(a))
            n_body.append(len(b))
            ends.append(len(tokens))
        terms = pa.StructArray.from_arrays(
            [pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(tf_title, pa.int32()), pa.array(tf_body, pa.int32()), pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(places, pa.int32()))],
            names=["token", "tf_title", "tf_body", "positions"],
        )
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_title, pa.int32()), pa.array(n_body, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms)], names=["doc_id", "len_title", "len_body", "terms"])

    return docs.select(F.col("doc_id").cast("long"), "title", "body").mapInArrow(run, f"doc_id long, len_title int, len_body int, terms {TERM}")


def token_positions(docs: DataFrame, stem: bool = False) -> DataFrame:
    """(doc_id, token, position, field): a row for each occurrence; field 0 is the title, 1 the body."""
    t = tokenized_documents(docs, stem).select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.token", "t.tf_title", F.posexplode("t.positions").alias("i", "position"))
    return t.select("doc_id", "token", F.col("position").cast("int"), (F.col("i") >= F.col("tf_title")).cast("int").alias("field"))


def bigrams(token: Column) -> Column:
    """Character bigrams of ``$token$``."""
    padded = F.concat(F.lit("$"), token, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(token) + 1), lambda i: F.substring(padded, i, F.lit(2)))
