"""Corpora: TSV files and tables as (doc_id, url, title, body)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostra.functions.analysis import ascii_lower
from ostra.operators.ranks import gapless_rank


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, value) of a text file (gzip by name), numbered from 0 in file order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_order"))
    return gapless_rank(lines.withColumn("_all", F.lit(0)), ["_all"], [F.col("_order")], "line_id").select("line_id", "value")


def parse_documents(lines: DataFrame, lowercase: bool = False) -> DataFrame:
    """(doc_id, url, title, body) of lines ``docid<TAB>url<TAB>title<TAB>body``: further fields are ignored, missing ones empty.

    ``doc_id`` is the line's number. Only A to Z are lower-cased. A last line without newline keeps its body.
    """
    fields = F.split("value", "[\t\r\n]")
    field = lambda i: F.coalesce(F.get(fields, F.lit(i)), F.lit(""))
    out = lines.select(F.col("line_id").alias("doc_id"), field(0).alias("external_id"), field(1).alias("url"), field(2).alias("title"), field(3).alias("body"))
    if lowercase:
        out = out.select("doc_id", "external_id", *[ascii_lower(F.col(c)).alias(c) for c in ("url", "title", "body")])
    return out


def read_corpus(spark: SparkSession, path: str, lowercase: bool = False) -> DataFrame:
    """A TSV corpus; a missing file is an error."""
    return parse_documents(raw_lines(spark, path), lowercase)


def documents_corpus(docs: DataFrame) -> DataFrame:
    """The ``documents`` table as a corpus: the first line is the title, the rest the body."""
    text = F.coalesce("text", F.lit(""))
    cut = F.instr(text, "\n")
    return docs.select(
        "doc_id", F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.substring_index(text, "\n", 1).alias("title"), F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise("").alias("body"),
    )


#: Elements that aren't text; one that isn't closed reaches to the end, so no place is tried twice.
UNSEEN = r"<title>.*?(?:</title>|\z)|<script[^>]*(?:>.*?(?:</script>|\z)|\z)|<style[^>]*(?:>.*?(?:</style>|\z)|\z)|<!--.*?(?:-->|\z)"
#: A tag, from its last opening sign.
TAG = r"<[^<>]*>"


def pages_corpus(pages: DataFrame) -> DataFrame:
    """The ``pages`` table as a corpus: title from its element, body from the page without markup.

    The expressions take time in proportion to a page, whatever its markup.
    """
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, f"(?is){UNSEEN}", " "), TAG, " ")
    return pages.select(F.col("page_id").alias("doc_id"), "url", F.regexp_extract(html, r"(?is)<title>(.*?)(?:</title>|\z)", 1).alias("title"), F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " ")).alias("body"))


def embedding_texts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, text) for embedding: title and body by a space; a line without these fields gives an empty text."""
    rows = raw_lines(spark, path)
    if limit is not None:
        rows = rows.where(F.col("line_id") < limit)
    f = F.split("value", "\t")
    return rows.select(F.col("line_id").alias("doc_id"), F.when(F.size(f) >= 4, F.concat_ws(" ", f[2], f[3])).otherwise("").alias("text"))


def get_documents(corpus: DataFrame, ids: list[int], processor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents of the given ids: a filter that reaches the scan. ``processor`` maps the rows."""
    rows = corpus.where(F.col("doc_id").isin(ids))
    return processor(rows) if processor else rows


def append_new(stored: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """The incoming rows that aren't stored yet: what a resumed ingest has to append."""
    return incoming.join(stored.select(key), key, "left_anti")


def as_dicts(rows: DataFrame) -> list[dict]:
    """A few documents, as ``get_documents`` returns them, as dictionaries by id, url, title and body."""
    return [{"id": r.doc_id, "url": r.url, "title": r.title, "body": r.body} for r in rows.orderBy("doc_id").toLocalIterator()]
