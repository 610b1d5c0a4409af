"""Language identification by Bayesian evidence fusion.

The posterior of a page's language joins four kinds of evidence: the likelihood of its text under
byte n-gram models of each language, the language its markup declares, the suffix of its address,
and a prior of its host. How far a declaration or a suffix can be trusted, and what a host
usually holds, isn't assumed but estimated: by grouped aggregation of the text's own posteriors,
the host's prior smoothed towards its domain's, that towards its suffix's and that towards all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostra.llm.common import text_bytes
from ostra.operators.ranks import hot_split_join
from ostra.session import settle

BUCKETS = 1 << 16
#: Additive smoothing of n-gram counts, and pages' worth of the coarser prior in each finer one.
ALPHA, STRENGTH = 0.5, 10.0
#: n-grams of a text overlap and aren't independent: their log-likelihood counts by this share.
TEMPER = 0.2
#: Languages whose models are gathered and shipped at once, 256 KB each.
BLOCK = 64

_ENTITY = re.compile(rb"(?i)&[a-z]+;|&#\d+;")
_LANG = re.compile(rb"""\slang\s*=\s*["']?([a-z]{2,3})""")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What opens with these ends with those, if that is still to come, else with the next ``>``.
_ENDS = {b"<!--": b"-->", b"<script": b"</script>", b"<style": b"</style>"}


def visible(html: bytes) -> bytes:
    """The text of a page without markup, scripts, styles and comments.

    One pass: an end that isn't found once isn't looked for again, so unclosed markup costs no more than other text.
    """
    lower, out, at, gone = html.lower(), [], 0, set()
    while (start := lower.find(b"<", at)) >= 0:
        out.append(html[at:start])
        stop = -1
        for opening, end in _ENDS.items():
            if end not in gone and lower.startswith(opening, start):
                found = lower.find(end, start + len(opening))
                if found < 0:
                    gone.add(end)
                else:
                    stop = found + len(end)
        if stop < 0:
            stop = lower.find(b">", start) + 1
            if not stop:  # no tag ends from here on: all of it is text
                at = start
                break
        at = stop
    out.append(html[at:])
    return _ENTITY.sub(b" ", b" ".join(out))


def declared_language(html: bytes) -> str | None:
    """The language that a page's first ``<html ...>`` declares, in lower case."""
    lower = html.lower()
    start = lower.find(b"<html")
    if start < 0:
        return None
    stop = lower.find(b">", start)
    found = _LANG.search(lower, start, stop if stop >= 0 else len(lower))
    return found[1].decode() if found else None


def gram_ids(text: bytes) -> np.ndarray:
    """Buckets of the byte 3- and 4-grams of a text's words, single spaces between them."""
    raw = np.frombuffer(b" " + b" ".join(text.translate(_LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in (3, 4):
        m = len(raw) - n + 1
        if m > 0:
            h = np.full(m, 2166136261 ^ n, np.uint32)
            for i in range(n):
                h = (h ^ raw[i : m + i]) * np.uint32(16777619)
            out.append((h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def train(docs: DataFrame) -> DataFrame:
    """(lang, logp): the log-probabilities of each language's buckets, as float32, counted over all rows with a language and a text.

    Each task counts into one table a language; the tables are summed by language and bucket, and a
    language's BUCKETS sums become one row, so no task holds more than one language's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                if lang not in counts and len(counts) >= BLOCK:  # many languages: hand on what was counted so far
                    yield from (counted_rows(x, c) for x, c in counts.items())
                    counts.clear()
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for text in texts:
                    own += np.bincount(gram_ids(text), minlength=BUCKETS) if len(text) > 1 << 14 else 0
                small = [gram_ids(t) for t in texts if len(t) <= 1 << 14]
                if small:
                    own += np.bincount(np.concatenate(small), minlength=BUCKETS)
        yield from (counted_rows(x, c) for x, c in counts.items())

    def counted_rows(lang: str, own: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(own)
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some.astype(np.int32)), "n": pa.array(own[some])})

    def model(table: pa.Table) -> pa.Table:
        own = np.full(BUCKETS, ALPHA)
        own[table["bucket"].to_numpy()] += table["n"].to_numpy()
        return pa.table({"lang": table["lang"][:1], "logp": pa.array([np.log(own / own.sum()).astype(np.float32).tobytes()], pa.binary())})

    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    counted = labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return settle(counted.groupBy("lang").applyInArrow(model, "lang string, logp binary"))


def ship_models(models: DataFrame, block: int = BLOCK) -> tuple[list[str], list]:
    """All languages by name, and their models as broadcast tables (buckets x languages) of ``block`` languages each.

    The driver holds one block at a time; a worker holds all of them, 256 KB a language.
    """
    langs = sorted(r.lang for r in models.select("lang").collect())
    shipped = []
    for at in range(0, len(langs), block):
        some = langs[at : at + block]
        got = models.where((F.col("lang") >= some[0]) & (F.col("lang") <= some[-1])).toArrow().to_pandas().set_index("lang")["logp"]
        shipped.append(models.sparkSession.sparkContext.broadcast(np.ascontiguousarray(np.stack([np.frombuffer(got[x], np.float32) for x in some]).T)))
    return langs, shipped


def text_evidence(pages: DataFrame, shipped: list) -> DataFrame:
    """Replace ``_text`` and ``_html`` by ``ll``, the tempered log-likelihood of each language (0 for texts without words), and ``declared``."""
    others = [c for c in pages.columns if c not in ("_text", "_html")]
    fields = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others), "ll array<double>", "declared string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [x.value for x in shipped]
        for batch in batches:
            rows, declared = [], []
            for text, is_html in zip(text_bytes(batch.column(len(others))), batch.column(len(others) + 1).to_pylist(), strict=True):
                ids = gram_ids(visible(text) if is_html else text)
                declared.append(declared_language(text) if is_html else None)
                total = np.concatenate([sum((table[ids[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64) for at in range(0, len(ids), 1 << 16)), np.zeros(table.shape[1])) for table in tables])
                rows.append((TEMPER * (total - total.max())).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(rows, pa.list_(pa.float64())), pa.array(declared, pa.string())], names=[*others, "ll", "declared"])

    return pages.select(*others, "_text", "_html").mapInArrow(run, fields)


def _soft(weights: Column) -> Column:
    """Log-weights to probabilities."""
    top = F.array_max(weights)
    e = F.transform(weights, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, doc_id, lang, probability, declared, suffix, host): the language of each page and each document.

    ``pages`` (page_id, url, html) are judged by all their evidence; ``docs`` (doc_id, text, lang,
    source), whose ``lang`` teaches the text models, by their text and their source as host.
    Null or empty texts have no text evidence, null or odd addresses no suffix, null markup no
    declaration; what is missing is neutral. Without any labelled text the language is null.
    Repeated rows are judged each, very long texts and any markup in time that follows their length. Every
    language counts, however many there are. Host, domain, suffix and declaration tables are grouped sums,
    which partial aggregation keeps even; equal posteriors go to the first language by name.
    """
    langs, shipped = ship_models(train(docs))
    empty = "page_id long, doc_id long, lang string, probability double, declared string, suffix string, host string"
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:@\s]+)", 1))
    web = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("long").alias("doc_id"), F.nullif(host, F.lit("")).alias("host"),
        F.col("html").alias("_text"), F.lit(True).alias("_html"),
    )
    plain = docs.select(
        F.lit(None).cast("long").alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"),
        F.col("text").alias("_text"), F.lit(False).alias("_html"),
    )
    both = web.unionByName(plain)
    if not langs:
        untold = both.select("page_id", "doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), "host")
        return untold.to(docs.sparkSession.createDataFrame([], empty).schema)
    n = len(langs)
    seen = settle(text_evidence(both, shipped))
    labels = F.split("host", r"\.")
    dotted = F.size(labels) >= 2
    seen = seen.withColumn("suffix", F.when(dotted, F.element_at(labels, -1))).withColumn("domain", F.when(dotted, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("host")))
    seen = seen.withColumn("p", _soft(F.col("ll")))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    packed = F.array(*[F.col(f"s{i}") for i in range(n)])

    # one grouped pass over all levels, from which the coarser ones are summed
    cells = settle(seen.groupBy("suffix", "domain", "host", "declared").agg(F.count("*").alias("n"), *sums))
    fold = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    overall = cells.agg(*fold, F.sum("n").alias("n")).first()
    total = sum(overall[i] or 0.0 for i in range(n))
    everywhere = [((overall[i] or 0.0) + 1 / n) / (total + 1) for i in range(n)]

    def smooth(level: str, above: Column, of: Column) -> Column:
        mass = F.aggregate(of, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(of, above, lambda c, a: (c + STRENGTH * a) / (mass + STRENGTH))

    top = F.array(*[F.lit(x) for x in everywhere])
    suffixes = cells.where("suffix is not null").groupBy("suffix").agg(*fold).select("suffix", smooth("suffix", top, packed).alias("p_suffix"))
    domains = cells.where("domain is not null").groupBy("suffix", "domain").agg(*fold).join(suffixes, "suffix", "left").select("domain", "suffix", smooth("domain", F.coalesce("p_suffix", top), packed).alias("p_domain"))
    hosts = (
        cells.where("host is not null").groupBy("suffix", "domain", "host").agg(*fold)
        .join(domains.select(F.col("domain").alias("d"), "p_domain", F.col("suffix").alias("x")), (F.col("domain") == F.col("d")) & F.col("suffix").eqNullSafe(F.col("x")), "left")
        .select("host", smooth("host", F.coalesce("p_domain", top), packed).alias("p_host"))
    )
    # likelihood of a declaration, of a suffix: P(declared | language), smoothed by one page for each language
    def likelihood(key: str, name: str) -> DataFrame:
        return cells.where(F.col(key).isNotNull()).groupBy(key).agg(*fold).select(F.col(key).alias(f"k_{key}"), F.array(*[F.log((F.col(f"s{i}") + 1.0) / F.lit((overall[i] or 0.0) + n)) for i in range(n)]).alias(name))

    # the tables have a row a cell; they are joined to the cells first, and to the rows by the cell's key
    cell = F.to_json(F.struct("host", "declared"))  # null fields are left out, so the key itself is never null
    facts = (
        cells.groupBy("host", "declared", "suffix").agg(F.sum("n").alias("n"))
        .join(hosts, "host", "left")
        .join(likelihood("declared", "l_declared"), F.col("declared") == F.col("k_declared"), "left")
        .join(likelihood("suffix", "l_suffix"), F.col("suffix") == F.col("k_suffix"), "left")
    )
    neutral = F.array_repeat(F.lit(0.0), n)
    prior = F.transform(F.coalesce("p_host", top), lambda x: F.log(x))
    added = F.zip_with(F.zip_with(prior, F.coalesce("l_declared", neutral), lambda a, b: a + b), F.coalesce("l_suffix", neutral), lambda a, b: a + b)
    # a host may hold a third of all rows: the facts of hot cells are broadcast, their rows stay where they are
    facts = settle(facts.select(cell.alias("cell"), "n", added.alias("added")))
    rows = seen.select("page_id", "doc_id", "ll", "declared", "suffix", "host", cell.alias("cell"))
    joined = hot_split_join(rows, facts, "cell", "n", int(overall["n"] or 0), "inner")
    p = _soft(F.zip_with("ll", "added", lambda a, b: a + b))
    out = joined.select("page_id", "doc_id", p.alias("p"), "declared", "suffix", "host")
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("p")
    return out.select("page_id", "doc_id", names[F.array_position("p", best).cast("int") - 1].alias("lang"), best.alias("probability"), "declared", "suffix", "host")
