"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Every bit
position i of a fingerprint gets a nonzero vector f(i) of r + 1 bits, r being the radius; for each
nonzero vector v the mask a(v) keeps the positions with <f(i), v> odd. If two fingerprints differ
in at most r positions, some v is orthogonal to the f of all these, so both agree under a(v): in
one of the 2^(r+1) - 1 tables the pair collides, surely and not only probably.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostra.llm.common import text_bytes
from ostra.operators.ranks import hot_split_join
from ostra.session import settle

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: Shingles whose bits are counted at a time, so a text's length doesn't show in the memory.
BLOCK = 1 << 16
#: A bucket with more different fingerprints is compared in pairs of blocks, by as many tasks.
SPLIT = 4096
#: Up to so many edges the components are found on the driver (16 bytes an edge); beyond it by joins.
LOCAL_EDGES = 500_000
#: Ids of rows to be dropped are broadcast up to so many (about 100 MB as a hash table); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> np.ndarray:
    """The masks of the tables: 15 for radius 3, each keeping about half of the positions."""
    n = 2 ** (radius + 1) - 1
    f = [1 + i % n for i in range(bits)]
    return np.array([sum(1 << i for i in range(bits) if (f[i] & v).bit_count() & 1) for v in range(1, n + 1)], np.uint64)


def fingerprint(text: bytes) -> int:
    """Of a text's bytes: 0 without words; a text of one or two words is one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        m = len(part) - SHINGLE + 1
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(part, part[1:], part[2:], strict=False)), repeat(SEED)), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the fingerprint as a signed long) of each whole text; null texts have no words."""
    n = len(keep)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in text_bytes(batch.column(n))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(fps)], names=[*keep, "fp"])

    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text")).mapInArrow(run, schema)


def _first_table(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The first table in which fingerprints that differ by ``x`` collide: there, and only there, the pair is counted."""
    return ((x[:, None] & masks[None, :]) == 0).argmax(axis=1)


def _links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, table: int, masks: np.ndarray, same: bool, radius: int):
    """Links of a bucket's block ``a`` to its block ``b``: documents linked with each, and edges that span the components."""
    ca, cb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    edges: list[tuple[int, int]] = []
    parent = list(range(len(a) + len(b)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(a)):
        x = a[i] ^ (b[i + 1 :] if same else b)
        near = np.flatnonzero(np.bitwise_count(x) <= radius)
        if len(near):
            near = near[_first_table(x[near], masks) == table]
        if not len(near):
            continue
        near = near + (i + 1 if same else 0)
        ca[i] += nb[near].sum()
        cb[near] += na[i]
        for j in near.tolist():
            p, q = find(i), find(j if same else len(a) + j)
            if p != q:
                parent[q] = p
                edges.append((i, j))
    return ca, cb, edges


def linked(reps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Rows (fp, n, other) whose ``n`` sum up to the documents linked with ``fp`` and whose (fp, other) span the components.

    ``reps``: different fingerprints ``fp`` with their number of documents ``n``.
    Each fingerprint goes into every table's bucket; the rows are sorted by bucket and compared as
    they stream by. No pair is emitted: only a sum for each member, and the edges of a spanning
    forest. A bucket of more than ``split`` members passes through and is compared in pairs of
    blocks by other tasks. A pair that collides in several tables counts in the first.
    """
    masks = covering_masks(BITS, radius)
    signed = masks.view(np.int64).tolist()
    keyed = reps.select("fp", "n", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    schema = "t int, key bigint, fp bigint, n bigint, other bigint, late boolean"
    batch_schema = pa.schema([("t", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("other", pa.int64()), ("late", pa.bool_())])

    def found(a, b, na, nb, t, same):
        ca, cb, edges = _links(a, b, na, nb, t, masks, same, radius)
        out = [(int(f), int(c), None) for f, c in zip(a.view(np.int64), ca) if c] + [(int(f), int(c), None) for f, c in zip(b.view(np.int64), cb) if c]
        return out + [(int(a[i].view(np.int64)), 0, int(b[j].view(np.int64))) for i, j in edges]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.bool_())], schema=batch_schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the last bucket, which the next batch may continue
        late: tuple[int, int] | None = None  # the bucket that is passed on

        def flush(t, key, fp, n, rows):
            if len(fp) > 1:
                u = fp.view(np.uint64)
                rows += [(t, key, f, c, o, False) for f, c, o in found(u, u, n, n, t, True)]

        tail = None
        for batch in batches:
            t, key, fp, n = (np.asarray(batch.column(c)) for c in range(4))
            if tail is not None:
                t, key, fp, n = (np.concatenate(p) for p in zip(tail, (t, key, fp, n)))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            rows: list[tuple] = []
            long = np.flatnonzero(ends - starts > 1)
            last = len(starts) - 1
            for k in {0, *long.tolist()} if late else long.tolist():
                s, e = int(starts[k]), int(ends[k])
                if late == (int(t[s]), int(key[s])) or e - s > split:
                    late = (int(t[s]), int(key[s]))
                    rows += [(*late, int(f), int(c), None, True) for f, c in zip(fp[s:e], n[s:e])]
                elif k != last:
                    flush(int(t[s]), int(key[s]), fp[s:e], n[s:e], rows)
            s = int(starts[last])
            tail = None if late == (int(t[s]), int(key[s])) else (t[s:], key[s:], fp[s:], n[s:])
            if rows:
                yield frame(rows)
        if tail is not None:
            rows = []
            flush(int(tail[0][0]), int(tail[1][0]), tail[2], tail[3], rows)
            if rows:
                yield frame(rows)

    first = settle(keyed.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp", "n").mapInArrow(stream, schema))
    out = first.where("not late").select("fp", "n", "other")
    sizes = first.where("late").groupBy("t", "key").agg(F.ceil(F.count("*") / split).cast("int").alias("g"))
    if sizes.isEmpty():
        return out

    # a bucket of g blocks: block pair (i, j) is compared by one task, to which both blocks go
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    pairs = (
        first.where("late").join(sizes, ["t", "key"]).withColumn("b", mine)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("t", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "fp", "n")
    )

    def compare(pdf):
        import pandas as pd

        t, i, j = int(pdf.t.iloc[0]), int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        a, b = pdf[pdf.b == i], pdf[pdf.b == j]
        fa, fb = a.fp.to_numpy().view(np.uint64), b.fp.to_numpy().view(np.uint64)
        rows = found(fa, fb, a.n.to_numpy(), b.n.to_numpy(), t, i == j)
        return pd.DataFrame({"fp": pd.array([r[0] for r in rows], "Int64"), "n": pd.array([r[1] for r in rows], "Int64"), "other": pd.array([r[2] for r in rows], "Int64")})

    return out.unionByName(pairs.groupBy("t", "key", "i", "j").applyInPandas(compare, "fp bigint, n bigint, other bigint"))


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of each node of the edges (a, b): root is the smallest node that can be reached.

    Up to ``local`` edges by union-find on the driver; more by rounds of joins, in which each node
    takes the smallest root of its neighbours and then its root's root, until none changes.
    """
    spark = edges.sparkSession
    n = edges.count()
    if n <= local:
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            parent.setdefault(i, i)
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in edges.select("a", "b").toArrow().to_pandas().itertuples(index=False):
            p, q = find(int(a)), find(int(b))
            if p != q:
                parent[max(p, q)] = min(p, q)
        nodes = np.array([*parent], np.int64)
        roots = np.array([find(i) for i in parent], np.int64)
        return spark.createDataFrame(pa.table({"node": nodes, "root": roots}))
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # a root may be that of a third of all nodes: its rows are salted, its own root is copied to every salt
        salts = 32
        up = better.select(F.col("node").alias("root"), F.col("root").alias("up")).withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
        jumped = better.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(up, ["root", "salt"])
        roots = settle(jumped.select("node", "old", F.least("root", "up").alias("root")))
        if roots.where("old != root").isEmpty():
            return roots.select("node", "root")
        roots = roots.select("node", "root")


def fingerprint_column():
    """A column function from texts to their fingerprints as signed longs."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t) for t in text_bytes(batch)], np.uint64).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, split: int = SPLIT, local: int = LOCAL_EDGES) -> DataFrame:
    """(doc_id, fingerprint, n_near, component_id) for each row of ``docs`` (doc_id, text, ...).

    ``fingerprint``: 16 hexadecimal digits; ``n_near``: other rows within ``radius`` bits;
    ``component_id``: the smallest doc_id that links reach, its own included. Null and empty texts
    have fingerprint zero and are linked like any others. Rows with equal ids count each; a null id is never the smallest.
    Copies share a fingerprint and are counted, never paired.
    """
    rows = settle(fingerprints(docs, text, ("doc_id",)))
    reps = settle(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
    total = reps.agg(F.sum("n")).first()[0] or 0
    links = settle(linked(reps.select("fp", "n"), radius, split))
    sums = links.groupBy("fp").agg(F.sum("n").alias("near"))
    roots = components(links.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")), local)
    member = roots.join(reps, F.col("node") == F.col("fp")).select("fp", "root", "low")
    # a component may hold a third of all fingerprints: its smallest id is a partial aggregate, joined by the hot split
    lows = member.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("m"))
    member = hot_split_join(member.select("fp", "root"), lows, "root", "m", total).select(F.col("fp").alias("node"), "component")
    # what most rows have needs no join: alone with their fingerprint, without any link
    facts = (
        reps.join(sums, "fp", "left").join(member, F.col("fp") == F.col("node"), "left")
        .select("fp", "n", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_near"), F.coalesce("component", "low").alias("component_id"))
        .where("n_near > 0")
    )
    facts = settle(facts)
    out = hot_split_join(rows, facts, "fp", "n", total)
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, text: str = "text", radius: int = RADIUS, split: int = SPLIT, local: int = LOCAL_EDGES, broadcast: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays.

    All columns are kept. Rows of one id are decided apart by their fingerprints: if a component's smallest id has
    several rows in it, one of them stays, that of smallest fingerprint; a null id comes after all others.
    """
    rows = settle(fingerprints(docs, text, ("doc_id",)))
    reps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    links = linked(reps.select("fp", "n"), radius, split).where("other is not null")
    roots = components(settle(links.select(F.col("fp").alias("a"), F.col("other").alias("b"))), local)
    first = F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("doc_id"), F.col("fp").alias("fp"))).alias("first")
    whole = reps.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(first)
    kept = settle(whole.select("first.doc_id", "first.fp"))
    # an id of one row needs no fingerprint; the rows of all others are told apart by theirs
    several = settle(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"])
    # what goes is less than what stays: while its ids are few, no text is shuffled
    first = kept.select(F.col("doc_id").alias("_kept"), F.col("fp").alias("_kept_fp"))
    lost = rows.join(first, (F.col("doc_id") == F.col("_kept")) & (F.col("fp") == F.col("_kept_fp")), "left_anti").select("doc_id")
    gone = settle(lost.unionByName(several).where("doc_id is not null").distinct())
    out = docs.where("doc_id is not null").join(F.broadcast(gone) if gone.count() <= broadcast else gone, "doc_id", "left_anti")
    if not several.isEmpty():
        name = "_fp"
        while name in {c.lower() for c in docs.columns}:
            name += "_"
        again = docs.join(F.broadcast(several) if several.count() <= 100_000 else several, same(docs, several), "left_semi").withColumn(name, fingerprint_column()(F.col(text)))
        again = again.join(kept, same(again, kept) & (again[name] == kept["fp"]), "left_semi")
        out = out.unionByName(again.dropDuplicates(["doc_id", name]).drop(name))
    return out.select(*docs.columns)
