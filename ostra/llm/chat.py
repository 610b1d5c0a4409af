"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins by doubled steps find the message 1, 2, 4, ... steps
above each (a conversation of n turns takes log2 n joins, not n). By these the leaves climb to their
root, which gives depth and score along the path; then the chosen leaves are expanded to their paths.
Branches are ranked by score, and each chosen path becomes one conversation in a template whose
control strings are escaped inside texts, reversibly.

All joins see numbers of messages only. A message names its text by the text's MD5, and the texts
move once, to the task that formats their tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostra.operators.ranks import gapless_rank
from ostra.session import settle, settled_rows

#: A tree of more bytes of text, or of more rows on its paths, isn't held by one task: its paths are gathered each for itself.
TREE_BYTES, TREE_ROWS = 64 << 20, 4_000_000
#: Joins in one plan, which is planned again after each of its stages: with more of them its driver's work would grow by their square.
STEPS = 4
#: Formatted characters after which a task hands on what it has.
FLUSH = 4 << 20
START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

def escape(text: str) -> str:
    """One more backslash in each ``<|``, ``<\\|``, ...; so no control string is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (in code points) of its assistant texts, the loss mask."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        turns.append((role, unescape(rest[: rest.rindex(END)])))
    return turns


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Of each k the (id, up, by) of the messages with 2**k messages above them: the one 2**k steps up, and the scores on the way up to it.

    Also the (id, up, by) of the messages on or behind a cycle of parents, None if there are none.
    """
    own = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("id").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("by"))
    jumps = [settle(nodes.join(own, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p"))).select("id", "up", "by"))]
    # messages whose way up is shorter fall out of the join; as soon as none does, all that are left lie on or behind a cycle
    before, left = -1, settled_rows(jumps[0])
    while left not in (0, before):
        far = jumps[-1].select(F.col("id").alias("at"), F.col("up").alias("up2"), F.col("by").alias("by2"))
        jumps.append(settle(jumps[-1].join(far, F.col("up") == F.col("at")).select("id", F.col("up2").alias("up"), (F.col("by") + F.col("by2")).alias("by"))))
        before, left = left, settled_rows(jumps[-1])
    last = jumps.pop()
    return jumps, last if left else None


def _paths(nodes: DataFrame, branches: int | None) -> DataFrame:
    """``paths`` of settled ``nodes`` (id, tree, node, parent, score) as (id, leaf, branch, depth).

    No union is settled on the way: its constraints, an OR of those of its parts, stay with it and would double with each step.
    """
    jumps, cyclic = _jumps(nodes)
    ends = nodes.select("id", "tree", "node", "score")
    if jumps:
        ends = ends.join(jumps[0].select("up"), F.col("id") == F.col("up"), "left_anti")
    if cyclic is not None:
        ends = ends.join(cyclic.select(F.col("id").alias("lost")), F.col("id") == F.col("lost"), "left_anti")
    heads = ends.select("tree", F.col("node").alias("leaf"), "id", F.col("id").alias("at"), F.lit(1).cast("long").alias("length"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    for k in reversed(range(len(jumps))):
        # a leaf's length in binary digits, the largest first
        far = jumps[k].select(F.col("id").alias("from"), "up", "by")
        heads = heads.join(far, F.col("at") == F.col("from"), "left").select(
            "tree", "leaf", "id", F.coalesce("up", "at").alias("at"), F.when(F.col("up").isNull(), F.col("length")).otherwise(F.col("length") + 2**k).alias("length"), (F.col("total") + F.coalesce("by", F.lit(0.0))).alias("total")
        )
        heads = settle(heads) if k % STEPS == 0 and 0 < k < len(jumps) - 1 else heads
    ranked = gapless_rank(heads.select("tree", "leaf", "id", "length", (F.col("total") / F.col("length")).alias("mean")), ["tree"], [F.desc("mean"), F.col("leaf")], "branch")
    chosen = settle((ranked if branches is None else ranked.where(F.col("branch") < branches)).select("id", "leaf", "branch", "length"))
    members = chosen.select("leaf", "branch", "id", F.col("length").alias("depth"))
    for k in reversed(range(len(jumps))):
        # every message found so far, and the one 2**k steps up; a message is joined once a step, so nothing is run twice
        far = jumps[k].select(F.col("id").alias("from"), "up")
        higher = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("id"), (F.col("depth") - 2**k).alias("depth")))
        members = members.join(far, F.col("id") == F.col("from"), "left").select("leaf", "branch", F.inline(F.array(F.struct("id", "depth"), higher))).where("id is not null")
        members = settle(members) if k % STEPS == 0 and 0 < k < len(jumps) - 1 else members
    return members.select("id", "leaf", "branch", "depth")


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, branch, node, depth) for each message on each chosen root-to-leaf path.

    ``messages``: tree, node, parent, score; (tree, node) is unique. A parent that is null or not
    there makes a root. A path's score is the mean of its messages' scores (null: 0); branches of
    a tree are ranked by it from 0, ties to the smaller leaf, and the first ``branches`` chosen
    (None: all). Messages on a cycle of parents have no root and so no path.
    """
    nodes = settle(messages.select(F.monotonically_increasing_id().alias("id"), "tree", "node", "parent", "score"))
    named = nodes.select(F.col("id").alias("i"), "tree", "node")
    return _paths(nodes, branches).join(named, F.col("id") == F.col("i")).select("tree", "leaf", "branch", "node", "depth")


def _formatted(members: DataFrame, texts: DataFrame, most_bytes: int = TREE_BYTES, most_rows: int = TREE_ROWS) -> DataFrame:
    """(tree, leaf, branch, formatted, spans) from ``members`` (tree, leaf, branch, depth, role, key) and ``texts`` (tree, key, text)."""
    types = dict(members.dtypes)
    schema = f"tree {types['tree']}, leaf {types['leaf']}, branch long, formatted string, spans array<struct<start: long, end: long>>"

    def batch(like: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [like.field("tree").type, like.field("leaf").type, pa.int64(), pa.string(), spans]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["tree", "leaf", "branch", "formatted", "spans"])

    def line(tree, leaf, branch, turns) -> tuple:
        formatted, spans = format_turns(turns)
        return tree, leaf, branch, formatted, [{"start": x, "end": y} for x, y in spans]

    # a tree's texts come first, then its paths, each turn by turn
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own, path, turns, rows, size, like = (), {}, None, [], [], 0, None
        for got in batches:
            like = got.schema
            for t, branch, depth, leaf, role, key, text in zip(*(got.column(c).to_pylist() for c in range(7)), strict=True):
                if path is not None and (t != tree or branch != path[1]):
                    rows.append(line(tree, *path, turns))
                    size += len(rows[-1][3])
                    path, turns = None, []
                if t != tree:
                    tree, own = t, {}
                if branch is None:
                    own[key] = text
                else:
                    path = leaf, branch
                    turns.append((role, own[key]))
                if size >= FLUSH:
                    yield batch(like, rows)
                    rows, size = [], 0
        if path is not None:
            rows.append(line(tree, *path, turns))
        if rows:
            yield batch(like, rows)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for tree, leaf, branch, turns in zip(*(got.column(c).to_pylist() for c in range(4)), strict=True):
                # equal texts of a tree come once each; a place on the path counts once
                rows.append(line(tree, leaf, branch, [(t["role"], t["text"]) for t, u in zip(turns, [None, *turns]) if u is None or t["depth"] != u["depth"]]))
            yield batch(got.schema, rows)

    # more than most_bytes in a tree: there are fewer of them than the table has such portions, so their ids are broadcast
    large = settle(
        texts.groupBy("tree").agg(F.sum(F.octet_length("text")).alias("b")).where(F.col("b") > most_bytes).select("tree")
        .union(members.groupBy("tree").count().where(F.col("count") > most_rows).select("tree")).distinct().select(F.col("tree").alias("large"), F.lit(True).alias("is_large"))
    )
    some = not large.isEmpty()
    ordinary = lambda df: df.join(F.broadcast(large), df["tree"].eqNullSafe(F.col("large")), "left_anti") if some else df
    rows = (
        ordinary(members).select("tree", "branch", "depth", "leaf", "role", "key", F.lit(None).cast("string").alias("text"))
        .union(ordinary(texts).select("tree", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast(types["leaf"]), F.lit(None).cast("string"), "key", "text"))
    )
    out = rows.repartition("tree").sortWithinPartitions("tree", F.asc_nulls_first("branch"), "depth").mapInArrow(stream, schema)
    if not some:
        return out
    big = lambda df: df.join(F.broadcast(large), df["tree"].eqNullSafe(F.col("large"))).drop("large", "is_large")
    words = big(texts).select(F.col("tree").alias("t"), F.col("key").alias("k"), "text")
    turns = (
        big(members).join(words, F.col("tree").eqNullSafe(F.col("t")) & (F.col("key") == F.col("k")))
        .groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    )
    return out.unionByName(turns.mapInArrow(gathered, schema))


def _of_trees(nodes: DataFrame, texts: DataFrame, branches: int | None, **bounds: int) -> DataFrame:
    """Paths of settled ``nodes`` (id, tree, node, parent, role, key, score), formatted."""
    found = _paths(nodes.select("id", "tree", "node", "parent", "score"), branches)
    named = nodes.select(F.col("id").alias("i"), "tree", "role", "key")
    members = settle(found.join(named, F.col("id") == F.col("i")).select("tree", "leaf", "branch", "depth", "role", "key"))
    return _formatted(members, texts, **bounds)


def format_trees(messages: DataFrame, branches: int | None = None, **bounds: int) -> DataFrame:
    """(tree, leaf, branch, formatted, spans): each chosen path as one conversation.

    ``messages``: tree, node, parent, role, text, score. Null roles and texts are empty.
    Of several rows with the same tree and node the smallest (parent, role, MD5 of the text) counts.
    A conversation's turns come together in one row, as they have to; a tree of more than ``most_bytes`` of text or
    ``most_rows`` rows on its paths isn't gathered. An empty table gives an empty result.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    nodes = settle(
        messages.groupBy("tree", "node").agg(F.min(F.struct("parent", role.alias("role"), F.unhex(F.md5(text)).alias("key"), "score")).alias("r"))
        .select(F.monotonically_increasing_id().alias("id"), "tree", "node", "r.parent", "r.role", "r.key", "r.score")
    )
    return _of_trees(nodes, messages.select("tree", F.unhex(F.md5(text)).alias("key"), text.alias("text")), branches, **bounds)


def format_conversations(conversations: DataFrame, **bounds: int) -> DataFrame:
    """The same for rows (conv_id, turn, role, text), of which each answers the one before it: trees that are chains.

    Rows are ordered by turn (null first), ties by role, by the text's first 32 characters and by its MD5; all of them
    count, repeated ones too. Null ids are one conversation, null roles and texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.substring(text, 1, 32).alias("start"), F.unhex(F.md5(text)).alias("key")
    )
    ranked = gapless_rank(rows, ["tree"], [F.col("turn"), F.col("role"), F.col("start"), F.col("key")], "node")
    nodes = settle(ranked.select(F.monotonically_increasing_id().alias("id"), "tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "key", F.lit(None).cast("double").alias("score")))
    return _of_trees(nodes, conversations.select(F.col("conv_id").alias("tree"), F.unhex(F.md5(text)).alias("key"), text.alias("text")), None, **bounds)


def digest(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says when it is read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            # the id never leaves Arrow, so a large one beside a null stays what it is
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
