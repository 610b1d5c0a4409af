"""Token counts by the whole-token shortcut.

A byte-level BPE tokenizer first splits a text into pre-tokens and then merges the bytes of each.
Most pre-tokens are strings of the vocabulary that the merges build up again as one token; which
ones do is proved once, offline, by encoding every string of the vocabulary alone. A pre-token
among these counts 1 by one dictionary look-up; only the others are merged, each once a worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ostra.llm.common import text_bytes

#: Pre-tokens of a byte-level tokenizer that splits by its own pattern, in the classes of ``re``;
#: characters of another class in the library are found by ``_odd_characters``.
PRE_TOKENS = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
CLASSES = {"L": r"[^\W\d_]", "N": r"\d", "S": r"\s"}
#: Most pre-tokens whose merged count a worker remembers; beyond it they are merged again.
MEMO = 600_000
#: Longer pre-tokens are merged anew, so the memo's memory is bounded.
MEMO_CHARS = 60


def byte_characters() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


@lru_cache(maxsize=4)
def proof(path: str) -> dict | None:
    """What is proved about a vocabulary, once and offline (on the driver); None: no shortcut for this kind.

    ``whole``: strings that are one pre-token and whose merges end in their own one token, each
    encoded alone by the library; ``special``: strings that the library takes out of a text first;
    ``odd``: characters that our pattern would put in another class than the library does.
    """
    spec = json.loads(open(path, encoding="utf-8").read())
    pre, special = spec["pre_tokenizer"] or {}, [t for t in spec["added_tokens"] if t["content"]]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special)
    if not (plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")):
        return None
    library, split = Tokenizer.from_file(path), re.compile(PRE_TOKENS).findall
    to_byte = {c: b for b, c in byte_characters().items()}
    strings = {}
    for token, i in spec["model"]["vocab"].items():
        try:
            strings[bytes(to_byte[c] for c in token).decode("utf-8")] = i
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token
    names = sorted((t["content"] for t in special), key=lambda t: -len(t))
    strings = {s: i for s, i in strings.items() if s not in names}
    alone = library.encode_batch_fast(list(strings), add_special_tokens=False)
    whole = [s for (s, i), e in zip(strings.items(), alone, strict=True) if e.ids == [i] and split(s) == [s]]
    return {"whole": whole, "special": names, "odd": _odd_characters(library)}


#: Characters from here on are rare enough to be left to the library unproved.
LAST = 0x20000


def _odd_characters(library: Tokenizer) -> str:
    chars = [chr(c) for c in range(LAST) if not 0xD800 <= c < 0xE000]
    ours = {n: set(re.findall(x, "".join(chars))) for n, x in CLASSES.items()}
    odd, split = [], library.pre_tokenizer.pre_tokenize_str
    for start in range(0, len(chars), 8192):
        block = chars[start : start + 8192]
        # a letter joins a letter before it, a number a number, and so on; white space joins none
        joined = {}
        for n, head in (("L", "a"), ("N", "1"), ("P", "!")):
            starts = {at for _, (at, _) in split("\n".join(head + c for c in block))}
            joined[n] = [3 * k + 1 not in starts for k in range(len(block))]
        for k, c in enumerate(block):
            theirs = next((n for n in "LNP" if joined[n][k]), "S")
            if theirs != next((n for n, own in ours.items() if c in own), "P"):
                odd.append(c)
    return "".join(odd)


class WholeTokenCounter:
    """Counts as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, proved: dict | None) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.shortcut = proved is not None
        if not self.shortcut:
            return
        spec = json.loads(open(path, encoding="utf-8").read())
        merges = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
        self.merge = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": merges, "added_tokens": [], "post_processor": None, "decoder": None, "truncation": None, "padding": None}))
        self.special = set(proved["special"])
        self.split = re.compile("(" + "|".join(map(re.escape, proved["special"])) + ")").split if self.special else None
        self.pre_tokens = re.compile(PRE_TOKENS).findall
        self.known = dict.fromkeys(proved["whole"], 1)
        self.proved = len(self.known)
        self.odd = np.zeros(0x110000, bool)
        self.odd[LAST:] = True
        self.odd[[*map(ord, proved["odd"])]] = True

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.shortcut:
            return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out, known, rest = [], self.known, {}
        waiting: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if self.odd[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any():
                out.append(len(self.library.encode(text, add_special_tokens=False).ids))
                continue
            total, unknown = 0, []
            for part in self.split(text) if self.split is not None else (text,):
                if part in self.special:
                    total += 1
                elif part:
                    pieces = self.pre_tokens(part)
                    counts = list(map(known.get, pieces))
                    missing = counts.count(None)
                    if missing:
                        unknown += [p for p, n in zip(pieces, counts) if n is None]
                        total += sum(filter(None, counts))
                    else:
                        total += sum(counts)
            out.append(total)
            if unknown:
                waiting.append((k, unknown))
                rest.update(dict.fromkeys(unknown))
        if rest:
            pieces = list(rest)
            counts = dict(zip(pieces, (len(e.ids) for e in self.merge.encode_batch_fast(pieces, add_special_tokens=False)), strict=True))
            for k, unknown in waiting:
                out[k] += sum(map(counts.__getitem__, unknown))
            if len(known) < self.proved + MEMO:
                known.update((p, n) for p, n in counts.items() if len(p) <= MEMO_CHARS)
        return out


_counters: dict[str, WholeTokenCounter] = {}


def counter(path: str, proved: dict | None) -> WholeTokenCounter:
    """One counter a worker process and vocabulary."""
    if path not in _counters:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _counters[path] = WholeTokenCounter(path, proved)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` to the other columns of ``docs`` (the text is dropped).

    Whole texts are counted. A null text counts as empty: 0 bytes, 0 tokens. Special strings in a
    text are one token, as by the library's default. Columns of the result's names are replaced.
    A map over the rows without any shuffle; repeated rows are counted each.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c not in added]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])

    shipped = docs.sparkSession.sparkContext.broadcast(proof(path))  # no more than the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, shipped.value).count
        for batch in batches:
            raw = text_bytes(batch.column(len(kept)))
            n = count([t.decode("utf-8", "replace") for t in raw])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[*kept, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(kept)], docs[f"`{text}`"].alias("_text")).mapInArrow(run, schema)
