"""A small interactive search: ``python -m ostra.cli INDEX``; ``--build`` makes the index of a TSV corpus first."""

from __future__ import annotations

import argparse
import importlib

from ostra.operators.index import build_index
from ostra.operators.search import SearchEngine
from ostra.session import local_session
from ostra.sources.corpus import read_corpus
from ostra.sources.store import load_model, read_raw_vectors


class Shell:
    """Commands ``mode:exact``, ``mode:semantic``, ``mode:combined``, ``enable:ltr``, ``disable:ltr`` and ``exit``; all else is a query."""

    def __init__(self, engine: SearchEngine) -> None:
        self.engine, self.mode, self.ltr = engine, "exact", False

    def command(self, line: str) -> str | None:
        """The answer to a command; None if the line is a query."""
        if line.startswith("mode:") and line[5:] in ("exact", "semantic", "combined"):
            if line[5:] != "exact" and not self.engine.semantic:
                return f"no {line[5:]} search without vectors and an embedder, mode {self.mode}"
            self.mode = line[5:]
            self.ltr = self.ltr or self.mode == "combined"  # a combined list has no order but the re-ranked one
            return f"mode {self.mode}"
        if line == "enable:ltr":
            if self.engine.model is None:
                return "no model to re-rank by"
            self.ltr = True
            return "re-ranking on"
        if line == "disable:ltr":
            self.ltr = False
            if self.mode == "combined":
                self.mode = "exact"
            return f"re-ranking off, mode {self.mode}"
        return None

    def search(self, query: str):
        e = self.engine
        if self.mode == "combined":
            return e.combined_search(query)
        return (e.semantic_search if self.mode == "semantic" else e.exact_search)(query, ltr_enabled=self.ltr)

    def run(self) -> None:
        while (line := input("> ").strip()) != "exit":
            said = self.command(line)
            if said is not None:
                print(said)
            elif line:
                better, n = self.engine.suggest(line)
                if n:
                    print(f"did you mean: {better}")
                self.search(line).select("rank", "doc_id", "score", "source", "title", "snippet").show(truncate=80)


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ostra", description=__doc__)
    p.add_argument("index", help="folder of the index")
    p.add_argument("--build", metavar="TSV", help="index this corpus (docid, url, title, body) first; .gz is read as well")
    p.add_argument("--stem", action="store_true", help="stem the words of a new index")
    p.add_argument("--documents", type=int, help="index the first so many documents only")
    p.add_argument("--vectors", help="raw float32 vectors of the documents, or a Parquet table (vec_id, embedding)")
    p.add_argument("--dim", type=int, default=64, help="their dimension")
    p.add_argument("--embedder", metavar="MODULE:FUNCTION", help="a function from a query's text to its vector")
    p.add_argument("--model", help="path of a saved re-ranker, without .npz")
    a = p.parse_args(arguments)
    spark = local_session()
    if a.build:
        build_index(read_corpus(spark, a.build), a.index, a.stem, a.documents)
    vectors = embed = None
    if a.vectors:
        vectors = spark.read.parquet(a.vectors) if a.vectors.endswith(".parquet") else read_raw_vectors(spark, a.vectors, a.dim)
    if a.embedder:
        module, _, function = a.embedder.partition(":")
        embed = getattr(importlib.import_module(module), function)
    engine = SearchEngine(spark, a.index, vectors, embed, load_model(a.model) if a.model else None)
    engine.cache()
    Shell(engine).run()


if __name__ == "__main__":
    main()
