"""Each stage of the pipeline against a brute-force version on its own input."""

import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
import numpy as np
from ostra.llm.decontam import MATCH, THRESHOLD, align, words_of
from ostra.llm.mixing import targets
from ostra.llm.toxicity import fit

from test_sharding import check, with_text
from test_simhash import brute
from tests_data import SMALL, documents


def plain_score(model, text):
    """The worst window's probability, n-gram by n-gram."""
    words = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or chr(b) in "@$*" else " " for b in text.encode()).split(" ")
    sums = []
    for w in filter(None, words):
        raw, own = b"<" + w.encode("latin-1") + b">", []
        for n in (3, 4, 5, 6):
            for at in range(len(raw) - n + 1):
                h = (2166136261 + n) & 0xFFFFFFFF
                for b in raw[at : at + n]:
                    h = (h ^ b) * 16777619 & 0xFFFFFFFF
                own.append(model.weight[(h ^ (h >> 15)) % len(model.weight)])
        sums.append((sum(own), len(own)))
    pairs = [sums[k : k + 2] for k in range(max(1, len(sums) - 1))] if sums else []
    logit = model.bias + max((sum(s for s, _ in p) / sum(n for _, n in p) for p in pairs), default=0.0)
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def aligned(docs, items):
    """Documents that reach the threshold with some item, by the whole table of every pair."""
    number, bad = {}, set()
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in words_of(t.encode())], np.int32)
    wanted = [x for x in (ids(i.text) for i in items) if len(x)]
    for d in docs:
        text = ids(d.text)
        if len(text) and any(align([x], [text])[0][0] >= THRESHOLD * MATCH * len(x) - 1e-6 for x in wanted):
            bad.add(d.doc_id)
    return bad


def test_stages(spark, tmp_path):
    docs, columns = documents(spark, SMALL), documents(spark, SMALL).columns
    labels, items = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = lambda df: Counter(map(tuple, df.collect()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            model = fit(docs, labels)
            bad = {r.doc_id for r in docs.collect() if plain_score(model, r.text) >= 0.3}
            assert rows(out) == rows(docs.where(~docs.doc_id.isin(list(bad) or [-1])))
        elif name == "simhash_near_dedup":
            kept = {c for _, _, _, c in brute([(r.doc_id, r.text) for r in docs.collect()])}
            assert rows(out) == rows(docs.where(docs.doc_id.isin(list(kept))))
        elif name == "decontamination":
            bad = aligned(docs.collect(), items.collect())
            assert rows(out) == rows(docs.where(~docs.doc_id.isin(list(bad) or [-1]))) and bad
        elif name == "mixing":
            before, copies = docs.collect(), Counter(r.doc_id for r in out.collect())
            assert rows(out) == Counter({tuple(r): copies[r.doc_id] for r in before if copies[r.doc_id]}) and max(copies.values()) <= 3
            n = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
            for source, aim in targets([(x, sum(n[r.doc_id] for r in before if r.source == x)) for x in {r.source for r in before}]).items():
                assert abs(sum(n[r.doc_id] * copies[r.doc_id] for r in before if r.source == source) - aim) <= max(n.values())
        else:
            check(with_text(out, docs), docs.count())
        if name != "sharding":
            assert out.columns == columns
        docs = out


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 100 and {r.shard for r in out.select("shard").distinct().collect()} <= set(range(8))


def test_stages_of_odd_rows(spark, nasty, empty):
    for docs in (nasty.withColumn("n_chars", nasty.doc_id), empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "sharding":
                assert out.columns == docs.columns
            out.count()
