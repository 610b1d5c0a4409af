import random
import re

import pytest
from ostra.llm.mixing import MOST, fit, mix, mixed_documents, subset_sum, targets

from tests_data import SMALL, documents


def test_targets_are_shared_anew_until_none_is_above():
    t = targets([("a", 10), ("b", 1000), (None, 500), ("c", 5)])
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(1515)
    assert all(t[s] <= 3 * n for s, n in [("a", 10), ("b", 1000), (None, 500), ("c", 5)])
    assert targets([("a", 0)]) == {"a": 0.0} and targets([]) == {}
    assert targets([("b", 10), ("a", 10)])["a"] > targets([("b", 10), ("a", 10)])["b"]


def test_subset_sum_is_best_possible():
    rng = random.Random(1)
    for _ in range(200):
        lengths = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        budget = rng.randint(0, 40)
        sums = {0}
        for n, c in lengths.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        got = subset_sum(lengths, budget, rng.randint(0, 9))
        assert sum(n * k for n, k in got.items()) == best
        assert all(0 < k <= lengths[n] for n, k in got.items())


def test_fit_takes_what_is_asked_for():
    rng = random.Random(2)
    for _ in range(100):
        counts = {rng.randint(0, 3000): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        size = sum(n * c for n, c in counts.items())
        target = rng.random() * 3 * size
        got = fit(counts, target)
        assert all(0 <= p <= MOST and 0 <= e <= counts[n] and p * counts[n] + e <= MOST * counts[n] for n, (p, e) in got.items())
        taken = sum(n * (p * counts[n] + e) for n, (p, e) in got.items())
        smallest = min((n for n in counts if n), default=1)
        assert abs(taken - target) <= max(smallest, max(counts)) and taken <= round(target)


def check(rows):
    """The contract of a mix: (source, size, source_size, target, taken)."""
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    aim = targets(list(sizes.items()))
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aim[r.source])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - aim[s]) <= max(r["size"] for r in rows if r.source == s) + 1


def test_mix_of_documents(spark):
    docs = documents(spark, SMALL)
    a, b = mix(docs).collect(), mix(docs.repartition(5)).collect()
    check(a)
    assert sorted((r.doc_id, r.taken) for r in a) == sorted((r.doc_id, r.taken) for r in b)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t.text)) for r, t in zip(sorted(a, key=lambda r: r.doc_id), docs.orderBy("doc_id").collect(), strict=True))


def test_mix_of_odd_rows(spark, nasty, empty):
    rows = mix(nasty).collect()
    assert len(rows) == nasty.count()
    check(rows)
    assert {r.taken for r in rows if r["size"] == 0} == {0}
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_documents_follow_the_mix(spark, nasty):
    docs = documents(spark, SMALL)
    wanted = sorted(r.doc_id for r in mix(docs).collect() for _ in range(r.copies))
    out = mixed_documents(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == wanted
    assert mixed_documents(nasty).columns == nasty.columns
