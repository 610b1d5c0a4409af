import numpy as np
import heapq
import random
import zlib

from ostra.llm.sharding import deal, schedule, shard

from tests_data import SMALL, documents


def heap(loads, size, count):
    h, got = [(load, s) for s, load in enumerate(loads)], [0] * len(loads)
    heapq.heapify(h)
    for _ in range(count):
        load, s = heapq.heappop(h)
        got[s] += 1
        heapq.heappush(h, (load + size, s))
    return got


def test_bulk_steps_end_as_the_heap():
    rng = random.Random(3)
    for _ in range(300):
        loads = [rng.randint(0, 200) for _ in range(rng.randint(1, 9))]
        size, count = rng.randint(1, 40), rng.randint(0, 400)
        assert deal(loads, size, count) == heap(loads, size, count)


def longest_first(sizes, shards=8):
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


def check(rows, texts):
    where, groups, loads, slots = {}, {}, [0] * 8, {}
    for r in rows:
        text = r.text or ""
        assert r["size"] == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        assert where.setdefault(text, r.shard) == r.shard
        groups[text] = groups.get(text, 0) + r["size"]
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == texts
    assert sorted(loads) == longest_first(groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def with_text(placed, docs):
    """Each placed row with a text of its id and checksum: ids may be repeated or null."""
    texts = {}
    for r in docs.collect():
        texts.setdefault((r.doc_id, zlib.crc32((r.text or "").encode())), r.text)
    from types import SimpleNamespace

    class Row(SimpleNamespace):
        def __getitem__(self, k):
            return getattr(self, k)

    return [Row(**r.asDict(), text=texts[r.doc_id, r.text_crc32]) for r in placed.collect()]


def test_documents(spark):
    docs = documents(spark, SMALL)
    check(with_text(shard(docs), docs), docs.count())


def test_odd_rows(spark, nasty, empty):
    check(with_text(shard(nasty), nasty), nasty.count())
    assert shard(empty).count() == 0


def test_schedule_in_pieces():
    rng = np.random.default_rng(2)
    sizes = rng.permutation(np.arange(1, 400))
    counts = rng.choice([1, 1, 1, 2, 90], len(sizes))
    whole = list(schedule(sizes, counts, 5))
    pieces = list(schedule(sizes, counts, 5, piece=7))
    assert len(whole) == 1 and len(pieces) == 57 and list(schedule(sizes[:0], counts[:0])) == []
    for k in (0, 1):
        assert (np.concatenate([p[k] for p in pieces]) == whole[0][k]).all()
    loads, wanted = [0] * 5, []
    for size, count in sorted(zip(sizes.tolist(), counts.tolist(), strict=True), reverse=True):
        got = heap(loads, size, count)
        loads = [x + g * size for x, g in zip(loads, got, strict=True)]
        wanted.append(np.cumsum(got))
    assert (whole[0][1] == np.array(wanted)).all()


def test_a_plan_written_in_pieces_is_the_same(spark, nasty):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(shard(nasty, piece=2)) == rows(shard(nasty))
