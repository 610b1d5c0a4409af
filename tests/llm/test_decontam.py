import random
import time

import numpy as np
from ostra.llm.decontam import GAP, MATCH, MISMATCH, THRESHOLD, Detector, Items, align, contaminations, drop_contaminated, words_of
from ostra.llm.queries import op5_decontamination

from tests_data import MIDDLE, SMALL, documents


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return int(h.max())


def test_alignment_against_the_table():
    rng = random.Random(4)
    a = [np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 12))], np.int32) for _ in range(100)]
    b = [np.array([rng.randint(-1, 5) for _ in range(rng.randint(1, 20))], np.int32) for _ in range(100)]
    assert [s for s, _ in align(a, b)] == [smith_waterman(x, y) for x, y in zip(a, b, strict=True)]


def brute(docs, items):
    out = set()
    for d in docs:
        text = words_of((d.text or "").encode())
        for i in items:
            item = words_of((i.text or "").encode())
            if item and smith_waterman(item, text) >= THRESHOLD * MATCH * len(item):
                out.add((d.doc_id, i.item_id))
    return out


def test_query_finds_every_copy_and_nothing_clean(spark):
    found = {(r.doc_id, r.item_id) for r in op5_decontamination(spark, MIDDLE).collect()}
    items = [(r.item_id, b" ".join(words_of(r.text.encode()))) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    exact = set()
    for d in documents(spark, MIDDLE).collect():
        text = b" " + b" ".join(words_of(d.text.encode())) + b" "
        exact |= {(d.doc_id, i) for i, t in items if b" " + t + b" " in text}
    assert exact <= found
    few = documents(spark, SMALL).where("length(text) < 900").orderBy("doc_id").limit(25).collect()
    some = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(8).collect()
    small = contaminations(documents(spark, SMALL), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()
    kept_docs, kept_items = {d.doc_id for d in few}, {i.item_id for i in some}
    assert {(r.doc_id, r.item_id) for r in small if r.doc_id in kept_docs and r.item_id in kept_items} == brute(few, some)


def edited(words, rng, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, "extra"] if x < 2 * rate / 3 else ["changed"] if x < rate else [w]
    return out


def test_edited_copies(spark):
    rng = random.Random(5)
    items = spark.read.parquet(f"{MIDDLE}/benchmark.parquet")
    docs, planted = [], []
    clean = [r.text for r in documents(spark, MIDDLE).where("length(text) < 3000").limit(120).collect()]
    for k, r in enumerate(items.orderBy("item_id").collect()):
        words = r.text.split()
        docs.append((k, clean[k] + " " + " ".join(edited(words, rng, 0.15)) + " " + clean[k + 1]))
        planted.append((k, r.item_id))
    found = {(r.doc_id, r.item_id) for r in contaminations(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert sum(p in found for p in planted) >= 0.95 * len(planted)


def test_a_passage_in_most_documents_keeps_its_seeds(spark):
    item = "curious violet engines hum beneath seven quiet bridges every winter morning until dusk"
    docs = spark.createDataFrame([(k, f"{k} filler words {item} more filler" if k % 3 else f"{k} only filler words") for k in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in contaminations(docs, items).collect()} == {k for k in range(300) if k % 3}
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {k for k in range(300) if not k % 3}


def test_many_equal_edited_and_cut_copies(spark):
    """Every document with every item by the whole table: what few n-grams find, be they in hundreds of documents."""
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(40))) for k in range(4)]
    words = [t.split() for _, t in items]
    spread = [w for k, w in enumerate(words[2]) for w in ([w, *["filler"] * 26] if k == 25 else [w])]  # more than half an item between its parts
    kinds = [
        ["changed" if k % 8 == 7 else w for k, w in enumerate(words[0])], words[1][:24], spread, words[3][18:],
        [w for k, w in enumerate(words[0]) if k % 9 != 4], words[1][:14],  # the last one is below the threshold
    ]
    docs = [(300 * k + i, " ".join([f"before{i}", "plain", *kind, "after", f"it{i}"])) for k, kind in enumerate(kinds) for i in range(200)]
    docs += [(9000 + i, " ".join(words[i % 4][j : j + 3])) for i in range(40) for j in (5, 20)]  # seeds that stand alone
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    by_text = {}
    for d, t in docs:
        key = t.replace(f"before{d % 300}", "x").replace(f"it{d % 300}", "x")
        by_text.setdefault(key, []).append(d)
    wanted = {}
    for t, ids in by_text.items():
        for i, w in items:
            a = words_of(w.encode())
            score = smith_waterman(a, words_of(t.encode())) / (MATCH * len(a))
            wanted |= {(d, i): score for d in ids if score >= THRESHOLD}
    assert len(wanted) >= 5 * 200 and not any(d // 300 == 5 for d, _ in wanted)
    assert {(r.doc_id, r.item_id): r.score for r in contaminations(rows, frame).collect()} == wanted
    bad = {d for d, _ in wanted}
    assert sorted(r.doc_id for r in drop_contaminated(rows, frame).collect()) == sorted(d for d, _ in docs if d not in bad)


def test_long_stretches_are_split():
    rng = random.Random(7)
    item = [f"w{rng.randint(0, 9)}" for _ in range(30)]
    text = " ".join([*item[:3]] * 5000 + item + [*item[:3]] * 3000).encode()
    (found,) = Detector(Items([7], [" ".join(item).encode()]), THRESHOLD).find([text])
    assert found[:3] == (0, 7, 1.0)


def test_odd_rows_and_blocks(spark, nasty, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (None, "x y z"), (3, ""), (4, "one"), (5, "one two"), (1, "alpha beta gamma delta")], "item_id long, text string")
    # "one" alone is half of item 5, but holds no seed of it
    wanted = sorted([(1, 1), (1, 1), (2, 1), (8, 4), (9, 4), (9, 5)])
    for most in (8 << 20, 1):
        found = sorted((r.doc_id, r.item_id) for r in contaminations(nasty, items, most=most).collect())
        assert found == wanted
        kept = drop_contaminated(nasty, items, most=most)
        assert kept.columns == nasty.columns and kept.count() == nasty.count() - 5
    assert contaminations(empty, items).count() == 0 and contaminations(nasty, items.limit(0)).count() == 0


def test_recall_by_copies_and_edits():
    """Of all passages that the whole table finds, by edit rate, in up to 50 copies that are edited alike or each for itself."""
    rng = random.Random(8)
    items = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(50)) for _ in range(6)]
    detector = Detector(Items(list(range(6)), [t.encode() for t in items]), THRESHOLD)
    plain = [f"w{k}" for k in range(900)] + [f"x{k}" for k in range(900)]
    for rate in (0.0, 0.1, 0.2, 0.3):
        texts = []
        for k, t in enumerate(items):
            same = edited(t.split(), rng, rate)
            for n in range(50 if k < 2 else 10):
                piece = same if k % 2 else edited(t.split(), rng, rate)
                texts.append(" ".join([*rng.choices(plain, k=30), *(piece if n % 3 else piece[: len(piece) * 2 // 3]), *rng.choices(plain, k=30)]).encode())
        wanted = {(k, i) for k, t in enumerate(texts) for i, item in enumerate(items) if smith_waterman_fast(words_of(item.encode()), words_of(t)) >= THRESHOLD * MATCH * 50}
        found = {(k, i) for k, i, _, _ in detector.find(texts)}
        assert found <= wanted and len(found) >= 0.95 * len(wanted) > 0, (rate, len(found), len(wanted))


def smith_waterman_fast(a, b):
    number = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t], np.int32) for t in (a, b))
    return align([x], [y])[0][0]


def test_texts_that_repeat_themselves():
    item = " ".join(["one of the"] * 400)
    detector = Detector(Items([1, 2], [item.encode(), b"one of the rare passages that stand in a test of twelve words"]), THRESHOLD)
    began = time.process_time()
    found = detector.find([b"one of the " * 100_000, b"of the one " * 100])
    assert {(k, i) for k, i, _, _ in found} == {(0, 1)}
    assert time.process_time() - began < 30
