import math
import re
import time
from collections import Counter, defaultdict

import pytest
from ostra.llm.language import declared_language, identify, visible
from ostra.llm.queries import op8_language

from conftest import COLUMNS
from tests_data import MIDDLE, documents


def test_query_on_labelled_rows(spark):
    rows = op8_language(spark, MIDDLE).collect()
    pages, docs = [r for r in rows if r.page_id is not None], [r for r in rows if r.doc_id is not None]
    assert len(pages) == spark.read.parquet(f"{MIDDLE}/pages.parquet").count() and len(docs) == documents(spark, MIDDLE).count()
    assert sum(r.lang == r.declared for r in pages) >= 0.98 * len(pages)
    lang = {r.doc_id: r.lang for r in documents(spark, MIDDLE).collect()}
    assert sum(lang[r.doc_id] == r.lang for r in docs) >= 0.98 * len(docs)


def test_held_out_documents(spark):
    docs = documents(spark, MIDDLE)
    from pyspark.sql import functions as F

    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    truth = {r.doc_id: r.lang for r in docs.where("doc_id % 4 = 0").collect()}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    found = {r.doc_id: r.lang for r in identify(pages, hidden).collect()}
    assert sum(found[i] == x for i, x in truth.items()) >= 0.98 * len(truth)


def test_evidence_decides_where_the_text_says_nothing(spark):
    docs = spark.createDataFrame([(k, "the house and the garden are here" if k % 2 else "das haus und der garten sind hier", "en" if k % 2 else "de", "s") for k in range(40)], "doc_id long, text string, lang string, source string")
    html = lambda lang, body: f'<html lang="{lang}"><body>{body}</body></html>'
    rows = [(k, f"http://a.example.de/{k}", html("de", "das haus und der garten")) for k in range(30)] + [(100 + k, f"http://b.example.com/{k}", html("en", "the house and the garden")) for k in range(30)]
    rows += [(500, "http://a.example.de/x", html("de", "12 34")), (501, "http://b.example.com/x", html("en", "12 34")), (502, "http://new.example.de/x", "<p>5</p>"), (503, "http://a.example.de/y", html("de", "the house and the garden are here " * 20))]
    found = {r.page_id: r.lang for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert (found[500], found[501], found[502], found[503]) == ("de", "en", "de", "en")


def test_odd_rows(spark, nasty, empty):
    pages = spark.createDataFrame([(1, None, None), (None, "http://x", ""), (2, "odd", "<html lang=>"), (2, "odd", "<html lang=>"), (3, "HTTPS://User.Example.FR:80/a", "<html lang='fr-CA'>été" + " mot" * 50_000)], "page_id long, url string, html string")
    rows = identify(pages, nasty).collect()
    assert len(rows) == pages.count() + nasty.count() and all(r.lang in ("en", "de", "fr") for r in rows)
    assert next(r for r in rows if r.page_id == 3).suffix == "fr"
    assert {r.lang for r in identify(pages, empty).collect()} == {None}
    assert identify(pages.limit(0), empty).count() == 0


@pytest.mark.parametrize("piece", [b"<!--", b"<script ", b"<style><", b"<", b"<html lang ", b"&a", b"<html", b" lang  ", b"<!-- x --", b"<script>a</script"])
def test_odd_markup_takes_time_in_proportion(piece):
    began = time.process_time()
    visible(piece * (1_000_000 // len(piece)))
    declared_language(b"<html " + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 1


def test_visible_text_and_declarations():
    old = re.compile(rb"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;|&#\d+;")
    for html in (b"a<b>c</b>&amp;d<!-- <p> -->e<SCRIPT x>1<2</Script >f</script>g<style>h</style>i&#65;j < k", b"<!-- never closed <p>x", b"x<script>y<p>z", b"", b"<", b"a<style>b<!--c</style>d-->e"):
        assert visible(html).split() == old.sub(b" ", html).split()
    assert declared_language(b'<!doctype html><HTML class=x LANG = "De-AT"><p lang=fr>') == "de"
    assert declared_language(b"<html><p lang=fr>") is None and declared_language(b"<html xml:lang=en>") is None and declared_language(b"") is None


def grams(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text)
    line = b" " + b" ".join(low.split()) + b" "
    for n in (3, 4):
        for at in range(len(line) - n + 1):
            h = 2166136261 ^ n
            for b in line[at : at + n]:
                h = (h ^ b) * 16777619 & 0xFFFFFFFF
            yield (h ^ (h >> 16)) & 0xFFFF


def soft(z):
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def brute(pages, docs):
    """The posteriors of all rows by their definition, without numpy or Spark."""
    counts = defaultdict(Counter)
    for _, text, lang, _ in docs:
        if lang is not None and text is not None:
            counts[lang].update(grams(text.encode()))
    langs = sorted(x for x in counts if counts[x])
    n = len(langs)
    seen = []
    for row, text, url, is_html in [((p, None), h, u, True) for p, u, h in pages] + [((None, d), t, s, False) for d, t, _, s in docs]:
        raw = (text or "").encode()
        ids = list(grams(visible(raw) if is_html else raw))
        ll = [sum(math.log((counts[x][i] + 0.5) / (sum(counts[x].values()) + 0.5 * 65536)) for i in ids) * 0.2 for x in langs]
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:@\s]+)", url or "") if is_html else None
        host = (m[1].lower() if m else None) if is_html else url
        parts = host.split(".") if host is not None else []
        suffix = parts[-1] if len(parts) > 1 else None
        seen.append((row, ll, declared_language(raw) if is_html else None, host, ".".join(parts[-2:]) if len(parts) > 1 else host, suffix, soft(ll)))
    add = lambda rows: [sum(r[6][i] for r in rows) for i in range(n)]
    overall = add(seen)
    everywhere = [(c + 1 / n) / (sum(overall) + 1) for c in overall]
    mix = lambda own, above: [(c + 10 * a) / (sum(own) + 10) for c, a in zip(own, above, strict=True)]
    out = {}
    for row, ll, declared, host, domain, suffix, _ in seen:
        prior = everywhere
        if host is not None:
            if suffix is not None:
                prior = mix(add([r for r in seen if r[5] == suffix]), prior)
            prior = mix(add([r for r in seen if (r[4], r[5]) == (domain, suffix)]), prior)
            prior = mix(add([r for r in seen if r[3] == host]), prior)
        z = [x + math.log(p) for x, p in zip(ll, prior, strict=True)]
        for key, at in ((declared, 2), (suffix, 5)):
            if key is not None:
                z = [x + math.log((c + 1) / (o + n)) for x, c, o in zip(z, add([r for r in seen if r[at] == key]), overall, strict=True)]
        out.setdefault(row, []).append(soft(z))
    return langs, out


def test_posteriors_against_brute_force(spark, nasty):
    docs = [(1, "the house and the garden", "en", "a"), (2, "das haus und der garten", "de", "a"), (3, "la maison et le jardin", "fr", None), (4, None, "en", "b.example.de"), (5, "haus garden maison", None, "b.example.de"), (6, "", "de", "a")]
    pages = [(1, "http://b.example.de/x", "<html lang=de><p>haus garten"), (2, "https://c.example.de", "<html lang='en'>the <!-- das --> garden"), (3, None, "jardin"), (4, "http://x.fr/", None), (5, "odd", "<html lang=xx>1 2"), (6, "http://www.d.fr/", "<html lang=de>la maison &amp; le")]
    langs, wanted = brute(pages, docs)
    rows = identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, COLUMNS)).collect()
    assert len(rows) == len(pages) + len(docs)
    for r in rows:
        p = wanted[r.page_id, r.doc_id][0]
        assert r.lang == langs[p.index(max(p))] and abs(r.probability - max(p)) < 1e-4


def test_more_languages_than_a_block_ships(spark):
    letters = "abcdefghij"
    word = lambda k: "".join(letters[int(d)] for d in f"{k * 79 % 1000:03d}") * 2
    docs = spark.createDataFrame([(k, f"{word(k)} " * 8, f"l{k:03d}", "s") for k in range(70)], COLUMNS)
    found = {r.doc_id: r.lang for r in identify(spark.createDataFrame([], "page_id long, url string, html string"), docs).collect()}
    assert found == {k: f"l{k:03d}" for k in range(70)}
