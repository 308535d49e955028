from __future__ import annotations

import random
import textwrap

import numpy as np

from loomline.llm import op2_host_paths as op2
from loomline.llm import op6_permutation_index as op6
from loomline.llm import op9_license_rules as op9
from loomline.llm import op10_chroma_fingerprints as op10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy</div><div role=search><form>Find</form></div>
<article class="post-12"><h1>Head &amp; line</h1><p>One  <b>two<br>three</b>&nbsp;four<p>Five<!-- no --> six<div class="comments">Rude</div>
<aside>Side</aside><ul><li>a<li>b</ul></article><footer>&copy; x</footer>"""


def test_pages(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, "http://a.example/y", "<body><div>plain <p>text"), (3, None, None), (4, "http://b.example", ""), (5, "nope", "<nav>only</nav>"), (1, "http://a.example/x", PAGE)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string")
    got = sorted((r.page_id, r.text) for r in op2.extract(pages).collect())
    main = "Head & line\n\nOne two three four\n\nFive six\n\na\n\nb"
    assert got == [(1, main), (1, main), (2, "plain\n\ntext"), (3, ""), (4, ""), (5, "")]
    assert op2.extract(pages.limit(0)).collect() == []
    assert {r.host: r.path for r in op2.winning_paths(pages.where("page_id = 1")).collect()} == {"a.example": "/html/body/article.post-#"}


ARTICLE = "<h1>Title here</h1><p>one two three four five six seven</p><p>more words in here for the text</p>"


def test_no_template_loses_its_article():
    text = "Title here\n\none two three four five six seven\n\nmore words in here for the text"
    for html in (
        '<div class="layout has-sidebar">%s</div>', '<div class="post comments-open">%s</div>', "<form id=aspnetForm><div>%s</div></form>", '<div class="site-footer">foot</div><div class="comments"><p>c</p></div>%s',
        "<form><p>search</p><input></form>%s", '<header class="page-header">top</header><main>%s</main><div id="cookie-banner">ok</div>', '<div data-role="navigation" title="hidden nav">%s</div>', "<script>if (a < b) '</p>'</script>%s<nav>n",
    ):
        assert op2.Page("<html><body>" + html % ARTICLE).text(None) == text
    for lead in ('<p title="a hidden gem">gem</p>', '<p aria-hidden="false">gem</p>', '<p data-id="related">gem</p>', '<p class="share-price">gem</p>'):
        assert op2.Page("<body>" + lead + ARTICLE).text(None) == "gem\n\n" + text


def test_hostile_pages_take_time_in_proportion():
    for bad in ("<a '", '<a x="', "<", "<!--", "<script>", "</", "<p", "<form>", "&"):
        op2.Page(bad * 50_000).text(None)
    assert op2.Page("<p>" + "word " * 200_000).text(None) == ("word " * 200_000).strip()


def test_neighbours_equal_brute_force_on_few_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.1, 3, size=(300, 1))
    rows = [(i, [float(v) for v in x[i]], i) for i in range(300)]
    rows += [(400, None, 0), (420, [0.0] * 8, 0), (440, [float("nan")] + [1.0] * 7, 0), (460, [1.0], 0), (480, [None] + [1.0] * 7, 0), (500, rows[0][1], 0), (20, rows[20][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long")
    got = {}
    for r in op6.every_twentieth(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = [*range(300), 500]
    every = np.append(x, x[:1], axis=0)
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        score = (every * every[ids.index(q)]).sum(axis=1)
        want = sorted((-s, i) for i, s in zip(ids, score.tolist(), strict=True) if i != q)[:20]
        assert sorted(found) == list(range(1, 21))
        listed = [found[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda f: (-f[1], f[0])) and all(abs(s - score[ids.index(v)]) < 1e-12 for v, s in listed)
        hits += len({v for v, _ in listed} & {i for _, i in want})
    assert hits / (20 * len(got)) >= 0.9
    assert op6.every_twentieth(table.limit(0)).collect() == []


def test_few_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(op6, "SHARD", 16)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<double>")
    got = op6.every_twentieth(same).collect()
    assert len(got) == 5 * 20
    assert [r.vec_id for r in sorted(got) if r.query_id == 0] == list(range(1, 21))
    one = same.where("vec_id < 3")
    assert [(r.query_id, r.vec_id) for r in sorted(op6.every_twentieth(one).collect())] == [(0, 1), (0, 2)]


def test_licenses(spark):
    s = op9.SENTENCES
    texts = [None, "", s[3], "Intro. " + s[1] + "\nFoo bar baz words.\n" + s[2].upper() + " End", s[2] + " " + s[1], s[40] + "\n" + s[41], "x " * 50_000 + "\n" + s[10], s[3] + "\n" + s[30]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rule string")
    got = sorted((r.doc_id, r.rule) for r in op9.scan(docs).collect())
    assert got == [(2, "mit-notice"), (3, "mit-text"), (5, "bsd-3-text"), (6, "apache-2-notice"), (7, "cc-by-nc-4-notice"), (7, "mit-notice")]
    plan = op9.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_wrapped_licenses(spark):
    s = op9.SENTENCES
    wrapped = lambda t, mark: "\n".join(mark + line for line in textwrap.wrap(t, 70))
    apache = "/*\n" + wrapped(s[11], " * ") + "\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n */"
    texts = [
        apache,
        wrapped(s[1], "") + "\n\n" + wrapped(s[2], ""),
        wrapped(s[21], "# ") + "\n#\n" + wrapped(s[22], "# "),
        "Head\r\n" + wrapped(s[40], "// ").replace("\n", "\r\n") + "\r\n" + wrapped(s[41], "// "),
        s[3] + " " + "*" * 5000,
        "No title\n" + s[3] + "\nmore",
        "It is not " + s[3],
        s[11].replace("2.0 ", "2.0\n"),
        "#!/bin/sh\n# SPDX-License-Identifier: MIT\necho",
        wrapped(s[40], "; "),
        wrapped(s[37], "/// "),
        wrapped(s[38], " ") + "\n" + wrapped(s[39], " "),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.rule) for r in op9.scan(docs).collect())
    assert got == [(0, "apache-2-header"), (1, "mit-text"), (2, "gpl-3-header"), (3, "bsd-3-text"), (4, "mit-notice"), (5, "mit-notice"), (8, "spdx-mit"), (9, "bsd-2-text"), (10, "isc-text"), (11, "zlib-text")]


def test_recordings_align(spark):
    rng = random.Random(1)
    a = [rng.gauss(0, 0.2) for _ in range(64)]
    b = [rng.gauss(0, 0.2) for _ in range(64)]
    part = a[9:] + [rng.gauss(0, 0.2) for _ in range(9)]
    rows = [(0, a), (1, b), (2, part), (3, None), (4, []), (5, a[:3]), (6, a), (7, [0.0] * 64), (8, [0.0] * 64), (20, [0.0] * 64)]
    media = spark.createDataFrame([(i, v, "y") for i, v in rows], "vec_id long, embedding array<double>, marks string")
    marks = op10.fingerprints(media, "vec_id", "embedding", render=True).cache()
    assert {r.id: len(r.marks) for r in marks.collect()}[4] == 0
    got = {(r.query_id, r.id): (r.offset, r.error_rate) for r in op10.matches(marks, marks.where("id % 20 = 0")).collect()}
    assert got[0, 6] == (0, 0.0) and got[0, 2][0] == 9 and got[0, 2][1] < 0.05
    assert (0, 1) not in got and {k for q, k in got if q == 20} == {7, 8}
    hot = op10.matches(marks, marks.where("id % 20 = 0"), often=3)
    assert {(r.query_id, r.id) for r in hot.collect()} >= {(0, 6), (0, 2)}
    marks.unpersist()
    assert op10.samples(b"RIFFxx").size == 0 and op10.fingerprint(None).size == 0


def test_links_of_every_recording_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**32, (3, 30))
    rows = {i: base[i % 3].copy() for i in (0, 1, 2, 3, 4, 20, 21, 40)}
    rows[3] = base[0] ^ (1 << rng.integers(0, 32, 30))
    rows[3][5] = base[0][5]
    rows[7] = np.array([], dtype=np.int64)
    rows[9] = rng.integers(0, 2**32, 30)
    marks = spark.createDataFrame([(i, [int(v) for v in m]) for i, m in rows.items()], "id long, marks array<long>")
    got = {r.id: r for r in op10.linked(marks, marks.where("id % 20 = 0")).collect()}
    assert set(got) == {i for i in rows if len(rows[i])}

    def alike(a, b):
        x, y = rows[a], rows[b]
        return bool((x == y).any()) and np.bitwise_count(x ^ y).sum() / (32 * 30) <= op10.ERRORS

    for i, r in got.items():
        others = [j for j in got if j != i and (i % 20 == 0 or j % 20 == 0) and alike(i, j)]
        assert r.links == len(others)
        assert r.class_id == min(j for j in got if len(rows[i]) == len(rows[j]) and (rows[i] == rows[j]).all())
    assert got[3].best_id == 0 and got[3].offset == 0 and got[3].component_id == 0 and got[9].best_id is None
    assert op10.linked(marks.limit(0), marks.limit(0)).collect() == []


def test_one_shared_integer_is_enough_however_often_it_is_held(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**32, 30)
    noisy = x ^ (1 << rng.integers(0, 32, 30))
    noisy[7] = x[7]
    rows = [(0, x), (1, noisy), (2, np.append(noisy[:29], x[0])), (3, noisy[4:])]
    rows += [(20 + i, np.append(rng.integers(0, 2**32, 12), x[7])) for i in range(30)]
    marks = spark.createDataFrame([(i, [int(v) for v in m]) for i, m in rows], "id long, marks array<long>")
    for often in (1, 3, 2000):
        got = sorted((r.query_id, r.id, r.offset, r.votes, r.overlap) for r in op10.matches(marks, marks.where("id % 20 = 0"), often).collect())
        assert got == [(0, 1, 0, 1, 30), (0, 2, 0, 1, 30), (0, 3, 4, 1, 26)]


def test_fingerprint_survives_noise_and_volume():
    rng = np.random.default_rng(3)
    x = rng.normal(size=64).tolist()
    audio = op10.rendered(x)
    y = np.frombuffer(audio[44:], dtype="<i2").astype(float) * 0.5 + rng.normal(size=(len(audio) - 44) // 2) * 60
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(op10.RATE)
        w.writeframes(y.astype("<i2").tobytes())
    p, q = op10.fingerprint(audio), op10.fingerprint(out.getvalue())
    assert np.bitwise_count(p ^ q).sum() / (32 * len(p)) < 0.1
