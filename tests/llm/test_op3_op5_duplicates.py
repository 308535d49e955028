from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from loomline.llm import op3_paragraph_dedup as op3
from loomline.llm import op5_minmax_dedup as op5
from loomline.llm import shingles, similar
from loomline.llm.components import components
from loomline.llm.shared import written

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def edited(rng: random.Random, own: list[str], n: int) -> list[str]:
    own = list(own)
    for _ in range(n):
        own[rng.randrange(len(own))] = "x" + str(rng.randrange(10**6))
    return own


def brute(texts: dict[int, str | None], size: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    least = {i: i for i in texts}
    changed = True
    links = [(a, b) for a, b in combinations(texts, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return {i: (len(sets[i]), least[i]) for i in texts}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out: dict[int, str | None] = {0: None, 1: "", 2: " \t\n", 3: "One two", 4: "one  TWO", 5: "one", 6: "É é", 7: "é é", 8: "a b c", 9: "A B c"}
    base = words(rng, 120)
    for i in range(60):  # a chain: neighbours are alike, far ones are not
        out[100 + i] = " ".join(base)
        base = edited(rng, base, 2)
    hub = words(rng, 200)
    for i in range(90):  # a crowd of copies and near copies
        out[200 + i] = " ".join(edited(rng, hub, i % 9))
    for i in range(60):
        out[400 + i] = " ".join(words(rng, rng.randint(1, 80)))
    out[500] = " ".join(words(rng, 30_000))
    out[501] = out[500] + " tail"
    return out


@pytest.mark.parametrize(("size", "percent", "paired"), [(3, 85, 40), (5, 80, 40), (3, 85, 2)])
def test_near_duplicates_equal_brute_force(spark, texts, size, percent, paired, monkeypatch):
    monkeypatch.setattr(similar, "PAIRED", paired)
    monkeypatch.setattr(similar, "BROADCAST_ROWS", 5 if paired == 2 else 1000)
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in op5.near_duplicates(docs, size, percent).collect()}
    want = brute(texts, size, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_keep_one_keeps_one_of_each_group(spark, texts):
    rows = [(i, t, 1) for i, t in texts.items()] + [(8, "a b c", 1), (None, "lone", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    kept = op5.keep_one(docs.withColumnRenamed("kept", "keys"))
    want = {i for i, (_, c) in brute(texts, 5, 80).items() if i == c} | {None}
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(want, key=str)


def test_components_of_paths_loops_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 299: 299, 300: 299}


def test_paragraphs_are_removed_but_once(spark):
    rng = random.Random(2)
    a, b, c = words(rng, 60), words(rng, 60), words(rng, 200)
    line = lambda w: " ".join(w)
    near = edited(rng, c, 3)
    rows = [
        (1, "\n".join([line(a), "short one", line(b)]), 0),
        (2, "\n".join(["intro", line(a), "short one"]), 0),
        (3, line(c), 0),
        (4, "\n".join(["", line(near).upper(), "end"]), 0),
        (5, line(words(rng, 80)), 0),
        (6, None, 0),
        (7, "", 0),
        (8, "\n".join([line(b), line(b)]), 0),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_chars long, place string")
    got = sorted((r.doc_id, r.place, r.kept_doc_id, r.kept_place) for r in op3.removals(docs).collect())
    assert got == [(2, 1, 1, 0), (4, 1, 3, 0), (8, 0, 1, 2), (8, 1, 1, 2)]
    out = {r.doc_id: r for r in op3.cleaned(docs).collect()}
    assert op3.cleaned(docs).columns == docs.columns
    assert out[2].text == "intro\nshort one" and out[4].text == "\nend" and out[8].text == "" and out[6].text is None
    assert out[1].text == rows[0][1] and out[2].n_chars == len(out[2].text) and out[5].text == rows[4][1]


def test_passages_are_found_wherever_lines_break(spark):
    rng = random.Random(8)
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    p, q, r, s, one = words(rng, 51), words(rng, 55), words(rng, 50), words(rng, 49), words(rng, 60)
    new = lambda n: words(rng, n)
    before, after, tail = new(150), new(150), new(30)
    rows = [
        (1, wrap(new(70) + p + new(70), 12)),
        (2, wrap(new(75) + [w.upper() for w in p] + new(64), 9)),
        (3, " ".join(new(200) + q + new(200))),
        (4, "é top\n" + " ".join(before + q + after) + "\nend"),
        (5, " ".join(new(90) + r)),
        (6, " ".join(tail + r)),
        (7, " ".join(new(90) + s)),
        (8, " ".join(new(90) + s)),
        (9, "same " * 120),
        (10, wrap(one, 10)),
        (11, "head\n\n" + wrap(one[:30] + ["other"] + one[31:], 10) + "\n\nfoot"),
        (6, "another text of this id"),
    ]
    docs = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, version string")
    out = [(r.doc_id, r.text) for r in op3.cleaned(docs).collect()]
    assert (6, " ".join(tail)) in out and rows[11] in out
    got = dict(o for o in out if o != rows[11])
    for i in (1, 3, 5, 7, 8, 10):
        assert got[i] == rows[[k for k, _ in rows].index(i)][1]
    assert got[2].split() == rows[1][1].split()[:75] + rows[1][1].split()[126:]
    assert got[4] == "é top\n" + " ".join(before + after) + "\nend"
    assert got[9].split() == ["same"] * 50 and got[11] == "head\n\n\nfoot"
    kept = {(r.doc_id, r.kept_doc_id) for r in op3.removals(docs).collect()}
    assert kept == {(2, 1), (4, 3), (6, 5), (9, 9), (11, 10)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert op5.near_duplicates(docs).collect() == [] and op5.keep_one(docs).collect() == []
    assert op3.removals(docs).collect() == [] and op3.cleaned(docs).collect() == []


def crowd(rng: random.Random, many: int) -> dict[int, list[str]]:
    """Texts that share one run of words, too few to be alike, and some pairs that are."""
    hub = words(rng, 60)
    out = {i: hub + words(rng, 90) for i in range(many)}
    for i in range(0, many, 3):
        out[many + i] = edited(rng, out[i], 1)
    return out


@pytest.mark.parametrize(("block", "items"), [(1000, 500_000), (7, 500_000), (1000, 900)])
def test_large_buckets_lose_no_link(spark, block, items, monkeypatch):
    """Units that share a single key, their own bucket's: no second key can vouch for a pair."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "BLOCK_ITEMS", items)
    texts = crowd(random.Random(4), 60)
    sets = {i: np.unique(shingles.hashed([" ".join(w[k : k + 3]).encode() for k in range(len(w) - 2)])) for i, w in texts.items()}
    hashing = shingles.MinMax(24, 4)
    rows = []
    for i, s in sets.items():
        _, sig = hashing.signed(s, np.array([0]))
        rows.append((i, len(s), [1], sig[0].tobytes()))
    units = written(spark.createDataFrame(rows, "id long, n long, keys array<long>, sig binary"), "units")
    items_df = written(spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in sets.items()], "id long, items binary"), "items")
    found, _ = similar.clusters(units, lambda ids: items_df.join(ids, "id", "left_semi"), 85)
    want = {}
    for a, b in combinations(sorted(sets), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            want[a] = want[b] = a
    assert len(want) == 40 and {r.node: r.component for r in found.collect()} == want


@pytest.fixture
def no_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_repetitions_are_not_shuffled(spark, no_broadcasts):
    """Even where lists are too large for a broadcast, texts that have no part in any stay where they are."""
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 8000))) for i in range(60)]
    copy, passage = " ".join(words(rng, 90)), " ".join(words(rng, 70))
    rows += [(100, copy), (101, copy), (102, f"{passage} {rows[0][1][:300]}"), (103, f"{rows[1][1][:300]} {passage}")]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    before = shuffled(spark)
    got = {r.doc_id for r in op3.removals(docs).collect()}
    assert got == {101, 102, 103}
    assert shuffled(spark) - before < sum(len(t) for _, t in rows)


def test_results_do_not_depend_on_batches(spark, no_broadcasts, monkeypatch):
    rng = random.Random(10)
    base = [words(rng, 90) for _ in range(12)]
    rows = [(i, "\n".join(" ".join(edited(rng, base[rng.randrange(12)], rng.randrange(3))) for _ in range(3))) for i in range(40)]
    rows += [(50 + i, " ".join(words(rng, 30) + base[i][:55 + i] + words(rng, 30))) for i in range(12)] + rows[:5]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    want = sorted(op3.removals(docs).drop("component_id").collect(), key=str)
    assert len(want) > 90 and any(r.start is not None for r in want)
    monkeypatch.setattr(op3, "MOST_BITS", 8)  # texts are marked in vain
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(op3.removals(docs).drop("component_id").collect(), key=str) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
