"""Removing repeated passages: paragraph MinHash banding.

Two steps. First paragraphs: a line of :data:`LEAST_WORDS` words or more, or shorter lines
up to a blank or a long one, together. Those of so many words are reduced to sets of
five-word shingles; equal sets have the same 64-bit number; the others meet in the
buckets of their signatures, tuned for recall: 14 bands of 3 values let two paragraphs of
similarity 0.8 miss each other with a chance of 4e-5. Colliding paragraphs are confirmed by
their exact Jaccard similarity and clustered by connected components. Of each cluster the
first paragraph (by document, then place) stays and the others are taken out of their texts.

Then verbatim passages in what is left, wherever lines break: of each window of
:data:`PASSAGE` words the first stays, and the words of the later ones are taken out. Only
windows whose least hash of :data:`GRAM` words comes twice are looked at: equal windows
have the same one, so none is lost. A window that overlaps the first one is no repetition.

Defined results: null texts stay null and lose nothing; an empty table gives an empty
table; repeated rows of one id and text are one document for the question which paragraph
stays, so each of them keeps or loses the same ones; different texts of one id are documents
of their own; a row whose id is null keeps its text; columns besides key, text and n_chars
pass through, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import shingles
from loomline.llm.shared import chunks, settled, ship, written
from loomline.llm.similar import clusters, small

LEAST_WORDS, SIZE, PERCENT = 20, 5, 80
#: Words of a verbatim passage, and of the grams whose least hash stands for it.
PASSAGE, GRAM = 50, 25
BANDS, ROWS = 14, 3
TEXT_BYTES = 2 << 20
#: Bits of a bitmap for each text that it marks, and of one at most.
BITS, MOST_BITS = 16, 1 << 26
_WORD = re.compile(r"[^\t\n\x0b\f\r ]+")


@lru_cache(maxsize=1)
def _hashing() -> shingles.MinMax:
    return shingles.MinMax(BANDS, ROWS)


class Lines:
    """The words of texts, one after another, and the lines that they stand in."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode() for t in texts]
        blob = b"\n".join(raw).translate(shingles._LOWER)
        self.hashes = shingles.hashed(blob.split())
        byte = np.frombuffer(blob, dtype=np.uint8)
        space = (byte == 32) | ((byte >= 9) & (byte <= 13))
        begins = np.flatnonzero(~space & np.append(True, space[:-1])) if len(byte) else np.empty(0, dtype=np.int64)
        # first word of each line; one more at the end
        self.word = np.append(np.append(0, np.searchsorted(begins, np.flatnonzero(byte == 10))), len(begins))
        many = np.array([t.count(b"\n") + 1 for t in raw], dtype=np.int64)
        self.row = np.repeat(np.arange(len(texts)), many)
        self.first = np.cumsum(many) - many  # first line of each text
        self.size = np.diff(self.word)

    def place(self, line: np.ndarray) -> np.ndarray:
        """Number of a line in its own text."""
        return line - self.first[self.row[line]]

    def runs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First lines and ends of the runs of lines, of one text each, for which ``of`` holds."""
        begins = of & np.append(True, ~of[:-1] | (self.row[1:] != self.row[:-1]))[: len(of)]
        ends = of & np.append(~of[1:] | (self.row[1:] != self.row[:-1]), True)[: len(of)]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """First lines and ends of the paragraphs of at least :data:`LEAST_WORDS` words."""
        first, end = self.runs((self.size > 0) & (self.size < LEAST_WORDS))
        alone = np.flatnonzero(self.size >= LEAST_WORDS)
        first, end = np.append(first, alone), np.append(end, alone + 1)
        use = np.flatnonzero(self.word[end] - self.word[first] >= LEAST_WORDS)
        use = use[np.argsort(first[use])]
        return first[use], end[use]

    def sets(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle sets of paragraphs and their starts."""
        return shingles.sets_of(self.hashes, self.word[first], self.word[end], SIZE)

    def left(self, gone: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every place of a window in what is left between lines that are gone: its word, number of
        its part, hash, and least hash of its grams."""
        kept = np.ones(len(self.size), dtype=bool)
        for r, places in enumerate(gone):
            if places:
                at = self.first[r] + np.array(places)
                end = self.first[r + 1] if r + 1 < len(self.first) else len(kept)
                kept[at[at < end]] = False
        first, end = self.runs(kept)
        a, b = self.word[first], self.word[end]
        use = b - a >= PASSAGE
        a, n = a[use], (b - a)[use] - PASSAGE + 1
        if not len(a):
            return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),) * 2
        window, least = windows(self.hashes)
        word = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        return word, np.repeat(np.arange(len(a)), n), window[word], least[word]

    def stand(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of a word, its number in the row's text, and of its line."""
        line = np.searchsorted(self.word, word, "right") - 1
        row = self.row[line]
        return row, word - self.word[self.first[row]], self.place(line)


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of :data:`PASSAGE` words, and the least of its grams' hashes."""

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = min(len(x), len(y))
        return shingles._mixed(x[:n] * shingles._A + y[:n])

    two = joined(h, h[1:])
    four = joined(two, two[2:])
    eight = joined(four, four[4:])
    gram = joined(joined(joined(eight, eight[8:]), eight[16:]), h[24:])
    least, width = gram, 1
    while width < PASSAGE - GRAM + 1:
        step = min(width, PASSAGE - GRAM + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return joined(gram, gram[GRAM:]), least


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", TEXT_BYTES):
        lines = Lines(batch.column("text").to_pylist())
        word, part, _, least = lines.left(batch.column("gone").to_pylist())
        at = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (part[1:] != part[:-1]))[: len(least)])
        # a gram is the least of as many windows in a row at most
        times = 1 + (np.diff(at, append=len(least)) - 1) // (PASSAGE - GRAM + 1)
        rows = pa.array(lines.stand(word[at])[0])
        columns = [batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(least[at].view(np.int64)), pa.array(times)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "seed", "times"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", TEXT_BYTES):
        lines = Lines(batch.column("text").to_pylist())
        word, _, window, least = lines.left(batch.column("gone").to_pylist())
        # a seed that is asked for in one text is asked for in every text that has it
        at = np.flatnonzero(np.isin(least.view(np.int64), batch.column("seeds").flatten().to_numpy()))
        row, own, line = lines.stand(word[at])
        rows = pa.array(row)
        columns = [batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(own), pa.array(line.astype(np.int32)), pa.array(window[at].view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "word", "line", "window"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places that repeat a window, from rows in order of ``window``, ``doc_id``, ``word`` and ``version``: its first row stays."""
    held = None  # the first row of a window that goes on
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy() for c in ("window", "doc_id", "word", "version", "line")]
        if held:
            own = [np.append(h, c) for h, c in zip(held, own, strict=True)]
        window, doc, word, version, line = own
        starts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        held = [c[starts[-1:]] for c in own]
        of = np.repeat(starts, np.diff(starts, append=len(window)))
        use = np.flatnonzero((doc != doc[of]) | (version != version[of]) | (word >= word[of] + PASSAGE))
        columns = [doc[use], version[use], word[use], doc[of[use]], line[of[use]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "version", "word", "kept_doc_id", "kept_place"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of hits with one entry for ``many`` words in a row that repeat the same line."""
    for batch in batches:
        lists = batch.column("hits")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
        flat = lists.flatten()
        word, doc, place = (flat.field(c).to_numpy() for c in ("word", "kept_doc_id", "kept_place"))
        order = np.lexsort((word, row))
        row, word, doc, place = (c[order] for c in (row, word, doc, place))
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (word[1:] > word[:-1] + 1) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))[: len(row)])
        many = word[np.append(starts[1:], len(row))[: len(starts)] - 1] - word[starts] + 1
        entries = pa.StructArray.from_arrays([pa.array(c) for c in (word[starts], many, doc[starts], place[starts])], ["word", "many", "kept_doc_id", "kept_place"])
        ends = pa.array(np.searchsorted(row[starts], np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.ListArray.from_arrays(ends, entries)], ["doc_id", "version", "hits"])


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "version", "place", "start", "stop", "kept_doc_id", "kept_place")])
    for batch in chunks(batches, "text", TEXT_BYTES):
        rows = []
        for d, v, t, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "hits")), strict=True):
            hits = sorted((h["word"] + k, h["kept_doc_id"], h["kept_place"]) for h in hits for k in range(h["many"]))
            at, first = np.array([h[0] for h in hits]), Lines([t]).word
            ends = at + PASSAGE
            touched = np.zeros(len(first), dtype=np.int64)  # lines that some passage lies in
            np.add.at(touched, np.searchsorted(first, at, "right") - 1, 1)
            np.add.at(touched, np.minimum(np.searchsorted(first, ends, "left"), len(first) - 1), -1)
            text = t.split("\n")
            for place in np.flatnonzero(np.cumsum(touched)[: len(text)] > 0).tolist():
                line = text[place]
                spans = [m.span() for m in _WORD.finditer(line)]
                of = np.arange(first[place], first[place] + len(spans))
                owner = np.searchsorted(at, of - PASSAGE + 1)
                marked = (owner < len(at)) & (at[np.minimum(owner, len(at) - 1)] <= of)
                edges = np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0)).tolist()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    kept = hits[owner[a]][1:]
                    if a == 0 and b == len(spans):
                        rows.append((d, v, place, None, None, *kept))
                    elif b < len(spans):
                        rows.append((d, v, place, spans[a][0], spans[b][0], *kept))
                    else:
                        rows.append((d, v, place, spans[a - 1][1], len(line), *kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=schema)


def _numbers(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, the same for equal ones."""
    return np.frombuffer(b"".join(k[:8] for k in shingles.set_keys(items, starts)), dtype="<i8")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashing = _hashing()
    for batch in chunks(batches, "text", TEXT_BYTES):
        lines = Lines(batch.column("text").to_pylist())
        first, end = lines.paragraphs()
        items, starts = lines.sets(first, end)
        keys, sigs = hashing.signed(items, starts)
        n = np.diff(np.append(starts, len(items)))
        columns = [
            batch.column("doc_id").take(pa.array(lines.row[first])), batch.column("version").take(pa.array(lines.row[first])), pa.array(lines.place(first).astype(np.int32)), pa.array((end - first).astype(np.int32)), pa.array(n),
            pa.array(_numbers(items, starts)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([s.tobytes() for s in sigs], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "place", "lines", "n", "id", "keys", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in chunks(batches, "text", TEXT_BYTES):
        lines = Lines(batch.column("text").to_pylist())
        first, end = lines.paragraphs()
        wanted = [{(w["place"], w["id"]) for w in ws} for ws in batch.column("wanted").to_pylist()]
        places = [{p for p, _ in w} for w in wanted]
        row, place = lines.row[first], lines.place(first)
        use = np.array([i for i, (r, p) in enumerate(zip(row.tolist(), place.tolist(), strict=True)) if p in places[r]], dtype=np.int64)
        items, starts = lines.sets(first[use], end[use])
        own = zip(row[use].tolist(), place[use].tolist(), _numbers(items, starts).tolist(), shingles.parts(items, starts), strict=True)
        rows = [(i, x) for r, p, i, x in own if (p, i) in wanted[r] and i not in seen and not seen.add(i)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["id", "items"])


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.where("doc_id IS NOT NULL").withColumn("version", F.xxhash64("text"))


def _perhaps(lists: DataFrame) -> Column:
    """Whether a text may be one of ``lists``, a written table: true for all of them and for few others.

    The executors get a bitmap of hashes of :data:`BITS` bits a text of ``lists``, :data:`MOST_BITS` at most.
    """
    spark = lists.sparkSession
    bits = min(MOST_BITS, 1 << max(16, (BITS * lists.count()).bit_length()))
    at = F.xxhash64("doc_id", "version").bitwiseAND(F.lit(bits - 1).cast("long"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            own = batch.column(0).to_numpy()
            np.bitwise_or.at(marks, own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([marks.tobytes()], pa.binary())], ["marks"])

    row = lists.select(at.alias("at")).repartition(1).mapInArrow(marked, "marks binary").first()
    shared = spark.sparkContext.broadcast(bytes(row.marks) if row else bytes(bits // 8))

    def has(at: pa.Array) -> pa.Array:
        own = at.to_numpy(zero_copy_only=False)
        return pa.array(np.frombuffer(shared.value, dtype=np.uint8)[own >> 3] >> (own & 7).astype(np.uint8) & 1 == 1)

    return F.arrow_udf(has, "boolean")(at)


def _with(own: DataFrame, lists: DataFrame, every: bool = False) -> DataFrame:
    """Texts with their row of ``lists``, a written table of one row a doc_id and version; ``every``: others too, with nulls.

    Where ``lists`` is too large for a broadcast, a text that has no row there is not shuffled.
    """
    near = small(lists)
    if near is not lists:
        return own.join(near, ["doc_id", "version"], "left" if every else "inner")
    perhaps = _perhaps(lists)
    found = own.where(perhaps).join(lists, ["doc_id", "version"], "left" if every else "inner")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in lists.schema if f.name not in ("doc_id", "version")]
    return found.union(own.where(~perhaps).select("doc_id", "version", *(c for c in own.columns if c not in ("doc_id", "version")), *others)) if every else found


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line, or part of a line, that repeats an earlier place.

    doc_id and place of the line (from 0), ``kept_doc_id`` and ``kept_place`` (first line) of
    what stays, ``component_id`` (any number) of their cluster; ``start`` and ``stop`` are the
    characters of a part, null if the whole line repeats.
    """
    lines = _paragraphs_removed(docs, key, text)
    parts = _passages_removed(docs, lines, key, text).withColumn("component_id", F.xxhash64("kept_doc_id", "kept_place"))
    return lines.unionByName(parts, allowMissingColumns=True).drop("version").distinct()


def _paragraphs_removed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of repeated paragraphs; ``version`` tells texts of one id apart."""
    spark = docs.sparkSession
    ship(spark)
    own = _texts(docs, key, text)
    kinds = "doc_id long, version long, place int, lines int, n long, id long, keys array<long>, sig binary"
    signed = written(own.mapInArrow(_signed, kinds), "paragraphs")

    def sets_of(ids: DataFrame) -> DataFrame:
        first = signed.select("id", "doc_id", "version", "place").join(small(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "place", "version")).alias("at"))
        wanted = first.groupBy("at.doc_id", "at.version").agg(F.collect_list(F.struct("at.place", "id")).alias("wanted"))
        return _with(own, written(wanted, "wanted")).select("text", "wanted").mapInArrow(_sets, "id long, items binary")

    found, links = clusters(signed.select("id", "n", "keys", "sig"), sets_of, PERCENT)
    twice = signed.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")
    marked = twice.join(found.withColumnRenamed("node", "id"), "id", "full").select("id", F.coalesce("component", "id").alias("component_id"))
    marked = written(marked, "marked")
    settled(spark, found, links)
    several = written(signed.select("id", "doc_id", "version", "place", "lines").join(small(marked), "id").drop("id"), "several")
    settled(spark, signed, marked)
    kept = written(several.groupBy("component_id").agg(F.min(F.struct("doc_id", "place", "version")).alias("kept")), "kept")
    hit = several.join(small(kept), "component_id").where(F.struct("doc_id", "place", "version") != F.col("kept"))
    place = F.explode(F.sequence("place", F.col("place") + F.col("lines") - 1)).alias("place")
    hit = hit.select("doc_id", "version", place, F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.place").alias("kept_place"), "component_id")
    out = written(hit.distinct(), "lines")
    settled(spark, several, kept)
    return out


def _passages_removed(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """Verbatim passages that repeat in what is left without ``lines``."""
    gone = lines.groupBy("doc_id", "version").agg(F.collect_set("place").alias("gone"))
    own = _texts(docs, key, text).where("text != ''")
    own = _with(own, written(gone, "gone"), every=True).select("doc_id", "version", "text", "gone")
    spark = docs.sparkSession
    seeds = written(own.mapInArrow(_seeds, "doc_id long, version long, seed long, times long"), "seeds")
    twice = written(seeds.groupBy("seed").agg(F.sum("times").alias("times")).where("times > 1").select("seed"), "twice")
    again = written(seeds.join(small(twice), "seed").select("doc_id", "version", "seed").distinct(), "repeated-seeds")
    settled(spark, seeds, twice)

    seeds = written(again.groupBy("doc_id", "version").agg(F.collect_list("seed").alias("seeds")), "seeds")
    every = _with(own, seeds).mapInArrow(_windows, "doc_id long, version long, word long, line int, window long")
    every = every.repartition("window").sortWithinPartitions("window", "doc_id", "word", "version")
    hits = written(every.mapInArrow(_later, "doc_id long, version long, word long, kept_doc_id long, kept_place int"), "hits")
    settled(spark, again, seeds)
    lists = hits.groupBy("doc_id", "version").agg(F.collect_list(F.struct("word", "kept_doc_id", "kept_place")).alias("hits"))
    kinds = "doc_id long, version long, hits array<struct<word:long,many:long,kept_doc_id:long,kept_place:int>>"
    runs = written(lists.mapInArrow(_runs, kinds), "runs")
    settled(spark, hits)
    schema = "doc_id long, version long, place long, start long, stop long, kept_doc_id long, kept_place long"
    cuts = _with(own, runs).select("doc_id", "version", "text", "hits").mapInArrow(_cuts, schema)
    for c in ("place", "start", "stop", "kept_place"):
        cuts = cuts.withColumn(c, F.col(c).cast("int"))
    out = written(cuts.distinct(), "passages")
    settled(spark, runs)
    return out


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all their columns, with repeated paragraphs taken out of the text.

    ``length``, if ``docs`` has it, becomes the text's new number of characters.
    """
    removed = _paragraphs_removed(docs, key, text)
    gone = removed.groupBy(F.col("doc_id").alias("gone_key"), F.col("version").alias("gone_version")).agg(F.collect_set("place").alias("gone_places"))
    gone = small(written(gone, "gone"))
    parts = _passages_removed(docs, removed, key, text)
    part = F.struct("place", "start", "stop")
    parts = parts.groupBy(F.col("doc_id").alias("part_key"), F.col("version").alias("part_version")).agg(F.reverse(F.array_sort(F.collect_list(part))).alias("gone_parts"))
    parts = small(written(parts, "parts"))
    version = F.xxhash64(docs[text].cast("string"))
    joined = docs.join(gone, (docs[key] == F.col("gone_key")) & (version == F.col("gone_version")), "left")
    joined = joined.join(parts, (docs[key] == F.col("part_key")) & (version == F.col("part_version")), "left")
    empty = F.array().cast("array<int>")
    whole = F.array_union(F.coalesce("gone_places", empty), F.coalesce(F.transform(F.filter("gone_parts", lambda c: c["start"].isNull()), lambda c: c["place"]), empty))
    cut = F.coalesce("gone_parts", F.array().cast("array<struct<place:int,start:int,stop:int>>"))

    def without(line: Column, i: Column) -> Column:
        return F.aggregate(
            F.filter(cut, lambda c: (c["place"] == i) & c["start"].isNotNull()),
            line,
            lambda t, c: F.concat(t.substr(F.lit(1), c["start"]), t.substr(c["stop"] + 1, F.length(t))),
        )

    # a line that is cut stays one line, so places hold until whole lines are left out
    lines = F.transform(F.split(docs[text].cast("string"), "\n"), without)
    lines = F.filter(lines, lambda _, i: ~F.array_contains(whole, i))
    changed = F.col("gone_places").isNotNull() | F.col("gone_parts").isNotNull()
    new = F.when(changed, F.array_join(lines, "\n")).otherwise(docs[text])
    out = joined.select(*[new.alias(text) if c == text else docs[c] for c in docs.columns])
    if length and length in docs.columns:
        out = out.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType))
    return out
