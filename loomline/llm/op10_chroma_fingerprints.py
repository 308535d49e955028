"""Audio columns: chroma fingerprints and their alignment.

A recording (WAV bytes, 16-bit PCM) is cut into overlapping frames, whose spectra are
folded to twelve pitch classes. Filters over the integral image of these frames compare
sums of neighbouring areas; sixteen of them, each of four levels, make a packed integer
of 32 bits for every place. Recordings that share integers are aligned by the histogram of
their offsets; the best offset is confirmed by the share of bits that differ.

Integers are joined by value, each alone. One that very many recordings have (a held note)
says little but may not be dropped: its places are joined in blocks, so a hot value makes
no hot task, and no pair of equal integers is left out. Every offset of a pair that has a
vote is checked by its bits. The work grows with the pairs of equal integers.

The tables hold no audio: :func:`rendered` is a documented stand-in that plays a vector
as a melody, one note for each number. Everything after it works on WAV bytes.

Defined results: null, empty or broken bytes and recordings shorter than the filters have
no integers and match nothing, as do samples of other than 16 bits; of a recording that is
cut what is whole counts; repeated rows of one id are one recording; an empty table gives
an empty table; other columns are ignored.

Alignments of all recordings are as many as the square of their number where they are all
alike, so :func:`linked` returns a row for each recording: its class of equal recordings,
its component, its number of links, and its best alignment with another class.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import components
from loomline.llm.shared import settled, ship, written
from loomline.llm.similar import small

RATE, FRAME, HOP, WIDTH = 11025, 4096, 2048, 8
#: Filters: kind, lowest pitch class, height, width in frames.
FILTERS = [
    (0, 0, 4, 8), (1, 0, 6, 8), (2, 0, 12, 8), (3, 0, 6, 8), (4, 2, 6, 8), (1, 6, 6, 8), (2, 4, 4, 8), (0, 8, 4, 8),
    (3, 4, 8, 4), (4, 0, 12, 8), (1, 3, 6, 4), (2, 8, 4, 4), (1, 9, 2, 8), (3, 6, 6, 8), (2, 0, 6, 4), (1, 1, 10, 8),
]
LEVELS = np.array([-0.12, 0.0, 0.12])
#: Share of differing bits up to which an alignment holds; integers it must have at least.
ERRORS, OVERLAP = 0.3, 10
#: Integers that are compared at a time.
COMPARED = 1 << 20


@lru_cache(maxsize=1)
def _notes() -> list[bytes]:
    t = np.arange(HOP) / RATE
    tones = [220 * 2 ** (k / 12) for k in range(-18, 19)]
    return [((np.sin(2 * np.pi * f * t) + 0.5 * np.sin(4 * np.pi * f * t)) * 12000).astype("<i2").tobytes() for f in tones]


def rendered(values: list[float] | None) -> bytes | None:
    """A vector as a melody in WAV: each number a note of 0.19 s on a ladder of semitones."""
    if not values:
        return None
    x = np.array([0.0 if v is None or not np.isfinite(v) else v for v in values])
    notes = _notes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(b"".join([notes[k] for k in (np.clip(np.round(x * 40), -18, 18) + 18).astype(int)]))
    return out.getvalue()


def samples(audio: bytes | None) -> np.ndarray:
    """Mono samples at :data:`RATE` of 16-bit PCM, what is whole of a cut recording; none for other bytes (24-bit ones too)."""
    try:
        with wave.open(io.BytesIO(audio or b""), "rb") as w:
            if w.getsampwidth() != 2 or not w.getframerate():
                return np.empty(0, dtype=np.float32)
            n, rate = w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
            x = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2")
    except (wave.Error, EOFError, ValueError):
        return np.empty(0, dtype=np.float32)
    x = x[: len(x) // n * n].reshape(-1, n).mean(axis=1).astype(np.float32) / 32768
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x).astype(np.float32)
    return x


@lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = np.flatnonzero((f >= 80) & (f <= 3520))
    classes = np.round(12 * np.log2(f[use] / 440)).astype(int) % 12
    matrix = np.zeros((len(use), 12), dtype=np.float32)
    matrix[np.arange(len(use)), classes] = 1
    return use, matrix


def chroma(x: np.ndarray) -> np.ndarray:
    """Energy of the pitch classes in each frame, of unit length; silent frames are zero."""
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.empty((0, 12), dtype=np.float32)
    use, matrix = _fold()
    window = np.hanning(FRAME).astype(np.float32)
    out = []
    for at in range(0, n, 64):
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[at * HOP : (min(n, at + 64) - 1) * HOP + 1 : HOP]
        out.append((np.abs(np.fft.rfft(frames * window, axis=1)[:, use]) ** 2).astype(np.float32) @ matrix)
    c = np.concatenate(out)
    size = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(size > 1e-3, c / np.where(size > 0, size, 1), 0)


def fingerprint(audio: bytes | None) -> np.ndarray:
    """Packed integers of a recording, one for each frame but the last few."""
    c = chroma(samples(audio))
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x0: int, y0: int, w: int, h: int) -> np.ndarray:
        return image[at + x0 + w, y0 + h] - image[at + x0, y0 + h] - image[at + x0 + w, y0] + image[at + x0, y0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:
            a, b = area(0, y, w, h), area(0, 0, w, 12) - area(0, y, w, h)
        elif kind == 1:
            a, b = area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
        elif kind == 2:
            a, b = area(0, y, w // 2, h), area(w // 2, y, w - w // 2, h)
        elif kind == 3:
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            b = area(0, y + h // 2, w // 2, h - h // 2) + area(w // 2, y, w - w // 2, h // 2)
        else:
            a = area(0, y + h // 3, w, h // 3)
            b = area(0, y, w, h // 3) + area(0, y + 2 * (h // 3), w, h - 2 * (h // 3))
        level = np.searchsorted(LEVELS, np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ by a bit
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], render: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            marks = [fingerprint(rendered(v) if render else v).astype(np.int64) for v in part.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(marks, pa.list_(pa.int64()))], ["id", "marks"])


def fingerprints(media: DataFrame, key: str, audio: str, render: bool = False) -> DataFrame:
    """``id`` and ``marks`` of each recording; ``render`` plays vectors as :func:`rendered` does."""
    ship(media.sparkSession)
    return media.select(F.col(key).cast("long").alias("id"), F.col(audio).alias("media")).where("id IS NOT NULL").mapInArrow(
        lambda it: _fingerprints(it, render), "id long, marks array<long>"
    )


def _met(own: DataFrame, places: DataFrame, often: int) -> DataFrame:
    """Places of equal value, of a query and of another recording.

    Values of more than ``often`` places are joined in blocks of about ``often`` places on
    either side; each pair of places meets in one block.
    """
    hot = places.groupBy("value").count().where(F.col("count") > often).select("value", F.ceil(F.col("count") / often).alias("blocks"))
    asked = own.join(hot, "value").groupBy("value", "blocks").agg(F.ceil(F.count("*") / often).alias("parts"))
    hot = small(written(asked, "hot"))
    blocks, parts = (F.coalesce(c, F.lit(1).cast("long")) for c in ("blocks", "parts"))

    def numbers(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    a = own.join(hot, "value", "left").withColumn("part", F.pmod(F.xxhash64("query_id", "place"), parts)).withColumn("block", numbers(blocks))
    b = places.join(hot, "value", "left").withColumn("block", F.pmod(F.xxhash64("id", "at"), blocks)).withColumn("part", numbers(parts))
    met = a.select("query_id", "place", "value", "block", "part").join(b.select("id", "at", "value", "block", "part"), ["value", "block", "part"])
    return met.where("query_id != id")


def _errors(x: pa.ListArray, y: pa.ListArray, row: np.ndarray, x0: np.ndarray, y0: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Differing bits of ``n`` integers of each ``row``, from ``x0`` and ``y0`` on."""
    p, q = (c.values.to_numpy(zero_copy_only=False).astype(np.uint32) for c in (x, y))
    p0, q0 = (c.offsets.to_numpy().astype(np.int64)[row] + at for c, at in ((x, x0), (y, y0)))
    ends, out, at = np.cumsum(n), np.zeros(len(n), dtype=np.int64), 0
    while at < len(n):
        done = ends[at] - n[at]
        to = max(at + 1, int(np.searchsorted(ends, done + COMPARED, "right")))
        size = n[at:to]
        starts = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(starts, size)
        bits = np.bitwise_count(p[np.repeat(p0[at:to], size) + inner] ^ q[np.repeat(q0[at:to], size) + inner])
        out[at:to] = np.add.reduceat(bits, starts, dtype=np.int64)
        at = to
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, tops = batch.column("x"), batch.column("y"), batch.column("tops")
        row = np.repeat(np.arange(batch.num_rows), tops.value_lengths().to_numpy())
        offset, votes = (tops.flatten().field(c).to_numpy() for c in ("offset", "votes"))
        x0, y0 = np.maximum(offset, 0), np.maximum(-offset, 0)
        n = np.minimum(x.value_lengths().to_numpy()[row] - x0, y.value_lengths().to_numpy()[row] - y0)
        use = n >= OVERLAP
        row, offset, votes, x0, y0, n = (v[use] for v in (row, offset, votes, x0, y0, n))
        rate = np.floor(_errors(x, y, row, x0, y0, n) / (32 * n) * 1e6 + 0.5) / 1e6
        use = rate <= ERRORS
        row, offset, votes, n, rate = (v[use] for v in (row, offset, votes, n, rate))
        order = np.lexsort((offset, -votes, row))
        best = order[np.diff(row[order], prepend=-1) > 0]
        ids = [batch.column(c).take(pa.array(row[best])) for c in ("query_id", "id")]
        values = [pa.array(v[best].astype(t)) for v, t in ((offset, "i8"), (votes, "i8"), (n, "i4"), (rate, "f8"))]
        yield pa.RecordBatch.from_arrays([*ids, *values], ["query_id", "id", "offset", "votes", "overlap", "error_rate"])


def matches(marks: DataFrame, queries: DataFrame, often: int = 2000) -> DataFrame:
    """Recordings that align with a query: query_id, id, offset, votes, overlap, error_rate.

    ``offset`` is the query's place less the other's. One row for each pair: of the offsets
    that hold the one with the most votes, of equal votes the least. Both tables have ``id``
    and ``marks``; ``often`` is the size of a block and changes no result.
    """
    ship(marks.sparkSession)
    marks = written(marks.where("size(marks) > 0").dropDuplicates(["id"]), "marks")
    asked = written(queries.select(F.col("id").alias("query_id")).distinct(), "asked")
    places = written(marks.select("id", F.posexplode("marks").alias("at", "value")), "index")
    own = written(places.join(asked, places.id == asked.query_id).select("query_id", F.col("at").alias("place"), "value"), "own")
    histogram = _met(own, places, often).groupBy("query_id", "id", (F.col("place") - F.col("at")).cast("long").alias("offset")).agg(F.count("*").alias("votes"))
    pairs = histogram.groupBy("query_id", "id").agg(F.collect_list(F.struct("offset", "votes")).alias("tops"))
    a = marks.join(asked, marks.id == asked.query_id).select("query_id", F.col("marks").alias("x"))
    both = pairs.join(small(a), "query_id").join(marks.withColumnRenamed("marks", "y"), "id")
    schema = "query_id long, id long, offset long, votes long, overlap int, error_rate double"
    return both.select("query_id", "id", "tops", "x", "y").mapInArrow(_aligned, schema)


def linked(marks: DataFrame, asked: DataFrame, often: int = 2000) -> DataFrame:
    """One row for each recording with integers, of its links with or as one of ``asked`` (id).

    id, class_id (least id of equal recordings), component_id (least id that links reach), links
    (other recordings it aligns with), and of the other classes that its class aligns with
    the one with the fewest errors, then most votes, then least id: best_id, offset, votes,
    overlap, error_rate (null where there is none). A recording aligns with its equals.
    """
    spark = marks.sparkSession
    marks = marks.where("size(marks) > 0").dropDuplicates(["id"])
    rows = marks.join(small(written(asked.select("id").distinct().withColumn("asked", F.lit(1)), "asked")), "id", "left")
    rows = written(rows.select("id", F.coalesce("asked", F.lit(0)).alias("asked"), "marks"), "recordings")
    classes = rows.groupBy("marks").agg(F.min("id").alias("class_id"), F.count("*").alias("size"), F.sum("asked").alias("queries"))
    classes = written(classes, "classes")
    members = written(rows.join(classes.select("marks", "class_id"), "marks").select("id", "class_id", "asked"), "members")
    own = classes.select(F.col("class_id").alias("id"), "marks")
    pairs = written(matches(own, classes.where("queries > 0").select(F.col("class_id").alias("id")), often), "pairs")
    settled(spark, rows)
    turned = pairs.select(F.col("id").alias("query_id"), F.col("query_id").alias("id"), (-F.col("offset")).alias("offset"), "votes", "overlap", "error_rate")
    both = pairs.union(turned).groupBy("query_id", "id").agg(F.min(F.struct("error_rate", (-F.col("votes")).alias("votes"), "offset", "overlap")).alias("how"))
    sizes = small(written(classes.select(F.col("class_id").alias("id"), "size", "queries"), "sizes"))
    counted = both.join(sizes, "id").groupBy(F.col("query_id").alias("class_id")).agg(
        F.sum("size").alias("others"),
        F.sum("queries").alias("other_queries"),
        F.min(F.struct("how.error_rate", "how.votes", "id", "how.offset", "how.overlap")).alias("best"),
    )
    counted = written(counted, "counted")
    found = components(pairs.select(F.col("query_id").alias("a"), F.col("id").alias("b"))).withColumnRenamed("node", "class_id")
    about = sizes.withColumnRenamed("id", "class_id").join(counted, "class_id", "left").join(found, "class_id", "left")
    out = members.join(about, "class_id")
    everyone = F.coalesce("others", F.lit(0)) + F.col("size") - 1
    queries = F.coalesce("other_queries", F.lit(0)) + F.col("queries")
    return out.select(
        "id", "class_id", F.coalesce("component", "class_id").alias("component_id"), F.when(F.col("asked") == 1, everyone).otherwise(queries).alias("links"),
        F.col("best.id").alias("best_id"), F.col("best.offset").alias("offset"), (-F.col("best.votes")).alias("votes"), F.col("best.overlap").alias("overlap"), F.col("best.error_rate").alias("error_rate"),
    )
