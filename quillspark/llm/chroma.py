"""Media columns: chroma audio fingerprints.

A recording (mono 16-bit PCM) becomes frames of energy in the twelve pitch classes. Over the integral image of frames x
pitch classes, sixteen Haar-like filters compare neighbouring regions; each answer is cut in four levels with a Gray
code, so that a frame gives one packed 32-bit integer. Recordings with equal fingerprints form a class. To align two
recordings, places where two successive integers agree vote for an offset; the fullest bin of the offset histogram is
verified by the share of differing bits over the whole overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, rows_of, staged

RATE, FRAME, HOP = 4000, 512, 128
LOWEST = 110.0
#: Filters (kind, first pitch class, pitch classes, frames): 0 and 1 halves in pitch and time, 2 checks, 3 middle of pitch.
FILTERS = tuple((k, y, h, w) for k, y, h, w in ((0, 0, 12, 8), (0, 0, 6, 4), (0, 6, 6, 4), (0, 3, 6, 8), (1, 0, 12, 8), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (1, 0, 6, 4), (1, 6, 6, 4), (2, 0, 12, 8), (2, 0, 8, 4), (2, 4, 8, 4), (3, 0, 12, 4), (3, 0, 9, 8), (3, 3, 9, 8)))
WIDEST = max(f[3] for f in FILTERS)
CUTS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
ERRORS = 0.15
#: Places of a key from which it is dealt in parts.
HOT = 4096


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12: each frame's energy by pitch class, of unit sum (zero for silence)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    usable = hz >= LOWEST / 2
    note = np.round(12 * np.log2(np.maximum(hz, 1) / LOWEST)).astype(int) % 12
    out = power[:, usable] @ np.eye(12)[note[usable]]
    return out / np.maximum(out.sum(1, keepdims=True), 1e-9) * (out.sum(1, keepdims=True) > 1e-3)


def packed(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place of the widest filter over chroma frames."""
    n = len(image) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    area = np.zeros((len(image) + 1, 13))
    area[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def total(t0, t1, y0, y1):
        return area[t + t1, y1] - area[t + t0, y1] - area[t + t1, y0] + area[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:
            a, b = total(0, w, y, y + h // 2), total(0, w, y + h // 2, y + h)
        elif kind == 1:
            a, b = total(0, w // 2, y, y + h), total(w // 2, w, y, y + h)
        elif kind == 2:
            a = total(0, w // 2, y, y + h // 2) + total(w // 2, w, y + h // 2, y + h)
            b = total(0, w // 2, y + h // 2, y + h) + total(w // 2, w, y, y + h // 2)
        else:
            a, b = total(0, w, y + h // 3, y + 2 * (h // 3)), total(0, w, y, y + h // 3) + total(0, w, y + 2 * (h // 3), y + h)
        level = np.searchsorted(CUTS, np.log((a + 0.1) / (b + 0.1)))
        out = out << np.uint32(2) | GRAY[level]
    return out


def fingerprints(media: DataFrame) -> DataFrame:
    """media_id and prints (array of packed integers) of rows media_id, audio. Null, empty or short audio has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [packed(chroma(np.frombuffer(a[: len(a) // 2 * 2], np.int16).astype(np.float32) / 32768)).view(np.int32) if a else np.zeros(0, np.int32) for a in batch.column("audio").to_pylist()]
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *got])))], names=["media_id", "prints"])

    return mapped(rows_of(media, media_id="long", audio="binary"), run, "media_id bigint, prints array<int>")


def align(prints: DataFrame, query: str = "media_id % 20 = 0", errors: float = ERRORS, hot: int = HOT) -> DataFrame:
    """media_id, class_id (least media_id of equal fingerprints), class_size, is_query, n_links, best_class, best_offset, best_errors.

    Queries are the rows that ``query`` names, against all rows. Links join classes of different fingerprints whose best
    alignment differs in at most ``errors`` of the bits; the results of a class hold for each query in it, and copies
    are not expanded into pairs. Ties between offsets go to the least shift, then the earlier; between links to the least
    class. Rows without fingerprint have no class and no links; those of one integer, or of one that never changes, have
    a class and no links; null ids are never queries. Repeated rows stay, further columns go; an empty table gives an
    empty result.
    """
    named = prints.withColumns({"digest": F.sha2(F.array_join(F.col("prints").cast("array<string>"), ","), 256), "is_query": F.coalesce(F.expr(query), F.lit(False))})
    some = named.where(F.size("prints") > 0)
    classes = staged(some.groupBy("digest").agg(F.min("media_id").alias("class_id"), F.count("*").alias("class_size"), F.max("is_query").alias("asks"), F.first("prints").alias("prints")), "chroma")
    pairs = F.expr("if(size(prints) > 1, transform(sequence(1, size(prints) - 1), i -> struct(prints[i - 1] as a, prints[i] as b)), null)")
    # Where nothing moves (silence, a held note) two equal integers follow each other at every offset: no vote.
    places = classes.select("digest", "asks", F.posexplode(pairs).alias("at", "key")).where("key.a <> key.b")
    # A key that many places share is dealt in parts by recording; a query's places go to each part.
    crowded = places.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    places = places.join(crowded, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    q = places.where("asks").select(F.col("digest").alias("q"), F.col("at").alias("q_at"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    r = places.select(F.col("digest").alias("r"), F.col("at").alias("r_at"), "key", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"))
    votes = q.join(r, ["key", "part"]).where("q <> r").groupBy("q", "r", (F.col("r_at") - F.col("q_at")).alias("offset")).count()
    first = votes.groupBy("q", "r").agg(F.max(F.struct("count", -F.abs("offset"), -F.col("offset"))).alias("m")).select("q", "r", (-F.col("m.col3")).alias("offset"))
    left, right = (classes.select(F.col("digest").alias(k), F.col("class_id").alias(f"{k}_class"), F.col("prints").alias(f"{k}_prints")) for k in "qr")
    both = first.join(left, "q").join(right, "r")
    low, high = "greatest(0, -offset)", "least(size(q_prints), size(r_prints) - offset)"
    share = f"aggregate(zip_with(slice(q_prints, {low} + 1, {high} - {low}), slice(r_prints, {low} + offset + 1, {high} - {low}), (x, y) -> bit_count(cast((x ^ y) as bigint) & 4294967295)), 0D, (a, x) -> a + x) / (32 * ({high} - {low}))"
    links = both.where(f"{high} > {low}").withColumn("errors", F.expr(share)).where(F.col("errors") <= errors)
    of_query = links.groupBy("q").agg(F.count("*").alias("n_links"), F.min(F.struct("errors", "r_class", "offset")).alias("best"))
    by_class = classes.join(of_query, classes.digest == of_query.q, "left").select("digest", "class_id", "class_size", "n_links", "best")
    out = named.select("media_id", "digest", "is_query").join(by_class, "digest", "left")
    asked = lambda c: F.when(F.col("is_query"), c)
    return out.select("media_id", "class_id", "class_size", "is_query", asked(F.coalesce("n_links", F.lit(0))).alias("n_links"), asked(F.col("best.r_class")).alias("best_class"), asked(F.col("best.offset")).alias("best_offset"), asked(F.col("best.errors")).alias("best_errors"))


def render(vectors: DataFrame, note: int = 192) -> DataFrame:
    """media_id and audio of rows vec_id, embedding: a melody with a tone for each number, for tables without recordings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(note) / RATE
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                v = np.array([x or 0.0 for x in v or ()])
                spread = np.sqrt((v * v).mean()) if len(v) else 0
                step = np.clip(np.floor((v / (spread or 1) + 2) * 6), 0, 23)
                out.append((9000 * np.sin(2 * np.pi * LOWEST * 2 * 2 ** (step[:, None] / 12) * t[None, :])).astype(np.int16).tobytes() if len(v) else None)
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(out, pa.binary())], names=["media_id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "media_id bigint, audio binary")


def op8_chroma(spark, sf_dir: str) -> DataFrame:
    audio = render(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return align(staged(fingerprints(audio), "prints"))
