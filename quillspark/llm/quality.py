"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words and runs of marks are tokens. Each has a fixed random index vector, sparse and ternary, drawn from its hash; a
word's vector is the sum of the index vectors of its neighbours over all documents, less what the average word has, at
unit length. Words share a table of fixed size by their hash, so that the vocabulary may grow without bound. A document
is pooled to the mean of its words' vectors, of their squares and of the products of successive ones (words that go on
and on agree with themselves). The network is fitted in numpy on a bounded sample of labelled documents; a part of it,
kept from the fit, sets the temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .langid import held_out
from .shared import mapped, rows_of, struct

#: Words of the table (a power of two), dimensions, entries of an index vector that are not zero, neighbours each way.
BUCKET_BITS, DIM, NONZERO, WINDOW = 15, 64, 4, 2
#: Labelled documents of the fit, the bound on what the driver learns from.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 0.003, 1e-4
#: From this score on a document is predicted good.
GOOD = 0.7
#: Tokens whose vectors are gathered at a time.
SLICE = 1 << 16

CONTEXTS = struct(bucket=T.IntegerType(), held=T.LongType(), **{f"s{k}": T.LongType() for k in range(DIM)})
POOLED = struct(doc_id=T.LongType(), quality=T.IntegerType(), pooled=T.ArrayType(T.FloatType(), False))
OUTPUT = struct(doc_id=T.LongType(), held_out=T.BooleanType(), score=T.DoubleType(), predicted=T.IntegerType())


def index_entries(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (NONZERO, tokens) of the index vectors."""
    h = tokens.mixed(prints ^ np.uint64(0xD1B54A32D192ED03))
    shifts = np.arange(NONZERO, dtype=np.uint64)[:, None] * np.uint64(8)
    return ((h >> shifts) & np.uint64(DIM - 1)).astype(np.int32), np.where((h >> (shifts + np.uint64(7))) & np.uint64(1), 1.0, -1.0)


def buckets(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def word_contexts(docs: DataFrame) -> DataFrame:
    """Of each word of the table how often it stands in the texts and the sum of its neighbours' index vectors.

    A task adds up its own part in an array of the table's size, so that at most that many rows of it are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(DIM << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
        for batch in batches:
            for _, prints, sizes in tokens.fingerprints(batch.column("text"), tokens.KINDS, tokens.EXACT):
                word, (place, sign) = buckets(prints), index_entries(prints)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                held += np.bincount(word, minlength=len(held))
                for lo in range(0, len(word), SLICE):
                    for off in range(1, WINDOW + 1):
                        i = np.arange(lo, min(lo + SLICE, len(word) - off))
                        i = i[doc[i] == doc[i + off]]
                        for a, b in ((i, i + off), (i + off, i)):
                            sums += np.bincount((word[a] * DIM + place[:, b]).ravel(), sign[:, b].ravel(), len(sums))
        used = np.flatnonzero(held)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used].astype(np.int64)), *(pa.array(c) for c in sums.reshape(-1, DIM)[used].astype(np.int64).T)], names=CONTEXTS.names)

    found = mapped(rows_of(docs, text="string"), run, CONTEXTS)
    return found.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in CONTEXTS.names[1:]))


def word_vectors(contexts: DataFrame) -> np.ndarray:
    """The table on the driver: its size is fixed."""
    out = np.zeros((1 << BUCKET_BITS, DIM), np.float32)
    table = contexts.toArrow()
    if table.num_rows:
        held, sums = table.column("held").to_numpy().astype(np.float64), np.stack([table.column(f"s{k}").to_numpy() for k in range(DIM)], 1)
        v = sums / held[:, None] - sums.sum(0) / held.sum()
        out[table.column("bucket").to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return out


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(texts, 3 * DIM): means of vectors, of squares and of products of successive ones; zeros where there is no token."""
    out = np.zeros((len(texts), 3, DIM))
    for first, prints, sizes in tokens.fingerprints(texts, tokens.KINDS, tokens.EXACT):
        word, own = buckets(prints), out[first : first + len(sizes)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        for lo in range(0, len(word), SLICE):
            v = vectors[word[lo : lo + SLICE + 1]]
            n = min(SLICE, len(word) - lo)
            at = doc[lo : lo + n]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            own[at[start], 0] += np.add.reduceat(v[:n], start)
            own[at[start], 1] += np.add.reduceat(v[:n] ** 2, start)
            pair = np.zeros((n, v.shape[1]), np.float32)
            m = len(v) - 1
            np.multiply(v[:m], v[1 : m + 1], out=pair[:m])
            pair[:m][doc[lo : lo + m] != doc[lo + 1 : lo + m + 1]] = 0
            own[at[start], 2] += np.add.reduceat(pair, start)
        own /= np.maximum(sizes, 1)[:, None, None]
    return out.reshape(len(texts), -1)


@dataclass
class Network:
    """Two layers on standardised inputs; temperature divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2)[:, 0] + b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def losses(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log-likelihood."""
    return float((np.logaddexp(0, logits) - y * logits).mean())


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 1/16 to 16 of the least loss, by golden section on its logarithm (the loss has one minimum).

    Targets are those of Platt scaling, a little off 0 and 1, so that a few rows without an error don't make it certain.
    """
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    lo, hi, golden = np.log(1 / 16), np.log(16), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if losses(logits / np.exp(a), y) <= losses(logits / np.exp(b), y) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Adam on four fifths of the rows; the temperature comes from the rest. Of few rows or one label, all rows do both."""
    rng = np.random.default_rng(seed)
    fifth = np.arange(len(y)) % 5 == 4
    apart = all(len(set(y[part])) == 2 for part in (fifth, ~fifth))
    train, rest = (~fifth, fifth) if apart else (np.ones(len(y), bool),) * 2
    net = Network(x[train].mean(0), np.maximum(x[train].std(0), 1e-6), [])
    own, target = (x[train] - net.mean) / net.scale, y[train].astype(np.float64)
    rate = np.clip(target.mean(), 1 / (len(target) + 2), 1 - 1 / (len(target) + 2))
    net.layers = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, 1)) / np.sqrt(HIDDEN), np.array([np.log(rate / (1 - rate))])]
    first, second, t = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            w1, b1, w2, b2 = net.layers
            h = np.tanh(own[at] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip((h @ w2)[:, 0] + b2[0], -500, 500))) - target[at])[:, None] / len(at)
            back = error @ w2.T * (1 - h * h)
            t += 1
            for k, g in enumerate((own[at].T @ back + DECAY * w1, back.sum(0), h.T @ error + DECAY * w2, error.sum(0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.layers[k] = net.layers[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net.temperature = temperature_of(net.logits(x[rest]), y[rest])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, text and quality of at most ``most`` labels outside the held-out quarter, drawn by a hash of doc_id.

    A label counts where quality is 0 or 1 and doc_id is not null; equal ones count once, and a doc_id with both gives
    two rows. Of documents that share an id the least text stands for it; a null text is empty.
    """
    valid = rows_of(labels, doc_id="long", quality="int").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    n = valid.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    few = valid.where(drawn < int((1 << 30) * min(1.0, 1.2 * most / max(n, 1)))).orderBy(drawn, "doc_id", "quality").limit(most)
    texts = rows_of(docs, doc_id="long", text="string").join(F.broadcast(few), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, Network | None]:
    """Word vectors from the texts of all documents, and the network from the sample (None without any label)."""
    vectors = word_vectors(word_contexts(docs))
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = pool(batch.column("text"), shipped.value).astype(np.float32)
            cuts = pa.array(np.arange(len(pooled) + 1, dtype=np.int32) * pooled.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.ListArray.from_arrays(cuts, pa.array(pooled.reshape(-1)))], names=POOLED.names)

    rows = mapped(labelled_sample(docs, labels, most), run, POOLED).toArrow()  # bounded by ``most``
    if not rows.num_rows:
        return vectors, None
    ids, y = rows.column("doc_id").to_numpy(), rows.column("quality").to_numpy()
    x = rows.column("pooled").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
    order = np.lexsort((y, tokens.mixed(ids.astype(np.uint64))))
    return vectors, fit_network(x[order], y[order])


def score(docs: DataFrame, vectors: np.ndarray, net: Network | None) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (1 from 0.7 on) of every document.

    Whole texts are read. A null or empty text is pooled to zeros and scored like any other; without a network every
    score is 0.5. Repeated rows stay, null ids are not held out, further columns are not read; an empty table gives an
    empty result. A score of just 0.7 predicts 1.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = shipped.value
        for batch in batches:
            p = network.probabilities(pool(batch.column("text"), table)) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= GOOD).astype(np.int32))], names=OUTPUT.names)

    return mapped(rows_of(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text"), run, OUTPUT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *fit(docs, labels))


def op11_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
