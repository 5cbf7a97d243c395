"""SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text has an edge for every piece that matches at a place; a character that no piece covers is
one edge of byte pieces. Forward Viterbi scores are exact heuristics for a backward A-star search from the end, so
paths leave the queue in order of their total score. The lattice is cut where every path must pass (no piece holds a
space after another character, and characters outside all pieces stand alone), so a text's N best segmentations follow
exactly from those of its chunks; what a chunk costs is kept in a memo of bounded size. Equal scores: fewer changes
against the best path first, then earlier ones.

A model of the BPE kind gives merge ranks, not probabilities. Its pieces get those of Zipf's law over the ranks, so
that sums of logarithms compare segmentations of different lengths; scores of other kinds are taken as they are.
"""

from __future__ import annotations

import heapq
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, rows_of

SPACE = "▁"
TOKENIZERS = os.environ.get("QUILLSPARK_TOKENIZERS", "/opt/tokenizers")
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
#: Scores are rounded to multiples of 1 / EXACT.
EXACT = 1 << 20
#: Segmentations that the query and the pipeline ask for.
N = 5
#: Chunks in the memo from which only those of the last batch, of at most LONGEST characters, stay: some 25 MB in a worker.
MEMO, LONGEST = 100_000, 32
#: Characters of texts that are encoded together, and of a text from which its chunks are read one by one.
TOGETHER, LONG_TEXT = 1 << 20, 1 << 18


class Numbers(dict):
    """Numbers strings as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Pieces:
    """Pieces, scores and byte pieces of a model (the bytes of its file), and the lattice search over them."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes, self.table = [0] * 256, []
        #: (id, score) of each piece; False for what only begins one.
        self.edges: dict[str, tuple[int, float] | bool] = {}
        found: list[tuple[str, int, float]] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.table.append(b"")
            else:
                found.append((piece, i, sp.get_score(i)))
                self.table.append(piece.replace(SPACE, " ").encode())
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"the piece {piece!r} holds a space after another character")
        if all(s <= 0 and s == int(s) for _, _, s in found):  # merge ranks
            whole = math.log(sum(1 / (1 - s) for _, _, s in found))
            found = [(p, i, -math.log(1 - s) - whole) for p, i, s in found]
        # Multiples of a power of two add up exactly, so that equal sums are equal: else rounding would part ties and the search would go through them one by one.
        found = [(p, i, round(s * EXACT) / EXACT) for p, i, s in found]
        for piece, i, score in found:
            for j in range(1, len(piece)):
                self.edges.setdefault(piece[:j], False)
            self.edges[piece] = (i, score)
        self.alone = min((s for _, _, s in found), default=0.0) - 10
        # The same edges as arrays: class of a character, state after a state and a class, piece and score of a state.
        states = {begin: k for k, begin in enumerate(self.edges, 1)}
        alphabet = sorted(set().union(*self.edges)) if self.edges else []
        self.wide, classes = len(alphabet) + 1, {c: k for k, c in enumerate(alphabet, 1)}
        self.class_of = np.zeros(0x110000, np.int32)
        for c, k in classes.items():
            self.class_of[ord(" " if c == SPACE else c)] = k
        moves = sorted((states.get(begin[:-1], 0) * self.wide + classes[begin[-1]], k) for begin, k in states.items())
        self.moves, self.then = (np.array(x, np.int64) for x in zip(*moves, (1 << 62, 0)))
        self.first = np.zeros(self.wide, np.int64)
        for c, k in classes.items():
            self.first[k] = states.get(c, 0)
        self.piece = np.full(len(states) + 1, -1, np.int32)
        self.score = np.zeros(len(states) + 1)
        for begin, k in states.items():
            if self.edges[begin]:
                self.piece[k], self.score[k] = self.edges[begin]
        # Signs that no piece has after a letter: between the two every path must pass.
        joined = {b for p, _, _ in found for a, b in zip(p, p[1:]) if a.isalpha()}
        signs = re.escape("".join(c for c in ".,;:!?|'\"()*#$%&" if c not in joined)) or "\n"
        letters, plain = r"[^\W\d_]+", rf"[^ \n{SPACE}]" if not any("\n" in p for p, _, _ in found) else rf"[^ {SPACE}]"
        #: Chunks: a run of spaces and what follows it, cut where a sign follows letters, at a line end if no piece holds one, and around a U+2581 of the text itself, which matches no piece.
        self.cut = re.compile(rf" *{letters}(?=[{signs}])|[{signs}]{plain}*| *{plain}+| +|\n|{SPACE}")
        spelt = [np.frombuffer(x, np.uint8) for x in self.table]
        self.spelt, self.spelt_size = np.concatenate(spelt), np.fromiter(map(len, spelt), np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        self.ranked: dict[tuple[str, int], list] = {}
        self.number = Numbers()
        #: By number of a chunk: score, loss of the second best, and where its ids are.
        self.best, self.loss, self.at, self.size = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def uncovered(self, char: str) -> list[int]:
        """Byte pieces of a character that no piece covers."""
        return [self.bytes[x] for x in (" " if char == SPACE else char).encode("utf-8", "replace")]

    def cost(self, chunk: str) -> tuple[list[int], float, float]:
        """ids of the best segmentation, its score, and how much less the second best has (infinite without one).

        Forward Viterbi with two scores at each place.
        """
        if chunk == SPACE:
            return [self.bytes[x] for x in SPACE.encode()], self.alone, math.inf
        s, size, edge, least = chunk.replace(" ", SPACE), len(chunk), self.edges.get, -math.inf
        best, second, back = [0.0] + [least] * size, [least] * (size + 1), [(0, -1)] * (size + 1)
        for i in range(size):
            top, next_ = best[i], second[i]
            covered = False
            for j in range(i + 1, size + 1):
                own = edge(s[i:j])
                if own is None:
                    break
                if own:
                    covered = covered or j == i + 1
                    total = top + own[1]
                    if total > best[j]:
                        second[j] = max(best[j], next_ + own[1])
                        best[j], back[j] = total, (i, own[0])
                    elif total > second[j]:
                        second[j] = total
            if not covered:
                total, j = top + self.alone, i + 1
                if total > best[j]:
                    second[j] = max(best[j], next_ + self.alone)
                    best[j], back[j] = total, (i, -1)
                elif total > second[j]:
                    second[j] = total
        ids: list[int] = []
        at = size
        while at:
            at, piece = back[at]
            if piece < 0:
                ids += reversed(self.uncovered(s[at]))
            else:
                ids.append(piece)
        ids.reverse()
        return ids, best[size], best[size] - second[size]

    def costs(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What cost() gives for chunks of one length, all at once: ids one after another, their numbers, scores, losses."""
        m, size = len(chunks), len(chunks[0])
        cls = self.class_of[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, size).T]
        best, second = np.full((size + 1, m), -np.inf), np.full((size + 1, m), -np.inf)
        best[0] = 0.0
        start, piece = np.zeros((size + 1, m), np.int32), np.zeros((size + 1, m), np.int32)

        def take(rows, i, j, own, ids) -> None:
            total, next_, b = best[i, rows] + own, second[i, rows] + own, best[j, rows]
            up = total > b
            second[j, rows] = np.where(up, np.maximum(b, next_), np.maximum(second[j, rows], total))
            best[j, rows] = np.where(up, total, b)
            start[j, rows] = np.where(up, i, start[j, rows])
            piece[j, rows] = np.where(up, ids, piece[j, rows])

        for i in range(size):
            # A character of its own always goes on, by byte pieces where no piece is it.
            state = self.first[cls[i]]
            ids = self.piece[state]
            take(slice(None), i, i + 1, np.where(ids < 0, self.alone, self.score[state]), ids)
            rows = np.nonzero(state)[0]
            state = state[rows]
            for j in range(i + 2, size + 1):
                key = state * self.wide + cls[j - 1, rows]
                at = np.searchsorted(self.moves, key)
                there = np.nonzero(self.moves[at] == key)[0]
                if not len(there):
                    break
                rows, state = rows[there], self.then[at[there]]
                ids = self.piece[state]
                some = np.nonzero(ids >= 0)[0]
                if len(some):
                    take(rows[some], i, j, self.score[state[some]], ids[some])
        at, every = np.full(m, size), np.arange(m)
        path = np.full((m, size), -2, np.int32)
        for k in range(size - 1, -1, -1):
            path[:, k] = np.where(at > 0, piece[at, every], -2)
            at = np.where(at > 0, start[at, every], 0)
        odd = (path == -1).any(1)
        path[odd] = -2
        used = path != -2
        ids, sizes = path[used], used.sum(1)
        if odd.any():  # a few chunks with characters that no piece covers
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k in np.nonzero(odd)[0].tolist():
                parts[k] = np.array(self.cost(chunks[k])[0], np.int32)
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes, best[size], best[size] - second[size]

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a chunk, best first: backward A-star on forward Viterbi scores."""
        if chunk == SPACE:
            return [(self.alone, tuple(self.bytes[x] for x in SPACE.encode()))]
        s, size, edge = chunk.replace(" ", SPACE), len(chunk), self.edges.get
        best = [0.0] + [-math.inf] * size
        coming: list[list] = [[] for _ in range(size + 1)]
        for i in range(size):
            top, covered = best[i], False
            for j in range(i + 1, size + 1):
                own = edge(s[i:j])
                if own is None:
                    break
                if own:
                    covered = covered or j == i + 1
                    coming[j].append((i, own))
                    best[j] = max(best[j], top + own[1])
            if not covered:
                coming[i + 1].append((i, (tuple(self.uncovered(s[i])), self.alone)))
                best[i + 1] = max(best[i + 1], top + self.alone)
        out, tie = [], count()
        queue = [(-best[size], 0, size, 0.0, None)]
        # Every queue entry ends in one path of its own of exactly its total, so an entry worse than n others is not kept.
        worst = [math.inf] * n
        while queue and len(out) < n:
            _, _, at, score, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    (ids.extend if isinstance(path[0], tuple) else ids.append)(path[0])
                    path = path[1]
                out.append((score, tuple(ids)))
                continue
            top, own_best = best[at], False
            for start, (piece, own) in coming[at]:
                lost = best[start] + own
                f = -(lost + score)
                if lost == top and not own_best:
                    own_best = True  # goes on with the path of the entry itself
                elif f >= worst[-1]:
                    continue
                else:
                    worst.append(f)
                    worst.sort()
                    worst.pop()
                heapq.heappush(queue, (f, next(tie), start, own + score, (piece, path)))
        return out

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's chunks; what new chunks cost is learnt for all texts at once."""
        known, number = len(self.number), self.number.__getitem__
        out = []
        for t in texts:
            t = " " + t if t else t
            parts = self.cut.findall(t) if len(t) < LONG_TEXT else map(re.Match.group, self.cut.finditer(t))
            out.append(np.fromiter(map(number, parts), np.int32))
        new: dict[int, list[int]] = {}
        keys = list(self.number)[known:]
        rows: list[tuple] = []
        for k, chunk in enumerate(keys):
            if chunk == SPACE or len(chunk) > LONGEST:
                ids, best, loss = self.cost(chunk)
                rows.append(([k], np.array(ids, np.int32), np.array([len(ids)]), np.array([best]), np.array([loss])))
            else:
                new.setdefault(len(chunk), []).append(k)
        for same in new.values():
            for lo in range(0, len(same), 1 << 14):
                own = same[lo : lo + (1 << 14)]
                rows.append((own, *self.costs([keys[k] for k in own])))
        if rows:
            ids, size, best, loss = (np.concatenate([r[i] for r in rows]) for i in range(1, 5))
            order = np.concatenate([np.array(r[0]) for r in rows])
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids])
            self.best, self.loss, self.at, self.size = (np.concatenate([old, x[back]]) for old, x in ((self.best, best), (self.loss, loss), (self.at, at), (self.size, size)))
        return out

    def forget(self, codes: np.ndarray) -> None:
        """Leaves only the chunks of the last batch in a memo that has become too large."""
        if len(self.number) > MEMO:
            keys = list(self.number)
            kept = [k for k in np.unique(codes).tolist() if len(keys[k]) <= LONGEST]
            ids, sizes = self.gather(np.array(kept, np.int64))
            self.number = Numbers((keys[k], i) for i, k in enumerate(kept))
            self.best, self.loss, self.size, self.ids = self.best[kept], self.loss[kept], sizes, ids
            self.at = np.cumsum(sizes) - sizes

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the best segmentations of chunks, one after another, and their numbers."""
        return ragged(self.ids, self.at[codes], self.size[codes]), self.size[codes]

    def _nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        got = self.ranked.get((chunk, n))
        if got is None:
            got = self.nbest(chunk, n)
            if len(chunk) <= LONGEST:
                if len(self.ranked) >= MEMO // 10:
                    self.ranked = {}
                self.ranked[chunk, n] = got
        return got

    def encode(self, texts: list[str], n: int = N) -> list[tuple[np.ndarray, list[float], list[list[tuple[int, int, list[int]]]]]]:
        """For each text: ids of the best segmentation, the n best scores, and what each further one changes in the best.

        A change is (first piece, number of pieces, new ids). A space is put before a text, as the model does.
        """
        codes = self.codes(texts)
        keys = list(self.number)
        out = [self._encode(own, keys, n) for own in codes]
        self.forget(np.concatenate([np.zeros(0, np.int32), *codes]))
        return out

    def _encode(self, codes: np.ndarray, keys: list[str], n: int) -> tuple[np.ndarray, list[float], list[list[tuple[int, int, list[int]]]]]:
        if not len(codes):
            return np.zeros(0, np.int32), [0.0], [[]]
        ids, sizes = self.gather(codes)
        total = float(self.best[codes].sum())
        plans: list[tuple[float, tuple]] = [(0.0, ())]
        if n > 1:
            # Only the n - 1 chunks that lose least can change in the n best.
            loss = self.loss[codes]
            for k in np.argsort(loss, kind="stable")[: n - 1].tolist():
                if loss[k] == math.inf:
                    break
                options = [(0.0, None), *((float(self.best[codes[k]]) - s, own) for s, own in self._nbest(keys[codes[k]], n)[1:])]
                plans = heapq.nsmallest(n, ((lost + more, done if own is None else (*done, (k, own))) for lost, done in plans for more, own in options), key=lambda x: (x[0], len(x[1]), [k for k, _ in x[1]]))
        first = np.cumsum(sizes) - sizes
        changes = [[(int(first[k]), int(sizes[k]), list(own)) for k, own in sorted(done)] for _, done in plans]
        return ids, [total - lost for lost, _ in plans], changes

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids spell, without the space put before it."""
        out = ragged(self.spelt, self.spelt_at[ids], self.spelt_size[ids]).tobytes()
        return out[1:] if out[:1] == b" " else out


def ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def model_bytes(path: str = MODEL) -> bytes:
    """The model's file, read once on the driver; tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


NAMES = ["doc_id", "ids", "scores", "changes", "round_trip"]
OUTPUT = "doc_id bigint, ids array<int>, scores array<double>, changes array<array<struct<at:int,length:int,ids:array<int>>>>, round_trip boolean"
CHANGES = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def encode(docs: DataFrame, n: int = N, path: str = MODEL) -> DataFrame:
    """doc_id, ids of the best segmentation, scores and changes of the n best, round_trip (decoding gives the text).

    A null or empty text has no ids, the one score 0 and round_trip true. A long text is encoded whole. Repeated rows
    stay, further columns go; an empty table gives an empty result.
    """
    blob = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(blob.value)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            cut = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // TOGETHER
            for lo, hi in pairwise([0, *(np.nonzero(np.diff(cut))[0] + 1).tolist(), len(texts)]):
                got = model.encode(texts[lo:hi], n)
                ends = np.cumsum([0, *(len(g[0]) for g in got)]).astype(np.int32)
                fine = [model.decode(g[0]) == t.encode("utf-8", "replace") for g, t in zip(got, texts[lo:hi])]
                found = pa.array(np.concatenate([np.zeros(0, np.int32), *(g[0] for g in got)]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), found), pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array([[[{"at": a, "length": b, "ids": c} for a, b, c in x] for x in g[2]] for g in got], CHANGES), pa.array(fine, pa.bool_())], names=NAMES)

    return mapped(rows_of(docs, doc_id="long", text="string"), run, OUTPUT)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of encoded rows. A null ids gives a null text."""
    blob = encoded.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(blob.value)
        for batch in batches:
            texts = [None if ids is None else model.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """What the query reports of the operator's rows."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("scores")[0].alias("score"), F.try_element_at("scores", F.lit(2)).alias("second_score"), F.to_json("changes").alias("changes"), "round_trip")


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    return digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
