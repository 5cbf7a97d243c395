"""Counts of words, signs and lengths for whole Arrow batches: NumPy in Spark's tasks, on what column expressions have cut."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as L

#: Signs, and tokens and words, counted at once; a batch of more is taken in slices of rows.
SIGNS, WORDS = 1_000_000, 200_000


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of a column of lists, the row of each, and how many each row has."""
    n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(n)), n), n


def _occurrences(row: np.ndarray, code: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and number of occurrences of each code that a row has."""
    key, k = np.unique(row * kinds + code, return_counts=True)
    return key // kinds, key % kinds, k


def _sum(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, value, rows)


def _entropy(row: np.ndarray, k: np.ndarray, rows: int) -> np.ndarray:
    """Shannon entropy in bits of each row's counts; 0 for none."""
    n = np.maximum(_sum(row, k, rows), 1)
    return np.log2(n) - _sum(row, k * np.log2(k), rows) / n


def _known(names: pa.Array, values: Iterable[str]) -> np.ndarray:
    return np.asarray(pc.is_in(names, pa.array(list(values), pa.string())))


def _tags(words: pa.Array) -> np.ndarray:
    """The rule tagger's tag of each distinct word. Its words and endings are plain letters, which no other letter becomes in lower case but K's sign, and they have no k."""
    low = pc.ascii_lower(words)
    ends = lambda *x: np.any([np.asarray(pc.ends_with(low, e)) for e in x], axis=0)
    rules = {"PRP": _known(low, L.PRONOUNS), "IN": _known(low, L.PREPOSITIONS), "VB": _known(low, L.BE_VERBS)}
    rules |= {"RB": ends("ly"), "VB ": ends("ing", "ed"), "NN": ends("tion", "ment", "ness"), "JJ": ends("ous", "ful", "ive", "al")}
    return np.select(list(rules.values()), [np.array(k.strip()) for k in rules], np.array("NN"))


TAGS = {"noun": "NN", "verb": "VB", "adj": "JJ", "adv": "RB", "pronoun": "PRP", "prep": "IN"}
MARKS = {"comma": ",", "semicolon": ";", "colon": ":", "emdash": "—–-", "quote": "\"'", "parentheses": "()"}
SURFACE = ("char_entropy", "word_entropy", "bigram_entropy", "ttr", "root_ttr", "hapax_ratio", "stopword_ratio", "top10_concentration", *(f"pos_{t}_ratio" for t in TAGS), *(f"{m}_rate" for m in MARKS))
RHYTHM = ("sent_len_mean", "sent_len_median", "sent_len_std", "sent_len_cv", "sent_delta_variance", "sent_delta_mean_abs", "para_len_mean", "para_len_std")
VOCABULARY = ("action", "passive", "abstract", "concrete")


def _doubles(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _sliced(names: Iterable[str], f: Callable[..., dict[str, np.ndarray]], tokens: pa.Array, words: pa.Array, *more: pa.Array) -> pa.Array:
    """f's columns over slices of rows, so that what NumPy holds at once is bounded."""
    held = np.cumsum([np.asarray(x.value_lengths().fill_null(0)).astype(np.int64) for x in (tokens, words)], axis=1).sum(0) // WORDS
    edges = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(tokens)]
    return pa.concat_arrays([_struct(names, f(*(c.slice(a, b - a) for c in (tokens, words, *more)))) for a, b in pairwise(edges)])


def _struct(names: Iterable[str], columns: dict[str, np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(columns[n], pa.float64()) for n in names], list(names))


def _signs(texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Entropy of the code points, and how often the marks stand in each text."""
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    at, point, k = _occurrences(row, points, 0x110000)
    return _entropy(at, k, len(texts)), {f"{m}_rate": _sum(at, k * np.isin(point, list(map(ord, signs))), len(texts)) for m, signs in MARKS.items()}


def _slices(texts: list[str]) -> Iterable[list[str]]:
    own, size = [], 0
    for x in texts:
        if own and size + len(x) > SIGNS:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x)
    yield own


@F.arrow_udf(_doubles(SURFACE))
def surface(text: pa.Array, tokens: pa.Array, words: pa.Array) -> pa.Array:
    """Entropies, richness, stopwords, tags and marks of each row; all 0 for a text without tokens."""
    return _sliced(SURFACE, _surface, tokens, words, text)


def _surface(tokens: pa.Array, words: pa.Array, text: pa.Array) -> dict[str, np.ndarray]:
    rows = len(text)
    found, row, n = _flat(tokens)
    coded = found.dictionary_encode()
    code, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    some, many = n > 0, np.maximum(n, 1)
    at, _, k = _occurrences(row, code, max(len(names), 1))
    kinds = np.bincount(at, minlength=rows)
    pair = np.flatnonzero(row[1:] == row[:-1])
    two, _, k2 = _occurrences(row[pair], np.unique(code[pair] * len(names) + code[pair + 1], return_inverse=True)[1], max(len(pair), 1))
    order = np.lexsort((-k, at))
    place = np.arange(len(order)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
    out = {
        "word_entropy": _entropy(at, k, rows), "bigram_entropy": _entropy(two, k2, rows), "ttr": kinds / many, "root_ttr": kinds / np.sqrt(many),
        "hapax_ratio": _sum(at, k == 1, rows) / np.maximum(kinds, 1), "stopword_ratio": _sum(row, _known(names, L.STOPWORDS)[code], rows) / many, "top10_concentration": _sum(at[order], k[order] * (place < 10), rows) / many,
    }
    found, row, n_words = _flat(words)
    coded = found.dictionary_encode()
    tags = _tags(coded.dictionary)
    for t, tag in TAGS.items():
        out[f"pos_{t}_ratio"] = _sum(row, (tags == tag)[np.asarray(coded.indices)], rows) / np.maximum(n_words, 1)
    signs = [_signs(own) for own in _slices(text.to_pylist())]
    out["char_entropy"] = np.concatenate([x[0] for x in signs])
    for m in signs[0][1]:
        out[m] = np.concatenate([x[1][m] for x in signs]) / many * 100.0
    return {c: np.where(some, v, 0.0) for c, v in out.items()}


def _moments(row: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of each row's numbers; 0 for none."""
    mean = _sum(row, x, len(n)) / np.maximum(n, 1)
    return mean, _sum(row, (x - mean[row]) ** 2, len(n)) / np.maximum(n, 1)


@F.arrow_udf(_doubles(RHYTHM))
def rhythm(sentences: pa.Array, paragraphs: pa.Array) -> pa.Array:
    """Mean, median, spread and changes of each row's lengths of sentences (one at least), and those of its paragraphs."""
    found, row, n = _flat(sentences)
    x = np.asarray(found).astype(float)
    mean, var = _moments(row, x, n)
    ordered, start = np.append(x[np.lexsort((x, row))], 0.0), np.cumsum(n) - n
    half = lambda k: ordered[start + np.maximum(k, 0) // 2]
    near = np.flatnonzero(row[1:] == row[:-1])
    d, d_row = x[near + 1] - x[near], row[near]
    found, p_row, p_n = _flat(paragraphs)
    p_mean, p_var = _moments(p_row, np.asarray(found).astype(float), p_n)
    out = (mean, (half(n - 1) + half(n)) / 2, np.sqrt(var), np.sqrt(var) / np.maximum(mean, 1e-5), _moments(d_row, d, n - 1)[1], _sum(d_row, np.abs(d), len(n)) / np.maximum(n - 1, 1), p_mean, np.sqrt(p_var))
    return _struct(RHYTHM, dict(zip(RHYTHM, out)))


@F.arrow_udf(_doubles(VOCABULARY))
def vocabulary(tokens: pa.Array, words: pa.Array) -> pa.Array:
    """Windows of four tokens from a first person that hold a verb of action or state, abstract words, and concrete ones with whole numbers."""
    return _sliced(VOCABULARY, _vocabulary, tokens, words)


def _vocabulary(tokens: pa.Array, words: pa.Array) -> dict[str, np.ndarray]:
    found, row, n = _flat(tokens)
    coded = found.dictionary_encode()
    code, names = np.asarray(coded.indices), coded.dictionary
    person = np.flatnonzero(_known(names, L.FIRST_PERSON)[code])
    end = np.cumsum(n)[row[person]]

    def near(values: Iterable[str]) -> np.ndarray:
        one = np.append(_known(names, values)[code], False)
        hit = np.any([one[np.where(person + j < end, person + j, -1)] for j in range(4)], axis=0)
        return _sum(row[person], hit, len(n))

    among = lambda values: _sum(row, _known(names, values)[code], len(n))
    found, w_row, _ = _flat(words)
    coded = found.dictionary_encode()
    digits = np.asarray(pc.utf8_is_decimal(coded.dictionary))[np.asarray(coded.indices)]
    return {"action": near(L.ACTION_VERBS), "passive": near(L.PASSIVE_STATE_VERBS), "abstract": among(L.ABSTRACT), "concrete": among(L.CONCRETE) + _sum(w_row, digits, len(n))}
