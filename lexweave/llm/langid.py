"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its
letters, each permuted (rotated) by its place; a text's vector bundles (adds) those of its n-grams; a
language's prototype bundles those of its training texts. A text's language is that of the prototype with
the highest cosine. Letters are lower-cased; every run of other characters is one space.

Bounds tell which texts are in none of the languages: those whose letters are for the most part no letters of
the training texts, and those whose cosine is lower than that of training texts of their length (by n-grams, in
powers of two). A training text is held against its language without itself, whole and cut to its first
characters, so that short lengths have bounds too. A bound is the LOW quantile of these cosines, or half-way
from it to the HIGH quantile of the cosines with the other languages where that is less. More than LOW of
training texts with a wrong language therefore lower the bounds.

Defined results: a null text or a text without a letter is "und" with score 0; ties go to the first language
in code point order; without training rows every text is "und"; texts of any length are used whole; repeated
rows give a row each; an empty table gives no row; only the named columns are read, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, slices

DIMENSIONS = 512
GRAM = 3
SEED = 20_251
UNKNOWN = "und"
#: Columns of an n-gram count matrix that are multiplied at a time.
COLUMNS = 8192
#: Texts whose vectors are held at a time.
ROWS = 1000
#: Cells that are counted in a dense array; more are sorted.
DENSE = 1 << 22
#: Quantiles of the cosines of training texts with their own and with the other languages.
LOW, HIGH = 0.005, 0.99
#: Training texts are also measured by so many first characters.
CUTS = (2, 8, 32, 128)
#: Cells of a cosine, and the least share of all training letters that a letter of the languages has.
CELLS, LEAST_SHARE = 1000, 1e-5

_LETTERS: list[np.ndarray] = []
_VECTORS: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a code point, the same in every process."""
    if (code, dimensions) not in _VECTORS:
        rng = np.random.Generator(np.random.Philox(key=[SEED, code]))
        _VECTORS[code, dimensions] = (rng.integers(0, 2, dimensions) * 2 - 1).astype(np.int8)
    return _VECTORS[code, dimensions]


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of n-grams given as rows of code points: rotated by place and multiplied."""
    n = grams.shape[1]
    out = None
    for place in range(n):
        codes, at = np.unique(grams[:, place], return_inverse=True)
        letters = np.stack([np.roll(letter_vector(int(c), dimensions), n - 1 - place) for c in codes]) if len(codes) else np.zeros((0, dimensions), np.int8)
        out = letters[at] if out is None else out * letters[at]
    return out


def gram_counts(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams (rows of code points) and, of every (text, n-gram) that occurs: text, n-gram, count."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    codes = np.where(letter_table()[codes], codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (text[1:] != text[:-1])
    codes, text = codes[keep], text[keep]
    none = np.zeros(0, np.int64)
    if len(codes) < n:
        return np.zeros((0, n), np.int64), none, none, none
    present = np.zeros(0x110000, bool)
    present[codes] = True
    alphabet = np.flatnonzero(present)
    small = np.zeros(0x110000, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    compact = small[codes]
    size, last = len(alphabet), len(codes) - n + 1
    key = np.zeros(last, np.int64)
    for place in range(n):
        key = key * size + compact[place : place + last]
    space = small[32]
    valid = text[:last] == text[n - 1 :]
    for place in range(1, n - 1):
        valid &= compact[place : place + last] != space
    key, text = key[valid], text[:last][valid]
    if size**n <= DENSE:
        seen = np.bincount(key, minlength=size**n) > 0
        distinct = np.flatnonzero(seen)
        place_of = np.cumsum(seen) - 1
        gram = place_of[key]
    else:
        distinct, gram = np.unique(key, return_inverse=True)
    pair = text * max(1, len(distinct)) + gram
    if len(texts) * len(distinct) <= DENSE:
        counts = np.bincount(pair, minlength=1)
        pair = np.flatnonzero(counts)
        counts = counts[pair]
    else:
        pair, counts = np.unique(pair, return_counts=True)
    grams = np.stack([alphabet[distinct // size ** (n - 1 - place) % size] for place in range(n)], axis=1)
    return grams, pair // max(1, len(distinct)), pair % max(1, len(distinct)), counts


def bundles(texts: list[str], dimensions: int = DIMENSIONS, rows: np.ndarray | None = None, groups: int = 0, counted: tuple | None = None) -> np.ndarray:
    """The vector of each text; with rows, the sums over the texts of each group (rows names a text's group).

    counted: gram_counts(texts), where it is at hand.
    """
    grams, text, gram, counts = gram_counts(texts) if counted is None else counted
    at = text if rows is None else rows[text]
    n = len(texts) if rows is None else groups
    out = np.zeros((n, dimensions), np.float32 if rows is None else np.float64)
    order = np.argsort(gram, kind="stable")
    at, gram, counts = at[order], gram[order], counts[order]
    columns = max(1, min(COLUMNS, COLUMNS * DIMENSIONS // dimensions))
    for begin in range(0, len(grams), columns):
        a, b = np.searchsorted(gram, [begin, begin + columns])
        width = min(columns, len(grams) - begin)
        matrix = np.bincount(at[a:b] * width + gram[a:b] - begin, weights=counts[a:b], minlength=n * width).reshape(n, width).astype(np.float32)
        out += matrix @ gram_vectors(grams[begin : begin + width], dimensions).astype(np.float32)
    return out


def prototypes(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages in order and their prototypes, from all rows of a training table with a language.

    Each task adds up the vectors of its texts by language; the sums are aggregated by (language, place).
    What comes to the driver is a vector for each language.
    """

    def sums(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text):
                names = part.column(lang).to_pylist()
                known = sorted(set(names))
                rows = np.array([known.index(x) for x in names])
                made = bundles(part.column(text).to_pylist(), dimensions, rows, len(known))
                for name, vector in zip(known, made):
                    totals[name] = totals.get(name, 0) + vector
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    partial = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).mapInArrow(sums, "lang string, v array<double>")
    whole = partial.select("lang", F.posexplode("v").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    rows = whole.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("v")).orderBy("lang").collect()
    return [r.lang for r in rows], np.array([r.v for r in rows], np.float64).reshape(len(rows), dimensions)


def parts(batch: pa.RecordBatch, text: str):
    """Slices of a batch with at most ROWS rows."""
    for part in slices(batch, text):
        for begin in range(0, part.num_rows, ROWS):
            yield part.slice(begin, ROWS)


def sizes_of(counted: tuple, n: int) -> np.ndarray:
    """The size class of each of n texts: the whole binary logarithm of its n-grams, -1 for none."""
    return np.frexp(np.bincount(counted[1], weights=counted[3], minlength=n))[1] - 1


def bounds(df: DataFrame, languages: list[str], profile: np.ndarray, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, np.ndarray]:
    """The least cosine by size class and the letters of the languages, from the rows that the prototypes were made of.

    Each task counts cosines by size class and cell, and letters; the counts are aggregated. What comes to the
    driver is a row for each class and cell, and one for each letter.
    """
    dimensions = profile.shape[1]
    place = {name: k for k, name in enumerate(languages)}
    norms = np.linalg.norm(profile, axis=1)
    directions = profile / np.where(norms > 0, norms, 1)[:, None]

    def tallies(batches):
        totals: dict[tuple[int, int, int], int] = {}

        def add(what: int, sizes: np.ndarray, values: np.ndarray, weights: np.ndarray | None = None):
            pairs, at = np.unique(np.stack([sizes, values]), axis=1, return_inverse=True)
            for (size, value), n in zip(pairs.T.tolist(), np.bincount(at.ravel(), weights=weights).astype(np.int64).tolist()):
                totals[what, size, value] = totals.get((what, size, value), 0) + n

        def cells(x: np.ndarray) -> np.ndarray:
            return (np.clip(x, 0, 1) * CELLS).astype(np.int64)

        for batch in batches:
            for part in parts(batch, text):
                texts = part.column(text).to_pylist()
                own = np.array([place[x] for x in part.column(lang).to_pylist()], np.int64)
                counted = gram_counts(texts)
                # Every letter of a text is the middle one of one n-gram.
                letters = counted[0][counted[2], 1]
                add(2, np.zeros(len(letters), np.int64), letters, counted[3])
                without = profile[own]
                for cut in (None, *CUTS):
                    cuts = texts if cut is None else [t[:cut] for t in texts]
                    counted = counted if cut is None else gram_counts(cuts)
                    vectors = bundles(cuts, dimensions, counted=counted).astype(np.float64)
                    if cut is None:
                        without -= vectors
                        rest = np.linalg.norm(without, axis=1)
                    size, sizes = np.linalg.norm(vectors, axis=1), sizes_of(counted, len(cuts))
                    scale = np.where(size > 0, size, 1)
                    near = vectors @ directions.T / scale[:, None]
                    near[np.arange(len(own)), own] = -1
                    other = near.max(1) if len(languages) > 1 else np.zeros(len(own))
                    mine = np.einsum("ij,ij->i", vectors, without) / (scale * np.where(rest > 0, rest, 1))
                    some = (sizes >= 0) if cut is None else (sizes >= 0) & (np.array([len(t) for t in texts]) > cut)
                    add(0, sizes[some], cells(mine[some]))
                    add(1, sizes[some], cells(other[some]))
        keys = np.array(list(totals), np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, k]) for k in range(3)), pa.array(list(totals.values()), pa.int64())], names=["what", "size", "value", "n"])

    tallied = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).mapInArrow(tallies, "what bigint, size bigint, value bigint, n bigint")
    rows = np.array(tallied.groupBy("what", "size", "value").agg(F.sum("n").alias("n")).collect(), np.int64).reshape(-1, 4)

    def quantile(what: int, size: int, share: float) -> float:
        found = rows[(rows[:, 0] == what) & (rows[:, 1] == size)]
        found = found[np.argsort(found[:, 2])]
        upto = np.cumsum(found[:, 3])
        return found[np.searchsorted(upto, share * upto[-1]), 2] / CELLS

    least = np.full(64, np.inf)
    for size in np.unique(rows[rows[:, 0] == 0, 1]):
        low, high = quantile(0, size, LOW), quantile(1, size, HIGH)
        least[size] = min(low, (low + high) / 2)
    # A class that no text is of takes the bound of the next lower one, the lowest that of the next higher one.
    seen = np.flatnonzero(np.isfinite(least))
    if len(seen):
        least = least[seen[np.maximum(0, np.searchsorted(seen, np.arange(64), side="right") - 1)]]
    letters = rows[rows[:, 0] == 2]
    return np.minimum.accumulate(least[::-1])[::-1], np.sort(letters[letters[:, 3] >= LEAST_SHARE * letters[:, 3].sum(), 2])


def predict(df: DataFrame, languages: list[str], profile: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bound: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Adds lang_pred and score (the cosine, at least 0) to the kept columns. With bounds, a text beyond them is "und"."""
    dimensions = profile.shape[1]
    norms = np.linalg.norm(profile, axis=1, keepdims=True)
    directions = (profile / np.where(norms > 0, norms, 1)).astype(np.float32)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def rows(batches):
        for batch in batches:
            for part in parts(batch, text):
                texts = column_of(part, text).fill_null("").to_pylist()
                counted = gram_counts(texts)
                vectors = bundles(texts, dimensions, counted=counted)
                sizes = np.linalg.norm(vectors, axis=1)
                known = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(languages)
                if languages:
                    near = vectors @ directions.T / np.where(sizes > 0, sizes, 1)[:, None]
                    best = near.argmax(1)
                    score = np.clip(near[np.arange(len(texts)), best].astype(np.float64), 0, 1)
                    inside = known
                    if bound is not None:
                        least, letters = bound
                        total = np.bincount(counted[1], weights=counted[3], minlength=len(texts))
                        own = np.bincount(counted[1], weights=counted[3] * np.isin(counted[0][:, 1], letters)[counted[2]], minlength=len(texts))
                        inside = known & (2 * own >= total) & (score >= least[np.maximum(sizes_of(counted, len(texts)), 0)])
                    names = [languages[b] if k else UNKNOWN for b, k in zip(best, inside)]
                else:
                    score, names = np.zeros(len(texts)), [UNKNOWN] * len(texts)
                kept = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*keep, "lang_pred", "score"])

    return df.select(*dict.fromkeys([*keep, text.split(".")[0]])).mapInArrow(rows, schema)
