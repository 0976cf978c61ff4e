"""BagMinHash signatures of multisets of word shingles, vectorised over many documents.

A multiset is a weight for each element. Every element owns a Poisson process over (time, slot, level): its
weight axis is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on, and each interval's process has
the rate of its length. A point has a random slot of the signature and a random level inside its interval;
it counts if its level is below the element's weight, so that two documents share exactly the points below
the lesser weight. A slot keeps its earliest point. Two signatures agree in a slot with the probability of
the weighted Jaccard similarity, the sum of the lesser over the sum of the greater weights.

Points come in order of time; an interval stops when its next point is later than the latest slot of its
document. Most elements of a long document stop at their first point.
"""

from __future__ import annotations

import numpy as np

from .common import mix, span_hashes, word_spans

SHINGLE_WORDS = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_bags(raw: np.ndarray, at: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts end to end in raw: their text, 64-bit hash (in order within a text) and count.

    Words are [^\\x20\\x09-\\x0D]+ as they are. A text of fewer words has one shingle of all its words; a text
    without words has none.
    """
    starts, ends = word_spans(raw, at)
    n = len(at) - 1
    text = np.searchsorted(at, starts, side="right") - 1
    hashes = span_hashes(raw, starts, ends)
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, np.zeros(0, np.uint64), none
    first = np.searchsorted(text, np.arange(n + 1))
    count = np.diff(first)
    with np.errstate(over="ignore"):
        made = hashes.copy()
        for k in range(1, words):
            stop = max(0, len(made) - k)
            made[:stop] = mix(made[:stop] * _GOLD + hashes[k:])
        bags = []
        for d in range(n):
            a, b = first[d], first[d + 1]
            if count[d] >= words:
                bags.append(np.sort(made[a : b - words + 1]))
            elif count[d]:
                one = hashes[a : a + 1].copy()
                for k in range(1, count[d]):
                    one = mix(one * _GOLD + hashes[a + k : a + k + 1])
                bags.append(one)
            else:
                bags.append(hashes[:0])
    shingles = np.concatenate(bags)
    owner = np.repeat(np.arange(n), [len(b) for b in bags])
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], shingles[begin], np.diff(np.append(begin, len(shingles)))


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, slots: int, seed: int = 1) -> np.ndarray:
    """An (n, slots) array of earliest times; texts without elements have infinity everywhere."""
    earliest = np.full(n * slots, np.inf)
    # Intervals: 0 is [0, 1), k is [2**(k-1), 2**k); an element has those that begin below its weight.
    doc, weight, begin, length, key = [], [], [], [], []
    k = 0
    while len(elements):
        low = 0 if k == 0 else 1 << (k - 1)
        rows = np.flatnonzero(weights > low)
        if not len(rows):
            break
        doc.append(owner[rows])
        weight.append(weights[rows])
        begin.append(np.full(len(rows), low, np.int64))
        length.append(np.full(len(rows), max(1, low), np.float64))
        with np.errstate(over="ignore"):
            key.append(mix(elements[rows] + mix(np.array([k * 1_000_003 + seed], np.uint64))))
        k += 1
    if not doc:
        return earliest.reshape(n, slots)
    doc, weight, begin, length, key = (np.concatenate(x) for x in (doc, weight, begin, length, key))
    time = np.zeros(len(doc))
    counter, chunk = 0, 1
    latest = np.full(n, np.inf)
    while len(doc):
        with np.errstate(over="ignore"):
            steps = (np.arange(counter, counter + chunk, dtype=np.uint64) + np.uint64(1)) * _GOLD
            random = mix(key[:, None] + steps[None, :])
            gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / length[:, None]
            times = time[:, None] + np.cumsum(gaps, axis=1)
            second = mix(random ^ _GOLD)
        slot = ((second >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        level = begin[:, None] + ((second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length[:, None]).astype(np.int64)
        hit = (level < weight[:, None]) & (times <= latest[doc][:, None])
        np.minimum.at(earliest, (doc[:, None] * slots + slot)[hit], times[hit])
        latest = earliest.reshape(n, slots).max(1)
        time = times[:, -1]
        on = time < latest[doc]
        doc, weight, begin, length, key, time = (x[on] for x in (doc, weight, begin, length, key, time))
        counter += chunk
        chunk = min(64, chunk * 2)
    return earliest.reshape(n, slots)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)[None, :].repeat(len(times), axis=0)
        for r in range(rows):
            key = mix(key * _GOLD + bits[:, :, r])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of the lesser and of the greater counts of two bags (ordered hashes, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    common = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    least = int(np.minimum(a[1][common], b[1][at[common]]).sum())
    return least, int(a[1].sum()) + int(b[1].sum()) - least
