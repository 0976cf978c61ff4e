"""Document quality from a linear-chain conditional random field over lines.

Every line with a character that is no white space gets the features below, those of the line before and
those of the line after. A chain of two labels, bad and good, scores lines by these features and neighbouring
labels by a transition table. It is trained on labelled documents, every line having its document's label.
A document's score is the mean of its lines' forward-backward marginals of "good", weighted by their bytes.

The training rows are a bounded sample: labelled documents in order of a hash of the id, at most SAMPLE_ROWS of
them and SAMPLE_BYTES of text. Scoring reads every line of every text.

Defined results: a null text, an empty text and one of white space alone have no line; they all score
good / (good + bad + 1) with the numbers of such texts among all labelled rows, so 0 where there is none; texts and lines of any
length are read whole; labels that are null or of documents that do not exist are passed over, of repeated
labels the least counts; without training rows of both labels every score is the share of good rows (or 0.5);
repeated rows give a row each; an empty table gives no row; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, column_of, slices, span_hashes, text_buffers, word_spans

#: Rows and bytes of text that the field is trained on, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20
#: Lines, with padding, that forward and backward passes hold at a time.
PADDED_LINES = 200_000
THRESHOLD = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | SPACE)

FEATURES = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "odd_symbol_share",
    "high_share",
    "doubled_symbol_share",
    "word_repeats",
    "distinct_words",
    "wordless_share",
    "symbol_end_share",
    "ends_in_stop",
    "repeats_line_before",
)


def _sums(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[end] - total[begin]).astype(np.float64)


def line_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of texts end to end in raw: their text, their bytes and their features."""
    breaks = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([at[:-1], breaks + 1]))
    begin = begin[begin < len(raw)]
    end = np.concatenate([begin[1:], [len(raw)]]).astype(np.int64)
    text = np.searchsorted(at, begin, side="right") - 1
    starts, ends = word_spans(raw, at)
    line = np.searchsorted(begin, starts, side="right") - 1
    words = np.bincount(line, minlength=len(begin)).astype(np.float64)
    real = words > 0
    small = np.cumsum(real) - 1
    begin, end, text, words = begin[real], end[real], text[real], words[real]
    line = small[line]
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(FEATURES)))
    size = (end - begin).astype(np.float64)
    inked = np.maximum(1, _sums(~SPACE[raw], begin, end))
    upper, lower, high = (_sums(m[raw], begin, end) for m in (_UPPER, _LOWER, _HIGH))
    symbol = _SYMBOL[raw]
    doubled = symbol.copy()
    doubled[0] = False
    doubled[1:] &= raw[1:] == raw[:-1]
    hashes = span_hashes(raw, starts, ends)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    key = np.sort((line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    letters = np.concatenate([[0], np.cumsum(_UPPER[raw] | _LOWER[raw] | _HIGH[raw] | _DIGIT[raw])])
    wordless = letters[ends] == letters[starts]
    tail = np.maximum(starts, ends - 2)
    marked = symbol[ends - 1] & symbol[tail] & (ends - starts > 1)
    last = np.searchsorted(line, np.arange(n), side="right") - 1
    per_line = lambda x: np.bincount(line, weights=x, minlength=n)
    whole = span_hashes(raw, begin, end)
    before = np.zeros(n)
    before[1:] = (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])
    columns = (
        np.log1p(size) / 8,
        np.log1p(words) / 6,
        np.minimum(inked / words, 40) / 10,
        upper / np.maximum(1, upper + lower + high / 2),
        _sums(_DIGIT[raw], begin, end) / inked,
        _sums(symbol, begin, end) / inked,
        _sums(symbol & ~_STOP[raw], begin, end) / inked,
        high / inked,
        _sums(doubled, begin, end) / inked,
        per_line(again) / words,
        np.bincount((key >> np.uint64(40)).astype(np.int64), weights=fresh, minlength=n) / words,
        per_line(wordless) / words,
        per_line(marked) / words,
        _STOP[raw[ends[last] - 1]].astype(np.float64),
        before,
    )
    return text, size, np.stack(columns, axis=1)


def with_neighbours(text: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (0 where there is none), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:] = np.where(same, own[:-1], 0)
        after[:-1] = np.where(same, own[1:], 0)
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1)


def _padded(text: np.ndarray):
    """Groups of texts with like numbers of lines: (rows of lines, mask), both texts by places."""
    if not len(text):
        return
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.concatenate([first, [len(text)]]))
    level = np.ceil(np.log2(count)).astype(int)
    for k in np.unique(level):
        chosen = np.flatnonzero(level == k)
        longest = int(count[chosen].max())
        step = max(1, PADDED_LINES // longest)
        for begin in range(0, len(chosen), step):
            part = chosen[begin : begin + step]
            place = np.arange(longest)[None, :]
            mask = place < count[part][:, None]
            yield np.where(mask, first[part][:, None] + place, 0), mask


def _share(odds: np.ndarray) -> np.ndarray:
    """Probabilities of log odds."""
    return np.exp(-np.logaddexp(0, -odds))


@dataclass
class Chain:
    """Weights of the field: of line features (for good), of neighbouring labels and of the first label.

    constant: the score of every text with a line, where there was nothing to learn from; blank: that of texts without.
    """

    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None
    blank: float = 0.0

    def emissions(self, text: np.ndarray, own: np.ndarray) -> np.ndarray:
        return with_neighbours(text, (own - self.mean) / self.scale) @ self.weights

    def odds(self, score: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of padded chains: the log odds of good given the lines up to each line, and what the lines after it add."""
        (bb, bg), (gb, gg) = self.transition
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        steps = score.shape[1]
        forward[:, 0] = self.start[1] - self.start[0] + score[:, 0]
        for t in range(1, steps):
            came = forward[:, t - 1]
            forward[:, t] = np.logaddexp(bg, came + gg) - np.logaddexp(bb, came + gb) + score[:, t]
        for t in range(steps - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            backward[:, t] = np.where(mask[:, t + 1], np.logaddexp(gb, ahead + gg) - np.logaddexp(bb, ahead + bg), 0)
        return forward, backward

    def expectations(self, score: np.ndarray, mask: np.ndarray):
        """Marginals of good, expected transitions and first labels, and the sum of log normalisers of padded chains."""
        (bb, bg), (gb, gg) = self.transition
        forward, backward = self.odds(score, mask)
        marginal = _share(forward + backward)
        inner = mask[:, 1:]
        came, ahead = forward[:, :-1][inner], (score[:, 1:] + backward[:, 1:])[inner]
        weights = np.stack([np.full(len(came), bb), bg + ahead, came + gb, came + gg + ahead])
        weights = np.exp(weights - weights.max(0))
        pairs = (weights / weights.sum(0)).sum(1).reshape(2, 2)
        first = marginal[:, 0].sum()
        last = forward[np.arange(len(mask)), mask.sum(1) - 1]
        normal = len(mask) * self.start[0] + np.logaddexp(bb, came + gb).sum() + np.logaddexp(0, last).sum()
        return marginal, pairs, np.array([len(mask) - first, first]), normal

    def marginals(self, text: np.ndarray, own: np.ndarray) -> np.ndarray:
        score = self.emissions(text, own)
        good = np.zeros(len(text))
        for rows, mask in _padded(text):
            forward, backward = self.odds(score[rows], mask)
            good[rows[mask]] = _share((forward + backward)[mask])
        return good

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Document scores of texts end to end."""
        text, size, own = line_features(raw, at)
        n = len(at) - 1
        total = np.bincount(text, weights=size, minlength=n)
        good = np.bincount(text, weights=size * (self.marginals(text, own) if self.constant is None else self.constant), minlength=n)
        return np.clip(np.where(total > 0, good / np.maximum(total, 1), self.blank), 0, 1)


def climb(slope_of, at: np.ndarray, rounds: int, memory: int = 8, least: float = 1e-5) -> np.ndarray:
    """The maximum of a smooth concave function by limited-memory quasi-Newton steps with backtracking.

    slope_of gives value and gradient. It ends after so many rounds, or where no part of the gradient exceeds least.
    """
    value, slope = slope_of(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < least:
            break
        way, used = slope.copy(), []
        for step, bend in reversed(moves):
            part = step @ way / (step @ bend)
            way -= part * bend
            used.append(part)
        if moves:
            step, bend = moves[-1]
            way *= step @ bend / (bend @ bend)
        else:
            way /= max(1.0, np.abs(slope).max())
        for (step, bend), part in zip(moves, reversed(used)):
            way += (part - bend @ way / (step @ bend)) * step
        size, rise = 1.0, slope @ way
        while True:
            new = at + size * way
            new_value, new_slope = slope_of(new)
            if new_value >= value + 1e-4 * size * rise or size < 1e-8:
                break
            size /= 2
        if new_value <= value:
            break
        step, bend = new - at, slope - new_slope
        if step @ bend > 1e-12:
            moves = [*moves, (step, bend)][-memory:]
        at, value, slope = new, new_value, new_slope
    return at


def train(texts: list[str], labels: list[int], rounds: int = 60, decay: float = 1e-3) -> Chain:
    """Maximises the conditional likelihood of the documents' label sequences, less decay / 2 of the squared weights."""
    parts = [(np.zeros(0, np.int64), np.zeros((0, len(FEATURES))))]
    done = 0
    for part in slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())}), "text"):
        found, _, made = line_features(*text_buffers(part.column("text")))
        parts.append((found + done, made))
        done += part.num_rows
    text, own = (np.concatenate(x) for x in zip(*parts))
    width = 3 * len(FEATURES) + 1
    gold = np.array(labels, np.float64)[text] if len(text) else np.zeros(0)
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not len(own):
        return Chain(np.zeros(width), np.zeros((2, 2)), np.zeros(2), np.zeros(len(FEATURES)), np.ones(len(FEATURES)), share)
    mean, scale = own.mean(0), own.std(0)
    chain = Chain(np.zeros(width), np.zeros((2, 2)), np.zeros(2), mean, np.where(scale > 1e-9, scale, 1.0))
    if gold.min() == gold.max():
        chain.constant = share
        return chain
    inputs = with_neighbours(text, (own - mean) / chain.scale)
    groups = list(_padded(text))
    documents = len(np.unique(text))
    # Every line of a document has its label, so that its labels change nowhere.
    gold_pairs, gold_start = np.zeros((2, 2)), np.zeros(2)
    for rows, mask in groups:
        label = gold[rows[:, 0]].astype(int)
        gold_start += np.bincount(label, minlength=2)
        gold_pairs += np.diag(np.bincount(label, mask[:, 1:].sum(1), minlength=2))

    def slope_of(at: np.ndarray) -> tuple[float, np.ndarray]:
        chain.weights, chain.transition, chain.start = at[:width], at[width : width + 4].reshape(2, 2), at[width + 4 :]
        score = inputs @ chain.weights
        good = np.zeros(len(text))
        pairs, start = np.zeros((2, 2)), np.zeros(2)
        value = gold @ score + (gold_pairs * chain.transition).sum() + gold_start @ chain.start
        for rows, mask in groups:
            marginal, own_pairs, own_start, normal = chain.expectations(score[rows], mask)
            good[rows[mask]] = marginal[mask]
            pairs += own_pairs
            start += own_start
            value -= normal
        slope = np.concatenate([inputs.T @ (gold - good), (gold_pairs - pairs).ravel(), gold_start - start]) / documents
        return value / documents - decay / 2 * (at @ at), slope - decay * at

    best = climb(slope_of, np.zeros(width + 6), rounds)
    chain.weights, chain.transition, chain.start = best[:width], best[width : width + 4].reshape(2, 2), best[width + 4 :]
    return chain


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """Trains on at most sample_rows labelled documents and sample_bytes of their texts, the first by a hash of the id."""
    spark = docs.sparkSession
    named = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(label).alias("label"))
    chosen = named.orderBy(F.xxhash64(id_column), id_column).limit(sample_rows).collect()
    few = spark.createDataFrame([(r[0], r[1]) for r in chosen], f"`{id_column}` {labels.schema[id_column].dataType.simpleString()}, label int")
    texts = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(few), id_column)  # at most sample_rows rows
    order = [F.xxhash64(id_column), F.col(id_column), F.col("text")]
    sample = rows.orderBy(*order).limit(sample_rows)
    found = sample.select("*", F.sum(F.octet_length("text")).over(Window.orderBy(*order)).alias("upto")).where(F.col("upto") <= sample_bytes).orderBy(*order).collect()  # a window over at most sample_rows rows
    chain = train([r.text for r in found], [r.label for r in found])
    blank = texts.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(id_column).join(named, id_column)
    good, every = blank.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    chain.blank = good / (every + 1)
    return chain


def score(df: DataFrame, chain: Chain, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds the score of every whole text to the kept columns."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def rows(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = chain.scores(*text_buffers(column_of(part, text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made)], names=[*keep, "score"])

    return df.select(*dict.fromkeys([*keep, text.split(".")[0]])).mapInArrow(rows, schema)
