"""Language-model score of a text: the marginal probability over all segmentations into a fixed vocabulary.

The vocabulary is that of an existing tokenizer model: its pieces that hold the word mark at most once, at
their start, its 256 byte pieces, and one more entry for the end of a text; tokenizers are not trained here.
Piece probabilities are found by hard expectation maximisation over the training words, each as often as it
occurs: the first segmentation is the model's own, each later one is the best under the probabilities so far.
A text is the sequence of its lower-cased (A-Z) words, each with the word mark in front, and an end. No piece
crosses the start of a word, so the sum over all segmentations of a text is the product of those of its words
and of the end. A word's sum is found in log space by the forward recursion over its byte positions.

score is that marginal: pieces alone, so every text, known or not, has a probability as spelled. base_score
counts all unknown words as one kind of token and does not spell them. Two columns set the lattice beside word
counts: in mixed_score a word of the training texts has one more arc for the whole word, with its discounted
relative frequency, and the pieces share what the discount frees; closed_score is the same in the base's event
space, where unknown words are not spelled.

Word counts and marginals are made once for each distinct word, not for each token:
1. each task counts the words of its blocks of documents;
2. (word, block, count) rows meet by word; a window gives the training count of the word;
3. piece frequencies are summed over the distinct training words; the marginal is found once for each word;
4. (word, block) rows go back to their block, where they meet the block's documents and add up.
A word of any frequency has one row for each block and split at most. A block is a run of rows of a file, told
by the row's number in it, so that it is the same however a later reading splits the file.

Defined results: a null text is an empty one, of which only the end is scored; texts and words of any length
are scored whole; without training rows pieces are equally likely and no word is known; rows that repeat an
id, or have none, give a row each; an empty table gives no row; only the named columns are read.
"""

from __future__ import annotations

import math
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Spans, stored, text_buffers
from .pieces import SPACE_PIECE, codec, field, fields, varint

#: Added to every piece's count, and to the end's.
PIECE_SMOOTHING = 0.1
#: Added to every token's count in the base score.
BASE_SMOOTHING = 0.1
#: Rounds of hard expectation maximisation after the model's own segmentation.
ROUNDS = 3
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 1_000_000
#: Fewer words of one size are gone through one by one.
FEW_WORDS = 8
#: First bits of a hash that are looked up before the hash.
FIRST_BITS = 20
#: Byte positions whose arcs are held at a time, about.
HELD_POSITIONS = 200_000
#: Bytes of text in a block, about, and tasks that the blocks are dealt over at most.
BLOCK_BYTES, MOST_TASKS = 32 << 20, 32768


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; both are what bytes.split and bytes.lower do."""
    return text.lower().split()


def rescored(model: bytes, scores: np.ndarray) -> bytes:
    """The same vocabulary with other scores, as a model that segments by the best sum of scores."""
    out, i = [], 0
    for number, body in fields(model):
        if number == 1:
            piece = dict(fields(body))
            body = field(1, piece[1]) + b"\x15" + struct.pack("<f", scores[i]) + b"\x18" + varint(piece.get(3, 1))
            i += 1
        elif number == 2:
            body += b"\x18\x01"  # model_type: unigram
        out.append(field(number, body))
    return b"".join(out)


class Vocabulary:
    """Log probabilities of pieces, of bytes and of the end; pieces are found by hashes of their bytes."""

    def __init__(self, model: bytes, counts: np.ndarray, ends: int = 0):
        tool = codec(model).processor
        self.pieces: dict[bytes, int] = {}
        byte_ids: dict[int, int] = {}
        for i in range(tool.get_piece_size()):
            if tool.is_byte(i):
                byte_ids[int(tool.id_to_piece(i)[3:5], 16)] = i
            elif not (tool.is_control(i) or tool.is_unknown(i) or tool.is_unused(i)):
                piece = tool.id_to_piece(i).encode()
                if piece and SPACE_PIECE not in piece[1:]:
                    self.pieces[piece] = i
        used = [*self.pieces.values(), *byte_ids.values()]
        total = float(counts[used].sum()) + ends + PIECE_SMOOTHING * (len(self.pieces) + 257)
        log = lambda c: np.log((c + PIECE_SMOOTHING) / total)
        self.single = log(np.array([counts[byte_ids[b]] if b in byte_ids else 0.0 for b in range(256)]))
        self.weights = log(counts[list(self.pieces.values())])
        self.end = float(log(ends))
        sizes = np.array([len(p) for p in self.pieces], np.int64)
        hashes = Spans(np.frombuffer(b"".join(self.pieces), np.uint8))(np.cumsum(sizes) - sizes, np.cumsum(sizes))
        order = np.argsort(hashes)
        self.hashes, self.ordered = hashes[order], self.weights[order]
        self.sizes = np.unique(sizes)
        # Most spans are no piece; the first bits of their hashes tell that of nearly all of them.
        self.some = np.zeros(1 << FIRST_BITS, bool)
        self.some[hashes >> np.uint64(64 - FIRST_BITS)] = True

    def arcs(self, raw: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Of every position and piece size, the piece's log probability there, or minus infinity. room: bytes left in the word."""
        out = np.full((len(raw), len(self.sizes)), -np.inf)
        spans = Spans(raw)
        for k, size in enumerate(self.sizes):
            at = np.flatnonzero(room >= size)
            if len(at):
                hashes = spans(at, at + size)
                maybe = self.some[hashes >> np.uint64(64 - FIRST_BITS)]
                at, hashes = at[maybe], hashes[maybe]
                place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                out[at, k] = np.where(self.hashes[place] == hashes, self.ordered[place], -np.inf)
        return out

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the summed probabilities of all segmentations of words, each with the mark in front."""
        out = np.zeros(len(words))
        sizes = np.array([len(w) + len(SPACE_PIECE) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(np.cumsum(sizes[order]), np.arange(HELD_POSITIONS, sizes.sum(), HELD_POSITIONS))
        for part in np.split(order, np.unique(cuts)):
            for size in np.unique(sizes[part]):
                same = part[sizes[part] == size]
                if len(same) < FEW_WORDS:
                    out[same] = [self._alone(SPACE_PIECE + words[k]) for k in same]
                    continue
                out[same] = self._forward(np.frombuffer(b"".join([SPACE_PIECE + words[k] for k in same]), np.uint8), int(size))
        return out

    def _alone(self, word: bytes) -> float:
        """The marginal of one word: the same recursion, position by position over the arcs that there are."""
        exp, log, single = math.exp, math.log, self.single.tolist()
        longest = int(self.sizes[-1])
        raw = np.frombuffer(word, np.uint8)
        ahead: dict[int, list[float]] = {}
        alpha = 0.0
        for base in range(0, len(word), HELD_POSITIONS):
            part = raw[base : base + HELD_POSITIONS + longest]
            found = self.arcs(part, np.arange(len(part), 0, -1))[:HELD_POSITIONS]
            at, kind = np.nonzero(found > -np.inf)
            arcs = list(zip(at.tolist(), self.sizes[kind].tolist(), found[at, kind].tolist()))
            place = 0
            for t in range(base, min(len(word), base + HELD_POSITIONS)):
                ahead.setdefault(t + 1, []).append(alpha + single[word[t]])
                while place < len(arcs) and arcs[place][0] == t - base:
                    _, size, weight = arcs[place]
                    ahead.setdefault(t + size, []).append(alpha + weight)
                    place += 1
                into = ahead.pop(t + 1)
                top = max(into)
                alpha = top + log(sum([exp(x - top) for x in into]))
        return alpha

    def _forward(self, raw: np.ndarray, size: int) -> np.ndarray:
        """Marginals of words of one size end to end: the forward recursion over positions, all words at a time.

        The last alphas are kept in a ring as long as the longest piece.
        """
        n, longest = len(raw) // size, int(self.sizes[-1])
        held = longest + 1
        alpha = np.full((held, n), -np.inf)
        alpha[0] = 0
        step = max(1, HELD_POSITIONS // (n * 8))
        raw = raw.reshape(n, size)
        weights, base = None, 0
        for t in range(1, size + 1):
            # Arcs into t begin at t - longest or later; they are found for a stretch of begins at a time.
            if weights is None or t - 1 >= base + step:
                begin = max(0, t - longest)
                end = min(size, t - 1 + step)
                width = min(size, end + longest) - begin
                made = self.arcs(np.ascontiguousarray(raw[:, begin : begin + width]).ravel(), np.tile(np.arange(width, 0, -1), n))
                weights, first, base = made.reshape(n, width, len(self.sizes)), begin, t - 1
            sources = t - self.sizes
            into = [alpha[(t - 1) % held] + self.single[raw[:, t - 1]]]
            into += [alpha[s % held] + weights[:, s - first, k] for k, s in enumerate(sources) if s >= 0]
            top = np.maximum.reduce(into)
            alpha[t % held] = top + np.log(sum(np.exp(x - top) for x in into))
        return alpha[size % held]


def _blocks(df: DataFrame, rows: int, parts: int) -> Column:
    """A column that names a row's block, the same at every reading.

    Rows that come straight from files go by their file and their number in it; others by a hash of what they hold.
    """
    number = F.col("_metadata.row_index")
    try:
        df.select(number)
    except AnalysisException:
        return F.pmod(F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString())), F.lit(parts))
    return F.xxhash64("_metadata.file_path", F.floor(number / F.lit(rows)))


def score(df: DataFrame, training: Column, model: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores all texts, learning from the rows where the column expression training holds.

    Returns id, learns, n_tokens, n_known, train_tokens, base_score, score, mixed_score and closed_score (log10
    probabilities).
    """
    spark = df.sparkSession
    learns = F.coalesce(training, F.lit(False))
    n_rows, n_bytes, ends = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count_if(learns)).first()
    parts = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    block = _blocks(df, max(1, n_rows // parts), parts)
    named = df.select(F.col(id_column).alias("id"), learns.alias("learns"), F.coalesce(F.col(text), F.lit("")).alias("text"), block.alias("block"))

    def count(batches):
        held: dict[int, Counter] = {}

        def flush():
            for block, counts in held.items():
                words = list(counts)
                for begin in range(0, len(words), 50_000):
                    part = words[begin : begin + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([block] * len(part), pa.int64()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "block", "n"])
            held.clear()

        seen = 0
        for batch in batches:
            raw, at = text_buffers(batch.column("text"))
            whole = raw.tobytes()
            for k, (block, learns) in enumerate(zip(batch.column("block").to_pylist(), batch.column("learns").to_pylist())):
                counts = held.setdefault(block, Counter())
                before = len(counts)
                words = words_of(whole[at[k] : at[k + 1]])
                if learns:
                    counts.update(words)
                else:
                    for w in words:
                        if w not in counts:
                            counts[w] = 0
                seen += len(counts) - before
                if seen > HELD_WORDS:
                    yield from flush()
                    seen = 0
        yield from flush()

    rows = named.select("block", "learns", "text").mapInArrow(count, "word binary, block bigint, n bigint")
    own = Window.partitionBy("word")
    rows = rows.select("word", "block", F.sum("n").over(own).alias("n"), (F.row_number().over(own.orderBy("block")) == 1).alias("first"))
    rows = stored(rows, "words")
    lexicon = stored(rows.where("first and n > 0").select("word", "n"), "lexicon")
    tokens, distinct, singles, doubles = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    train_tokens = tokens + ends
    kinds = distinct + (ends > 0)

    def piece_counts(segmenter: bytes) -> np.ndarray:
        """How often each piece occurs when the training words are segmented; a row for each piece comes to the driver."""

        def segmented(batches):
            tool = codec(segmenter).processor
            sums = np.zeros(tool.get_piece_size(), np.int64)
            for batch in batches:
                words, times = [w.decode() for w in batch.column("word").to_pylist()], batch.column("n").to_numpy()
                for begin in range(0, len(words), 2000):
                    coded = tool.encode(words[begin : begin + 2000], num_threads=1)
                    flat = np.array([i for ids in coded for i in ids], np.int64)
                    np.add.at(sums, flat, np.repeat(times[begin : begin + 2000], [len(ids) for ids in coded]))
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["piece", "n"])

        found = lexicon.mapInArrow(segmented, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(codec(model).processor.get_piece_size())
        for r in found:
            out[r.piece] = r.n
        return out

    counts = piece_counts(model)
    for _ in range(ROUNDS if distinct else 0):
        counts = piece_counts(rescored(model, np.log((counts + PIECE_SMOOTHING) / (counts.sum() + PIECE_SMOOTHING * len(counts)))))
    vocabulary = Vocabulary(model, counts, ends)
    discount = singles / (singles + 2 * doubles) if singles and doubles else 0.5
    freed = discount * distinct / tokens if tokens else 1.0

    def weigh(batches):
        """The marginal of each word, once in a batch."""
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            weights = vocabulary.marginals(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("block"), batch.column("n"), pa.array(weights)], names=["word", "block", "n", "weight"])

    weighed = rows.select("word", "block", "n").mapInArrow(weigh, "word binary, block bigint, n bigint, weight double")
    base_total = train_tokens + BASE_SMOOTHING * (kinds + 1)
    end_base = math.log10((ends + BASE_SMOOTHING) / base_total)
    end_share = (ends + BASE_SMOOTHING) / base_total if ends else 0.5
    end_score = math.log10(end_share)
    out_schema = T.StructType([T.StructField("id", df.schema[id_column].dataType), T.StructField("learns", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "mixed_score", "closed_score"))])

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {w: k for k, w in enumerate(right.column("word").to_pylist())}
        n = np.concatenate([right.column("n").to_numpy(), np.zeros(1, np.int64)]) if right.num_rows else np.zeros(1, np.int64)
        base = np.log10((n + BASE_SMOOTHING) / base_total)
        known = n > 0
        marginal = np.append(right.column("weight").to_numpy() if right.num_rows else np.zeros(0), 0.0)
        whole_arc = np.maximum(n - discount, 0) / max(1, tokens)
        with np.errstate(divide="ignore"):
            word_log = np.logaddexp(np.log(whole_arc), math.log(freed) + marginal) + math.log1p(-end_share)
        closed_log = np.where(known, word_log, math.log(freed) + math.log1p(-end_share))
        out = [[], [], [], [], [], []]
        raw, at = text_buffers(left.column("text"))
        whole = raw.tobytes()
        for k in range(left.num_rows):
            words = words_of(whole[at[k] : at[k + 1]])
            rows_ = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            out[0].append(len(words) + 1)
            out[1].append(int(known[rows_].sum()) + (ends > 0))
            out[2].append(float(base[rows_].sum()) + end_base)
            out[3].append((float(marginal[rows_].sum()) + vocabulary.end) / math.log(10))
            out[4].append(float(word_log[rows_].sum()) / math.log(10) + end_score)
            out[5].append(float(closed_log[rows_].sum()) / math.log(10) + end_score)
        kinds_ = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.table([left.column("id"), left.column("learns"), *(pa.array(v, t) for v, t in zip(out, kinds_))], names=out_schema.names)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, 4 * parts))
    dealt = named.repartition(tasks, "block").groupBy("block").cogroup(weighed.repartition(tasks, "block").groupBy("block"))
    scored = dealt.applyInArrow(add_up, out_schema)
    return scored.select(F.col("id").alias(id_column), "learns", "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "mixed_score", "closed_score")
