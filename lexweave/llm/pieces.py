"""SentencePiece encoding and decoding that keeps the source offsets of every piece.

The text is normalised here as the model's own specification says: at each position the longest prefix in
the compiled character map is replaced, white space is escaped, a dummy prefix is put in front; every byte
of the normalised text remembers the source byte that it came from. That normalised text is what is encoded, by
the library's segmentation with a specification that changes nothing more; the bytes of the pieces are then the
normalised text, end to end, and the alignment projects every piece to its source byte span.

Defined results: a null text counts as an empty one; an empty text gives the end id alone and no span; texts
of any length are encoded whole; repeated rows and ties give a row each; an empty table gives no row; columns
of the input beside the id and the text are carried along unless their names clash with the output's.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, text_buffers

SPACE_PIECE = "▁".encode()


def fields(message: bytes):
    """Fields of a protocol buffer: number and value (int or bytes)."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, message[at : at + n]
            at += n
        elif kind == 5:
            yield key >> 3, message[at : at + 4]
            at += 4
        elif kind == 1:
            yield key >> 3, message[at : at + 8]
            at += 8
        else:
            raise ValueError(f"wire type {kind} in a model file")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, body: bytes) -> bytes:
    """A bytes field of a protocol buffer."""
    return varint(number << 3 | 2) + varint(len(body)) + body


#: Where the model file is; None asks the installed package of public tokenizers.
MODEL_PATH: str | None = None


def piece_model(path: str | None = MODEL_PATH) -> bytes:
    """The bytes of a model file; the driver reads them and sends them along, so executors need no file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes and a pool of zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at a position and its replacement."""
        units, found = self.units, None
        node = self._step(0)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            has_leaf = units[node] >> 8 & 1
            node = node ^ self._step(node)
            if has_leaf:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]

    def _step(self, node: int) -> int:
        unit = self.units[node]
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normaliser:
    """Normalised bytes with, for each of them and for the end, the source byte it came from."""

    def __init__(self, model: bytes):
        spec = next((v for n, v in fields(model) if n == 3), b"")
        found = dict(fields(spec))
        self.map = CharacterMap(found.get(2, b""))
        self.dummy_prefix = bool(found.get(3, 1))
        self.strip = bool(found.get(4, 1))
        self.escape = bool(found.get(5, 1))
        trainer = next((dict(fields(v)) for n, v in fields(model) if n == 2), {})
        self.suffix = bool(trainer.get(24, 0))

    def __call__(self, text: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for the end its source byte."""
        if self.map or self.strip or self.suffix or not self.escape:
            return self._general(text.tobytes())
        return self._plain(text)

    def _plain(self, text: np.ndarray) -> tuple[bytes, np.ndarray]:
        """No character map: a byte stands for itself, a space for the three bytes of its escape."""
        n = len(text)
        if not n:
            return b"", np.zeros(1, np.int64)
        head = SPACE_PIECE * self.dummy_prefix
        source = np.repeat(np.arange(n), np.where(text == 32, 3, 1))
        return head + text.tobytes().replace(b" ", SPACE_PIECE), np.concatenate([np.zeros(len(head), np.int64), source, np.array([n])])

    def _general(self, text: bytes) -> tuple[bytes, np.ndarray]:
        mark = SPACE_PIECE if self.escape else b" "
        chunks: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map else None
            if hit:
                size, new = hit
            else:
                lead = text[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = text[at : at + size]
            chunks.append((new, at))
            at += size
        out, source = bytearray(), []

        def put(piece: bytes, origin: int):
            out.extend(piece)
            source.extend([origin] * len(piece))

        if self.strip:
            while chunks and not chunks[0][0].strip(b" "):
                chunks.pop(0)
        begin = chunks[0][1] if chunks else len(text)
        if chunks and self.dummy_prefix and not self.suffix:
            put(mark, begin)
        spaced = self.strip
        for new, origin in chunks:
            for k in range(len(new)):
                if new[k] != 32:
                    put(new[k : k + 1], origin)
                    spaced = False
                elif not (self.strip and spaced):
                    put(mark, origin)
                    spaced = True
        end = len(text)
        if self.strip:
            while out.endswith(mark) and out:
                end = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        if chunks and self.dummy_prefix and self.suffix:
            put(mark, end)
        return bytes(out), np.array([*source, end], dtype=np.int64)


#: A normalizer_spec that changes nothing: the name, no prefix, no stripping, no escaping.
IDENTITY_SPEC = field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"


def _segmenter(model: bytes) -> bytes:
    """The model without its normaliser (and its self test), for texts that are normalised already."""
    kept = [field(n, v) for n, v in fields(model) if n not in (3, 4)]
    return b"".join(kept) + field(3, IDENTITY_SPEC)


class Codec:
    """A model with the library's processors, its own normaliser and the bytes of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=_segmenter(model))
        self.normaliser = Normaliser(model)
        size = self.processor.get_piece_size()
        self.bytes = [b""] * size
        for i in range(size):
            if self.processor.is_byte(i):
                self.bytes[i] = bytes([int(self.processor.id_to_piece(i)[3:5], 16)])
            elif not (self.processor.is_control(i) or self.processor.is_unknown(i)):
                self.bytes[i] = self.processor.id_to_piece(i).encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.unknown = self.processor.unk_id()

    def encode(self, texts: list[np.ndarray], end_id: bool = True) -> list[tuple[list[int], np.ndarray]]:
        """Ids and source byte spans of texts given by their bytes."""
        normal = [self.normaliser(t) for t in texts]
        coded = self.segmenter.encode([whole.decode() for whole, _ in normal], add_eos=end_id, num_threads=1)
        return [(ids, self.aligned(ids, whole, source)) for ids, (whole, source) in zip(coded, normal)]

    def spans(self, text: np.ndarray, ids: list[int]) -> np.ndarray:
        """Source byte span (start, end) of every id of a text's own encoding."""
        return self.aligned(ids, *self.normaliser(text))

    def aligned(self, ids: list[int], whole: bytes, source: np.ndarray) -> np.ndarray:
        """Source byte span of every id over a normalised text; control ids have an empty span at their place.

        The bytes of the pieces are the normalised text, or it is a ValueError.
        """
        pieces = [self.bytes[i] for i in ids]
        lengths = self.lengths[np.asarray(ids, np.int64)]
        if self.unknown in ids:
            parts = self.segmenter.encode(whole.decode(), out_type=str)
            for k in [k for k, i in enumerate(ids) if i == self.unknown]:
                pieces[k] = parts[k].encode()
                lengths[k] = len(pieces[k])
        if b"".join(pieces) != whole:
            raise ValueError("the pieces do not tile the normalised text")
        ends = np.cumsum(lengths)
        return np.stack([source[ends - lengths], source[ends]], axis=1)


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for a model in each Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


#: What encode() can put out, with the Spark and the Arrow type.
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "starts": ("array<int>", pa.list_(pa.int32())),
    "ends": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("bigint", pa.int64()),
    "n_source_bytes": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "spans_sha256": ("string", pa.string()),
}


def encode(df: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = tuple(OUTPUTS), end_id: bool = True) -> DataFrame:
    """Encodes every whole text and decodes its ids again.

    keep: columns carried along. outputs: of OUTPUTS; the digests are taken where the rows are encoded, so
    that ids and spans need not leave the Python worker. n_source_bytes counts the source bytes that the
    spans cover. spans_sha256: of the spans as little-endian 64-bit pairs.
    """
    clash = set(keep) & set(outputs)
    if clash:
        raise ValueError(f"output columns would clash with {sorted(clash)}")
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, *(T.StructField(c, T._parse_datatype_string(OUTPUTS[c][0])) for c in outputs)])
    wanted = set(outputs)

    def rows(batches):
        tool = codec(model)
        names = [str(i) for i in range(len(tool.lengths))]
        for batch in batches:
            for part in slices(batch, text):
                raw, at = text_buffers(part.column(text))
                coded = tool.encode([raw[a:b] for a, b in zip(at, at[1:])], end_id)
                decoded = tool.processor.decode([ids for ids, _ in coded]) if wanted & {"decoded", "decoded_sha256"} else [None] * len(coded)
                columns: dict[str, list] = {c: [] for c in outputs}
                for k, (ids, spans) in enumerate(coded):
                    made = {"ids": ids, "decoded": decoded[k], "n_tokens": len(ids)}
                    if "starts" in wanted:
                        made["starts"] = spans[:, 0].astype(np.int32)
                    if "ends" in wanted:
                        made["ends"] = spans[:, 1].astype(np.int32)
                    if "n_source_bytes" in wanted:
                        reached = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
                        before = np.concatenate([[0], reached[:-1]]) if len(spans) else reached
                        made["n_source_bytes"] = int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], before)).sum())
                    if "ids_sha256" in wanted:
                        made["ids_sha256"] = hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest()
                    if "decoded_sha256" in wanted:
                        made["decoded_sha256"] = hashlib.sha256(decoded[k].encode()).hexdigest()
                    if "spans_sha256" in wanted:
                        made["spans_sha256"] = hashlib.sha256(np.ascontiguousarray(spans, "<i8").tobytes()).hexdigest()
                    for c in outputs:
                        columns[c].append(made[c])
                arrays = [part.column(f.name) for f in kept] + [pa.array(columns[c], OUTPUTS[c][1]) for c in outputs]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*keep, text).mapInArrow(rows, schema)
