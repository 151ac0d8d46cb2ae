"""SentencePiece encoding that keeps the place of every piece, and decoding.

`Normaliser` applies the model's compiled character map: at each place the
longest prefix that the map knows is replaced, else one character is copied, and
every byte of the result remembers the byte of the source it came from. White
space is then trimmed, prefixed and escaped as the model says. The normalised
text is cut where no piece of the vocabulary reaches across, each stretch is
segmented by the library once per worker (`chunk_cache.py`), and the byte lengths
of its pieces project them to spans of the original text.

Null and empty texts give no pieces (an end id alone, if one is asked for) and
decode to the empty text; a null key stays null; repeated rows give repeated
rows; an empty table gives an empty one; further columns are not looked at.
Models need byte fallback, so that no run of unknown signs is joined to one piece.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import SentencePieceProcessor

from tracewell.llm.batches import Batches, documents, keyed_texts, map_batches, record_batch, slices
from tracewell.llm.chunk_cache import ChunkCache
from tracewell.llm.words import Words, stretch_hashes, text_bytes

_ESCAPED = "▁".encode()
_INT_LIST = pa.list_(pa.int32())
_PIECES = pa.schema(
    [("key", pa.int64()), ("ids", _INT_LIST), ("begins", _INT_LIST), ("ends", _INT_LIST)]
)
_DIGESTS = pa.schema(
    [
        ("key", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("ids", _INT_LIST),
    ]
)


# The model file: a message of numbered fields


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _message(number: int, data: bytes) -> bytes:
    size, out = len(data), bytes([number << 3 | 2])
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + data


#: Fields of the model and of its normaliser.
NORMALISER = 3
NAME, CHARACTER_MAP, ADD_PREFIX, TRIM, ESCAPE = 1, 2, 3, 4, 5


def with_normaliser(
    model: bytes, name: str, character_map: bytes, add_prefix: bool, trim: bool, escape: bool = True
) -> bytes:
    """The model with another normaliser: of a field given twice, the later value holds."""
    flags = b"".join(bytes([n << 3, v]) for n, v in ((ADD_PREFIX, add_prefix), (TRIM, trim), (ESCAPE, escape)))
    spec = _message(NAME, name.encode()) + _message(CHARACTER_MAP, character_map) + flags
    return model + _message(NORMALISER, spec)


class CharacterMap:
    """A double array of prefixes, each with the place of its replacement."""

    def __init__(self, packed: bytes):
        size = struct.unpack("<I", packed[:4])[0] if packed else 0
        self.units = np.frombuffer(packed[4 : 4 + size], "<u4").tolist()
        self.replacements = packed[4 + size :]
        self.first = np.zeros(256, bool)
        self.alone = np.zeros(256, bool)
        for byte in range(256) if self.units else ():
            self.first[byte] = self._steps(bytes([byte])) > 0
            self.alone[byte] = self.longest(bytes([byte]), 0) is not None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _steps(self, text: bytes) -> int:
        at = self._offset(self.units[0])
        for n, byte in enumerate(text):
            unit = self.units[at ^ byte]
            if unit & 0x800000FF != byte:
                return n
            at ^= byte ^ self._offset(unit)
        return len(text)

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[start:] and its replacement."""
        at, found = self._offset(self.units[0]), None
        for i in range(start, len(text)):
            unit = self.units[at ^ text[i]]
            if unit & 0x800000FF != text[i]:
                break
            at ^= text[i] ^ self._offset(unit)
            if unit & 256:
                found = i + 1 - start, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        size, place = found
        return size, self.replacements[place : self.replacements.index(b"\0", place)]


class Normaliser:
    def __init__(self, model: bytes):
        spec = {}
        for number, value in _fields(model):
            if number == NORMALISER:
                spec |= dict(_fields(value))
        self.map = CharacterMap(spec.get(CHARACTER_MAP, b""))
        self.add_prefix, self.trim = bool(spec.get(ADD_PREFIX, 1)), bool(spec.get(TRIM, 1))
        self.escaped = _ESCAPED if spec.get(ESCAPE, 1) else b" "

    def _replaced(self, raw: np.ndarray, offsets: np.ndarray):
        """Bytes after the character map, the source of each, and the new offsets.

        The bytes of a character or of a replacement all come from its first byte.
        """
        place = np.arange(len(raw))
        place = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, place)) if len(raw) else place
        if not self.map.units:
            return raw, place, offsets
        high = np.concatenate((raw[1:] >= 128, [False]))
        tried = self.map.first[raw] & ((raw >= 128) | high | self.map.alone[raw]) & (raw & 0xC0 != 0x80)
        bounds = np.searchsorted(np.flatnonzero(tried), offsets)
        places, data = np.flatnonzero(tried).tolist(), raw.tobytes()
        parts, sources, sizes, done = [], [], [], 0
        for t in range(len(offsets) - 1):
            text_end, size = int(offsets[t + 1]), 0
            text = data[:text_end] if bounds[t] < bounds[t + 1] else b""
            for at in [*places[bounds[t] : bounds[t + 1]], text_end]:
                if at < done:
                    continue
                found = self.map.longest(text, at) if at < text_end else (0, b"")
                if found is None:
                    continue
                parts += [raw[done:at], np.frombuffer(found[1], np.uint8)]
                sources += [place[done:at], np.full(len(found[1]), at)]
                size += at - done + len(found[1])
                done = at + found[0]
            sizes.append(size)
        joined = np.concatenate(parts) if parts else raw
        source = np.concatenate(sources) if sources else place
        return joined, source, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def __call__(self, texts: pa.Array):
        """Normalised bytes, their offsets, the source of each byte, and the end of each text's source.

        Sources count from the beginning of the text.
        """
        raw, offsets = text_bytes(texts)
        data, source, bounds = self._replaced(raw, offsets)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        last = np.diff(offsets)
        source = source - offsets[owner]
        space = data == 32
        if self.trim and len(data):
            begin = np.zeros(len(data), bool)
            begin[bounds[:-1][np.diff(bounds) > 0]] = True
            after_space = np.concatenate(([True], space[:-1])) | begin
            keep = ~(space & after_space)
            # What is left at the end is one space at most.
            kept = np.flatnonzero(keep)
            final = np.concatenate((owner[kept][1:] != owner[kept][:-1], [True])) if len(kept) else np.zeros(0, bool)
            tail = kept[final & space[kept]]
            last = last.copy()
            last[owner[tail]] = source[tail]
            keep[tail] = False
            data, source, owner, space = data[keep], source[keep], owner[keep], space[keep]
        sizes = np.where(space, len(self.escaped), 1)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(data) else np.zeros(0, np.int64)
        lead = len(self.escaped) * self.add_prefix
        before = np.zeros(len(data), np.int64)
        before[first] = lead
        ends = np.cumsum(sizes + before)
        total = int(ends[-1]) if len(ends) else 0
        out, where = np.zeros(total, np.uint8), np.zeros(total, np.int64)
        at = ends - sizes
        out[at[~space]] = data[~space]
        where[at] = source
        for i, byte in enumerate(self.escaped):
            out[at[space] + i] = byte
            where[at[space] + i] = source[space]
            if lead:
                out[at[first] - lead + i] = byte
                where[at[first] - lead + i] = source[first]
        lengths = np.bincount(owner, sizes + before, len(bounds) - 1).astype(np.int64)
        if self.trim:
            out, where, last, lengths = self._without_tails(out, where, last, lengths)
        return out, np.concatenate(([0], np.cumsum(lengths))), where, last

    def _without_tails(self, out: np.ndarray, where: np.ndarray, last: np.ndarray, lengths: np.ndarray):
        """Escapes that a text itself ends with are trimmed like white space."""
        mark, ends = np.frombuffer(self.escaped, np.uint8), np.cumsum(lengths)
        long = np.flatnonzero(lengths >= len(mark))
        tails = out[ends[long][:, None] + np.arange(-len(mark), 0)] if len(long) else np.zeros((0, len(mark)), np.uint8)
        keep, last, lengths = np.ones(len(out), bool), last.copy(), lengths.copy()
        for i in long[(tails == mark).all(axis=1)].tolist():
            start, end = int(ends[i] - lengths[i]), int(ends[i])
            bare = end - start
            while bare >= len(mark) and (out[start + bare - len(mark) : start + bare] == mark).all():
                bare -= len(mark)
            keep[start + bare : end] = False
            last[i], lengths[i] = where[start + bare], bare
        return out[keep], where[keep], last, lengths


class Pieces:
    """Encodes batches with the model file at `path`."""

    def __init__(self, path: str | None = None, model: bytes | None = None):
        if model is None:
            with open(path, "rb") as file:
                model = file.read()
        self.processor = SentencePieceProcessor(model_proto=model)
        self.core = SentencePieceProcessor(model_proto=with_normaliser(model, "identity", b"", False, False, False))
        self.normalise = Normaliser(model)
        core = self.core
        n = core.vocab_size()
        self.lengths = np.zeros(n, np.int64)
        joined = np.zeros((256, 256), bool)
        across = False
        for i in range(n):
            if core.is_byte(i):
                self.lengths[i] = 1
            elif not (core.is_control(i) or core.is_unknown(i) or core.is_unused(i)):
                piece = core.id_to_piece(i)
                data = piece.encode()
                self.lengths[i] = len(data)
                joined[list(data[:-1]), list(data[1:])] = True
                across |= "▁" in piece.lstrip("▁")
        if not any(core.is_byte(i) for i in range(n)) or across:
            raise ValueError("only models with byte fallback whose pieces do not go on after white space")
        self.joined = joined
        self.cache = ChunkCache(lambda chunks: core.encode([c.decode() for c in chunks], num_threads=1))

    def _stretches(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """The texts cut where no piece reaches across."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[1:-1] = ~self.joined[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)
        if len(data) > 2:
            escaped, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
            escaped[:-3] = (data[:-2] == _ESCAPED[0]) & (data[1:-1] == _ESCAPED[1]) & (data[2:] == _ESCAPED[2])
            after[3:] = escaped[:-3]
            cut = (cut | escaped) & ~(escaped & after)
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        if not len(data):
            edges = np.zeros(1, np.int64)
        starts, ends = edges[:-1], edges[1:]
        return Words(data, offsets, starts, ends, stretch_hashes(data, starts, ends), np.searchsorted(starts, offsets))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the bytes of the source where each begins and ends, and the bounds of the texts."""
        data, offsets, source, last = self.normalise(texts)
        ids, ends = self.cache.ids(self._stretches(data, offsets))
        ends_at = np.cumsum(self.lengths[ids])
        bounds = np.searchsorted(ends_at, offsets, "right")
        bounds[-1] = len(ids)
        begins = source[ends_at - self.lengths[ids]] if len(ids) else np.zeros(0, np.int64)
        stops = np.concatenate((source, [0]))[ends_at]
        final = bounds[1:][np.diff(bounds) > 0] - 1
        stops[final] = last[np.diff(bounds) > 0]
        return ids, begins, stops, bounds


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One per worker and file."""
    return Pieces(path)


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def encode_batches(batches: Batches, path: str, end: bool = True) -> Batches:
    """(key, ids, begins, ends) for (key, text); the end id stands for no bytes."""
    model = pieces(path)
    for batch in slices(batches):
        ids, begins, stops, bounds = model.encode(batch.column("text"))
        if end:
            at = bounds[1:]
            final = np.diff(text_bytes(batch.column("text"))[1])
            ids = np.insert(ids, at, model.processor.eos_id())
            begins, stops = np.insert(begins, at, final), np.insert(stops, at, final)
            bounds = bounds + np.arange(len(bounds))
        yield record_batch(
            _PIECES, batch.column("key"), _lists(bounds, ids), _lists(bounds, begins), _lists(bounds, stops)
        )


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """Ids of every whole text, with the bytes of the original text that each stands for."""
    found = map_batches(
        keyed_texts(df, key, text),
        lambda batches: encode_batches(batches, path, end),
        "key long, ids array<int>, begins array<int>, ends array<int>",
    )
    return found.withColumnRenamed("key", key)


def decode_batches(batches: Batches, path: str) -> Batches:
    """Adds the decoded text to batches with `ids`."""
    processor = pieces(path).processor
    for batch in batches:
        texts = [processor.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield batch.append_column("decoded", pa.array(texts, pa.string()))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of rows with ids; null ids count as none."""
    rows = df.selectExpr(f"CAST(`{key}` AS LONG) AS key", f"coalesce(`{ids}`, array()) AS ids")

    def run(batches: Batches) -> Batches:
        for batch in decode_batches(batches, path):
            yield batch.select(["key", "decoded"])

    return map_batches(rows, run, "key long, decoded string").withColumnRenamed("key", key)


def _digests(batches: Batches, path: str) -> Batches:
    names = [str(i) for i in range(pieces(path).processor.vocab_size())]
    for batch in decode_batches(encode_batches(batches, path), path):
        ids = batch.column("ids").to_pylist()
        yield record_batch(
            _DIGESTS,
            batch.column("key"),
            [len(x) for x in ids],
            [hashlib.sha256(" ".join([names[i] for i in x]).encode()).hexdigest() for x in ids],
            [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()],
            batch.column("ids"),
        )


def encoded_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, ids), with the digests taken in the task that encodes and decodes."""
    found = map_batches(
        keyed_texts(df, key, text),
        lambda batches: _digests(batches, path),
        "key long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>",
    )
    return found.withColumnRenamed("key", key)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")
