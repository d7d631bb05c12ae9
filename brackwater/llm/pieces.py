"""SentencePiece encoding with byte spans, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map
(a double-array trie), which also records where in the source each normalised byte
comes from; pieces that the model's user defined stay as they are, and models without
a map keep the text. Segments that no piece can straddle
(a run of spaces with what follows, or a newline) are encoded once each and reused;
every use is compared byte by byte. Piece k of a text covers the source bytes from
offsets[k] to offsets[k + 1]. Pieces for single bytes cover their byte.
"""

from __future__ import annotations

import importlib.util
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm import words as W
from brackwater.sources.shared import spread

CACHE_SEGMENTS = 200_000
META = b"\xe2\x96\x81"
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


def wire(number: int, value: int | bytes) -> bytes:
    """One field in wire format."""

    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """Longest-prefix replacement by a double-array trie of 32-bit units followed by the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size :]
        root = self._offset(self.units[0])
        first = [b for b in range(128) if self._child(root, b) is not None]
        # ASCII that begins no entry, and ASCII that begins one only before other than ASCII
        self.plain = {*range(128)} - {*first}
        self.alone = {b for b in first if not self.units[root ^ b] >> 8 & 1 and not any(self._child(self._child(root, b), c) is not None for c in range(1, 128))}

    def _child(self, node: int, byte: int) -> int | None:
        """The node that a byte leads to."""
        at = node ^ byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        return at ^ self._offset(self.units[at])

    def prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, bytes taken) of the longest match at a place, else the character there."""
        node = self._offset(self.units[0])
        value = taken = -1
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value, taken = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if value >= 0:
            return self.strings[value : self.strings.index(b"\0", value)], taken
        n = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
        return text[at : at + n], n

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


@dataclass
class Model:
    """A parsed model file."""

    data: bytes
    pieces: list[bytes] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    map: CharacterMap | None = None
    user: re.Pattern | None = None
    same: re.Pattern | None = None
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True

    def __post_init__(self) -> None:
        kept = []
        for number, value in fields(self.data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1])
                self.kinds.append(piece.get(3, 1))
            if number == 3:
                spec = dict(fields(value))
                self.map = CharacterMap(spec[2]) if spec.get(2) else None
                self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
            elif number != 4 and number != 5:
                kept.append(wire(number, value))
        # the same pieces over text that is normalised already
        plain = wire(1, b"identity") + wire(3, 0) + wire(4, 0) + wire(5, int(self.escape))
        own = sorted((p for p, k in zip(self.pieces, self.kinds) if k == USER), key=len, reverse=True)
        self.user = re.compile(b"|".join(map(re.escape, own))) if own else None
        if self.map:  # runs of bytes that stay as they are, spaces apart
            begun = {p[0] for p in own} | {32}
            free, alone = (b"".join(b"\\x%02x" % b for b in sorted(some - begun)) for some in (self.map.plain, self.map.alone))
            ways = [b"[%s]" % free] * bool(free) + [b"[%s](?=[\\x00-\\x7f]|$)" % alone] * bool(alone)
            self.same = re.compile(b"(?:%s)+" % b"|".join(ways), re.S) if ways else None
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=b"".join(kept) + wire(3, plain))
        surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(META, b" ") for p, k in zip(self.pieces, self.kinds)]
        self.unknown = self.kinds.index(UNKNOWN)
        self.length = np.array([len(s) for s in surface], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        text = [p for p, k in zip(self.pieces, self.kinds) if k not in (CONTROL, UNKNOWN, BYTE)]
        self.by_space = all(META not in p.lstrip(META) if p.startswith(META) else META not in p for p in text) if META else False
        self.by_line = all(b"\n" not in p for p in text)


def load(path: str) -> Model:
    """The model of a file."""
    with open(path, "rb") as f:
        return Model(f.read())


def normalise(text: bytes, model: Model) -> tuple[bytes, np.ndarray]:
    """The normalised text, with spaces as such, and the source offset of each of its bytes and of its end."""
    out, where = bytearray(), []
    at, n = 0, len(text)

    def prefix() -> tuple[bytes, int]:
        if model.user and (own := model.user.match(text, at)):
            return own[0], len(own[0])
        return model.map.prefix(text, at) if model.map else (text[at : at + 1], 1)

    if model.trim:
        while at < n and (p := prefix())[0] == b" ":
            at += p[1]
    if at == n:
        return b"", np.zeros(1, np.int64)
    if model.dummy_prefix:
        out += b" "
        where.append(at)
    space = model.trim
    while at < n:
        if model.same and (run := model.same.match(text, at)):
            out += run[0]
            where += range(at, run.end())
            at, space = run.end(), False
            continue
        to, taken = prefix()
        if space:
            to = to.lstrip(b" ")
        if to:
            out += to
            where += [at] * len(to)
            space = to.endswith(b" ")
        at += taken
        if not model.trim:
            space = False
    while model.trim and out.endswith(b" "):
        at = where.pop()
        out.pop()
    return unmarked(bytes(out), np.array([*where, at], np.int64))


def unmarked(text: bytes, where: np.ndarray) -> tuple[bytes, np.ndarray]:
    """text with a space for each mark of a space that stands in it as such, as the pieces can't tell them apart."""
    if META not in text:
        return text, where
    keep = np.ones(len(where), bool)
    at = text.find(META)
    while at >= 0:
        keep[at + 1 : at + 3] = False
        at = text.find(META, at + 3)
    return text.replace(META, b" "), where[keep]


class Encoder:
    """Encodes batches of texts; segments seen before are not encoded again."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of segments, sorted, and the slot of each
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.byte_first = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def prepared(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Normalised bytes of all rows, row offsets, and the source offsets (none where it is the text after one space or none)."""
        raw, at = W.utf8(array)
        m = self.model
        marked = META in raw.tobytes()
        if m.map is None and not m.trim and not marked:
            if not m.dummy_prefix:
                return raw, at, None
            full = np.diff(at) > 0
            shift = np.concatenate([[0], np.cumsum(full)])
            out = np.full(raw.size + shift[-1], 32, np.uint8)
            mask = np.ones(out.size, bool)
            mask[(at[:-1] + shift[:-1])[full]] = False
            out[mask] = raw
            return out, at + shift, None
        if m.map is None and not m.trim:
            rows = [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            lead = [m.dummy_prefix and bool(t) for t in rows]
            parts, where = zip(*(unmarked(b" " * p + t, np.maximum(np.arange(len(t) + p + 1) - int(p), 0)) for t, p in zip(rows, lead)))
        else:
            parts, where = zip(*(normalise(raw[a:b].tobytes(), m) for a, b in zip(at[:-1], at[1:])))
        sizes = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), where

    def _add(self, texts: list[bytes], hashes: np.ndarray) -> None:
        m = self.model
        found = m.engine.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)
        lengths = []
        for k, ids in enumerate(found):
            own = m.length[ids] if ids else np.zeros(0, np.int64)
            if m.unknown in ids:
                proto = m.engine.encode(texts[k].decode("utf-8", "replace"), return_type="proto")
                own = np.array([len(p.surface.encode()) for p in proto.pieces], np.int64)
            lengths.append(own)
        at = np.searchsorted(self.known, hashes)
        self.slot = np.insert(self.slot, at, len(self.first) - 1 + np.arange(len(texts)))
        self.known = np.insert(self.known, at, hashes)
        self.ids = np.concatenate([self.ids, *(np.array(f, np.int32) for f in found)])
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(f) for f in found])])
        self.byte_first = np.concatenate([self.byte_first, self.byte_first[-1] + np.cumsum([len(t) for t in texts])])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(texts), np.uint8)])

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, rows, exact): of row k the ids from rows[k] to rows[k + 1], the offsets from rows[k] + k on, one more; exact where decoding gives the source text again."""
        m, count = self.model, len(array)
        text, at, where = self.prepared(array)
        n = text.size
        start = np.zeros(n + 1, bool)
        start[at] = True
        if m.by_space:
            space = text == 32
            start[1:-1] |= space[1:] & ~space[:-1]
        if m.by_line:
            line = text == 10
            start[:-1] |= line
            start[1:] |= line
        cuts = np.flatnonzero(start[:-1])
        ends = np.append(cuts[1:], n) if len(cuts) else cuts
        hashes, use = np.unique(W.span_hashes(text, cuts, ends, W.RAW_CODES[1]), return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_SEGMENTS:
            self._clear()
        place = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            sample = np.zeros(len(hashes), np.int64)
            sample[use] = np.arange(len(use))
            self._add([text[a:b].tobytes() for a, b in zip(cuts[sample[new]], ends[sample[new]])], hashes[new])
        slot = self.slot[np.searchsorted(self.known, hashes)][use] if len(use) else np.zeros(0, np.int64)
        # each use has the very bytes that were encoded
        size = ends - cuts
        if (self.byte_first[slot + 1] - self.byte_first[slot] != size).any() or (self.bytes[np.repeat(self.byte_first[slot] - cuts, size) + np.arange(n)] != text).any():
            raise ValueError("two segments have one hash")
        many = self.first[slot + 1] - self.first[slot]
        total = int(many.sum())
        source = np.repeat(self.first[slot] - (np.cumsum(many) - many), many) + np.arange(total)
        ids, lengths = self.ids[source], self.lengths[source]
        rows = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(cuts, at)]
        ends_at = np.cumsum(lengths)
        # boundaries in the normalised text, one more than pieces in each row
        row_of = np.repeat(np.arange(count), np.diff(rows))
        offsets = np.zeros(total + count, np.int64)
        offsets[np.arange(total) + row_of + 1] = ends_at - at[row_of]
        if where is None:
            offsets = np.maximum(offsets - int(m.dummy_prefix), 0)
        else:
            for k in range(count):
                part = slice(rows[k] + k, rows[k + 1] + k + 1)
                offsets[part] = where[k][offsets[part]]
        # decoded again, as decode_lists() does, and held against the source; without offsets of its own that is the text itself
        back = piece_bytes(ids, m)
        exact = np.ones(count, bool)
        if where is not None or len(back) != n or not np.array_equal(back, text):
            cut = np.concatenate([[0], np.cumsum(m.length[ids])])[rows]
            raw, raw_at = (text, at) if where is None else W.utf8(array)
            for k in range(count):
                got = back[cut[k] : cut[k + 1]]
                if where is not None and m.dummy_prefix and len(got) and got[0] == 32:
                    got = got[1:]
                exact[k] = np.array_equal(got, raw[raw_at[k] : raw_at[k + 1]])
        return ids, offsets.astype(np.int32), rows, exact


def piece_bytes(ids: np.ndarray, m: Model) -> np.ndarray:
    """The bytes of the pieces, one after the other."""
    size = m.length[ids]
    return m.bytes[np.repeat(m.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())] if len(ids) else np.zeros(0, np.uint8)


def decode_lists(array: pa.ListArray, m: Model) -> pa.Array:
    """The text of each list of ids; null for null. Bytes that aren't UTF-8 become U+FFFD, unknown pieces nothing."""
    ids = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.array([0 if x is None else x for x in pa.compute.list_value_length(array).to_pylist()], np.int64)
    rows = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    back = piece_bytes(ids, m)
    cut = np.concatenate([[0], np.cumsum(m.length[ids])])[rows]
    out = []
    for k in range(len(array)):
        text = back[cut[k] : cut[k + 1]].tobytes().decode("utf-8", "replace")
        out.append(None if not array.is_valid()[k].as_py() else text[1:] if m.dummy_prefix and text.startswith(" ") else text)
    return pa.array(out, pa.string())


def model_path() -> str:
    """The public 32k model of the environment, by BRACKWATER_PIECES or the package of tokenizer files."""
    if given := os.environ.get("BRACKWATER_PIECES"):
        return given
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin), "piece_bpe_32k.model") if spec else "/opt/tokenizers/piece_bpe_32k.model"


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets, pieces, exact) of every text, whole.

    A null text gives null ids and offsets, no pieces, and counts as exact; an empty
    one has no ids and the one offset 0. Null ids and repeated rows are carried along,
    an empty table gives an empty one, other columns are not read.
    """
    W.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(load(path or model_path()).data)  # half a megabyte
    out = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("offsets", T.ArrayType(T.IntegerType(), False)), T.StructField("pieces", T.IntegerType()), T.StructField("exact", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model(sent.value))
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                text = batch.column(1).slice(a, b - a)
                ids, offsets, rows, exact = encoder.encode(text)
                void = text.is_null()
                lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v), mask=void) for o, v in ((rows, ids), (rows + np.arange(len(rows)), offsets))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists, pa.array(np.diff(rows).astype(np.int32)), pa.array(exact)], out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def decode(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ...) of encoded (doc_id, ids): the normalised text, and the columns to keep.

    Null ids give null, no ids an empty text. Null doc_ids and repeated rows are carried
    along, an empty table gives an empty one, other columns are not read.
    """
    W.bound_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(load(path or model_path()).data)
    out = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType()), *(encoded.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), decode_lists(part.column(1), model), *part.columns[2:]], out.names)

    return encoded.select("doc_id", "ids", *keep).mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, encoded, and decoded again: ``decoded`` is the MD5 of what decoding gives."""
    encoded = encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))
    back = decode(encoded, keep=("ids", "offsets", "pieces", "exact"))
    return back.select("doc_id", "ids", "offsets", "pieces", "exact", F.md5("text").alias("decoded"))
