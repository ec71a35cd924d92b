"""Subword encoding that keeps the place of every piece in the original text, and decoding.

The text is normalised by the model's compiled character map: at each place the
longest prefix found in its double-array trie is replaced, any other character
stays.  Every normalised byte keeps the original byte it comes from, so the
pieces, which tile the normalised text, project to spans of original bytes.

Merging itself is the library's, on the text normalised here: the processor that
encodes is the same model with its own normalisation switched off.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foreshock.llm.text import rounds, to_batch

SPACE_MARK = "▁"
#: Chunks kept per Python worker; about 250 bytes each.  The ones before are looked up until there are as many again.
CACHED_CHUNKS = 200_000


def _number(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """(field, value, first byte, end) of a protocol buffer message."""
    i = 0
    while i < len(b):
        at = i
        tag, i = _number(b, i)
        kind = tag & 7
        value: int | bytes
        if kind == 0:
            value, i = _number(b, i)
        elif kind == 2:
            n, i = _number(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield tag >> 3, value, at, i


# Field numbers of the model's message, types of pieces and the bits of a double-array unit.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
CHARS_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
BYTE_FALLBACK = 35
BYTE_PIECE, USER_DEFINED = 6, 4
#: A normaliser that changes nothing: identity map, no prefix, no removal, no escaping.
OFF_SPEC = b"\x1a\x10" + b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x00"


@dataclass
class CharsMap:
    """Compiled character map: a double-array trie over byte strings and their replacements."""

    units: list[int] = field(default_factory=list)
    texts: bytes = b""

    @classmethod
    def parse(cls, blob: bytes) -> CharsMap:
        if not blob:
            return cls()
        (size,) = struct.unpack_from("<I", blob)
        return cls(list(struct.unpack_from(f"<{size // 4}I", blob, 4)), blob[4 + size :])

    def longest(self, b: bytes, at: int) -> tuple[int, int]:
        """(length, place of the replacement) of the longest key at ``at``; length 0 if there is none."""
        units, found = self.units, (0, 0)
        node = 0

        def children(u: int) -> int:
            return (u >> 10) << ((u & 0x200) >> 6)

        node ^= children(units[node])
        for i in range(at, len(b)):
            node ^= b[i]
            if node >= len(units) or units[node] & 0x800000FF != b[i]:
                break
            u = units[node]
            node ^= children(u)
            if u & 0x100:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def replacement(self, place: int) -> bytes:
        return self.texts[place : self.texts.index(b"\0", place)]


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec: dict[int, int | bytes] = {}
        kept, lengths, pairs, split_ok, fallback = [], [], set(), True, False
        for number, value, at, end in _fields(model):
            if number == NORMALIZER:
                spec = {n: v for n, v, _, _ in _fields(value)}
                continue
            kept.append(model[at:end])
            if number == TRAINER:
                fallback = bool({n: v for n, v, _, _ in _fields(value)}.get(BYTE_FALLBACK, 0))
            elif number == PIECES:
                piece = {n: v for n, v, _, _ in _fields(value)}
                text, kind = piece[1].decode(), piece.get(3, 1)
                if kind == USER_DEFINED:
                    raise ValueError("models with user-defined symbols are not supported")
                lengths.append(1 if kind == BYTE_PIECE else len(piece[1]))
                if kind == 1:
                    pairs.update(zip(text, text[1:], strict=False))
        split_ok = fallback and all(a == SPACE_MARK or b != SPACE_MARK for a, b in pairs)
        self.chars = CharsMap.parse(spec.get(CHARS_MAP, b""))
        self.dummy_prefix = bool(spec.get(DUMMY_PREFIX, 1))
        self.remove_spaces = bool(spec.get(REMOVE_SPACES, 1))
        self.escape = bool(spec.get(ESCAPE_SPACES, 1))
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=b"".join(kept) + OFF_SPEC)
        self.lengths = np.array(lengths, np.int64)
        self.pairs = pairs
        # No piece joins a character and a following space mark, so what lies between is encoded on its own.
        line = "\n" if not any("\n" in p for p in pairs) else ""
        self.chunks = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}{line}]+|{SPACE_MARK}+" + (f"|{line}" if line else "")) if split_ok else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the chunks known before the last clearing

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the original byte it comes from."""
        raw = text.encode()
        mark = SPACE_MARK if self.escape else " "
        if not raw:
            return "", np.zeros(1, np.int64)
        if not self.chars.units and not self.remove_spaces:
            b = np.frombuffer(raw, np.uint8)
            wide = np.where(b == 0x20, len(mark.encode()), 1)
            source = np.repeat(np.arange(len(b)), wide)
            head = np.zeros(len(mark.encode()) * self.dummy_prefix, np.int64)
            return mark * self.dummy_prefix + text.replace(" ", mark), np.concatenate([head, source, [len(b)]])
        parts: list[tuple[bytes, int]] = []  # replacement, original byte
        at = 0
        while at < len(raw):
            n, place = self.chars.longest(raw, at) if self.chars.units else (0, 0)
            if n:
                parts.append((self.chars.replacement(place), at))
            else:
                n = 1 + sum(raw[at] >= x for x in (0xC0, 0xE0, 0xF0))
                parts.append((raw[at : at + n], at))
            at += n
        return self._spaces(parts, len(raw), mark)

    def _spaces(self, parts: list[tuple[bytes, int]], size: int, mark: str) -> tuple[str, np.ndarray]:
        out, source, m = bytearray(), [], mark.encode()
        end = size
        if self.remove_spaces:
            while parts and parts[0][0] == b" " * len(parts[0][0]):
                parts.pop(0)
            if not parts:
                return "", np.array([size], np.int64)
        last_space = False

        def add(b: bytes, at: int) -> None:
            out.extend(b)
            source.extend([at] * len(b))

        if self.dummy_prefix:
            add(m, parts[0][1])
        last_space = self.remove_spaces
        for b, at in parts:
            if self.remove_spaces and last_space:
                b = b.lstrip(b" ")
            for k in range(len(b)):
                add(m if b[k] == 0x20 else b[k : k + 1], at)
            if b:
                last_space = self.remove_spaces and b.endswith(b" ")
        if self.remove_spaces:
            while out.endswith(m):
                del out[-len(m) :]
                end = source[-len(m)]
                del source[-len(m) :]
        return out.decode(), np.array([*source, end], np.int64)

    def _ids(self, chunk: str) -> bytes:
        return np.array(self.bare.encode(chunk), "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        # A last character that no piece joins to the one before it is encoded on its own.
        cut = {c for c in new if len(c) > 1 and (c[-2], c[-1]) not in self.pairs}
        single = sorted(((new - cut) | {c[:-1] for c in cut} | {c[-1] for c in cut}).difference(self.known))
        done = self.bare.encode(single, num_threads=1) if single else []
        self.known.update(zip(single, (np.array(x, "<u4").tobytes() for x in done), strict=True))
        for c in cut:
            self.known[c] = self.known[c[:-1]] + self.known[c[-1]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids without begin and end, first and end original byte of each piece."""
        normal = [self.normalize(t) for t in texts]
        if self.chunks is None:
            ids = [self._ids(t) for t, _ in normal]
        else:
            split = [self.chunks.findall(t) for t, _ in normal]
            get = self.known.get
            found = [list(map(get, s)) for s in split]
            new = {c for s, f in zip(split, found, strict=True) if None in f for c, x in zip(s, f, strict=True) if x is None}
            again = new & self.before.keys()
            self.known.update((c, self.before[c]) for c in again)
            self._learn(new - again)
            ids = [b"".join(map(get, s) if None in f else f) for s, f in zip(split, found, strict=True)]
            if len(self.known) > CACHED_CHUNKS:
                self.known, self.before = {}, self.known
        out = []
        for x, (_, source) in zip(ids, normal, strict=True):
            x = np.frombuffer(x, "<u4")
            to = np.cumsum(self.lengths[x])
            if len(x) and to[-1] != len(source) - 1:
                raise ValueError("pieces do not tile the normalised text")
            edges = source[np.concatenate([[0], to])] if len(x) else np.zeros(1, np.int64)
            out.append((x, edges[:-1], edges[1:]))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The model, loaded once per Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _framed(c: PieceCodec, texts: list[str], begin: bool, end: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    first = [c.library.bos_id()] if begin else []
    last = [c.library.eos_id()] if end else []
    for (ids, a, b), t in zip(c.encode(texts), texts, strict=True):
        n = len(t.encode())
        yield (
            np.concatenate([first, ids, last]).astype("<u4"),
            np.concatenate([[0] * len(first), a, [n] * len(last)]).astype(np.int64),
            np.concatenate([[0] * len(first), b, [n] * len(last)]).astype(np.int64),
        )


def encode(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """Per document: doc_id, ids array<int>, span_start and span_end array<long> (original UTF-8 bytes), decoded string.

    A null text is empty.  Begin and end ids have empty spans.  Repeated rows
    are encoded as often as they occur; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("span_start", pa.list_(pa.int64())), ("span_end", pa.list_(pa.int64())), ("decoded", pa.string())])
        c = codec(model_path)
        for b in rounds(batches):
            done = list(_framed(c, [t or "" for t in b.column("text").to_pylist()], begin, end))
            yield to_batch(
                out,
                doc_id=b.column("doc_id"),
                ids=pa.array([x.astype(np.int32) for x, _, _ in done], pa.list_(pa.int32())),
                span_start=pa.array([x for _, x, _ in done], pa.list_(pa.int64())),
                span_end=pa.array([x for _, _, x in done], pa.list_(pa.int64())),
                decoded=c.decode([x.tolist() for x, _, _ in done]),
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, span_start array<long>, span_end array<long>, decoded string")


def digests(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """:func:`encode` reduced inside the tasks: doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes.

    ``covered_bytes`` counts original bytes inside the pieces' spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("covered_bytes", pa.int64())])
        c = codec(model_path)
        for b in rounds(batches):
            done = list(_framed(c, [t or "" for t in b.column("text").to_pylist()], begin, end))
            plain = c.decode([x.tolist() for x, _, _ in done])
            yield to_batch(
                out,
                doc_id=b.column("doc_id"),
                n_tokens=[len(x) for x, _, _ in done],
                ids_sha256=[hashlib.sha256(x.tobytes()).hexdigest() for x, _, _ in done],
                decoded_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in plain],
                covered_bytes=[int((b - a).sum()) for _, a, b in done],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
