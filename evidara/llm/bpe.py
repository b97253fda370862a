"""Byte-level BPE from a rank file: encoding by backtracking, and decoding.

Bytes are mapped to Latin-1 characters for an Aho-Corasick automaton, which gives the
longest token at every place in one pass. Encoding goes left to right with longest
matches, and back to shorter ones where two adjacent tokens could not have come from
the merges; whether they could is found by undoing merges, and kept. Each piece of the
split pattern takes linear time, and its ids are those of merging by rank.

Defined cases: a null text is an empty one and has no ids; very long texts and very
long pieces take linear time; repeated rows stay; ids and extra columns of the input
are not touched.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PATTERN, Chunks, cut
from .common import hold, slices

#: Pairs of adjacent tokens that a task keeps the compatibility of at most.
PAIRS = 200_000


def merge_by_rank(piece: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """The parts that merging the lowest rank first leaves, and the last merge. Quadratic; for single tokens."""
    parts, last = list(piece), None
    while len(parts) > 1:
        best, at = min((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


class ByteBPE:
    """An encoder and decoder of one rank file (lines of a base64 token and its rank)."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines() if rank_file else [])}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.rank = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.size = {i: len(b) for b, i in ranks.items()}
        self.base = max(self.bytes_of, default=0) + 1
        self.split: dict[int, tuple[int, int]] = {}  # the last merge of a token; single bytes have none
        self.merged: dict[int, int] = {}  # the token of two adjacent ones
        self.in_order = True
        self.automaton = ahocorasick.Automaton()
        reached: dict[str, int] = {}
        for text, i in self.rank.items():
            parts, last = merge_by_rank(text, self.rank)
            if len(parts) > 1:
                continue  # no merges lead to it; it is met only as a whole piece
            reached[text] = i
            self.automaton.add_word(text, i)
            if last:
                a, b = (self.rank[x] for x in last)
                self.split[i] = (a, b)
                self.merged[a * self.base + b] = i
                self.in_order &= a < i and b < i if len(last[0]) > 1 and len(last[1]) > 1 else (len(last[0]) == 1 or a < i) and (len(last[1]) == 1 or b < i)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.shorter = {i: next((reached[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in reached), -1) for t, i in reached.items()}
        #: Merges happen in the order of ranks, but single bytes come first of all.
        self.order = {i: -1 if n == 1 else i for i, n in self.size.items()}
        self.pairs: dict[int, bool] = {}
        self.chunks = Chunks(self._encode_text)
        self.by_chunk = pattern == PATTERN  # other patterns may split elsewhere, so whole texts are encoded

    def fits(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave a and b side by side: no merge across them comes
        before those that made them. Undoes the later merge of the two tokens at the border."""
        limit = 1 << 60
        while True:
            if self.merged.get(a * self.base + b, limit) < limit:
                return False
            oa, ob = self.order[a], self.order[b]
            if oa < 0 and ob < 0:
                return True
            if oa > ob:  # of equal merges the left one is done first, so the right one is undone first
                limit = a
                a = self.split[a][1]
            else:
                limit = b + 1
                b = self.split[b][0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        if not self.in_order:
            return [self.rank[x] for x in merge_by_rank(piece, self.rank)[0]]
        size, pairs, base = self.size, self.pairs, self.base
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece):
            longest[end - size[token] + 1] = token
        able = [True] * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            good = able[end]
            if good and out:
                key = out[-1] * base + token
                good = pairs.get(key)
                if good is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    good = pairs[key] = self.fits(out[-1], token)
            if good:
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
                if token < 0:
                    raise KeyError(f"byte {piece[at]!r} is no token")
                continue
            token = self.shorter[token]
            if token < 0:
                able[at] = False
                token = out.pop()
                at -= size[token]

    def _encode_text(self, text: str) -> bytes:
        ids: list[int] = []
        for m in self.pattern.findall(text):
            ids += self.encode_piece(m.encode("utf-8", "surrogatepass").decode("latin-1"))
        return array("I", ids).tobytes() if array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = cut(text) if self.by_chunk else None
        return self._encode_text(text) if parts is None else b"".join(map(self.chunks.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[bytes, ByteBPE] = {}


def bpe_of(rank_file: bytes, pattern: str) -> ByteBPE:
    """One ByteBPE per process and rank file."""
    hold("bpe", _made.clear)
    key = hashlib.sha256(rank_file + b"\0" + pattern.encode()).digest()
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(rank_file, pattern)
    return _made[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, digests: bool = False) -> DataFrame:
    """Ids of every text of docs (doc_id, text).

    rank_file is read by the driver and sent to the tasks; a rank file has a few MB at
    most. Returns doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit); with
    digests, ids_sha256 and decoded_sha256 instead of ids, the latter of the bytes that
    decoding these ids gives.
    """
    with open(rank_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    tail = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.binary())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *tail])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(raw.value, pattern)
        for batch in slices(batches):
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            out = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]] if digests else [ids]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(o, f.type) for o, f in zip(out, list(schema)[2:]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, f"doc_id long, n_tokens long, {kinds}")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) of encode_documents' rows; null ids decode to no bytes."""
    with open(rank_file, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(raw.value, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(apply, "doc_id long, decoded binary")
