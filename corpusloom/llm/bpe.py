"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens come from the tokenizer's pattern. Within one, a linked list holds the
current symbols and every adjacent pair that is in the vocabulary waits in the
bucket of its merge rank. A two-level bitmap over the ranks tells the lowest
bucket that isn't empty by two find-first-set steps; its positions are merged
from left to right, entries that an earlier merge has made stale are skipped, and
pairs that a merge forms are queued. Work is near linear in the bytes, so very long
pre-tokens do no harm, and all new pre-tokens of a run of texts share one list and
queue, no pair reaching from one to the next. The ids of recent pre-tokens are cached, as
most repeat; the cache is bounded by two generations, of which the older goes.

Only public rank files are read, from a path that is a parameter; on a cluster
the file must be installed at that path on every node, as the tokenizer package is.

Defined cases. Null or empty text: no ids. Repeated rows are encoded each. Empty
table: empty result. Texts are taken whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


CACHE_ENTRIES = 300_000  # in each of two generations
CACHED_CHARS = 64
RUN_CHARS = 500_000  # pre-tokens of so much text are encoded in one run
RUN_ROWS = 500
RANKS_FILE = "byte_bpe_50k.tiktoken"


class RankQueue:
    """Buckets per rank under a bitmap of two levels, 256-way."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a = rank >> 8
        if not self.low[a]:
            self.top |= 1 << a
        self.low[a] |= 1 << (rank & 255)

    def put(self, rank: int, positions: list[int]) -> None:
        """As many pushes into a bucket; it holds these alone then."""
        self.buckets.pop(rank, None)
        self.push(rank, positions[0])
        self.buckets[rank] = positions

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank with its positions, which leave the queue."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.low[a]
        rank = (a << 8) | ((word & -word).bit_length() - 1)
        word &= word - 1
        self.low[a] = word
        if not word:
            self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder(dict):
    """Pre-token to packed ids; as a dict it is the cache of recent ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES):
        import regex

        super().__init__()
        self.entries = entries
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.older: dict[str, bytes] = {}
        self.of_one = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.of_two = np.full(65536, -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_two[token[0] * 256 + token[1]] = rank

    def __missing__(self, piece: str) -> bytes:
        self.learn([piece])
        return self[piece]

    def learn(self, pieces: list[str]) -> None:
        """Encode pre-tokens that are not in the cache, all in one queue."""
        if len(self) + len(pieces) > self.entries:
            self.older = dict(self)
            self.clear()
        older, ranks, left, raws = self.older.get, self.ranks.get, [], []
        for piece in pieces:
            ids = older(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                whole = ranks(raw)
                if whole is None:
                    left.append(piece)
                    raws.append(raw)
                    continue
                ids = pack("<I", whole)
            self[piece] = ids
        if left:
            self.update(zip(left, self.merge(raws), strict=True))

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of each; the pre-tokens lie side by side in one list."""
        raw = b"".join(raws)
        n, rank_of, queue = len(raw), self.ranks.get, self.queue
        ends = np.cumsum([len(r) for r in raws])
        starts = [0, *ends[:-1].tolist()]
        first = bytearray(n + 1)  # 1 where a pre-token starts
        for s in starts:
            first[s] = 1
        first[n] = 1
        codes = np.frombuffer(raw, np.uint8).astype(np.int64)
        ids = self.of_one[codes].tolist()
        ranks = self.of_two[codes[:-1] * 256 + codes[1:]]
        ranks[ends[:-1] - 1] = -1
        pair = [*ranks.tolist(), -1]  # rank of the pair that starts here; -1: none or dead
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        known, cuts = np.unique(ranks[order], return_index=True)
        for r, at in zip(known.tolist(), np.split(order, cuts[1:]), strict=False):
            queue.put(r, at.tolist())
        after = list(range(1, n + 1))  # where the next symbol starts
        before = list(range(-1, n))
        push, buckets = queue.push, queue.buckets
        while queue.top:
            rank, at = queue.pop()
            at.sort()
            for k, i in enumerate(at):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                after[i] = end = after[j]
                pair[j] = -1
                before[end] = i
                ids[i] = rank
                lowest = rank + 1
                r = -1 if first[end] else rank_of(raw[i:after[end]], -1)
                pair[i] = r
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        push(r, i)
                    lowest = r
                if not first[i]:
                    h = before[i]
                    r = rank_of(raw[h:end], -1)
                    if r != pair[h]:
                        pair[h] = r
                        if r >= 0:
                            if r in buckets:
                                buckets[r].append(h)
                            else:
                                push(r, h)
                            if r < lowest:
                                lowest = r
                if lowest <= rank:  # a new pair goes first: put the rest back
                    if k + 1 < len(at):
                        queue.put(rank, at[k + 1:] + buckets.get(rank, []))
                    break
        out = []
        for s, e in zip(starts, ends.tolist(), strict=True):
            found = []
            while s < e:
                found.append(ids[s])
                s = after[s]
            out.append(pack(f"<{len(found)}I", *found))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            pieces, size = [], 0
            while at < len(texts) and size < RUN_CHARS:
                pieces.append(self.find(texts[at]))
                size += len(texts[at])
                at += 1
            new = set().union(*pieces) - self.keys()
            self.learn(list(new))
            out += [b"".join(map(self.__getitem__, p)) for p in pieces]
            for piece in [x for x in new if len(x) > CACHED_CHARS]:
                self.pop(piece, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, entries: int = CACHE_ENTRIES) -> Encoder:
    return Encoder(load_ranks(path), pattern, entries)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (packed), decoded (bytes of the decoded ids)."""
    return _each(docs, path, pattern, text, key, lambda e, ids: (len(ids) // 4, ids, e.decode(ids)), {"n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()})


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def one(e: Encoder, ids: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

    return _each(docs, path, pattern, text, key, one, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id", entries: int = CACHE_ENTRIES) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (packed); a text that doesn't decode to itself fails the job.

    entries bounds each generation of the workers' caches, which live on after the stage.
    """
    if path is None or pattern is None:
        known = default_tokenizer()
        path, pattern = path or known[0], pattern or known[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern, entries)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_ROWS):
                part = batch.slice(at, RUN_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                packed = e.encode_all(texts)
                for t, ids in zip(texts, packed, strict=True):
                    if e.decode(ids) != t.encode("utf-8", "surrogatepass"):
                        raise ValueError("a text does not survive encoding and decoding")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in packed], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    source = docs.select(F.col(key).alias("doc_id"), F.col(text))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def _each(docs: DataFrame, path, pattern, text, key, one, fields: dict) -> DataFrame:
    if path is None or pattern is None:
        known = default_tokenizer()
        path, pattern = path or known[0], pattern or known[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_ROWS):
                part = batch.slice(at, RUN_ROWS)
                rows = [one(e, ids) for ids in e.encode_all([t or "" for t in part.column(1).to_pylist()])]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(fields.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *fields])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    source = docs.select(F.col(key).alias("doc_id"), F.col(text))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {kinds[v]}" for k, v in fields.items())
    return source.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    return digests(docs)
