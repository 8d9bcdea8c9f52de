"""Vectors: norms, cosine, and the hashed bag-of-words embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

HASHED_DIMENSIONS = 1024
#: Similarities of a matrix product that are held at once, and how far they may be off.
CELLS, SLACK = 1 << 21, 1e-9


def _dot(a: Column, b: Column) -> Column:
    """Over the shorter length; missing entries count as zero."""
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), zero)), zero, lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def l2_normalise(v: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / n))).otherwise(0.0)


class Block:
    """The vectors of an Arrow column as numbers, a dimension a row; missing entries are zero."""

    def __init__(self, column: pa.ChunkedArray, width: int):
        lists = column.combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, rows = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.values, self.given = np.zeros((width, len(sizes))), np.zeros((width, len(sizes)), dtype=bool)
        self.values[at, rows] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        self.given[at, rows] = flat.is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(sum((v * v for v in self.values), np.zeros(len(sizes))))
            self.plain = (self.norm >= 1e-100) & (self.norm <= 1e100)
            self.unit = np.where(self.plain, self.values / self.norm, 0.0)
        self.odd = ~self.plain & (self.norm != 0)  # not a number, or beyond what a product of units tells

    def first_copies(self, k: int) -> np.ndarray:
        """Places of the first k of each set of equal vectors."""
        rows = np.ascontiguousarray(np.hstack([np.ascontiguousarray(self.values.T).view(np.uint8), self.given.T.view(np.uint8)]))
        if not rows.shape[1]:
            return np.arange(min(k, len(rows)))
        which = np.unique(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        order = np.argsort(which, kind="stable")
        return np.sort(order[_places(which[order]) < k])


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group; groups lie together."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def cosines(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """``cosine`` of a's vectors at i and b's at j, to the last bit: summed in the same order."""
    total, some = np.zeros(len(i)), a.odd[i].any() or b.odd[j].any()
    with np.errstate(all="ignore"):
        for d in range(len(a.values)):
            part = a.values[d, i] * b.values[d, j]
            if some:
                part[~(a.given[d, i] & b.given[d, j])] = 0.0
            total += part
        n = a.norm[i] * b.norm[j]
        found = total / n
    found[np.isnan(found)] = 1.0  # as for Spark and SQL NaN is the largest number
    return np.where((n > 0) | np.isnan(n), np.clip(found, -1.0, 1.0), 0.0)


def nearest(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(query_id, path, similarity): the k vectors most similar to each query, if positive.

    vectors: (path, vector); queries: (query_id, vector). Ties go by path. A matrix product
    proposes all that can be among the k; ``cosines`` decides.
    """
    vectors = vectors.take(pc.sort_indices(vectors["path"], null_placement="at_start"))
    width = max((pc.max(pc.list_value_length(t["vector"])).as_py() or 0 for t in (vectors, queries)), default=0)
    x, q = Block(vectors["vector"], width), Block(queries["vector"], width)
    kept = x.first_copies(k)
    if len(kept) < len(vectors):
        vectors = vectors.take(pa.array(kept))
        x = Block(vectors["vector"], width)
    m, n = len(queries), len(vectors)
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, CELLS // max(n, 1))
    for at in range(0, m if n and k > 0 else 0, step):
        near, mine = q.unit[:, at:at + step].T @ x.unit, slice(at, at + step)
        least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(near))
        asked = near >= np.maximum(least, 0.0)[:, None] - SLACK
        asked &= x.plain & q.plain[mine, None]
        asked |= x.odd | q.odd[mine, None]
        i, j = np.nonzero(asked)
        found = cosines(x, j, q, at + i)
        i, j, found = i[found > 0], j[found > 0], found[found > 0]
        order = np.lexsort((j, -found, i))
        order = order[_places(i[order]) < k]
        got.append((at + i[order], j[order], found[order]))
    i, j, found = (np.concatenate(c) for c in zip(*got, strict=True))
    return pa.table({"query_id": queries["query_id"].take(pa.array(i)), "path": vectors["path"].take(pa.array(j)), "similarity": pa.array(found)})


def hash_vector(text: str, dimensions: int = HASHED_DIMENSIONS) -> list[float]:
    """Word counts at BLAKE2b-hashed places, of unit length."""
    out = np.zeros(dimensions)
    for word in re.findall("[a-z0-9]+", (text or "").lower()):
        out[int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") % dimensions] += 1.0
    n = float(np.linalg.norm(out))
    return (out / n if n else out).tolist()


def hashed_embedding(dimensions: int = HASHED_DIMENSIONS):
    """An Arrow-batched function of a text column; Spark has no BLAKE2b of its own."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: hash_vector(t, dimensions))

    return embed
