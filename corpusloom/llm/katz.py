"""Language-model scoring: a Katz backoff bigram model.

Model. Counts are Good-Turing discounted (the log-linear form of Gale and Sampson:
n_r ~ r^b, so r* = r (1 + 1/r)^(b+1), a discount at every r) and

    p(w)     = r*(w) / N, the rest being the mass of one class that all unknown words are;
    p(w | h) = r*(hw) / c(h)       if the pair was seen (min_count times or more),
               alpha(h) p(w)       else,

with alpha(h) = (1 - sum of p(w|h)) / (1 - sum of p(w)) over the kept pairs of h,
so that every history's distribution over the words and the unknown class sums to one. A text is its words and an end,
read from a start that is only ever a history.

Tables. Words and pairs are keyed by 64-bit hashes and dealt to buckets by key, so a
frequent word or history never gathers in one task. Texts are packed into blocks of
about ``BLOCK_CHARS``; a block sends each bucket the distinct keys it holds, with
their training counts (aggregated before the shuffle), and gets a total for each key
back in the same order, so keys travel once; a block and a bucket without a key in
common exchange nothing, so messages are never more than keys. In the same way the blocks exchange the
sums behind alpha: each kept pair is summed once, by the block that the bucket names
its owner. Then each block evaluates its texts token by token: pair, else backoff
weight and word, else unknown. Counts, exchanges and evaluation cover every row and
whole texts; nothing is broadcast but the fitted constants.

Defined cases. Null or empty text: the end only. No training row: N = V = 0, and both
scores are 0. Repeated rows count and are scored each. Null doc_id: trains. Very long
texts make a block of their own. Empty table: empty result. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import io
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER, Scratch

BLOCK_CHARS = 5_000_000
BUCKET_TOKENS = 1_000_000
MIN_COUNT = 1  # pairs seen less often are left to backoff
HELD_OUT, HELD_OUT_IS = 7, 2
LEAST_BUCKETS = 32

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_END, _START = b"\n<end>", b"\n<start>"  # no word holds a line feed


def key_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29)))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Block:
    """Distinct words and pairs of some texts, and the tokens in terms of them.

    Words and pairs are in the order of their keys; ``word`` and ``pair`` give each
    token's, ``history`` each pair's first word (the last entry is the start).
    """

    def __init__(self, texts: list[str | None], train: np.ndarray):
        ids: dict[bytes, int] = defaultdict(count().__next__)
        end = ids[_END]
        parts, lengths = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
            parts.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words)))
            parts.append(np.array([end], dtype=np.int32))
            lengths.append(len(words) + 1)
        raw = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        keys = np.fromiter(map(key_of, ids), dtype=np.uint64, count=len(ids))
        order = np.argsort(keys)
        place = np.empty(len(ids), dtype=np.int32)
        place[order] = np.arange(len(ids))
        self.keys = keys[order]
        self.word = place[raw]
        self.lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        start = len(ids)
        before = np.empty_like(self.word)
        if len(before):
            before[1:] = self.word[:-1]
            before[self.starts] = start
        codes, pair = np.unique(before.astype(np.int64) * (start + 1) + self.word, return_inverse=True)
        del raw, before
        history, second = codes // (start + 1), codes % (start + 1)
        all_keys = np.append(self.keys, np.uint64(key_of(_START)))
        made = pair_keys(all_keys[history], all_keys[second])
        order = np.argsort(made)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair_keys, self.history, self.second, self.pair = made[order], history[order], second[order], place[pair.ravel()]
        self.history_keys = all_keys
        of_token = np.repeat(np.asarray(train, dtype=float), self.lengths)
        self.word_counts = np.bincount(self.word, weights=of_token, minlength=len(self.keys)).astype(np.uint32)
        self.pair_counts = np.bincount(self.pair, weights=of_token, minlength=len(self.pair_keys)).astype(np.uint32)


def small(values: np.ndarray) -> bytes:
    """Whole numbers in one byte each, those of 255 or more listed behind."""
    big = np.flatnonzero(values >= 255)
    return np.uint32(len(big)).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + big.astype("<u4").tobytes() + values[big].astype("<u8").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    k = int(np.frombuffer(data, "<u4", 1)[0])
    values = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    values[np.frombuffer(data, "<u4", k, 4 + n)] = np.frombuffer(data, "<u8", k, 4 + n + 4 * k)
    return values


def dealt(keys: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Bucket to the indices of its keys, in order of the keys; only of buckets that get some."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:]), strict=False))


def pack(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue()


def unpack(data) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer() if hasattr(data, "as_buffer") else data).read_all()


def block_of(data) -> tuple[pa.Table, Block]:
    pa.default_memory_pool().release_unused()
    table = unpack(data)
    return table, Block(table.column("text").to_pylist(), np.array(table.column("train").to_pylist(), dtype=bool))


class Discounts:
    """The fitted constants: totals, slopes of the Good-Turing lines, unknown mass."""

    def __init__(self, texts: int, types: int, word_n: dict[int, int], pair_n: dict[int, int]):
        self.texts, self.types = texts, types
        self.tokens = sum(r * n for r, n in word_n.items())
        self.word_slope, self.pair_slope = slope(word_n), slope(pair_n)
        r, n = (np.array(list(x), dtype=float) for x in (word_n.keys(), word_n.values()))
        self.unknown = 1.0 - float((discounted(r, self.word_slope) * n).sum()) / max(self.tokens, 1)

    def word_share(self, c: np.ndarray) -> np.ndarray:
        return discounted(c, self.word_slope) / max(self.tokens, 1)


def slope(counts: dict[int, int]) -> float:
    """b of n_r ~ r^b from averaged counts of counts; always below -1."""
    r = np.array(sorted(x for x in counts if x > 0), dtype=np.int64)
    if len(r) < 2:
        return -1.5
    n = np.array([counts[x] for x in r.tolist()], dtype=float)
    q = np.concatenate(([0], r[:-1]))
    t = np.concatenate((r[1:], [2 * r[-1] - q[-1]]))
    x, y = np.log(r), np.log(n / (0.5 * (t - q)))
    b = float(np.cov(x, y, bias=True)[0, 1] / np.var(x))
    return min(b, -1.05)


def discounted(c: np.ndarray, b: float) -> np.ndarray:
    """r* of each count; 0 of 0."""
    c = np.asarray(c, dtype=float)
    safe = np.maximum(c, 1.0)
    return np.where(c > 0, safe * (1.0 + 1.0 / safe) ** (b + 1.0), 0.0)


def trains(key):
    return F.coalesce(F.crc32(key.cast("string")) % HELD_OUT != HELD_OUT_IS, F.lit(True))


def _packed(docs: DataFrame, text: str, key: str, block_chars: int) -> DataFrame:
    """(block, docs): whole texts packed with their ids and training marks."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), trains(F.col(key)).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 24, 0
        held, size = [], 0

        def flush():
            nonlocal n, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([pack(whole)], pa.binary())], ["block", "docs"])
            n, held, size = n + 1, [], 0
            return out

        for batch in batches:
            at = 0
            sizes = [len(t) if t else 0 for t in batch.column(1).to_pylist()]
            for i, s in enumerate(sizes):
                size += s
                if size >= block_chars:
                    held.append(batch.slice(at, i + 1 - at))
                    at = i + 1
                    yield flush()
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield flush()

    return rows.mapInArrow(run, "block long, docs binary")


def _asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, counts...) of what each block holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = block_of(data)[1]
                words, pairs = dealt(b.keys, buckets), dealt(b.pair_keys, buckets)
                sent, none = sorted(words.keys() | pairs.keys()), np.zeros(0, np.int64)
                words, pairs = ([x.get(k, none) for k in sent] for x in (words, pairs))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sent, pa.int32()), pa.array([block] * len(sent), pa.int64()),
                        pa.array([b.keys[w].tobytes() for w in words], pa.binary()), pa.array([small(b.word_counts[w]) for w in words], pa.binary()),
                        pa.array([b.pair_keys[p].tobytes() for p in pairs], pa.binary()), pa.array([small(b.pair_counts[p]) for p in pairs], pa.binary()),
                    ],
                    ["bucket", "block", "words", "word_counts", "pairs", "pair_counts"],
                )

    return blocks.mapInArrow(run, "bucket int, block long, words binary, word_counts binary, pairs binary, pair_counts binary")


def _sum(table: pa.Table, keys: str, counts: str) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Totals per row's keys, the distinct totals, and what each row owns."""
    each = [np.frombuffer(k.as_buffer(), "<u8") for k in table.column(keys)]
    own = [large(c.as_py(), len(k)) for k, c in zip(each, table.column(counts), strict=True)]
    flat, n = np.concatenate(each), np.concatenate(own)
    _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    totals = np.bincount(inverse, weights=n, minlength=len(first)).astype(np.int64)
    mine = np.zeros(len(flat), dtype=bool)
    mine[first] = True
    cuts = np.cumsum([len(k) for k in each])[:-1]
    return np.split(totals[inverse], cuts), totals, np.split(mine, cuts)


def counts_of(totals: np.ndarray) -> bytes:
    """Counts of counts as (count, how many) pairs."""
    return np.stack(np.unique(totals[totals > 0], return_counts=True), axis=1).astype("<i8").tobytes()


def _told(asked: DataFrame, min_count: int) -> DataFrame:
    """(block, bucket, words, pairs, owned): totals in the order asked; block -1: histograms."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()), ("owned", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block").combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        words, word_totals, _ = _sum(table, "words", "word_counts")
        pairs, pair_totals, mine = _sum(table, "pairs", "pair_counts")
        rows = {"block": table.column("block").to_pylist() + [-1], "bucket": [bucket] * (table.num_rows + 1)}
        keep = [np.where(p >= min_count, p, 0) for p in pairs]
        rows["words"] = [small(w) for w in words] + [counts_of(word_totals)]
        rows["pairs"] = [small(p) for p in keep] + [counts_of(pair_totals)]
        rows["owned"] = [np.packbits(m).tobytes() for m in mine] + [b""]
        return pa.table(rows, schema=schema)

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, words binary, pairs binary, owned binary")


def _constants(told: DataFrame, texts: int) -> Discounts:
    """From the buckets' counts of counts, summed before the driver reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for pair in (False, True):
                    r = np.frombuffer(batch.column(int(pair))[i].as_buffer(), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array([pair] * len(r), pa.bool_()), pa.array(r[:, 0], pa.int64()), pa.array(r[:, 1], pa.int64())], ["pair", "r", "n"])

    rows = told.where("block = -1").select("words", "pairs").mapInArrow(run, "pair boolean, r long, n long")
    word_n, pair_n = {}, {}
    for row in rows.groupBy("pair", "r").agg(F.sum("n").alias("n")).toLocalIterator():
        (pair_n if row.pair else word_n)[row.r] = row.n
    types = sum(word_n.values())
    return Discounts(texts, types, word_n, pair_n)


def log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def _evaluated(blocks: DataFrame, told: DataFrame, fit: Discounts, buckets: int) -> DataFrame:
    """Rows of two kinds: a block's remainder, and its sums for alpha by bucket."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary()), ("rest", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py()
        table, b = block_of(left.column("docs")[0])
        words, pairs, owned = np.zeros(len(b.keys), np.int64), np.zeros(len(b.pair_keys), np.int64), np.zeros(len(b.pair_keys), bool)
        at_word, at_pair, none = dealt(b.keys, buckets), dealt(b.pair_keys, buckets), np.zeros(0, np.int64)
        for k, w, p, m in zip(right.column("bucket").to_pylist(), right.column("words"), right.column("pairs"), right.column("owned"), strict=True):
            i, j = at_word.get(k, none), at_pair.get(k, none)
            words[i], pairs[j] = large(w.as_py(), len(i)), large(p.as_py(), len(j))
            owned[j] = np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(j)).astype(bool)
        p_word = np.where(words > 0, fit.word_share(words), fit.unknown)
        history_counts = np.append(words, fit.texts)
        kept = pairs > 0
        p_pair = np.zeros(len(pairs))
        p_pair[kept] = discounted(pairs[kept], fit.pair_slope) / history_counts[b.history[kept]]
        token_known = kept[b.pair]
        value = np.where(token_known, log10(p_pair[b.pair]), log10(p_word[b.word]))
        base = log10((words[b.word] + 1.0) / (fit.tokens + fit.types + 1.0))
        add = lambda x: np.add.reduceat(x, b.starts) if len(b.starts) else np.zeros(0)
        back = ~token_known
        asked, index = np.unique(b.history[b.pair[back]], return_inverse=True)
        mine = kept & owned
        summed = np.zeros((len(b.history_keys), 2))
        np.add.at(summed, b.history[mine], np.stack([p_pair[mine], p_word[b.second[mine]]], axis=1))
        sent = np.union1d(asked, np.flatnonzero(summed[:, 0]))
        sent = sent[np.argsort(b.history_keys[sent])]
        place = np.empty(len(b.history_keys), dtype=np.int64)
        place[sent] = np.arange(len(sent))
        rest = pa.RecordBatch.from_arrays(
            [
                table.column("doc_id").combine_chunks(), table.column("train").combine_chunks(), pa.array(b.lengths), pa.array(add((words[b.word] > 0).astype(np.int64))),
                pa.array(add(base)), pa.array(add(value)), pa.array(add(back.astype(np.int64))),
            ],
            ["doc_id", "train", "n_tokens", "n_known", "base", "value", "backs"],
        )
        wanted = place[asked][index.ravel()].astype("<u4")
        keys = b.history_keys[sent]
        parts = dealt(keys, buckets)
        rows = {
            "block": [block] * (len(parts) + 1), "bucket": [*parts, -1],
            "keys": [keys[i].tobytes() for i in parts.values()] + [keys.tobytes()],
            "sums": [summed[sent[i]].astype("<f8").tobytes() if summed[sent[i]].any() else b"" for i in parts.values()] + [wanted.tobytes()],
            "rest": [b""] * len(parts) + [pack(rest)],
        }
        return pa.table(rows, schema=schema)

    return blocks.groupBy("block").cogroup(told.where("block >= 0").groupBy("block")).applyInArrow(run, "block long, bucket int, keys binary, sums binary, rest binary")


def _alphas(sums: DataFrame) -> DataFrame:
    """(block, bucket, alphas): log10 of the backoff weights in the order asked."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("alphas", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block").combine_chunks()
        each = [np.frombuffer(k.as_buffer(), "<u8") for k in table.column("keys")]
        own = [np.frombuffer(s.as_buffer(), "<f8").reshape(-1, 2) if len(s.as_buffer()) else np.zeros((len(k), 2)) for k, s in zip(each, table.column("sums"), strict=True)]
        flat = np.concatenate(each)
        keys, inverse = np.unique(flat, return_inverse=True)
        add = np.concatenate(own)
        pair, word = (np.bincount(inverse, weights=add[:, i], minlength=len(keys)) for i in (0, 1))
        alpha = np.where(pair > 0, log10((1.0 - pair) / np.maximum(1.0 - word, 1e-12)), 0.0)
        parts = np.split(alpha[inverse], np.cumsum([len(k) for k in each])[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "alphas": [p.astype("<f8").tobytes() for p in parts]}, schema=schema)

    return sums.groupBy("bucket").applyInArrow(run, "block long, bucket int, alphas binary")


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS, bucket_tokens: int = BUCKET_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(docs.sparkSession, "katz")
    kind = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.length(text)), F.count_if(trains(F.col(key)))).first()
    buckets = max(LEAST_BUCKETS, math.ceil((total[0] or 0) / 6 / bucket_tokens))
    blocks, blocks_at = scratch.save(_packed(docs, text, key, block_chars))
    told, told_at = scratch.save(_told(_asked(blocks, buckets), min_count))
    fit = _constants(told, total[1])
    parts, _ = scratch.save(_evaluated(blocks, told, fit, buckets))
    scratch.drop(blocks_at)
    scratch.drop(told_at)
    alphas = _alphas(parts.where("bucket >= 0"))
    tokens = fit.tokens

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rest = unpack(left.column("rest")[0])
        keys = np.frombuffer(left.column("keys")[0].as_buffer(), "<u8")
        wanted = np.frombuffer(left.column("sums")[0].as_buffer(), "<u4")
        alpha, at = np.zeros(len(keys)), dealt(keys, buckets)
        for k, a in zip(right.column("bucket").to_pylist(), right.column("alphas"), strict=True):
            alpha[at[k]] = np.frombuffer(a.as_buffer(), "<f8")
        backs = rest.column("backs").to_numpy()
        more = np.bincount(np.repeat(np.arange(len(backs)), backs), weights=alpha[wanted], minlength=len(backs))
        n = rest.num_rows
        return pa.table({
            "doc_id": rest.column("doc_id"), "held_out": pa.array(~rest.column("train").to_numpy(zero_copy_only=False)),
            "n_tokens": rest.column("n_tokens"), "n_known": rest.column("n_known"), "train_tokens": pa.array([tokens] * n, pa.int64()),
            "base_score": rest.column("base"), "score": pa.array(rest.column("value").to_numpy() + more),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.where("bucket = -1").groupBy("block").cogroup(alphas.groupBy("block")).applyInArrow(run, schema)


def report(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return score(docs, min_count=min_count)
