"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has a bit set if over half of its shingles' XXH64 values
have. Fingerprints within two bits of each other are linked; a document's
component is the set it reaches over links.

Lookup. The fingerprint is cut into two 32-bit segments, and each has a table from
its value to the fingerprints that hold it. Of two fingerprints that differ in two
bits at most, one segment differs in one bit at most, so each fingerprint asks each
table for the 33 values of its segment's Hamming ball of radius one; what it gets is
verified by the complete distance. Copies share a fingerprint and are collapsed
before; documents get their component by an equi-join on it.

Hot values. A value that more than ``HOT`` fingerprints hold isn't joined with its
askers, as that would be all pairs of a group. The fingerprints that hold or ask for
such a value are entered, both segments together, at the 65 keys that differ from
them in one bit at most. Any two of them within two bits meet at a key (one of the
bits is turned by each), and a key has at most 65 fingerprints, all within two bits
of each other, so links between neighbours in the key's order connect them.

Components: large-star and small-star rounds on the links, written to the shared
folder after each, until they no longer change.

Defined cases. Null, empty or blank text: fingerprint zero, linked like any
other. Fewer words than a shingle: one shingle of all words. Repeated rows: equal
fingerprints, a row each. Null doc_id: a row like any other; its component has the
smallest doc_id that isn't null, if there is one. Very long texts are taken whole, one
at a time. Empty table: empty result. Other columns are not read by the fingerprints;
``drop_near_copies`` returns all columns unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER, Scratch, fresh_name, sliced

SEED = 42
SEGMENTS = ((0, 32), (32, 64))
HOT = 64  # fingerprints of one segment value that are joined with its askers
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, words: int = 3, distinct: bool = False) -> int:
    """The 64-bit fingerprint as a signed number; distinct: each shingle once."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not tokens:
        return 0
    if distinct and words == 1:
        tokens = list(dict.fromkeys(tokens))
    if len(tokens) <= words:
        values = np.array([digest(b" ".join(tokens), SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
        values = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)), dtype=np.uint64, count=len(starts)
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 65536):
        part = values[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, distinct: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [fingerprint(t.as_py(), words, distinct) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    source = docs.select(F.col(key).alias("doc_id"), F.col(text))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def segment_values(fp: str = "fp") -> Column:
    """Table keys: (segment, value) in one number for each segment."""
    return F.array(*[_segment(F.col(fp), i) for i in range(len(SEGMENTS))])


def segment_balls(fp: str = "fp") -> Column:
    """The keys asked for: each segment's value and those a bit away, 33 a segment."""
    keys = []
    for i, (a, z) in enumerate(SEGMENTS):
        own = _segment(F.col(fp), i)
        keys += [own, *[own.bitwiseXOR(F.lit(1 << b)) for b in range(z - a)]]
    return F.array(*keys)


def _segment(fp: Column, i: int) -> Column:
    a, z = SEGMENTS[i]
    return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1)) + F.lit(i << (z - a))


def whole_ball(fp: str = "fp") -> Column:
    """The 65 fingerprints that differ in one bit at most."""
    return F.array(F.col(fp), *[F.col(fp).bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])


def hot_links(fps: DataFrame, distance: int) -> DataFrame:
    """(u, v) that connect all of fps within two bits, whatever segments they share."""
    table = fps.select(F.explode(whole_ball()).alias("at"), "fp")
    before = F.lag("fp").over(Window.partitionBy("at").orderBy("fp"))
    pairs = table.select(F.col("fp").alias("v"), before.alias("u")).where("u is not null")
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")


def links(distinct: DataFrame, scratch: Scratch, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(u, v) over fingerprints; connects all within two bits of each other."""
    table = distinct.select(F.explode(segment_values()).alias("at"), "fp")
    asked = distinct.select(F.explode(segment_balls()).alias("at"), F.col("fp").alias("asker"))
    crowded, _ = scratch.save(table.groupBy("at").count().where(F.col("count") > hot).select("at"))
    near = (F.col("asker") < F.col("fp")) & (F.bit_count(F.col("asker").bitwiseXOR(F.col("fp"))) <= distance)
    if crowded.isEmpty():
        found = asked.join(table, "at").where(near).select(F.col("asker").alias("u"), F.col("fp").alias("v"))
    else:
        found = asked.join(table.join(crowded, "at", "left_anti"), "at").where(near).select(F.col("asker").alias("u"), F.col("fp").alias("v"))
        touched, _ = scratch.save(asked.join(crowded, "at", "left_semi").select(F.col("asker").alias("fp")).distinct())
        found = found.union(hot_links(touched, distance))
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), u > v: each linked node with the smallest node of its component.

    Smallest neighbours are written before they are joined back, as a join of two
    plain tables is one that adaptive execution can split at a hub.
    """
    now, at = scratch.save(edges)
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, one = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, mid = scratch.save(large)
        least, two = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small, end = scratch.save(small)
        sign = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for path in (at, one, mid, two):
            scratch.drop(path)
        now, at = small, end
        if sign == seen:
            return now
        seen = sign


def near_components(docs: DataFrame, words: int = 3, distance: int = 2, distinct: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) per row; distance is 2 at most."""
    if not 0 <= distance <= 2:
        raise ValueError("balls of radius one reach a distance of two")
    scratch = Scratch(docs.sparkSession, "simhash")
    marked, _ = scratch.save(fingerprints(docs, words, distinct, text, key))
    unique, _ = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(unique, scratch, distance), scratch)
    rooted = unique.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# Near-duplicates by similarity: linked fingerprints propose first, prefixes of the shingle sets
# propose what fingerprints can't reach, the sets decide.

FREQUENT = 200_000  # shingles ordered last; which ones are never changes the result
FREQUENT_SAMPLE, FREQUENT_LEAST = 16, 3
STAR_ROUNDS = 4
STAR_SHARE = 0.25  # of the shorter prefix, for a comparison ahead of the last round
STAR_GAIN = 0.2  # links a comparison that the next star round is worth
BROADCAST_IDS = 1_000_000
_MARKS = 1 << 22


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_hashes(tokens: list[bytes], words: int, known: _WordHashes | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted; all words are one if there are fewer."""
    known = _WordHashes() if known is None else known
    hashes = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    k = min(words, len(tokens))
    found = np.zeros(max(1, len(tokens) - words + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            found = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + len(found)]
        found = (found ^ (found >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        found = (found ^ (found >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(found ^ (found >> np.uint64(31))).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """An Arrow array of whole numbers per row, without Python numbers between."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)))


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()


def _sets(texts, words: int) -> list[np.ndarray]:
    known = _WordHashes()
    return [shingle_hashes(_tokens(t.as_py()), words, known) for t in texts]


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_sets(batch.column(1), words))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shingles array<bigint>")


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that one document in sixteen shows to be common, sorted, with their counts."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(FREQUENT_SAMPLE)) == 0)
    counts = shingle_sets(some, words).select(F.explode("shingles").alias("at")).groupBy("at").count()
    found = counts.where(F.col("count") >= FREQUENT_LEAST).orderBy(F.desc("count"), "at").limit(FREQUENT).toArrow()
    at, n = (found.column(c).to_numpy() for c in ("at", "count"))
    order = np.argsort(at)
    return at[order], n[order]


def marks_of(common: np.ndarray) -> np.ndarray:
    """Which low bits the common shingles have: a quick no for nearly all others."""
    marks = np.zeros(_MARKS, dtype=bool)
    marks[common & (_MARKS - 1)] = True
    return marks


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float, marks: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 shingles, common ones ordered last.

    The order, by count and then by hash, is the same for all documents, so two sets of
    the similarity share one.
    """
    length = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    if not len(common):
        return shingles[:length]
    maybe = np.flatnonzero((marks_of(common) if marks is None else marks)[shingles & (_MARKS - 1)])
    at = np.minimum(np.searchsorted(common, shingles[maybe]), len(common) - 1)
    known = common[at] == shingles[maybe]
    last, rank = maybe[known], counts[at[known]]
    rare = np.ones(len(shingles), dtype=bool)
    rare[last] = False
    first = shingles[rare][:length]
    if len(first) == length:
        return first
    return np.concatenate([first, shingles[last[np.lexsort((last, rank))]][:length - len(first)]])


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, fp, sig, n, prefix): sig tells sets apart by 128 bits, n is a set's size."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common, counts = shared.value
        marks = marks_of(common)
        for batch in sliced(batches):
            sets = _sets(batch.column(1), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()), _lists([prefix(s, common, counts, similarity, marks) for s in sets]),
                ],
                ["doc_id", "fp", "sig", "n", "prefix"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, sig binary, n int, prefix array<bigint>")


def fingerprint_pairs(marked: DataFrame, scratch: Scratch, distance: int = 2) -> DataFrame:
    """(a, b) that connect all documents of (doc_id, fp) whose fingerprints are linked.

    Each document is paired with the first of its fingerprint, and the first documents of
    linked fingerprints with each other.
    """
    unique, _ = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked, _ = scratch.save(links(unique, scratch, distance))
    one, two = (unique.select(F.col("fp").alias(c), F.col("first").alias(d)) for c, d in (("u", "a"), ("v", "b")))
    across = linked.join(one, "u").join(two, "v").select("a", "b")
    within = marked.join(unique, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_pairs(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have the Jaccard similarity."""
    one = shingles.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = shingles.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    jaccard = both / (F.size("x") + F.size("y") - both)
    return pairs.join(one, "a").join(two, "b").where(jaccard >= similarity).select("a", "b").distinct()


def _in_components(table: DataFrame, root: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The rows of table with their component c, at keys where several meet; written."""
    named = table.join(root.select(F.col("u").alias("doc_id"), "v"), "doc_id", "left").withColumn("c", F.coalesce("v", "doc_id")).drop("v")
    mixed, at = scratch.save(named.groupBy("at").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("at"))
    rows, rows_at = scratch.save(named.join(mixed, "at", "left_semi"))
    scratch.drop(at)
    return rows, rows_at


def star_pairs(rows: DataFrame, turn: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): each document with that first document of its keys that is met most often."""
    order = F.xxhash64(F.lit(turn), "doc_id")
    first = rows.groupBy("at").agg(F.min(F.struct(order.alias("h"), F.col("doc_id").alias("f"), F.col("c").alias("fc"), F.col("n").alias("fn"), F.col("p").alias("fp"))).alias("x"))
    first, _ = scratch.save(first.select("at", "x.f", "x.fc", "x.fn", "x.fp"))
    met = rows.join(first, "at").where("c <> fc").where(F.least("n", "fn") >= similarity * F.greatest("n", "fn") - 1e-9)
    often = met.groupBy("doc_id", "f", "p", "fp").count().where(F.col("count") >= STAR_SHARE * F.least("p", "fp"))
    best = often.groupBy("doc_id").agg(F.max(F.struct("count", "f")).alias("x"))
    return best.select(F.least("doc_id", "x.f").alias("a"), F.greatest("doc_id", "x.f").alias("b")).distinct()


def open_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all pairs of different components that can have the similarity.

    Of sets with an overlap of o, at least o - n + len(prefix) common shingles lie in both
    prefixes, by the set whose prefix ends first; pairs that share fewer are left out.
    """
    one = rows.select("at", F.col("doc_id").alias("a"), F.col("n").alias("x"), F.col("p").alias("p"), F.col("c").alias("k"))
    two = rows.select("at", F.col("doc_id").alias("b"), F.col("n").alias("y"), F.col("p").alias("q"), F.col("c").alias("l"))
    fits = F.least("x", "y") >= similarity * F.greatest("x", "y") - 1e-9
    met = one.join(two, "at").where((F.col("a") < F.col("b")) & (F.col("k") != F.col("l")) & fits)
    least = F.ceil(similarity / (1 + similarity) * (F.col("x") + F.col("y")) - 1e-9)
    shared = F.least(least - F.col("x") + F.col("p"), least - F.col("y") + F.col("q"))
    return met.groupBy("a", "b", "x", "y", "p", "q").count().where(F.col("count") >= shared).select("a", "b").distinct()


def similar_components(docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, component_id) of documents whose component has a smaller doc_id.

    doc_ids are distinct and not null. Pairs of five-word-shingle similarity 0.8 or more are
    linked. Equal sets are collapsed. Then multi-index hashing proposes: documents whose
    fingerprints are linked are compared by their sets. Fingerprints don't reach all pairs of the
    similarity, but all share a shingle of their prefixes: star rounds compare each document with
    one that shares its keys, which joins large groups with few comparisons; at last every pair
    that shares a key and still lies in different components is decided, so none is missed.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked, marked_at = scratch.save(prefixes(source, words, similarity))
    copied = marked.groupBy("sig").agg(F.min("doc_id").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copied, copied_at = scratch.save(copied)
    same, same_at = scratch.save(marked.select("doc_id", "sig").join(copied, "sig").where("doc_id <> a").select(F.col("doc_id").alias("u"), F.col("a").alias("v")))
    kept = marked.join(same.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
    printed, _ = scratch.save(kept.select("doc_id", "fp"))
    table = kept.select("doc_id", "n", F.size("prefix").alias("p"), F.explode("prefix").alias("at"))
    several, several_at = scratch.save(table.groupBy("at").count().where("count > 1").select("at"))
    table, _ = scratch.save(table.join(several, "at", "left_semi"))
    for path in (marked_at, copied_at, several_at):
        scratch.drop(path)

    def decided(pairs: DataFrame) -> tuple[DataFrame, int]:
        """(u, v) of the similar ones of pairs, and how many pairs were compared; only their texts are read."""
        pairs, pairs_at = scratch.save(pairs)
        ids, ids_at = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("_sh_id")).distinct())
        few = ids.count() <= BROADCAST_IDS
        texts = source.join(F.broadcast(ids) if few else ids, source["doc_id"] == ids["_sh_id"]).select("doc_id", "text")
        shingles, shingles_at = scratch.save(shingle_sets(texts, words))
        found, _ = scratch.save(similar_pairs(pairs, shingles, similarity).select(F.col("b").alias("u"), F.col("a").alias("v")))
        n = pairs.count()
        for path in (pairs_at, ids_at, shingles_at):
            scratch.drop(path)
        return found, n

    more, _ = decided(fingerprint_pairs(printed, scratch))
    root = components(same.union(more), scratch)
    scratch.drop(same_at)
    for turn in range(STAR_ROUNDS):
        rows, at = _in_components(table, root, scratch)
        more, compared = decided(star_pairs(rows, turn, similarity, scratch))
        scratch.drop(at)
        joined = more.count()
        if joined:
            root = components(root.unionByName(more), scratch)
        if joined <= STAR_GAIN * compared:
            break
    rows, _ = _in_components(table, root, scratch)
    more, _ = decided(open_pairs(rows, similarity))
    done = components(root.unionByName(more), scratch)
    return done.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id.

    Each row is a document, whatever its id. Where ids repeat or are null, rows are first
    written with a number in the order of id (null last) and text, which stands for the id;
    of copies with one id the first in that order stays. Columns pass through as they are.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    ids = docs.groupBy(F.col(key).alias("k")).count()
    row, rows = key, docs
    if not ids.where("k is null or count > 1").isEmpty():
        row = fresh_name(docs, "row")
        order = [F.asc_nulls_last(key), F.asc_nulls_first(text)]
        rows, _ = scratch.save(docs.orderBy(*order).withColumn(row, F.monotonically_increasing_id()))
    found = similar_components(rows, similarity, words, text, row, scratch)
    gone = found.select(F.col("doc_id").alias(fresh_name(docs, "gone")))
    return rows.join(gone, rows[row] == gone[gone.columns[0]], "left_anti").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    found = near_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
