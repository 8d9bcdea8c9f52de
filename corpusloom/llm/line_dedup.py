"""Line dedup: a suffix array over line ids, by distributed prefix doubling.

The corpus is one sequence of line ids (equal lines, equal ids; lines are compared
by MD5) in the order of doc_id, with a separator after each document, and a
position in it is a suffix. Blank lines are not part of the sequence.

Prefix doubling. Level k groups the suffixes that share their next 2^k lines; a
group, an interval of the suffix array, is named by its smallest position. Level
k + 1 groups pairs (name of p, name of p + 2^k). Suffixes that no other shares are
sorted apart already and leave, so a level holds repeated runs only, and the
levels end with the longest of them.

Common prefixes. A copy is a suffix that has an earlier one in its group. The
longest prefix that it shares with any earlier suffix lies in [2^k, 2^(k+1)) for
its highest level k as a copy, and is found by descending: the members of a
context (suffixes that share their first l lines) are split by their next 2^d
lines; those that have an earlier member beside them move on to that narrower
context, and only the first of each part stays behind, since what the rest share
with other parts, the first shares too. An earlier first of a part goes along as
a witness.

Deletion. A maximal repeated run is deleted wherever an earlier copy of it exists;
``min_words`` leaves shorter runs alone.

Grouping aggregates before each shuffle (a smallest position and a count) and
groups are joined back by equi-joins, which adaptive execution splits where a line
is hot; no group is gathered. Each level is written to the shared folder.

Defined cases. Null text: stays null. Empty texts and blank lines stay. A document
that loses all its words is dropped (or kept empty, with drop_emptied=False).
Runs inside one document count as well. Rows equal in doc_id and text are one
document and cut alike. Null doc_id: ordered first. Empty table: empty result.
Very long texts and lines are taken whole; what is known of a document's runs is one
row, of its lines at most. All columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, fresh_name, sliced, without_space

MIN_WORDS = 1


def sequence(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, tkey, ln, id, p): lines in the corpus order; id null separates."""
    t = F.col(text)
    ids = F.transform(F.filter(F.split(t, "\n", -1), lambda x: without_space(x) != ""), lambda x: F.unhex(F.md5(x)))
    lines = docs.where(t.isNotNull()).select(
        F.col(key).alias("doc_id"), F.xxhash64(t).alias("tkey"), F.posexplode(F.concat(ids, F.array(F.lit(None).cast("binary")))).alias("ln", "id")
    )
    lines = lines.repartitionByRange("doc_id", "tkey").dropDuplicates(["doc_id", "tkey", "ln"])
    return lines.sortWithinPartitions("doc_id", "tkey", "ln").withColumn("p", F.monotonically_increasing_id())


def _named(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, str]:
    """(p, r): r the smallest position with the same keys; singletons leave.

    The groups are written first: a join of two plain tables is one that adaptive
    execution can split where a key is hot.
    """
    groups = rows.groupBy(*keys).agg(F.min("p").alias("_r"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups, groups_at = scratch.save(groups)
    found = scratch.save(rows.join(groups, keys).select("p", F.col("_r").alias("r")))
    scratch.drop(groups_at)
    return found


def suffix_levels(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Level k: (p, r) of the suffixes that share their next 2^k lines."""
    now, _ = _named(lines.where("id is not null").select("p", "id"), ["id"], scratch)
    levels = []
    while not now.isEmpty():
        levels.append(now)
        step = 1 << (len(levels) - 1)
        ahead = now.select((F.col("p") - step).alias("p"), F.col("r").alias("r2"))
        now, _ = _named(now.join(ahead, "p"), ["r", "r2"], scratch)
    return levels


def copied_prefixes(levels: list[DataFrame], scratch: Scratch) -> DataFrame | None:
    """(p, l): the most lines that suffix p shares with an earlier suffix."""
    if not levels:
        return None
    done, state, old = None, None, None
    for k in range(len(levels) - 1, -1, -1):
        active = levels[k].where("p <> r")
        if k + 1 < len(levels):
            active = active.join(levels[k + 1].where("p <> r"), "p", "left_anti")
        active = active.select("p", F.col("r").alias("ctx"), F.lit(1 << k).cast("long").alias("l"), F.lit(True).alias("active"))
        if k == 0:
            done = active.select("p", "l")
            break
        first = active.select(F.col("ctx").alias("p"), "ctx", "l", F.lit(False).alias("active")).distinct()
        fresh = active.unionByName(first)
        state = fresh if state is None else state.unionByName(fresh)
        d = k - 1
        nxt = levels[d].select(F.col("p").alias("_at"), F.col("r").alias("r2"))
        seen = state.join(nxt, F.col("p") + F.col("l") == F.col("_at"), "left").drop("_at")
        parts = seen.where("r2 is not null").groupBy("ctx", "l", "r2").agg(F.min("p").alias("m"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        parts, parts_at = scratch.save(parts)
        seen = seen.join(parts, ["ctx", "l", "r2"], "left")
        stay = F.struct("ctx", "l", "active")
        move = F.struct(F.col("m").alias("ctx"), (F.col("l") + (1 << d)).alias("l"), (F.col("p") != F.col("m")).alias("active"))
        out = F.when(F.col("m").isNull(), F.array(stay)).when(F.col("p") != F.col("m"), F.array(move)).otherwise(F.array(move, stay))
        state = seen.select("p", F.explode(out).alias("x")).select("p", "x.*")
        state, at = scratch.save(state)
        scratch.drop(parts_at)
        if old:
            scratch.drop(old)
        old = at
    return done if state is None else done.unionByName(state.where("active").select("p", "l"))


def cut(text: str | None, runs: list[tuple[int, int]], min_words: int) -> tuple[str | None, int, int, bool]:
    """Text without the runs (first line, lines), lines, lines removed, words left."""
    if text is None:
        return None, 0, 0, False
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    words = [len(x.split()) for x in lines]
    real = [i for i, w in enumerate(words) if w]
    total = [0]
    for i in real:
        total.append(total[-1] + words[i])
    gone, until = set(), 0
    for ln, n in sorted(runs):
        end = min(ln + n, len(real))
        if total[end] - total[ln] >= min_words:
            gone.update(real[max(ln, until):end])
            until = max(until, end)
    if gone:
        text = b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8", "surrogatepass")
    return text, len(real), len(gone), len(gone) < len(real)


def _with_runs(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs with one more column: the runs of its lines that have an earlier copy."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines, _ = scratch.save(sequence(docs, text, key))
    found = copied_prefixes(suffix_levels(lines, scratch), scratch)
    runs, same_id, same_text = (fresh_name(docs, f"_ld_{n}") for n in ("runs", "id", "text"))
    if found is None:
        return docs.withColumn(runs, F.lit(None).cast("array<struct<ln:int,l:bigint>>"))
    per = found.join(lines, "p").groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("ln", "l")).alias(runs))
    per = per.select(F.col("doc_id").alias(same_id), F.col("tkey").alias(same_text), runs)
    same = docs[key].eqNullSafe(per[same_id]) & (F.xxhash64(docs[text]) == per[same_text])
    return docs.join(per, same, "left").select(*docs.columns, runs)


def _runs(value) -> list[tuple[int, int]]:
    return [(x["ln"], x["l"]) for x in value.as_py() or ()]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with later copies of repeated runs deleted; columns as before."""
    marked = _with_runs(docs, text, key)
    at, runs_at, names = docs.columns.index(text), len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, keep = [], []
            for t, r in zip(batch.column(at), batch.column(runs_at), strict=True):
                runs = _runs(r)
                new, _, gone, left = cut(t.as_py(), runs, min_words) if runs else (t.as_py(), 0, 0, True)
                texts.append(new)
                keep.append(left or not gone or not drop_emptied)
            columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(runs_at)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return marked.mapInArrow(run, docs.schema)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 of what is left."""
    marked = _with_runs(docs.select("doc_id", "text"), "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [cut(t.as_py(), _runs(r), min_words) for t, r in zip(batch.column(1), batch.column(2), strict=True)]
            sha = [hashlib.sha256((r[0] or "").encode("utf-8", "surrogatepass")).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(sha)],
                ["doc_id", "n_lines", "n_removed", "text_sha256"],
            )

    return marked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_removed long, text_sha256 string")
