"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over the whole text and every rule a
(measure, bound, threshold) row; ``rule_projection`` turns the table into the
columns of a single select, without user functions and without a shuffle.

Defined cases. Null or empty text: no words, so it fails for length. Very long
texts are measured whole; repeated rows are judged alike; an empty table gives
an empty result; other columns are not read.

``n_repeat_words`` compares three-word windows by a 64-bit hash chained over
their words, within one text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import words_of, without_space

# Frequent function words of the four languages, in lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "be", "it", "on",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "pour",
    "der", "die", "das", "den", "und", "zu", "von", "mit", "ist", "ein", "eine", "nicht",
    "el", "los", "las", "del", "se", "por", "con", "una", "no", "es", "en",
)
SYMBOLS = "#*$%&|<>"
BULLETS = r"^[\x20\x09]*[-*•]"


@dataclass(frozen=True)
class Rule:
    """The row fails where measure lies beyond the threshold."""

    name: str
    measure: str
    bound: str  # "min" or "max"
    threshold: float


#: measure names are columns of ``measures``; a text without words fails base.
RULES = (
    Rule("too_long", "n_words", "max", 1_000_000.0),
    Rule("short_words", "mean_word_chars", "min", 2.0),
    Rule("long_words", "mean_word_chars", "max", 15.0),
    Rule("symbols", "symbols_per_word", "max", 0.1),
    Rule("few_stop_words", "stop_word_ratio", "min", 0.005),
    Rule("repeated_lines", "dup_line_ratio", "max", 0.5),
    Rule("bullet_lines", "bullet_line_ratio", "max", 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", "max", 0.3),
)


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key with the counts and ratios that rules refer to.

    Only texts with a repeated three-word window are sorted for n_repeat_words:
    where all windows differ, their distinct count shows it. In the sorted list a
    window is repeated if it equals a neighbour; the words covered are summed
    from the gaps between such positions.
    """
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_w", words_of(F.col("_t")))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    spans = F.when(
        F.size("_h") >= 3,
        F.transform(
            F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get(F.col("_h"), i + 1), F.get(F.col("_h"), i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_g", spans)
    ordered = F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ordered))
    twice = F.filter(
        F.transform(
            "_s",
            lambda x, k: F.when(
                (x["g"] == F.get(F.col("_s"), k - 1)["g"]) | (x["g"] == F.get(F.col("_s"), k + 1)["g"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    d = d.withColumn("_p", F.array_sort(twice))
    covered = F.aggregate(
        F.transform("_p", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), k + 1) - i, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: without_space(x) != ""))
    count = lambda c: c.cast("long")
    d = d.withColumns({
        "n_words": count(F.size("_w")),
        "word_chars": count(F.length(without_space(F.col("_t")))),
        "n_symbols": count(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))),
        "n_lines": count(F.size("_l")),
        "n_dup_lines": count(F.size("_l") - F.size(F.array_distinct("_l"))),
        "n_stop_words": count(F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS)))),
        "n_bullet_lines": count(F.size(F.filter("_l", lambda x: x.rlike(BULLETS)))),
        "n_ellipsis_lines": count(F.size(F.filter("_l", lambda x: x.endswith("...") | x.endswith("…")))),
    })
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.withColumns({
        "mean_word_chars": part("word_chars", "n_words"),
        "symbols_per_word": part("n_symbols", "n_words"),
        "stop_word_ratio": part("n_stop_words", "n_words"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "bullet_line_ratio": part("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": part("n_ellipsis_lines", "n_lines"),
    }).drop("_t", "_w", "_h", "_g", "_s", "_p", "_l")


def rule_projection(rules=RULES) -> dict[str, Column]:
    """One boolean column per rule, true where it fails."""
    fails = {}
    for r in rules:
        value = F.col(r.measure)
        fails[f"fails_{r.name}"] = value < r.threshold if r.bound == "min" else value > r.threshold
    return fails


def judge(docs: DataFrame, rules=RULES, min_words: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the measures, base_failed, each rule's outcome and kept."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fails = rule_projection(rules)
    judged = measures(docs, text, key).withColumns({"base_failed": base, **fails})
    verdict = ~F.col("base_failed")
    for name in fails:
        verdict = verdict & ~F.col(name)
    return judged.withColumn("kept", verdict)


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), g3 AS (
  SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS k FROM g
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g3
), cov AS (
  SELECT rid, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS r
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM c WHERE n > 1) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.r, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w.w, lambda x: x IN (@STOP@)))::BIGINT AS n_stop,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]')))::BIGINT AS n_bullet,
         len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…'))::BIGINT AS n_ell
  FROM w LEFT JOIN cov USING (rid)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 1000000 AND word_chars / n_words >= 2 AND word_chars / n_words <= 15
       AND n_symbols / n_words <= 0.1::DOUBLE AND n_stop / n_words >= 0.005::DOUBLE
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_bullet / greatest(n_lines, 1) <= 0.9::DOUBLE AND n_ell / greatest(n_lines, 1) <= 0.3::DOUBLE AS kept
FROM j
""".replace("@STOP@", ", ".join(f"'{w}'" for w in STOP_WORDS))
