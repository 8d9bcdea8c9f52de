"""Chat formatting whose round trip is proven on every turn.

Grammar of the formatted text of one conversation, turns in order::

    turn  := "<s>[INST] " role "[/INST]" mark text "</s>"
    mark  := " "   text and role as they are, without any control string
           | "~"   "~", "<" and "[" in text and role written "~0", "~1", "~2"

The parser is deterministic: it cuts at ``</s>``, takes the role up to the first
``[/INST]``, reads one mark and undoes the escapes that it names. Each turn is
first rendered plain and reparsed; where the result isn't exactly the turn (a
text holds a control string) it is rendered escaped, which leaves no ``<``
or ``[`` and so no control string inside, and compared once more. A turn that
still differed would fail the job.

The loss mask covers the assistant texts. It is kept as runs, one per turn:
``skip`` characters without loss, ``take`` with loss, ``tail`` without; laid end
to end they tile the formatted text.

A conversation becomes one row, so its turns meet in one task: rendering is done
before that, and only (turn, rendered text) is shuffled.

Defined cases. Null text or role: empty. Turns are ordered by turn, then role and
text (nulls first); repeated rows all appear. Null conv_id is a conversation of
its own. Very long texts are rendered whole; a conversation must fit in a task. Empty
table: empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN, CLOSE, END = "<s>[INST] ", "[/INST]", "</s>"
PLAIN, ESCAPED = " ", "~"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        role, text = escape(role), escape(text)
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), F.lit(ESCAPED if escaped else PLAIN), text, F.lit(END))


def parse_turn(body: Column) -> Column:
    """body: a turn without END. Struct of role, text, and where the text starts."""
    head = F.substring_index(body, CLOSE, 1)
    role = F.substr(head, F.lit(len(OPEN) + 1))
    start = F.length(head) + len(CLOSE) + 1
    mark = F.substr(body, start, F.lit(1))
    text = F.substr(body, start + 1)
    coded = mark == ESCAPED
    return F.struct(
        F.when(coded, unescape(role)).otherwise(role).alias("role"),
        F.when(coded, unescape(text)).otherwise(text).alias("text"),
        start.alias("start"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_runs (skip, take, tail), escaped_turns."""
    t = turns.select("conv_id", "turn", F.col("role").alias("_r"), F.col("text").alias("_x"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def same(rendered: Column, inside: Column) -> Column:
        pieces = F.split(rendered, END, -1)
        back = parse_turn(F.get(pieces, F.lit(0)))
        free = F.lit(True)
        for control in CONTROL:
            free = free & ~F.contains(inside, F.lit(control))
        return free & (F.size(pieces) == 2) & F.startswith(rendered, F.lit(OPEN)) & (back["role"] == F.col("role")) & (back["text"] == F.col("text"))

    t = t.withColumn("_plain", render(F.col("role"), F.col("text"), False))
    said = F.concat(F.col("role"), F.lit("\n"), F.col("text"))
    t = t.withColumn("_ok", same(F.col("_plain"), said))
    t = t.withColumn("_out", F.when(F.col("_ok"), F.col("_plain")).otherwise(render(F.col("role"), F.col("text"), True)))
    t = t.withColumn("_out", F.when(F.col("_ok") | same(F.col("_out"), escape(said)), F.col("_out")).otherwise(F.raise_error(F.lit("a turn does not survive its round trip"))))
    rows = t.groupBy("conv_id").agg(
        F.collect_list(F.struct("turn", "_r", "_out", (F.col("role") == loss_role).alias("loss"), (~F.col("_ok")).cast("int").alias("esc"))).alias("_turns")
    )

    def placed(x: Column) -> Column:
        """Ties are ordered by the text as it was, not as it is rendered."""
        said = parse_turn(F.get(F.split(x["_out"], END), F.lit(0)))["text"]
        return F.struct(x["turn"], x["_r"], said.alias("said"), x["_out"].alias("_out"), x["loss"].alias("loss"), x["esc"].alias("esc"))

    rows = rows.withColumn("_turns", F.array_sort(F.transform("_turns", placed)))

    def run(x: Column) -> Column:
        whole = F.length(x["_out"])
        head = F.length(F.substring_index(x["_out"], CLOSE, 1)) + len(CLOSE) + 1
        return F.when(x["loss"], F.struct(head.alias("skip"), (whole - head - len(END)).alias("take"), F.lit(len(END)).alias("tail"))).otherwise(
            F.struct(whole.alias("skip"), F.lit(0).alias("take"), F.lit(0).alias("tail")))

    return rows.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda x: x["_out"]), "").alias("formatted"),
        F.transform("_turns", run).alias("loss_runs"),
        F.aggregate("_turns", F.lit(0), lambda a, x: a + x["esc"]).alias("escaped_turns"),
    )


def read_loss(formatted: Column, runs: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    pieces = F.slice(F.split(formatted, END, -1), F.lit(1), F.size(runs))
    texts = F.zip_with(pieces, runs, lambda p, r: F.when(
        r["take"] > 0,
        F.when(F.substr(p, r["skip"], F.lit(1)) == ESCAPED, unescape(F.substr(p, r["skip"] + 1, r["take"]))).otherwise(F.substr(p, r["skip"] + 1, r["take"])),
    ).otherwise(F.lit("")))
    return F.array_join(texts, "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss mask give back."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    f = formatted.withColumn("_t", turns).withColumn("_loss", read_loss(F.col("formatted"), F.col("loss_runs")))
    return f.select(
        "conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """conversations and one more, of control strings only."""
    hard = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    return read_back(format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role AS r0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_matches(role || chr(10) || text, '<s>|</s>|\[INST\]|\[/INST\]') AS esc FROM t
), f AS (
  SELECT *, 10 + 7 + 1 + 4 + length(role) + length(text)
    + CASE WHEN esc THEN length(regexp_replace(role || text, '[^~<\[]', '', 'g')) ELSE 0 END AS chars FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r0 NULLS FIRST, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
