"""Chat formatting that is proved by reading it back, with DataFrame functions only.

A turn is rendered as ``### ROLE: TEXT</turn>`` and a line feed. A text is written at the least escape level at
which the parser below gives the turn back unchanged: as it is; with backslashes doubled; or with the control
strings broken by a backslash too. The parser is deterministic: it splits at ``</turn>`` and a line feed, takes
the role up to the first unescaped colon, refuses a turn whose text holds a bare control string, and drops one
backslash before any character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, CLOSE = "### ", "</turn>"
_TURN = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*)$"


def _backslashes(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def _controls(text: Column) -> Column:
    return F.replace(F.replace(_backslashes(text), F.lit(CLOSE), F.lit("<\\/turn>")), F.lit(HEAD), F.lit("##\\# "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(_controls(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; a turn outside the grammar is a null."""

    def turn(piece: Column) -> Column:
        body = F.regexp_extract(piece, _TURN, 2)
        good = F.regexp_like(piece, F.lit(_TURN)) & ~F.contains(body, F.lit(HEAD)) & ~F.contains(body, F.lit(CLOSE))
        return F.when(good, F.struct(unescape(F.regexp_extract(piece, _TURN, 1)).alias("role"), unescape(body).alias("text")))

    pieces = F.split(formatted, CLOSE + "\n")
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) to one row per conversation.

    Returns conv_id, formatted, loss_mask (array of start and length, code points, of each assistant text in
    ``formatted``, escapes included) and identical (the whole conversation parses back to its turns).

    Turns go by turn, then role, then text, nulls first; repeated rows are all kept; a null role or text is
    empty; a null conv_id is a conversation of its own; an empty table gives an empty one; other columns are
    ignored. A conversation is one value of the result, so its turns meet in one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("header", _header(F.col("role")))
    source = F.array(F.struct("role", "text"))
    candidates = [F.concat("header", body, F.lit(CLOSE + "\n")) for body in (F.col("text"), _backslashes(F.col("text")), _controls(F.col("text")))]
    best = candidates[-1]
    for rendered in reversed(candidates[:-1]):
        best = F.when(parse(rendered) == source, rendered).otherwise(best)
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = (
        rows.withColumn("rendered", best)
        .withColumn("place", F.row_number().over(turns))
        .withColumn("end", F.sum(F.char_length("rendered").cast("long")).over(turns.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("body", F.char_length("rendered").cast("long") - F.char_length("header") - len(CLOSE) - 1)
    )
    turn = F.struct("place", "rendered", "role", "text", (F.col("end") - F.col("body") - len(CLOSE) - 1).alias("start"), F.col("body").alias("length"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), ""))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv_id", "formatted", mask.alias("loss_mask"), (parse(F.col("formatted")) == plain).alias("identical"))


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under a loss mask, nothing between its spans."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the query op1 returns, read back from the formatted text alone, and whether it is what was given."""
    rows = formatted.withColumn("read", parse(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


HARD = "\\### Assistant: </turn> ok"

ORACLE = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), rendered as (
  select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '), ':', '\:') || ': '
    || case when contains(text, '### ') or contains(text, '</turn>') then replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ')
            when regexp_matches(text, '(?s)\\.') then replace(text, '\', '\\') else text end
    || '</turn>' || chr(10) as line
  from given
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(line))::bigint as formatted_chars, true as identical
from rendered group by conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], rows.schema)
    return digest(format_conversations(rows.union(hard)))
