"""Chat formatting: turns -> text segments with loss flags, from a declarative template.

A finite-state machine over roles checks the order of turns. Formatting, reading
back and checking are built-in SQL functions; the one shuffle gathers a
conversation, which is one output cell and so one task's business by definition.

Defined cases: a null text or role is empty; turns are ordered by (turn, role,
text), so ties and repeated rows have one result and count as turns; roles the
template does not name are formatted under their own name without loss and end
the machine's good run; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``names``: role -> name in the mark; ``loss``: roles that are trained on; ``follows``: state -> roles allowed next."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    start: str = "###"
    end: str = "</turn>\n"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)

    def codes(self) -> list[tuple[str, str]]:
        """Strings a text must not hold as they are, and what stands for them; the backslash comes first."""
        return [("\\", "\\b"), (self.start, "\\h"), (self.end.strip(), "\\t")]

    def name_codes(self) -> list[tuple[str, str]]:
        return [*self.codes(), (":", "\\c"), ("\n", "\\n")]


DEFAULT = Template()
# what stands before the name of a role that the template does not know
OTHER = "role "


def escape(text: Column, codes: list[tuple[str, str]]) -> Column:
    """Every backslash of the result begins a code, so the codes can be undone one after the other."""
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]]) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _name(role: Column, t: Template) -> Column:
    out = F.concat(F.lit(OTHER), escape(role, t.name_codes()))
    for known, name in t.names.items():
        out = F.when(role == known, name).otherwise(out)
    return out


def _role(name: Column, t: Template) -> Column:
    out = unescape(F.substring(name, len(OTHER) + 1, 2**31 - 1), t.name_codes())
    for known, shown in t.names.items():
        out = F.when(name == shown, known).otherwise(out)
    return out


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turn rows -> one row per conversation with its ordered turns."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def first_fault(turns: Column, t: Template = DEFAULT) -> Column:
    """Index of the first turn that the machine rejects, the number of turns if it ends too early, null if all is well."""
    allowed = [f"{state}>{role}" for state, roles in t.follows.items() for role in roles]

    def step(acc: Column, x: Column) -> Column:
        bad = F.when(F.concat(acc["state"], F.lit(">"), x["role"]).isin(allowed), acc["bad"]).otherwise(F.coalesce(acc["bad"], acc["i"]))
        return F.struct(x["role"].alias("state"), (acc["i"] + 1).alias("i"), bad.alias("bad"))

    begin = F.struct(F.lit("").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, begin, step, lambda s: F.coalesce(s["bad"], F.when(~s["state"].isin(*t.final), s["i"])))


def segments(turns: Column, t: Template = DEFAULT) -> Column:
    """Three segments a turn, ``array<struct<text, loss>>``: mark, escaped text, end mark; only trained roles' texts bear loss."""
    def three(x: Column) -> Column:
        mark = F.concat(F.lit(f"{t.start} "), _name(x["role"], t), F.lit(":\n"))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(mark, F.lit(False)), piece(escape(x["text"], t.codes()), x["role"].isin(*t.loss)), piece(F.lit(t.end), F.lit(False))
        )

    return F.flatten(F.transform(turns, three))


def format_conversations(turns: DataFrame, t: Template = DEFAULT, key: str = "conv_id") -> DataFrame:
    """``(key, formatted, segments, valid, fault)``: the text, its segments with loss flags, and what the machine says."""
    cut = conversations(turns, key).select(key, segments(F.col("turns"), t).alias("segments"), first_fault(F.col("turns"), t).alias("fault"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return cut.select(key, formatted.alias("formatted"), "segments", F.col("fault").isNull().alias("valid"), "fault")


def read_turns(formatted: Column, t: Template = DEFAULT) -> Column:
    """The text -> its turns, ``array<struct<role, text>>``; undoes format_conversations()."""
    parts = F.split(formatted, re.escape(t.end), -1)
    head = len(t.start) + 2

    def read(part: Column) -> Column:
        at = F.locate(":\n", part)
        name = F.substring(part, F.lit(head), at - head)
        return F.struct(_role(name, t).alias("role"), unescape(F.substring(part, at + 2, F.length(part)), t.codes()).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), read)


def loss_text(segments: Column, t: Template = DEFAULT) -> Column:
    """All text under the loss flags, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t.codes())), "")


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold control strings."""
    hard = F.lit("\\### Assistant: </turn> ok")
    two = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"),
    )
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(two)


def digests(formatted: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = formatted.select("conv_id", "formatted", "valid", read_turns(F.col("formatted"), t).alias("turns"), loss_text(F.col("segments"), t).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_conversations(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), d AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS safe,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE 'role ' || replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n') END AS name,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) || '>' || role
      IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS good
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(name) + length(safe) + 14) AS BIGINT) AS formatted_chars,
  bool_and(good) AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM d GROUP BY conv_id
"""
