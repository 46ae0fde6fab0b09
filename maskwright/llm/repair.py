"""Repair of conversations: the cheapest edits that make the turns alternate.

Turns are aligned to the strings of the grammar ``(s?(ua)+)?``. The strings of
one kind are suffixes of each other, so one Wagner-Fischer table over the
remaining turns and the remaining target symbols holds every feasible length; only
the Ukkonen band is filled that the cost of a first, greedy repair (the incumbent)
allows: half of it turns ahead of the target, a fifth of it symbols ahead of the
turns. Among all lengths of least cost the audits are traced together, letter by
letter, and the ASCII-least one stays.

Two exact short cuts. A blank or repeated turn must go, so it is left out of the
table and its D put back as early as possible. A run of ``SURE`` or more clean alternating
turns is kept in its middle by every cheapest repair (being out of step costs one
a turn, getting back in step at most two at either end), so the conversation is cut
there, before a user turn, and each piece is aligned alone. Of a long piece
only every so many rows of the table are kept, and the others filled again when
the trace comes by.

In Spark: texts are dealt by conversation once to number the rows and find
repeats; then flags alone are dealt and streamed in order, a conversation's flags
taking some bytes a turn; then texts meet their audit, again as a sorted stream,
so that no task holds the texts of a conversation. A conversation is one audit,
one cell, and so one task's business; nothing is collected on the driver.

Defined cases: rows of a conversation are ordered by turn (null first), then
role, then text, so that ties and repeated rows have one result; a null conversation id is
a conversation; roles count by their first letter, an empty role has none and
cannot be kept; a conversation of which nothing is left has an empty audit; an
empty table gives an empty result; very long texts pass as they are; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from maskwright.sources.sinks import as_table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: turns a clean run must have to be cut, and how far from its ends
SURE, MARGIN = 14, 6
BLANKS = " \t\n\x0b\x0c\r"
BIG = 1 << 29
# cells of a table kept whole
CELLS = 1 << 22
_RUN = re.compile(r"u?(?:au){5,}a?")


def _incumbent(key: str, opening: bool, empty: bool) -> int:
    """The cost of a quick repair: the better one of deleting what is out of step and of giving it the role that is due."""
    best = DELETE * len(key) + (0 if empty else 2 * INSERT)
    for rerole in (False, True):
        cost, due, kept = 0, "u", 0
        for c in key:
            if c == due or (c == "s" and opening and not kept):
                due = "a" if c == "u" else "u"
                kept += 1
            elif c.isupper() or not rerole:
                cost += DELETE
            else:
                cost += REROLE
                due = "a" if due == "u" else "u"
                kept += 1
        cost += INSERT if due == "a" else 0
        # a system turn alone is no conversation
        if kept > 1 or (kept == 1 and due == "a"):
            best = min(best, cost)
    return best


def align(key: str, opening: bool = True, empty: bool = True) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns ``s``, ``u``, ``a`` or other, in capitals if truncated.

    ``opening``: the target may begin with a system turn; ``empty``: it may be empty.
    """
    n, most = len(key), _incumbent(key, opening, empty)
    lo, hi = most // DELETE, most // INSERT
    width = lo + hi + 1
    d = np.arange(width, dtype=np.int64)
    slope = INSERT * d
    roles, extra = key.lower(), [TRUNCATED if c.isupper() else 0 for c in key]

    def left(i: int) -> np.ndarray:
        """Target symbols still to come at each place of the band, before turn i."""
        return n - i + d - lo

    def above(row: np.ndarray, i: int) -> np.ndarray:
        """Costs from turn i on, from those from turn i + 1 on."""
        j = left(i)
        best = np.append(row[1:], BIG) + DELETE
        off = (j % 2 == 0) if roles[i] != "u" else (j % 2 == 1)
        if roles[i] not in "ua":
            off = np.ones(width, bool)
        step = row + extra[i] + REROLE * off
        best = np.where(j > 0, np.minimum(best, step), best)
        best = np.where(j < 0, BIG, best)
        return np.minimum(np.minimum.accumulate(best - slope) + slope, BIG)

    at_end = left(n)
    row = np.where(at_end >= 0, INSERT * at_end, BIG)
    every = 1 if n * width <= CELLS else isqrt(n) + 1
    kept = {n: row}
    # costs from turn i on if a system turn is still to be kept first
    system, after = [BIG] * (n + 1), [BIG] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = left(i + 1)
        if opening and roles[i] == "s":
            after[i] = int(row[(j >= 2) & (j % 2 == 0)].min(initial=BIG))
        system[i] = min(DELETE + system[i + 1], extra[i] + after[i], BIG)
        row = above(row, i)
        if i % every == 0:
            kept[i] = row

    block: dict[int, np.ndarray] = {}

    def at(i: int) -> np.ndarray:
        if i in kept:
            return kept[i]
        if i not in block:
            block.clear()
            top = min(n, (i // every + 1) * every)
            again = kept[top]
            for k in range(top - 1, i - 1, -1):
                block[k] = again = above(again, k)
        return block[i]

    j = left(0)
    ends = (j % 2 == 0) & (j >= (0 if empty else 2))
    cost = min(int(row[ends].min(initial=BIG)), system[0])
    states = set(np.flatnonzero(ends & (row == cost)).tolist())
    waiting, i, audit = system[0] == cost, 0, []
    while i < n or any(n - i + s - lo for s in states):
        here, below = at(i), at(i + 1) if i < n else None
        moves: dict[str, set[int]] = {"D": set(), "I": set(), "K": set(), "R": set()}
        for s in states:
            rest, value = n - i + s - lo, int(here[s])
            if rest > 0 and s and here[s - 1] + INSERT == value:
                moves["I"].add(s - 1)
            if below is None:
                continue
            if s + 1 < width and below[s + 1] + DELETE == value:
                moves["D"].add(s + 1)
            if rest > 0:
                fits = roles[i] == ("u" if rest % 2 == 0 else "a")
                if below[s] + extra[i] + (0 if fits else REROLE) == value:
                    moves["K" if fits else "R"].add(s)
        waits = waiting and i < n and system[i] == DELETE + system[i + 1]
        if waiting and i < n and after[i] < BIG and system[i] == extra[i] + after[i]:
            j = left(i + 1)
            moves["K"] |= set(np.flatnonzero((j >= 2) & (j % 2 == 0) & (below == after[i])).tolist())
        letter = "D" if moves["D"] or waits else next(c for c in "IKR" if moves[c])
        states, waiting = moves[letter], waits and letter == "D"
        audit.append(letter)
        i += letter != "I"
    return cost, "".join(audit)


_short = lru_cache(1 << 16)(align)


def pieces(key: str) -> list[str]:
    """The turns cut inside long clean runs, which are pieces of their own."""
    cuts = [0]
    for m in _RUN.finditer(key):
        if m.end() - m.start() >= SURE:
            first = m.start() + MARGIN + (key[m.start() + MARGIN] != "u")
            last = m.end() - MARGIN - (key[m.end() - MARGIN] != "u")
            cuts += [first, last] if last > first else [first]
    return [key[a:b] for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True)]


def repair(key: str, gone: np.ndarray) -> tuple[int, str]:
    """Cost and audit of a conversation: the turns not ``gone`` as in align(), and which turns must be deleted."""
    parts = pieces(key)
    cost, letters = DELETE * int(gone.sum()), []
    for k, part in enumerate(parts):
        if k and _RUN.fullmatch(part) and len(part) % 2 == 0:
            letters.append("K" * len(part))
            continue
        c, audit = (_short if len(part) <= 64 else align)(part, k == 0, len(parts) == 1)
        cost += c
        letters.append(audit)
    if not gone.any():
        return cost, "".join(letters)
    steps = iter(re.findall(r"I*[DKR]|I+$", "".join(letters)))
    out = ["D" if g else next(steps) for g in gone.tolist()]
    return cost, "".join([*out, *steps])


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation (``place``, from 1) and first ``fault``: blank, duplicate, truncated or null.

    Input: conv_id, turn, role, text, and ``dropped`` for rows that only say that the conversation exists.
    """
    dealt = turns.select("conv_id", "turn", "role", "text", "dropped").repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy("dropped", F.col("turn").asc_nulls_first(), "role", "text", "_case")
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", "blank").when(F.col("_case") > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return dealt.withColumn("_case", F.row_number().over(same)).withColumn("place", F.row_number().over(order)).withColumn("fault", fault).drop("_case")


AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_NAMES = [c.split()[0] for c in AUDIT.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, int, int, pa.RecordBatch]]:
    """Stretches of equal values of the first column in sorted batches: value, whether it is a new one, start, end, batch."""
    none = object()
    before = none
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        start = 0
        for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            yield value, before is none or value != before, start, end, b
            before, start = value, end


def _batched(items: Iterator[tuple], size: Callable[[tuple], int], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of up to 4,096 rows, or of about 4 MB."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    out, total = [], 0
    for item in items:
        out.append(item)
        total += size(item)
        if len(out) >= 4096 or total >= 1 << 22:
            yield batch()
            out, total = [], 0
    if out:
        yield batch()


def _kind(rows: DataFrame) -> tuple[str, pa.DataType]:
    """The type of conv_id, for Spark and for Arrow."""
    return dict(rows.dtypes)["conv_id"], to_arrow_type(rows.schema["conv_id"].dataType)


def _decided(parts: list[tuple[np.ndarray, ...]]) -> tuple:
    turn, known, live, role, fault = (np.concatenate(c) for c in zip(*parts, strict=True))
    turn, role, fault = turn[known & live], role[live], fault[live]
    gaps = int(turn.max()) - int(turn.min()) + 1 - len(np.unique(turn)) if len(turn) else 0
    pair = role[:-1] * 4 + role[1:]
    gone = (fault == 1) | (fault == 2)
    letters = np.frombuffer(b"xuasXUAS", np.uint8)[role + 4 * (fault == 3)]
    cost, audit = repair(letters[~gone].tobytes().decode(), gone)
    legal = [1 * 4 + 2, 2 * 4 + 1, 3 * 4 + 1]
    # a number of gaps beyond a long is null
    return gaps if gaps < 1 << 63 else None, *(int((fault == f).sum()) for f in (1, 2, 3)), int((~np.isin(pair, legal)).sum()), cost, audit


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of numbered(): counts of faults, cost, and ``audit`` (K keep, R rerole, D delete, I insert)."""
    key, kind = _kind(rows)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "u", 1).when(initial == "a", 2).when(initial == "s", 3).otherwise(0)
    fault = F.when(F.col("fault") == "blank", 1).when(F.col("fault") == "duplicate", 2).when(F.col("fault") == "truncated", 3).otherwise(0)
    slim = rows.select(
        "conv_id",
        "place",
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().alias("known"),
        (~F.col("dropped")).alias("live"),
        code.alias("role"),
        fault.alias("fault"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            conv, parts, last = None, [], None
            for value, fresh, start, end, b in _runs(batches):
                if b is not last:
                    last, columns = b, [b.column(c).to_numpy(zero_copy_only=False) for c in range(2, 7)]
                if fresh and parts:
                    yield conv, *_decided(parts)
                    parts = []
                conv = value
                parts.append(tuple(c[start:end] for c in columns))
            if parts:
                yield conv, *_decided(parts)

        yield from _batched(found(), lambda r: len(r[-1]), ["conv_id", *_NAMES], [kind] + [pa.int64()] * 6 + [pa.string()])

    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, f"conv_id {key}, {AUDIT}")


@dataclass
class _Trace:
    """Goes along an audit turn by turn."""

    audit: str
    at: int = 0
    place: int = 0
    opened: bool = False

    def _out(self, letter: str, role: str | None, text: str) -> tuple:
        self.place += 1
        if self.place == 1:
            self.opened = letter == "K" and role[:1] == "s"
        due = "user" if (self.place - self.opened) % 2 else "assistant"
        return self.place, letter, role if letter == "K" else due, text

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out("I", None, "")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._out(letter, role, text)
        yield from self.inserted()


REPAIRED = "place bigint, edit string, role string, text string"


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 1), edit (K, R or I), role, text.

    A conversation's turns lie in one partition, one after the other.
    """
    key, kind = _kind(rows)
    none = F.lit(None).cast("string")
    head = decided.select("conv_id", F.lit(0).alias("place"), F.col("audit"), none.alias("role"), none.alias("text"))
    body = rows.filter("not dropped").select("conv_id", "place", none.alias("audit"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            trace = _Trace("")
            for conv, _, start, end, b in _runs(batches):
                part = b.slice(start, end - start).to_pydict()
                for place, audit, role, text in zip(part["place"], part["audit"], part["role"], part["text"], strict=True):
                    if place == 0:
                        trace = _Trace(audit)
                    for out in trace.turn(role, text) if place else trace.inserted():
                        yield conv, *out

        yield from _batched(found(), lambda r: len(r[4]), ["conv_id", "place", "edit", "role", "text"], [kind, pa.int64(), *[pa.string()] * 3])

    dealt = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, f"conv_id {key}, {REPAIRED}")


def digests(turns: DataFrame) -> DataFrame:
    """For each conversation of repaired() the SHA-256 of its ``role:text`` lines, a newline between."""
    key, kind = _kind(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            conv, digest = None, None
            for value, fresh, start, end, b in _runs(batches):
                if fresh:
                    if digest:
                        yield conv, digest.hexdigest()
                    conv, digest, between = value, hashlib.sha256(), b""
                part = b.slice(start, end - start)
                for role, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    digest.update(between + role.encode() + b":")
                    digest.update(text.encode())
                    between = b"\n"
            if digest:
                yield conv, digest.hexdigest()

        yield from _batched(found(), lambda r: 64, ["conv_id", "sha256"], [kind, pa.string()])

    return turns.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {key}, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with the faults that repair is tried on: by a hash of conversation and turn, some go, some are changed."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20).alias("fate"),
    )
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    once = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), "fate")
    return once.withColumn("_copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "fate")


def mended(turns: DataFrame) -> DataFrame:
    """Audits, and the digests of what the audits make of the turns; input as numbered()."""
    rows = as_table(numbered(turns), "turns")
    decided = as_table(audits(rows), "audits")
    found = digests(repaired(rows, decided)).withColumnRenamed("conv_id", "_id")
    joined = decided.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("conv_id", *_NAMES, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mended(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_SQL = r"""
with recursive bits as (
  select list_transform(range(256), lambda n: list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
fate as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(
        string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as f
  from conversations, bits),
damaged as (
  select conv_id, turn, case when f = 4 then 'user' else role end as role,
    case when f = 1 then '' when f = 2 then translate(text, '.!?', '') else text end as text
  from fate, lateral (select unnest(range(case when f = 3 then 2 else 1 end)) as copy) where f <> 0),
ids as (select conv_id, row_number() over (order by conv_id nulls first) as k from (select distinct conv_id from conversations)),
placed as (
  select k, d.*, row_number() over (partition by k order by turn nulls first, role, text) as i,
    regexp_replace(text, '[ 	-]+$', '') as body
  from damaged d join ids on d.conv_id is not distinct from ids.conv_id),
judged as (
  select k, i, turn, role, text, substr(role, 1, 1) as r,
    case when body = '' then 'blank' when row_number() over (partition by k, role, text order by i) > 1 then 'duplicate'
      when substr(body, length(body)) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from placed),
-- the cheapest way to each state, as nine digits of cost and an audit: nothing yet, user due after assistant, assistant due, user due after system
ways as (
  select k, 0::bigint as i, '000000000' as w, null::varchar as u, null::varchar as a, null::varchar as s from ids
  union all
  select x.k, j.i,
    lpad((substr(w, 1, 9)::int + 2)::varchar, 9, '0') || substr(w, 10) || 'D',
    least(lpad((substr(u, 1, 9)::int + 2)::varchar, 9, '0') || substr(u, 10) || 'D',
      case when fault not in ('blank', 'duplicate') then
        lpad((substr(a, 1, 9)::int + (fault = 'truncated')::int * 5 + (r <> 'a')::int)::varchar, 9, '0') || substr(a, 10) || case when r = 'a' then 'K' else 'R' end end),
    least(lpad((substr(a, 1, 9)::int + 2)::varchar, 9, '0') || substr(a, 10) || 'D',
      case when fault not in ('blank', 'duplicate') then
        lpad((substr(least(w, u, s), 1, 9)::int + (fault = 'truncated')::int * 5 + (r <> 'u')::int)::varchar, 9, '0')
          || substr(least(w, u, s), 10) || case when r = 'u' then 'K' else 'R' end end),
    least(lpad((substr(s, 1, 9)::int + 2)::varchar, 9, '0') || substr(s, 10) || 'D',
      case when fault not in ('blank', 'duplicate') and r = 's' then
        lpad((substr(w, 1, 9)::int + (fault = 'truncated')::int * 5)::varchar, 9, '0') || substr(w, 10) || 'K' end)
  from (
    select k, i, w, s, a, least(u, lpad((substr(a, 1, 9)::int + 5)::varchar, 9, '0') || substr(a, 10) || 'I') as u
    from (select k, i, w, s, u, least(a, lpad((substr(least(w, u, s), 1, 9)::int + 5)::varchar, 9, '0') || substr(least(w, u, s), 10) || 'I') as a from ways)) x
  join judged j on j.k = x.k and j.i = x.i + 1),
last as (
  select k, least(w, u, lpad((substr(least(a, ai), 1, 9)::int + 5)::varchar, 9, '0') || substr(least(a, ai), 10) || 'I') as best
  from (select *, lpad((substr(least(w, u, s), 1, 9)::int + 5)::varchar, 9, '0') || substr(least(w, u, s), 10) || 'I' as ai
    from ways qualify row_number() over (partition by k order by i desc) = 1)),
chosen as (select k, substr(best, 1, 9)::bigint as cost, substr(best, 10) as audit from last),
letters as (
  select k, p, substr(audit, p::int, 1) as e,
    length(replace(substr(audit, 1, p::int), 'I', '')) as i, length(replace(substr(audit, 1, p::int), 'D', '')) as o
  from chosen, lateral (select unnest(range(1, length(audit) + 1)) as p)),
steps as (
  select l.*, j.role, j.text, max(case when o = 1 and e = 'K' and r = 's' then 1 else 0 end) over (partition by l.k) as opened
  from letters l left join judged j on j.k = l.k and j.i = l.i and e <> 'I' where e <> 'D'),
lines as (
  select k, string_agg(case when e = 'K' then role when (o - opened) % 2 = 1 then 'user' else 'assistant' end
    || ':' || case when e = 'I' then '' else text end, chr(10) order by p) as all_lines from steps group by k),
counts as (
  select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before || r not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(r) over (partition by k order by i) as before from judged) group by k)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, cost, audit, sha256(coalesce(all_lines, '')) as repaired_sha256
from ids join chosen using (k) left join lines using (k) left join counts using (k)
"""
