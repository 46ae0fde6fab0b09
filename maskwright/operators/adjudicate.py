"""Adjudication: candidate spans -> final spans, inside the row.

Each step is linear or n log n in the spans of one document and keeps no
growing accumulator, so documents with very many spans stay cheap:

* overlap groups compare the i-th smallest end with the i-th start: a span that
  starts where all earlier spans have ended opens a group,
* winners are array_max() over the ranks of a group's slice,
* merges depend on neighbouring pairs only, so merged runs are slices as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.operators.detect import no_spans
from maskwright.sources import fixed_values as fixed


def ordered(spans: Column) -> Column:
    """Spans by start, longest first, then insertion order."""
    return F.sort_array(spans)


def _heads(items: Column, opens) -> Column:
    """1-based positions of the items that open a run; ``opens(item, i)``."""
    flags = F.transform(items, lambda x, i: F.when(opens(x, i), i + 1))
    return F.filter(flags, lambda p: p.isNotNull())


def _runs(items: Column, heads: Column) -> Column:
    """Slices of ``items`` from each head up to the next."""
    return F.transform(
        heads, lambda h, j: F.slice(items, h, F.coalesce(tx.item(heads, j + 1), F.size(items) + 1) - h)
    )


def overlap_groups(sorted_spans: Column) -> Column:
    """Transitive overlap groups of ordered() spans; touching spans do not overlap."""
    ends = F.sort_array(F.transform(sorted_spans, lambda s: s["end"]))
    return tx.let(
        ends,
        lambda e: tx.let(
            _heads(sorted_spans, lambda s, i: (i == 0) | (tx.before(e, i) <= s["start"])),
            lambda heads: _runs(sorted_spans, heads),
        ),
    )


def winners(groups: Column) -> Column:
    """One span per group: most specific, then longest, then first."""
    def best(group: Column) -> Column:
        ranked = F.transform(
            group, lambda s, i: F.struct(s["specificity"], s["end"] - s["start"], F.negative(i), s.alias("span"))
        )
        return F.array_max(ranked)["span"]

    return F.transform(groups, best)


def group_winners(sorted_spans: Column) -> Column:
    """winners(overlap_groups()) of ordered() spans: groups are compared by their ranks, so only the winners are copied."""
    ends = F.sort_array(F.transform(sorted_spans, lambda s: s["end"]))
    ranks = F.transform(sorted_spans, lambda s, i: F.struct(s["specificity"], s["end"] - s["start"], F.negative(i).alias("at")))

    def chosen(heads: Column, rank: Column) -> Column:
        def best(h: Column, j: Column) -> Column:
            n = F.coalesce(tx.item(heads, j + 1), F.size(rank) + 1) - h
            return F.when(n == 1, h).otherwise(1 - F.array_max(F.slice(rank, h, n))["at"])

        return F.transform(heads, lambda h, j: F.element_at(sorted_spans, best(h, j)))

    return tx.let(
        ends,
        lambda e: tx.let(
            _heads(sorted_spans, lambda s, i: (i == 0) | (tx.before(e, i) <= s["start"])),
            lambda heads: tx.let(ranks, lambda rank: chosen(heads, rank)),
        ),
    )


def drop_false_positives(spans: Column) -> Column:
    """Drop spans whose text is never an entity of their label."""
    def known(s: Column) -> Column:
        value = tx.strip(F.lower(s["text"]))
        tests = [(F.upper(s["label"]) == lab) & value.isin(texts) for lab, texts in fixed.FALSE_POSITIVES.items()]
        return reduce(lambda a, b: a | b, tests)

    return F.filter(spans, lambda s: ~known(s))


def _person_gap(gap: Column) -> Column:
    """Only spaces, dots, apostrophes and hyphens; or a short lower-case word."""
    word = tx.strip(gap)
    # all letters, at least one lower-case, none upper or title case
    joins = word.rlike(r"^(?=\p{L}*\p{IsLowercase})[\p{L}&&[^\p{IsUppercase}\p{Lt}]]+\z")
    return gap.rlike(tx.java_regex(fixed.PERSON_GAP)) | ((F.length(gap) < fixed.PERSON_GAP_WORD_BELOW) & joins)


def _address_gap(gap: Column) -> Column:
    return (F.length(gap) < fixed.ADDRESS_GAP_BELOW) & gap.rlike(tx.java_regex(fixed.ADDRESS_GAP))


def merge_neighbours(spans: Column, text: Column, person: bool = True, address: bool = True) -> Column:
    """Merge neighbouring names and neighbouring address parts.

    ``spans`` must be disjoint and ordered. A merged span runs from its first to
    its last member, takes the highest specificity, and is an ADDRESS_LINE if
    any member is one.
    """
    def joined(a: Column, b: Column, gap: Column) -> Column:
        tests = [F.lit(False)]
        if person:
            tests.append((a["label"] == "PERSON") & (b["label"] == "PERSON") & _person_gap(gap))
        if address:
            tests.append(a["label"].isin(fixed.ADDRESS_LABELS) & b["label"].isin(fixed.ADDRESS_LABELS) & _address_gap(gap))
        return reduce(lambda x, y: x | y, tests)

    def merge(pieces: Column, run: Column) -> Column:
        first, last = run[0], F.element_at(run, -1)
        label = F.when(F.exists(run, lambda s: s["label"] == "ADDRESS_LINE"), F.lit("ADDRESS_LINE")).otherwise(first["label"])
        merged = tx.let(
            F.array_max(F.transform(run, lambda s: s["specificity"])),
            lambda top: F.struct(
                first["start"].alias("start"),
                F.negative(last["end"]).alias("back"),
                first["ord"].alias("ord"),
                last["end"].alias("end"),
                tx.cut(pieces, first["start"], last["end"] - first["start"]).alias("text"),
                label.alias("label"),
                first["source"].alias("source"),
                first["score"].alias("score"),
                top.alias("specificity"),
            ),
        )
        return F.when(F.size(run) == 1, first).otherwise(merged)

    def with_pieces(pieces: Column) -> Column:
        def opens(s: Column, i: Column) -> Column:
            before = tx.before(spans, i)
            mergeable = [*(["PERSON"] if person else []), *(fixed.ADDRESS_LABELS if address else [])]
            test = tx.let(
                tx.cut(pieces, before["end"], s["start"] - before["end"]), lambda gap: ~joined(before, s, gap)
            )
            both = s["label"].isin(mergeable) & before["label"].isin(mergeable)
            return F.when(i == 0, True).when(both, test).otherwise(True)

        return tx.let(
            _heads(spans, opens),
            lambda heads: F.when(F.size(heads) == F.size(spans), spans).otherwise(
                F.transform(_runs(spans, heads), lambda run: merge(pieces, run))
            ),
        )

    return F.when(F.size(spans) > 1, tx.let(tx.chunks(text), with_pieces)).otherwise(spans)


def final_spans(spans: Column, text: Column) -> Column:
    """Candidate spans -> disjoint, filtered and merged spans, ordered by start."""
    found = tx.let(
        ordered(spans),
        lambda s: tx.let(
            group_winners(s), lambda k: tx.let(drop_false_positives(k), lambda w: merge_neighbours(w, text))
        ),
    )
    return F.when(F.size(spans) > 0, found).otherwise(no_spans())


def adjudicate(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``final``, the adjudicated spans of the ``spans`` column."""
    return df.withColumn("final", tx.let(F.col(spans), lambda s: final_spans(s, F.col(text))))
