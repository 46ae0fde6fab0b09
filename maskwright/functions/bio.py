"""Column helpers for BIO tags: repair, entities, alignment and word tags from spans.

All work stays inside the row: linear or n log n in the length of the sentence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import text as tx

IGNORED = -100  # label id of positions that carry no label
PAIRS = 1024  # words times spans up to which tag_words() compares all of them
READ = 16_384  # bytes of text times spans up to which tag_text() reads the text once a span


def prefix(tag: Column) -> Column:
    """Part before the first ``-``; an untyped tag counts as B."""
    return F.when(F.contains(tag, F.lit("-")), F.substring_index(tag, "-", 1)).otherwise(F.lit("B"))


def entity_type(tag: Column) -> Column:
    """Part after the first ``-``; an untyped tag is its own type."""
    return F.when(F.contains(tag, F.lit("-")), F.substring(tag, F.length(F.substring_index(tag, "-", 1)) + 2, F.length(tag))).otherwise(tag)


def sanitize(labels: Column) -> Column:
    """Repair tags: untyped tags become B, an I that continues nothing becomes B.

    Whether an I continues depends on the raw tag before it only, since a repair
    keeps the type and stays within {B, I}.
    """
    def repaired(tag: Column, i: Column) -> Column:
        before = tx.before(labels, i)
        continues = (before != "O") & prefix(before).isin("B", "I") & (entity_type(before) == entity_type(tag))
        kept = F.when((prefix(tag) == "I") & ~F.coalesce(continues, F.lit(False)), F.lit("B")).otherwise(prefix(tag))
        return F.when(tag == "O", tag).otherwise(F.concat(kept, F.lit("-"), entity_type(tag)))

    return F.transform(labels, repaired)


def has_entity(labels: Column) -> Column:
    return F.exists(labels, lambda t: t != "O")


def order_key(tag: Column) -> Column:
    """Sort key of the label vocabulary: O, then by type, B before the others."""
    outside = tag == "O"
    return F.struct(
        F.when(outside, 0).otherwise(1).alias("group"),
        F.when(outside, "").otherwise(entity_type(tag)).alias("type"),
        F.when(outside | (prefix(tag) == "B"), 0).otherwise(1).alias("rank"),
        tag.alias("label"),
    )


def align(labels: Column, word_ids: Column, label_all: bool = False) -> Column:
    """Word labels -> sub-word labels: first piece of a word, others ignored (or all)."""
    def piece(w: Column, i: Column) -> Column:
        label = tx.item(labels, w)
        first = (i == 0) | ~tx.before(word_ids, i).eqNullSafe(w)
        return F.when(w.isNull(), IGNORED).when(first | F.lit(label_all), label).otherwise(IGNORED)

    return F.transform(word_ids, piece)


def entities(tags: Column) -> Column:
    """Entities of a tag sequence, ``array<struct<type, start, end>>`` with the end included.

    Lenient reading of B/I/O/E/S tags: an entity also opens on a type change and
    on an I after O.
    """
    def parsed(t: Column) -> Column:
        rest = F.substring(t, 2, F.length(t))
        typ = F.when(F.contains(rest, F.lit("-")), F.substring(rest, F.instr(rest, "-") + 1, F.length(rest))).otherwise(rest)
        return F.struct(F.substring(t, 1, 1).alias("p"), F.when(typ == "", "_").otherwise(typ).alias("t"))

    none = F.array().cast("array<struct<type:string,start:int,end:int>>")

    def collect(seq: Column) -> Column:
        p = lambda e: e["p"]
        before = lambda i: F.when(i > 0, tx.before(seq, i)).otherwise(parsed(F.lit("O")))

        def opens(b: Column, e: Column) -> Column:
            turned = ~p(e).isin("O", ".") & (b["t"] != e["t"])
            return p(e).isin("B", "S") | (p(b).isin("E", "S", "O") & p(e).isin("E", "I")) | turned

        def closes(b: Column, e: Column) -> Column:
            turned = ~p(b).isin("O", ".") & (b["t"] != e["t"])
            return p(b).isin("E", "S") | (p(b).isin("B", "I") & p(e).isin("B", "S", "O")) | turned

        def where(test) -> Column:
            at = F.transform(seq, lambda e, i: tx.let(before(i), lambda b: F.when(test(b, e), i)))
            return F.filter(at, lambda i: i.isNotNull())

        # an entity runs from the last opening before its end
        return tx.let(
            F.struct(where(opens).alias("starts"), where(closes).alias("ends")),
            lambda v: tx.let(
                ranks(v["starts"], v["ends"], inclusive=False),
                lambda begun: F.transform(
                    v["ends"],
                    lambda e, j: F.struct(
                        tx.before(seq, e)["t"].alias("type"),
                        tx.before(v["starts"], tx.item(begun, j)).alias("start"),
                        (e - 1).alias("end"),
                    ),
                ),
            ),
        )

    # the closing O ends an entity at the end of the sentence
    padded = F.transform(F.concat(tags, F.array(F.lit("O"))), parsed)
    return F.when(has_entity(tags), tx.let(padded, collect)).otherwise(none)


def ranks(points: Column, queries: Column, inclusive: bool) -> Column:
    """For each query the number of ``points`` below it (or up to it): a merge of two sorted lists."""
    point, query = (0, 1) if inclusive else (1, 0)
    events = F.concat(
        F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(point).alias("kind"), F.lit(0).alias("i"))),
        F.transform(queries, lambda q, i: F.struct(q.alias("at"), F.lit(query).alias("kind"), i.alias("i"))),
    )
    placed = F.transform(F.sort_array(events), lambda e, pos: F.struct(e["i"].alias("i"), e["kind"].alias("kind"), pos.alias("pos")))
    asked = F.filter(placed, lambda e: e["kind"] == query)
    counted = F.transform(asked, lambda e, j: F.struct(e["i"].alias("i"), (e["pos"] - j).alias("n")))
    return F.transform(F.sort_array(counted), lambda e: e["n"])


def _tags_by_pair(words: Column, spans: Column) -> Column:
    """The raw tags of tag_words() where few words meet few spans: each word looks for the last span that touches it."""
    lowest = F.lit(-(2**31))

    def tag(w: Column, i: Column) -> Column:
        touching = F.filter(
            spans, lambda s: (w["end"] > F.coalesce(s["start"], lowest)) & (w["start"] < F.coalesce(s["end"], lowest))
        )

        def of_last(s: Column) -> Column:
            first = (i == 0) | (tx.before(words, i)["end"] <= F.coalesce(s["start"], lowest))
            return F.concat(F.when(first, F.lit("B-")).otherwise(F.lit("I-")), s["label"])

        return tx.let(touching, lambda t: F.when(F.size(t) > 0, tx.let(F.element_at(t, -1), of_last)).otherwise(F.lit("O")))

    return F.transform(words, tag)


def tag_words(words: Column, spans: Column) -> Column:
    """Word tags from character spans: B on the first word a span touches, I on the rest.

    ``words`` are words_at(), ``spans`` have start, end and label; a later span
    overwrites an earlier one. The result is repaired as by sanitize().
    """
    def spread(v: Column) -> Column:
        def of_span(s: Column, k: Column) -> Column:
            first, last = tx.item(v["first"], k), tx.item(v["after"], k) - 1
            tags = F.transform(
                F.sequence(first, last),
                lambda w: F.struct(
                    w.alias("word"),
                    F.negative(k).alias("turn"),
                    F.concat(F.when(w == first, F.lit("B-")).otherwise(F.lit("I-")), s["label"]).alias("tag"),
                ),
            )
            return F.when(first <= last, tags).otherwise(F.array().cast("array<struct<word:int,turn:int,tag:string>>"))

        plain = F.transform(words, lambda w, i: F.struct(i.alias("word"), F.lit(1).alias("turn"), F.lit("O").alias("tag")))
        return F.sort_array(F.concat(F.flatten(F.transform(spans, of_span)), plain))

    bounds = F.struct(
        ranks(F.transform(words, lambda w: w["end"]), F.transform(spans, lambda s: s["start"]), inclusive=True).alias("first"),
        ranks(F.transform(words, lambda w: w["start"]), F.transform(spans, lambda s: s["end"]), inclusive=False).alias("after"),
    )
    tagged = tx.let(
        tx.let(bounds, spread),
        lambda all_tags: F.transform(
            F.filter(all_tags, lambda t, i: (i == 0) | (tx.before(all_tags, i)["word"] != t["word"])), lambda t: t["tag"]
        ),
    )
    few = F.size(words) * F.size(spans) <= PAIRS
    tags = F.when(few, _tags_by_pair(words, spans)).otherwise(tagged)
    return F.when(F.size(spans) > 0, tx.let(tags, sanitize)).otherwise(F.transform(words, lambda w: F.lit("O")))


def _in_order(spans: Column) -> Column:
    """True if the spans have both offsets, hold text, and each begins where the one before has ended."""
    def fits(s: Column, i: Column) -> Column:
        return (s["start"] >= F.when(i == 0, F.lit(0)).otherwise(tx.before(spans, i)["end"])) & (s["start"] < s["end"])

    return ~F.array_contains(F.transform(spans, lambda s, i: F.coalesce(fits(s, i), F.lit(False))), False)


def _tags_by_count(text: Column, n: Column, spans: Column) -> Column:
    """The tags of tag_words() for spans that are _in_order(), from the number of words before each end of a span.

    A run of tags begins with B, so nothing is to be repaired. Only the spans are gone through, not the words.
    """
    def bounds(heads: Column, s: Column) -> Column:
        # no text is longer than READ here
        start, end = (F.least(s[at], F.lit(READ)).cast("int") for at in ("start", "end"))

        def begun(at: Column) -> Column:
            """The number of words that begin before an offset."""
            before = F.substring(heads, F.lit(1), at)
            return F.length(before) - F.length(F.replace(before, F.lit(tx.MARK), F.lit("")))

        # a word that runs across the start is the first one touched
        across = F.substring(heads, start + 1, F.lit(1)).rlike(f"[^{tx.SPACE}{tx.MARK}]")
        return F.struct((begun(start) - across.cast("int")).alias("first"), begun(end).alias("after"), s["label"].alias("label"))

    def run(b: Column, i: Column, runs: Column) -> Column:
        # a word that two spans touch goes to the later one
        begin = F.when(i == 0, F.lit(0)).otherwise(F.least(tx.before(runs, i)["after"], b["first"]))
        end = F.least(b["after"], F.coalesce(tx.item(runs, i + 1)["first"], n))
        tags = F.concat(
            F.array_repeat(F.lit("O"), b["first"] - begin),
            F.array(F.concat(F.lit("B-"), b["label"])), F.array_repeat(F.concat(F.lit("I-"), b["label"]), end - b["first"] - 1),
        )
        return F.when(end > b["first"], tags).otherwise(F.array_repeat(F.lit("O"), b["first"] - begin))

    # the text with a mark for the first character of each word
    heads = F.regexp_replace(text, f"(?<![^{tx.SPACE}])[^{tx.SPACE}]", tx.MARK)
    return tx.let(
        tx.let(heads, lambda h: F.transform(spans, lambda s: bounds(h, s))),
        lambda runs: F.concat(
            F.flatten(F.transform(runs, lambda b, i: run(b, i, runs))), F.array_repeat(F.lit("O"), n - F.element_at(runs, -1)["after"])
        ),
    )


def tag_text(text: Column, n: Column, spans: Column) -> Column:
    """tag_words() of a text of ``n`` words; words are placed only where spans are many or out of order."""
    few = (F.octet_length(text) * F.size(spans) <= READ) & ~F.contains(text, F.lit(tx.MARK))
    tags = F.when(few & _in_order(spans), _tags_by_count(text, n, spans)).otherwise(
        tx.let(F.struct(tx.words_at(text).alias("w"), spans.alias("s")), lambda v: tag_words(v["w"], v["s"]))
    )
    return F.when(F.size(spans) > 0, tags).otherwise(F.array_repeat(F.lit("O"), n))
