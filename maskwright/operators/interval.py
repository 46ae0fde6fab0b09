"""Words and spans as tables: an interval join by range bins, for texts whose words or spans do not fit one row.

Both sides are dealt to bins of BIN characters of their document and meet by equality of
document and bin, so a long document is spread over many tasks, and no side is
compared with all of the other. In overlaps() a pair that shares several bins is met in the one where the later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as tx

BIN = 256


def word_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, no, start, end, word)``: white-space words, numbered from 1."""
    at = docs.select(key, F.posexplode_outer(tx.words_at(F.col(text))).alias("_i", "_w")).filter("_w is not null")
    return at.select(key, (F.col("_i") + 1).alias("no"), "_w.start", "_w.end", "_w.word")


def overlaps(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = BIN) -> DataFrame:
    """All pairs of rows of one document with ``left.start < right.end and left.end > right.start``; null and reversed ranges meet nothing.

    So touching ranges do not overlap, and an empty one overlaps what it lies within.

    Columns besides ``key`` must differ, but for ``start`` and ``end``, which are not kept.
    """
    def binned(df: DataFrame, own: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (key, "start", "end")]
        low = F.floor(F.col("start") / width)
        high = F.greatest(low, F.floor((F.col("end") - 1) / width))
        placed = df.filter(F.col("start") <= F.col("end")).select(
            key, *rest, F.col("start").alias(f"_s{own}"), F.col("end").alias(f"_e{own}"), low.alias(f"_b{own}"), F.explode(F.sequence(low, high)).alias("_bin")
        )
        return placed

    met = binned(left, "l").join(binned(right, "r"), [key, "_bin"])
    mine = F.col("_bin") == F.greatest("_bl", "_br")
    apart = (F.col("_sl") < F.col("_er")) & (F.col("_el") > F.col("_sr"))
    return met.filter(mine & apart).drop("_bin", "_sl", "_el", "_bl", "_sr", "_er", "_br")


def _tag(hit: Column, before: Column, of_before: Column) -> Column:
    """The tag of a word with the span ``hit``: I if the word before it meets that span too and has a span of this label, else B."""
    goes_on = (before["start"] < hit["end"]) & (before["end"] > hit["start"]) & (of_before["label"] == hit["label"])
    head = F.when(F.coalesce(goes_on, F.lit(False)), "I-").otherwise("B-")
    return F.when(hit["label"].isNotNull(), F.concat(head, hit["label"])).otherwise(F.lit("O"))


def _meet(w: Column, s: Column) -> Column:
    return (w["start"] < s["end"]) & (w["end"] > s["start"])


def _tags_by_number(words: Column, spans: Column) -> Column:
    """Tags where numbers repeat in a bin: all words of one number count as one, and all spans of one ``ord``."""
    def of_word(w: Column) -> Column:
        return F.transform(F.filter(spans, lambda s: _meet(w, s)), lambda s: F.struct(w["no"].alias("no"), s["ord"].alias("ord"), s["label"].alias("label")))

    def tag(met: Column, no: Column) -> Column:
        top = lambda n: F.array_max(F.transform(F.filter(met, lambda m: m["no"] == n), lambda m: F.struct(m["ord"], m["label"])))
        first = lambda t: F.array_min(F.transform(F.filter(met, lambda m: m["ord"] == t["ord"]), lambda m: m["no"]))
        lasts = lambda t: (first(t) < no) & (top(no - 1)["label"] == t["label"])
        head = lambda t: F.when(F.coalesce(lasts(t), F.lit(False)), "I-").otherwise("B-")
        return tx.let(top(no), lambda t: F.when(t["label"].isNotNull(), F.concat(head(t), t["label"])).otherwise(F.lit("O")))

    return tx.let(F.flatten(F.transform(words, of_word)), lambda met: F.transform(words, lambda w: tag(met, w["no"])))


def tag_rows(words: DataFrame, spans: DataFrame, key: str = "doc_id", width: int = BIN) -> DataFrame:
    """``(key, no, word, tag)`` of word_rows() and span rows ``(key, ord, start, end, label)``; ``no`` and ``ord`` are unique in a document.

    The first word that a span overlaps is B, the others I; the span with the greatest ``ord`` counts; then tags are repaired.
    So a word is I if the word before it overlaps its span as well and has the same label.

    Words and spans are dealt once, gathered by document and bin: a cell holds a bin, and a document is nowhere one task's. A bin
    tells the tags of its words but at its edges: of a word that goes on in the next bin (a span may begin there), and of the
    first one if its span begins before it. Those few are dealt again, by word, with what the bins know of them and of the words before them.
    """
    def placed(df: DataFrame, entry: Column, name: str) -> DataFrame:
        low = F.floor(F.col("start") / width)
        high = F.greatest(low, F.floor((F.col("end") - 1) / width))
        return df.filter(meets).withColumn("_bin", F.explode(F.sequence(low, high))).select(key, "_bin", entry.alias(name))

    meets = F.coalesce(F.col(key).isNotNull() & (F.col("start") <= F.col("end")), F.lit(False))
    # a word is text only in the bin that it begins in; in others it is a guest
    text = F.when(F.floor(F.col("start") / width) == F.col("_bin"), F.col("word"))
    rows = placed(words, F.struct("no", "start", "end", text.alias("word")), "_w").unionByName(
        placed(spans, F.struct("ord", "start", "end", "label"), "_s"), allowMissingColumns=True
    )
    bins = rows.groupBy(key, "_bin").agg(F.collect_list("_w").alias("_w"), F.collect_list("_s").alias("_s")).filter(F.size("_w") > 0)
    home = lambda w: F.floor(w["start"] / width) == F.col("_bin")
    beyond = lambda w: F.floor((w["end"] - 1) / width) > F.floor(w["start"] / width)

    def entries(ws: Column, ss: Column) -> Column:
        """An entry for each distinct word, in order."""
        def hit(w: Column) -> Column:
            return F.array_max(F.transform(F.filter(ss, lambda s: _meet(w, s)), lambda s: F.struct(*[s[c].alias(c) for c in ("ord", "label", "start", "end")])))

        def entry(w: Column, i: Column, hits: Column) -> Column:
            mine, w0, of_w0 = tx.item(hits, i), tx.before(ws, i), tx.before(hits, i)
            # a guest has spans that begin elsewhere, so what is known of it here is not all
            known = F.coalesce(home(w0) & (w0["no"] == w["no"] - 1), F.lit(False))
            reach = F.when(known, F.struct(w0["start"].alias("start"), w0["end"].alias("end")))
            early = ~F.coalesce(home(w0), F.lit(False)) & F.coalesce(mine["start"] < w["start"], F.lit(False))
            onward = (i == F.size(ws) - 1) & F.exists(ss, lambda s: _meet(w, s) & (s["end"] > w["end"]))
            return F.struct(
                w.alias("w"), mine.alias("hit"), reach.alias("before"), F.when(known, of_w0).alias("of_before"),
                _tag(mine, reach, F.when(known, of_w0)).alias("tag"), (home(w) & (beyond(w) | early)).alias("open"), (beyond(w) | onward).alias("tells"),
            )

        def closed(e: Column, tag: Column) -> Column:
            same = [e[c].alias(c) for c in ("w", "hit", "before", "of_before")]
            return F.struct(*same, tag.alias("tag"), F.lit(False).alias("open"), F.lit(False).alias("tells"))

        unique = (F.size(F.array_distinct(ws["no"])) == F.size(ws)) & (F.size(F.array_distinct(ss["ord"])) == F.size(ss))
        by_place = tx.let(F.transform(ws, hit), lambda hits: F.transform(ws, lambda w, i: entry(w, i, hits)))
        by_number = tx.let(_tags_by_number(ws, ss), lambda tags: F.transform(by_place, lambda e, i: closed(e, tx.item(tags, i))))
        return F.when(unique, by_place).otherwise(by_number)

    def of_all(v: Column) -> Column:
        """An entry for each word, also for those of a document that comes twice."""
        found = entries(v["w"], v["s"])
        spread = tx.let(found, lambda es: F.transform(F.col("_w"), lambda w: tx.item(es, F.array_position(v["w"], w).cast("int") - 1)))
        return F.when(F.size(v["w"]) == F.size("_w"), found).otherwise(spread)

    def each(df: DataFrame) -> DataFrame:
        ordered = F.struct(F.sort_array(F.array_distinct("_w")).alias("w"), F.array_distinct("_s").alias("s"))
        return df.select(key, "_bin", F.explode(tx.let(ordered, of_all)).alias("e"))

    inner = each(bins).filter(~F.col("e.open") & home(F.col("e.w"))).select(key, "e.w.no", "e.w.word", "e.tag")

    # only bins with a word or span that goes over an edge, or a span that begins or ends beyond all words
    crossed = F.exists("_w", lambda w: beyond(w)) | (F.array_min("_s.start") < F.array_min("_w.start")) | (F.array_max("_s.end") > F.array_max("_w.end"))
    e = F.col("e")
    own = F.when(e["open"], F.struct(e["w"]["word"].alias("word")))
    here = F.struct(e["w"]["no"].alias("no"), own.alias("own"), e["hit"].alias("hit"), e["before"].alias("before"), e["of_before"].alias("of_before"))
    reach = F.struct(e["w"]["start"].alias("start"), e["w"]["end"].alias("end"))
    there = F.struct(
        (e["w"]["no"] + 1).alias("no"), F.lit(None).alias("own"), F.lit(None).alias("hit"), reach.alias("before"), e["hit"].alias("of_before")
    )
    sent = F.concat(F.when(e["open"] | ~home(e["w"]), F.array(here)).otherwise(F.array()), F.when(e["tells"], F.array(there)).otherwise(F.array()))
    told = each(bins.filter(crossed)).select(key, F.explode(sent).alias("t")).select(key, "t.*")
    gathered = told.groupBy(key, "no").agg(
        F.collect_list("own").alias("own"), F.max("hit").alias("hit"), F.max("before").alias("before"), F.max("of_before").alias("of_before")
    )
    edges = gathered.select(key, "no", F.explode("own").alias("own"), _tag(F.col("hit"), F.col("before"), F.col("of_before")).alias("tag")).select(key, "no", "own.word", "tag")
    apart = words.filter(~meets).select(key, "no", "word", F.lit("O").alias("tag"))
    return inner.unionByName(edges).unionByName(apart)
