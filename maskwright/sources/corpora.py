"""Readers of tagged corpora and raw text.

Each returns ``sent_id`` (or ``doc_id``) with token and label arrays. Ids from
files are unique over all files of a corpus, and in file order within a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import bio
from maskwright.functions import text as tx
from maskwright.sources.sinks import as_table

CONLL_FILES = {"train": "train.txt", "validation": "valid.txt", "test": "test.txt"}
CHUNK_WORDS = 128


_STRING = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""


def list_literal(text: Column) -> Column:
    """A Python list literal of scalars -> ``array<string>``, as str() shows them; null if it is none.

    Quotes and backslash escapes as in ``repr()``, numbers, None, True and False,
    and a comma after the last item. Each item becomes JSON: a string stays, but
    for ``\\xHH``; another word is quoted, so it is read as its own spelling.
    """
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s){_STRING}|[^\s\[\],'\"]++|\S"), F.lit(0))
    hexed = lambda t: F.regexp_replace(t, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    word = lambda t: F.when(t.rlike(r"\A(?:None|True|False|[+-]?\d+(?:\.\d+)?)\z"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    spelled = F.transform(tokens, lambda t: F.when(t.rlike(r"\A['\"].+"), hexed(t)).otherwise(word(t)))
    json = F.regexp_replace(F.array_join(spelled, " "), r",\s*\]\z", "]")
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.when(F.ltrim(text).startswith("["), F.from_json(json, "array<string>", options))


def _parsed(df: DataFrame, tokens: str, labels: str) -> tuple[DataFrame, Column]:
    missing = {tokens, labels} - set(df.columns)
    if missing:
        raise ValueError(f"the corpus lacks the columns {sorted(missing)}")
    rest = [c for c in df.columns if c not in (tokens, labels)]
    lists = F.struct(list_literal(F.col(tokens)).alias("tokens"), list_literal(F.col(labels)).alias("labels"))
    # the test of the lists would read them again for each use
    parsed = tx.once(df.select(*rest, lists.alias("_lists")), "_lists").select(*rest, F.col("_lists.tokens").alias("tokens"), F.col("_lists.labels").alias("_labels"))
    return parsed, F.col("tokens").isNotNull() & F.col("_labels").isNotNull() & (F.size("tokens") == F.size("_labels"))


def parse_tagged(df: DataFrame, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """List-literal columns -> token and label arrays with repaired tags.

    Rows that do not parse, or whose lists differ in length, are dropped; rejected_tagged() counts them.
    """
    parsed, usable = _parsed(df, tokens, labels)
    rest = [c for c in parsed.columns if c not in ("tokens", "_labels")]
    return parsed.filter(usable).select(*rest, "tokens", bio.sanitize(F.col("_labels")).alias("labels"))


def rejected_tagged(df: DataFrame, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """``(reason, n)``: rows that parse_tagged() drops."""
    parsed, usable = _parsed(df, tokens, labels)
    both = F.col("tokens").isNotNull() & F.col("_labels").isNotNull()
    reason = F.when(both, "lists of different length").otherwise("not a list literal")
    return parsed.filter(~usable).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def read_tagged_csv(spark: SparkSession, path: str, tokens: str = "tokens", labels: str = "labels", multi_line: bool = False) -> DataFrame:
    """CSV with list-literal columns -> ``(sent_id, tokens, labels)``.

    List literals escape line breaks, so a record is a line and large files are split;
    ``multi_line`` is for files with line breaks in other columns, each then one task.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    missing = {tokens, labels} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    numbered = raw.select(F.monotonically_increasing_id().alias("sent_id"), tokens, labels)
    return parse_tagged(numbered, tokens, labels).select("sent_id", "tokens", "labels")


def _fields(block: Column) -> Column:
    """First and last fields of the lines of a block that are kept. Lines are split into words only where one space does not part all fields."""
    odd = F.when(tx.is_ascii(block), block.rlike(r"[\t\x0b-\r\x1c-\x1f]")).otherwise(block.rlike(rf"[{tx.SPACE}&&[^ \n]]"))
    uneven = odd | F.contains(block, F.lit("  ")) | F.contains(block, F.lit("\n ")) | F.contains(block, F.lit(" \n")) | block.startswith(" ") | block.endswith(" ")

    def both(lines: Column, first, last) -> Column:
        return tx.let(lines, lambda ls: F.struct(F.transform(ls, first).alias("tokens"), F.transform(ls, last).alias("labels")))

    def at_spaces(lines: Column) -> Column:
        four = F.filter(lines, lambda line: F.octet_length(F.substring_index(line, " ", 3)) < F.octet_length(line))
        return both(four, lambda line: F.substring_index(line, " ", 1), lambda line: F.substring_index(line, " ", -1))

    def at_words(lines: Column) -> Column:
        four = F.filter(F.transform(lines, lambda line: tx.words(line)), lambda f: F.size(f) >= 4)
        return both(four, lambda f: f[0], lambda f: F.element_at(f, -1))

    lines = F.filter(F.split(block, "\n", -1), lambda line: ~F.contains(F.upper(line), F.lit("DOCSTART")))
    return tx.let(lines, lambda ls: F.when(uneven, at_words(ls)).otherwise(at_spaces(ls)))


def conll_sentences(blocks: DataFrame, block: str = "value") -> DataFrame:
    """Blocks of ``token ... tag`` lines -> tokens and labels; tags are kept as they are.

    DOCSTART lines and lines with fewer than four fields are skipped, blocks
    without any other line dropped.
    """
    rest = [c for c in blocks.columns if c != block]
    # the test of the fields would read them a second time
    return (
        tx.once(blocks.select(*rest, _fields(F.col(block)).alias("_l")), "_l").filter(F.size("_l.tokens") > 0)
        .select(*rest, F.col("_l.tokens").alias("tokens"), F.col("_l.labels").alias("labels"))
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (ended by ``\n``, ``\r\n`` or ``\r``, also mixed), with their file and the split they were read in."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


RUN = "file string, block bigint, run bigint, first bigint, last boolean, value string"


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, block, line, kept columns) in reading order -> the runs between empty lines of each split.

    ``run`` counts the empty lines of the split before a run. The row that closes a split
    (``last``) holds what is read after its last empty line, maybe nothing, and so that count for the whole split.
    """
    here, kept, empty, opened, first = None, [], 0, [], None

    def out(run, line, last: bool, value: pa.Array) -> pa.RecordBatch:
        n = len(value)
        columns = [pa.repeat(pa.scalar(x, t), n) for x, t in zip(here, (pa.string(), pa.int64()), strict=True)]
        columns += [pa.array(run, pa.int64()), pa.array(line, pa.int64()), pa.repeat(last, n), value]
        return pa.RecordBatch.from_arrays([*columns, *[pa.repeat(c[0], n) for c in kept]], names)

    def close() -> pa.RecordBatch:
        return out([empty], [first], True, pa.array(["\n".join(opened)], pa.string()))

    for b in batches:
        names = [*[f.split()[0] for f in RUN.split(", ")], *b.schema.names[4:]]
        files, starts = b.column(1), b.column(2).to_numpy()
        change = np.flatnonzero(np.concatenate(([True], (starts[1:] != starts[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)))) if b.num_rows else []
        for begin, end in pairwise([*change, b.num_rows]):
            part = b.slice(begin, end - begin)
            split = (part.column(1)[0].as_py(), part.column(2)[0].as_py())
            if here is not None and split != here:
                yield close()
                empty, opened, first = 0, [], None
            here, kept = split, part.columns[4:]
            text, line = part.column(0).cast(pa.string()), part.column(3).to_numpy()
            is_blank = pc.equal(text, "").to_numpy(zero_copy_only=False)
            blank = np.flatnonzero(is_blank)
            # lines before the first empty one go on from what is open
            head = int(blank[0]) if len(blank) else part.num_rows
            if head:
                first = int(line[0]) if first is None else first
                opened += text.slice(0, head).to_pylist()
            if not len(blank):
                continue
            if opened:
                yield out([empty], [first], False, pa.array(["\n".join(opened)], pa.string()))
            # runs between two empty lines of the batch are joined at once
            low, size = blank[:-1] + 1, np.diff(blank) - 1
            some = size > 0
            if some.any():
                begun, tail = head + 1, int(blank[-1])
                lines = text.slice(begun, tail - begun).filter(pa.array(~is_blank[begun:tail]))
                ends = pa.array(np.concatenate(([0], np.cumsum(size[some]))), pa.int32())
                yield out(empty + 1 + np.flatnonzero(some), line[low[some]], False, pc.binary_join(pa.ListArray.from_arrays(ends, lines), "\n"))
            rest = int(blank[-1]) + 1
            empty, opened = empty + len(blank), text.slice(rest).to_pylist()
            first = int(line[rest]) if opened else None
    if here is not None:
        yield close()


def blocks(lines: DataFrame, *keep: str) -> DataFrame:
    """Runs of lines between empty ones -> one row each: ``first`` (a unique number, in file order within a file), the kept columns, ``value``.

    Lines are grouped where they are read, as a stream, and not shuffled. Only the first
    and last run of a file split can go on in a neighbour: they meet by the number of empty
    lines in the whole file before them, summed over one slim row a split. A file is read by as
    many tasks as it has splits, and no run is larger than its lines. Kept columns are the same throughout a file.
    """
    kinds = dict(lines.dtypes)
    schema = ", ".join([RUN, *[f"`{c}` {kinds[c]}" for c in keep]])
    found = lines.select("value", "file", "block", F.monotonically_increasing_id().alias("line"), *keep).mapInArrow(_runs_of, schema)
    runs = as_table(found, "runs")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.filter("last").select("file", "block", F.coalesce(F.sum("run").over(ahead), F.lit(0)).alias("before"))
    edges = runs.filter("last or run = 0").filter("value <> ''").join(before, ["file", "block"])
    stitched = edges.groupBy("file", (F.col("before") + F.col("run")).alias("run"), *keep).agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("_r"))
    whole = stitched.select(F.col("_r")[0]["first"].alias("first"), *keep, F.array_join("_r.value", "\n").alias("value"))
    return runs.filter("not last and run > 0").select("first", *keep, "value").unionByName(whole)


def read_conll(spark: SparkSession, directory: str) -> DataFrame:
    """CoNLL files -> ``(sent_id, split, tokens, labels)``; absent files are skipped, ids are unique over all of them."""
    parts = []
    for split, name in CONLL_FILES.items():
        try:
            parts.append(_lines(spark, f"{directory.rstrip('/')}/{name}").withColumn("split", F.lit(split)))
        except PySparkException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not parts:
        return spark.createDataFrame([], "sent_id bigint, split string, tokens array<string>, labels array<string>")
    found = blocks(reduce(DataFrame.unionByName, parts), "split")
    return conll_sentences(found.withColumnRenamed("first", "sent_id").select("sent_id", "split", "value"))


def paragraphs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Paragraphs of each text: split at empty lines (of any line end), stripped, empty ones dropped."""
    lines = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    parts = F.split(lines, "\n\n", -1)
    return (
        df.select(key, F.posexplode_outer(parts).alias("para_no", "_raw"))
        .select(key, "para_no", tx.strip(F.col("_raw")).alias("text")).filter("text <> ''")
    )


def paragraph_chunks(df: DataFrame, text: str = "text", key: str = "doc_id", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Paragraphs cut into runs of at most ``chunk_words`` words, joined by one space."""
    n = max(1, chunk_words)
    split = paragraphs(df, text, key).select(key, "para_no", tx.words(F.col("text")).alias("_w"))
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(n))
    return (
        split.filter(F.size("_w") > 0)
        .select(key, "para_no", F.posexplode(F.transform(starts, lambda s: F.slice("_w", s + 1, n))).alias("chunk_no", "_c"))
        .select(key, "para_no", "chunk_no", F.array_join("_c", " ").alias("text"), F.size("_c").alias("n_words"))
    )


def numbered_chunks(chunks: DataFrame, *order: str) -> DataFrame:
    """Chunks with ``sent_id``, a unique integer that grows in the given order (document, paragraph, chunk), as a stored table: ids are given once."""
    by = order or [c for c in ("doc_id", "para_no", "chunk_no") if c in chunks.columns]
    return as_table(chunks.orderBy(*by).withColumn("sent_id", F.monotonically_increasing_id()), "chunks")


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw text files -> ``(doc_id, text)``, one row per run of lines between empty ones, read in parallel."""
    return blocks(_lines(spark, path)).select(F.col("first").alias("doc_id"), F.col("value").alias("text"))
