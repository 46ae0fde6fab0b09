"""Column helpers for text: exact offsets, slices and Python-style regexes on the JVM.

Every helper returns a Column built from Spark SQL functions, so it runs inside
the executors' JVM without Python workers. All offsets are 0-based code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A control character that marks the two ends of each match, see marked().
MARK = "\u0001"

# Texts are sliced from pieces of this many code points, so that a slice costs
# the same anywhere in the text (substring() counts from the first byte).
CHUNK_BITS = 9
CHUNK = 1 << CHUNK_BITS

# Block length of running_totals().
BLOCK = 256

# In marked texts of up to this many bytes, offsets are counted from the beginning each time: one native call.
SHORT = 1024

# Python's str classes, spelled out for java.util.regex.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
DIGIT = r"\p{Nd}"

# Java's own Unicode word characters, and the few that only one of the two languages counts.
JAVA_WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
ODD_WORD = f"[[{JAVA_WORD}]&&[^{WORD}]]|[[{WORD}]&&[^{JAVA_WORD}]]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain Python variable would repeat the whole expression at each use, and
    inside a lambda once per array element. It is the end of an aggregate without
    elements: transform() of a one-element array does the same, but copies the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def item(array: Column, i: Column) -> Column:
    """0-based element; null beyond the end. Cheaper than get() inside lambdas, where it is interpreted."""
    return F.try_element_at(array, i + 1)


def before(array: Column, i: Column) -> Column:
    """The element before 0-based ``i``; null before the first. 1-based, that is the element number ``i``."""
    return F.try_element_at(array, F.nullif(i, F.lit(0)))


def java_regex(pattern: str, native_boundary: bool = False, ascii_only: bool = False) -> str:
    """Spell a Python ``re`` pattern for java.util.regex with equal meaning.

    Python's classes follow Unicode and ``.``/``$`` know only ``\\n`` as a line
    end; Java needs both said explicitly. ``native_boundary`` keeps Java's ``\\b``:
    about three times faster, and equal on texts for which same_words() holds.
    ``ascii_only`` is for texts of ASCII characters, where Java's plain classes do; faster again.
    """
    inside = {"w": WORD, "s": SPACE, "d": DIGIT, "W": f"[^{WORD}]", "S": f"[^{SPACE}]", "D": f"[^{DIGIT}]"}
    outside = {
        "w": f"[{WORD}]", "W": f"[^{WORD}]", "s": f"[{SPACE}]", "S": f"[^{SPACE}]",
        "d": f"[{DIGIT}]", "D": f"[^{DIGIT}]", "Z": r"\z",
    }
    if ascii_only:
        plain = {"w": r"\w", "s": r"\t-\r\x1c-\x20", "d": r"\d"}
        inside = plain | {c.upper(): f"[^{x}]" for c, x in plain.items()}
        outside = plain | {"s": r"[\t-\r\x1c-\x20]", "S": r"[^\t-\r\x1c-\x20]", "W": r"\W", "D": r"\D", "Z": r"\z"}
    elif not native_boundary:
        outside["b"] = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
        outside["B"] = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
    out, i, in_class, lines = [], 0, False, False
    # Java's group names have no underscore
    named = {name: f"g{n}" for n, name in enumerate(re.findall(r"\(\?P<(\w+)>", pattern))}
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            out.append((inside if in_class else outside).get(nxt, c + nxt))
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            # a leading ']' (or '^]') is a literal in Python
            head = "[^" if pattern[i + 1 : i + 2] == "^" else "["
            i += len(head)
            out.append(head)
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        elif c == "$":
            out.append("$" if lines else r"(?=\n?\z)")
        elif m := re.match(r"\(\?P<(\w+)>", pattern[i:]):
            out.append(f"(?<{named[m[1]]}>")
            i += m.end()
            continue
        elif m := re.match(r"\(\?P=(\w+)\)", pattern[i:]):
            out.append(rf"\k<{named[m[1]]}>")
            i += m.end()
            continue
        elif m := re.match(r"\(\?([imsux]+)([:)])", pattern[i:]):
            # under (?m) a line's end is $ in both
            lines = lines or "m" in m[1]
            out.append(f"(?{m[1].replace('u', '').replace('i', 'iu')}{m[2]}")
            i += m.end()
            continue
        elif m := re.match(r"\{,(\d+)\}", pattern[i:]):
            out.append(f"{{0,{m[1]}}}")
            i += m.end()
            continue
        else:
            out.append(c)
        i += 1
    return ("(?dU)" if native_boundary and not ascii_only else "(?d)") + "".join(out)


def same_words(text: Column) -> Column:
    """True if Java and Python agree on every word character of the text."""
    return is_ascii(text) | ~text.rlike(ODD_WORD)


def quoted(literal: str) -> str:
    """A literal as a Java regex."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def any_of(literals: list[str]) -> str:
    """A Java regex with one group that takes the longest of the literals beginning at a place, written as a prefix tree."""
    tree: dict = {}
    for word in literals:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        run = ""
        # a stretch without branches is written out
        while len(node) == 1 and "" not in node:
            (c, node), = node.items()
            run += c
        ways = [quoted(c) + spelled(below) for c, below in node.items() if c]
        rest = "(?:" + "|".join(ways) + ")" + ("?" if "" in node else "") if ways else ""
        return (quoted(run) if run else "") + rest

    heads = "".join(re.sub(r"([\\\[\]^&-])", r"\\\1", c) for c in tree)
    # most places are left at their first character
    return f"(?=[{heads}])({spelled(tree)})"


def mark_for(text: Column) -> Column:
    """A mark the text does not contain: MARK, or in the rare text that holds it, one with the text's hash."""
    return F.when(F.contains(text, F.lit(MARK)), F.concat(F.lit(MARK), F.md5(text), F.lit(MARK))).otherwise(F.lit(MARK))


def marked(text: Column, regex: str, mark: Column) -> Column:
    """The text with a mark before and after each leftmost match: one regex pass.

    Split at the mark it reads ``[gap, match, gap, match, ..., gap]``.
    """
    return F.regexp_replace(text, F.lit(regex), F.concat(mark, F.lit("$0"), mark))


def is_short(marked_text: Column, mark: Column) -> Column:
    """Whether offsets in a marked text may be counted from its beginning: few bytes, marks of one."""
    return (F.octet_length(marked_text) <= SHORT) & (F.octet_length(mark) == 1)


def odd_items(pieces: Column, item: Callable[[Column], Column]) -> Column:
    """``item(i)`` for the match positions 1, 3, 5, ... of a split marked text."""
    return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), item)


def running_totals(values: Column) -> Column:
    """Exclusive running totals of an integer array: ``[0, v0, v0+v1, ...]`` without the last.

    Done per block of BLOCK values, then shifted by the totals of the blocks
    before, so that long arrays do not cost quadratic copying.
    """
    zero = F.array(F.lit(0))

    def within(block: Column) -> Column:
        grown = F.aggregate(block, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return F.slice(grown, 1, F.size(block))

    def by_block(vals: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(vals), F.lit(BLOCK)), lambda b: F.slice(vals, b, BLOCK))
        return let(
            blocks,
            lambda bs: let(
                F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)),
                lambda totals: let(
                    within(totals),
                    lambda base: F.flatten(
                        F.transform(bs, lambda b, j: F.transform(within(b), lambda v: v + item(base, j)))
                    ),
                ),
            ),
        )

    return let(values, lambda vals: F.when(F.size(vals) <= BLOCK, within(vals)).otherwise(by_block(vals)))


def sql_literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_let(value: str, name: str, body: str) -> str:
    """let() in SQL."""
    return f"aggregate(CAST(array() AS ARRAY<INT>), {value}, ({name}, _e) -> {name}, {name} -> {body})"


def sql_running_totals(values: str) -> str:
    """running_totals() in SQL."""
    def within(block: str) -> str:
        grown = f"aggregate({block}, array(0), (acc, v) -> concat(acc, array(element_at(acc, -1) + v)))"
        return f"slice({grown}, 1, size({block}))"

    sums = "transform(bs, b -> aggregate(b, 0, (a, v) -> a + v))"
    shifted = f"flatten(transform(bs, (b, j) -> transform({within('b')}, v -> v + element_at(base, j + 1))))"
    blocks = f"transform(sequence(1, size(vals), {BLOCK}), b -> slice(vals, b, {BLOCK}))"
    by_block = sql_let(blocks, "bs", sql_let(sums, "totals", sql_let(within("totals"), "base", shifted)))
    return sql_let(values, "vals", f"CASE WHEN size(vals) <= {BLOCK} THEN {within('vals')} ELSE {by_block} END")


def sql_chunks(text: str) -> str:
    """chunks() in SQL."""
    return f"CASE WHEN octet_length({text}) BETWEEN 1 AND {CHUNK} THEN array({text}) ELSE regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0) END"


def sql_cut(pieces: str, start: str, length: str) -> str:
    """cut() in SQL, for a positive length."""
    first = f"shiftright({start}, {CHUNK_BITS})"
    last = f"shiftright({start} + {length} - 1, {CHUNK_BITS})"
    near = f"array_join(slice({pieces}, {first} + 1, {last} - {first} + 1), '')"
    far = f"substring({near}, {start} - shiftleft({first}, {CHUNK_BITS}) + 1, {length})"
    return f"CASE WHEN size({pieces}) = 1 THEN substring(element_at({pieces}, 1), {start} + 1, {length}) ELSE {far} END"


def sql_mark(text: str) -> str:
    """mark_for() in SQL."""
    m = sql_literal(MARK)
    return f"CASE WHEN contains({text}, {m}) THEN concat({m}, md5({text}), {m}) ELSE {m} END"


def chunks(text: Column) -> Column:
    """The text as an array of CHUNK-long pieces (the last may be shorter)."""
    n = F.octet_length(text)
    return F.when((n > 0) & (n <= CHUNK), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from offset ``start`` of a text given as chunks()."""
    first = F.shiftright(start, CHUNK_BITS)
    last = F.shiftright(start + length - 1, CHUNK_BITS)
    near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return (
        F.when(length <= 0, F.lit(""))
        .when(F.size(pieces) == 1, F.substring(F.element_at(pieces, 1), start + 1, length))
        .otherwise(F.substring(near, start - F.shiftleft(first, CHUNK_BITS) + 1, length))
    )


def strip(text: Column) -> Column:
    """Python's ``str.strip()``: all Unicode white space, both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def words(text: Column) -> Column:
    """Python's ``str.split()``: split at white-space runs, no empty words."""
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def words_at(text: Column) -> Column:
    """Words of a text as ``array<struct<start int, end int, word string>>``."""
    def counted(marked_text: Column, mark: Column, pieces: Column) -> Column:
        upto = lambda i: F.length(F.call_function("substring_index", marked_text, mark, i)) - i + 1
        return odd_items(
            pieces, lambda i: F.struct(upto(i).alias("start"), upto(i + 1).alias("end"), item(pieces, i).alias("word"))
        )

    def placed(pieces: Column) -> Column:
        return let(
            running_totals(F.transform(pieces, lambda p: F.length(p))),
            lambda starts: odd_items(
                pieces,
                lambda i: F.struct(
                    item(starts, i).alias("start"), item(starts, i + 1).alias("end"), item(pieces, i).alias("word")
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    by_mark = lambda m, mark: let(
        F.split(m, mark, -1), lambda p: F.when(F.size(p) <= 1, none).when(is_short(m, mark), counted(m, mark, p)).otherwise(placed(p))
    )
    found = let(mark_for(text), lambda mark: let(marked(text, f"[^{SPACE}]+", mark), lambda m: by_mark(m, mark)))
    return F.when(text.isNotNull(), found).otherwise(none)


def each(df: DataFrame, *keep: str, **arrays: Column) -> DataFrame:
    """One row per element of one array: the kept columns and the element.

    An outer explode with the empty rows filtered after it. For a plain explode the
    optimizer adds a test of the array below, which evaluates a costly one again.
    """
    (name, array), = arrays.items()
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def once(df: DataFrame, name: str) -> DataFrame:
    """The table with a costly column computed in one place.

    The optimizer copies a column's expression into each later use and each pushed
    filter, but not across an explode; here it explodes one element.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode_outer(F.array(F.struct(F.col(name).alias("v")))).alias("_once")).select(*rest, F.col("_once.v").alias(name))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def swap_case(token: Column) -> Column:
    """Python's ``str.swapcase()``; ASCII takes one translate()."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    each = F.transform(
        F.split(token, "", -1),
        lambda c: F.when(c.rlike(r"^\p{IsUppercase}\z"), F.lower(c))
        .when(c.rlike(r"^\p{IsLowercase}\z"), F.upper(c))
        .otherwise(c),
    )
    return F.when(is_ascii(token), F.translate(token, lower + upper, upper + lower)).otherwise(F.array_join(each, ""))
