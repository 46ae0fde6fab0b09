"""Detection: text -> candidate spans, all inside the row.

Spans are an array column, so detection needs no shuffle and no Python worker:
one scan of the text table, each rule one native regex pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.sources import fixed_values as fixed
from maskwright.sources.catalog import NER_ORD, Catalog, ContextKey, TextRule
from maskwright.sources.spans import span_fault

# Field order matters: spans sort by start, then longest first, then insertion order.
SPAN = (
    "struct<start:int,back:int,ord:int,end:int,text:string,label:string,"
    "source:string,score:double,specificity:int>"
)
NO_SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def span(start, end, text, label, source, specificity, ord, score=None) -> Column:
    """A candidate span. ``back`` is the negated end, for sorting long spans first."""
    score = F.lit(None) if score is None else score
    return F.struct(
        start.alias("start"),
        F.negative(end).alias("back"),
        ord.cast("int").alias("ord"),
        end.alias("end"),
        text.alias("text"),
        label.alias("label"),
        F.lit(source).alias("source"),
        score.cast("double").alias("score"),
        specificity.cast("int").alias("specificity"),
    )


def _contains_any(text: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {tx.sql_literal(n)})" for n in needles) + ")"


def _sql_span(start: str, end: str, text: str, label: str, source: str, specificity: str, ord: str) -> str:
    """span() in SQL."""
    return (
        f"named_struct('start', {start}, 'back', -({end}), 'ord', {ord}, 'end', {end}, 'text', {text}, 'label', {label}, "
        f"'source', '{source}', 'score', CAST(NULL AS DOUBLE), 'specificity', {specificity})"
    )


def text_spans(text: str, rules: list[TextRule]) -> Column:
    """Spans of all regex rules on a text column: all leftmost non-overlapping matches of each.

    One regex pass per rule sets a mark before and after each match; split at the
    mark, the text reads gap, match, gap, ..., and offsets are running lengths.
    Patterns are literals, compiled once per task; what follows the regex is one
    expression over all rules. ASCII texts take the fastest spelling of the
    patterns, nearly all others a faster one; the exact one is kept for texts with
    characters that Java and Python class differently.

    Written as SQL text: long literal lists are built there in one call.
    """
    if not rules:
        return no_spans()
    t = f"`{text}`"

    def by_rule(native_boundary: bool, ascii_only: bool = False) -> str:
        def one(r: TextRule) -> str:
            regex = tx.sql_literal(tx.java_regex(r.pattern, native_boundary, ascii_only))
            hit = f"regexp_replace({t}, {regex}, between)"
            return f"CASE WHEN {_contains_any(t, r.needs)} THEN {hit} END" if r.needs else hit

        return f"array({', '.join(one(r) for r in rules)})"

    # what the spans of a rule have in common, a literal; a marked text is longer than the text
    abouts = (f"named_struct('ord', {r.ord}, 'label', {tx.sql_literal(r.label)}, 'specificity', {r.specificity})" for r in rules)
    infos = f"array({', '.join(abouts)})"
    odd = tx.sql_literal(tx.ODD_WORD)
    each = (
        f"CASE WHEN octet_length({t}) = length({t}) THEN {by_rule(True, True)} "
        f"WHEN NOT rlike({t}, {odd}) THEN {by_rule(True)} ELSE {by_rule(False)} END"
    )
    def spans_at(start: str, end: str) -> str:
        one_span = _sql_span(start, end, "element_at(pieces, i + 1)", "info.label", "regex", "info.specificity", "info.ord")
        return f"transform(sequence(1, size(pieces) - 2, 2), i -> {one_span})"

    totals = tx.sql_let(
        tx.sql_running_totals("transform(pieces, p -> length(p))"), "starts", spans_at("element_at(starts, i + 1)", "element_at(starts, i + 2)")
    )
    counted = spans_at("length(substring_index(m, mark, i)) - i + 1", "length(substring_index(m, mark, i + 1)) - i")
    placed = f"CASE WHEN octet_length(m) <= {tx.SHORT} AND octet_length(mark) = 1 THEN {counted} ELSE {totals} END"
    of_rule = tx.sql_let("element_at(infos, r + 1)", "info", tx.sql_let("split(m, mark, -1)", "pieces", placed))
    by_rules = f"transform({each}, (m, r) -> CASE WHEN octet_length(m) > octet_length({t}) THEN {of_rule} END)"
    found = tx.sql_let(infos, "infos", tx.sql_let("concat(mark, '$0', mark)", "between", f"flatten(filter({by_rules}, f -> f IS NOT NULL))"))
    return F.expr(tx.sql_let(tx.sql_mark(t), "mark", found))


def _borders(key: str) -> bool:
    """Whether two occurrences of a key can overlap."""
    return any(key.startswith(key[i:]) for i in range(1, len(key)))


def _found_keys(keys: list[ContextKey]) -> str:
    """All occurrences of all keys in ``low``: ``array<struct<pos, key>>``, ``pos`` the offset behind the key, as SQL text.

    One regex pass, whatever the number of keys: at every place a look-ahead takes the
    longest key that begins there, from a prefix tree; the shorter keys beginning there are its prefixes, known
    beforehand. Marks and keys are put into the text, which split at the mark reads gap, key, gap, ...
    Of occurrences of one key that overlap the first counts; few keys can overlap themselves.
    """
    by_key: dict[str, list[ContextKey]] = {}
    for k in keys:
        by_key.setdefault(k.key, []).append(k)
    patterns = list(dict.fromkeys(k.pattern for k in keys))

    def about(k: ContextKey) -> str:
        return (
            f"named_struct('ord', {k.ord}, 'label', {tx.sql_literal(k.label)}, 'pattern', {patterns.index(k.pattern)}, "
            f"'window', {k.window}, 'length', {len(k.key)}, 'folds', {str(_borders(k.key)).lower()})"
        )

    # one literal list of keys; for each distinct text the numbers of those that begin with it
    flat = [k for same in by_key.values() for k in same]
    number: dict[str, list[int]] = {}
    for i, k in enumerate(flat):
        number.setdefault(k.key, []).append(i + 1)
    begins = {t: [i for n in range(1, len(t) + 1) for i in number.get(t[:n], [])] for t in by_key}
    texts = f"array({', '.join(tx.sql_literal(t) for t in begins)})"
    lists = f"array({', '.join('array(' + ', '.join(map(str, ns)) + ')' for ns in begins.values())})"
    infos = f"array({', '.join(about(k) for k in flat)})"
    tree = tx.sql_literal(f"(?={tx.any_of(list(by_key))})")
    pieces = f"split(regexp_replace(low, {tree}, concat(mark, '$1', mark)), mark, -1)"
    gaps = "transform(sequence(0, size(pieces) - 1, 2), g -> length(element_at(pieces, g + 1)))"
    at_place = (
        "transform(element_at(lists, int(array_position(texts, element_at(pieces, 2 * i)))), "
        "n -> named_struct('pos', element_at(starts, i + 1) + element_at(infos, n).length, 'key', element_at(infos, n)))"
    )
    found = tx.sql_let(tx.sql_running_totals(gaps), "starts", f"flatten(transform(sequence(1, size(starts) - 1), i -> {at_place}))")
    placed = f"CASE WHEN size(pieces) > 1 THEN {found} END"
    tables = tx.sql_let(texts, "texts", tx.sql_let(lists, "lists", tx.sql_let(infos, "infos", tx.sql_let(pieces, "pieces", placed))))
    if not any(_borders(t) for t in by_key):
        return tables
    none = "filter(hits, h -> false)"
    first = (
        "aggregate(filter(hits, h -> h.key.ord = o), named_struct('end', 0, 'kept', {none}), (a, h) -> "
        "CASE WHEN h.pos - h.key.length >= a.end THEN named_struct('end', h.pos, 'kept', concat(a.kept, array(h))) ELSE a END).kept"
    ).format(none=none)
    folding = "array_distinct(transform(filter(hits, h -> h.key.folds), h -> h.key.ord))"
    apart = f"concat(filter(hits, h -> NOT h.key.folds), flatten(transform({folding}, o -> {first})))"
    return tx.sql_let(tables, "hits", f"CASE WHEN exists(hits, h -> h.key.folds) THEN {apart} ELSE hits END")


def context_spans(text: str, keys: list[ContextKey]) -> Column:
    """First value match in the window after each occurrence of each keyword.

    Positions come from the lower-cased text and windows from the original one,
    which is sliced before the value is looked for. All keys are found in one pass.
    """
    keys = [k for k in keys if k.key]
    if not keys:
        return no_spans()
    t = f"`{text}`"
    patterns = list(dict.fromkeys(k.pattern for k in keys))
    exact, ascii_only = [tx.java_regex(p) for p in patterns], [tx.java_regex(p, True, True) for p in patterns]

    def by_pattern(regexes: list[str], of: Callable[[str], str]) -> str:
        cases = " ".join(f"WHEN {i} THEN {of(p)}" for i, p in enumerate(regexes))
        return f"CASE w.key.pattern {cases} END"

    def by_text(of: Callable[[str], str], of_exact: Callable[[str], str]) -> str:
        plain = "octet_length(w.text) = length(w.text)"
        return f"CASE WHEN {plain} THEN {by_pattern(ascii_only, of)} ELSE {by_pattern(exact, of_exact)} END"

    window = f"named_struct('pos', h.pos, 'key', h.key, 'text', {tx.sql_cut('chunks', 'h.pos', 'h.key.window')})"
    match = lambda p: f"regexp_extract(w.text, {tx.sql_literal(p)}, 0)"
    value = by_text(match, match)
    # the shortest lead before a match is the lead of the leftmost match; places in an ASCII text are those of Java
    lead = by_text(
        lambda p: f"greatest(regexp_instr(w.text, {tx.sql_literal(p)}) - 1, 0)",
        lambda p: f"length(regexp_extract(w.text, {tx.sql_literal(rf'\A([\s\S]*?)(?:{p})')}, 1))",
    )
    values = f"transform(transform(found, h -> {window}), w -> named_struct('start', w.pos + {lead}, 'text', {value}, 'key', w.key))"
    one_span = _sql_span(
        "f.start", "f.start + length(f.text)", "f.text", "f.key.label", "context", str(fixed.CONTEXT_SPECIFICITY), "f.key.ord"
    )
    spans = f"transform(filter({tx.sql_let(tx.sql_chunks(t), 'chunks', values)}, f -> f.text <> ''), f -> {one_span})"
    some = f"CASE WHEN found IS NULL THEN CAST(array() AS {NO_SPANS}) ELSE {spans} END"
    return F.expr(tx.sql_let(f"lower({t})", "low", tx.sql_let(tx.sql_let(tx.sql_mark("low"), "mark", _found_keys(keys)), "found", some)))


def recogniser_spans(text: Column, found: Column, catalog: Catalog) -> Column:
    """Spans of an entity recogniser, ``array<struct<start, end, label, score>>``.

    Spans without label or offset, empty ones and those not within the text are passed over.
    Labels become canonical; an ORG is more specific if a keyword stands in the
    ORG_KEYWORD_REACH characters before it or within it.
    """
    keyword = "|".join(tx.quoted(k) for k in fixed.ORG_KEYWORDS)
    reach = fixed.ORG_KEYWORD_REACH

    def one(pieces: Column, e: Column, i: Column) -> Column:
        begin = F.greatest(e["start"] - reach, F.lit(0))
        return tx.let(
            F.struct(
                catalog.canonical(e["label"]).alias("label"),
                tx.cut(pieces, e["start"], e["end"] - e["start"]).alias("text"),
                tx.cut(pieces, begin, e["start"] - begin).alias("before"),
            ),
            lambda v: span(
                e["start"], e["end"], v["text"], v["label"], "spacy",
                F.when(
                    (v["label"] == "ORG") & (F.lower(v["before"]).rlike(keyword) | F.lower(v["text"]).rlike(keyword)),
                    fixed.ORG_BOOSTED_SPECIFICITY,
                ).otherwise(fixed.NER_SPECIFICITY),
                i + NER_ORD, e["score"],
            ),
        )

    def fitting(length: Column) -> Column:
        return F.filter(found, lambda e: e.isNotNull() & span_fault(e["start"], e["end"], e["label"], length).isNull())

    spans = tx.let(
        F.struct(tx.chunks(text).alias("pieces"), tx.let(F.length(text), fitting).alias("found")),
        lambda v: F.transform(v["found"], lambda e, i: one(v["pieces"], e, i)),
    )
    return F.when(F.size(found) > 0, spans).otherwise(no_spans())


def detect(docs: DataFrame, catalog: Catalog, text: str = "text", ner: str | None = None) -> DataFrame:
    """Add ``spans``: regex, keyword and (if ``ner`` names such a column) recogniser spans."""
    parts = [text_spans(text, catalog.rules), context_spans(text, catalog.keys)]
    if ner:
        parts.append(recogniser_spans(F.col(text), F.col(ner), catalog))
    return docs.withColumn("spans", F.flatten(F.array(*parts)))


def span_rows(df: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
    """One row per span."""
    cols = ["start", "end", "text", "label", "source", "score", "specificity", "ord"]
    return tx.each(df, *keep, _s=F.col(spans)).select(*keep, *[F.col(f"_s.{c}") for c in cols])
