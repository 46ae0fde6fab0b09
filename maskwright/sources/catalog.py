"""Rule catalogs: regex rules, keyword-window rules and label synonyms.

A catalog is a few dozen rows of configuration. It is read once on the driver
and turned into literals of the plan, so that every pattern is compiled once
per task instead of once per row.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import java_regex, sql_literal
from maskwright.sources import fixed_values as fixed

log = logging.getLogger(__name__)

TEXT_RULE_SCHEMA = "label string, pattern string, specificity int"
CONTEXT_RULE_SCHEMA = "keys array<string>, window int, label string, value_regex string"

# Context keys follow all text rules in the tie-break order, recogniser spans follow both.
CONTEXT_ORD = 100_000
NER_ORD = 200_000


@dataclass(frozen=True)
class TextRule:
    ord: int
    label: str
    pattern: str
    specificity: int
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class ContextKey:
    """One keyword of a keyword-window rule."""

    ord: int
    key: str
    window: int
    label: str
    pattern: str


@dataclass(frozen=True)
class Catalog:
    rules: list[TextRule]
    keys: list[ContextKey]
    synonyms: dict[str, str] = field(default_factory=dict)

    def canonical(self, label: Column) -> Column:
        """Upper-cased label, mapped to its canonical name where it has one."""
        up = F.upper(label)
        if not self.synonyms:
            return up
        names = F.expr(f"map({', '.join(sql_literal(x) for kv in self.synonyms.items() for x in kv)})")
        return F.coalesce(F.try_element_at(names, up), up)


def _usable(pattern: str, label: str, spark: SparkSession | None = None) -> bool:
    """Whether a pattern compiles here and, asked of a session, in the executors' language too."""
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        log.warning("pattern of %s skipped: %s", label, e)
        return False
    if compiled.search("") or compiled.fullmatch(""):
        log.warning("pattern of %s skipped: it matches the empty text", label)
        return False
    try:
        for native in (True, False) if spark else ():
            spark.range(1).select(F.col("id").cast("string").rlike(java_regex(pattern, native))).collect()
    except (PySparkException, Py4JJavaError) as e:
        log.warning("pattern of %s skipped: %s", label, str(e).splitlines()[0])
        return False
    return True


def order_rules(rows: list[tuple[str, int | None, str]], spark: SparkSession | None = None) -> list[TextRule]:
    """Usable rules, most specific first; equal specificity keeps the file order."""
    usable = [(lab, fixed.DEFAULT_SPECIFICITY if spec is None else spec, pat) for lab, spec, pat in rows if _usable(pat, lab, spark)]
    if len(usable) > CONTEXT_ORD:
        raise ValueError(f"more than {CONTEXT_ORD} rules")
    ranked = sorted(usable, key=lambda r: -r[1])
    return [TextRule(i, lab, pat, spec, tuple(fixed.NEEDS.get(pat, ()))) for i, (lab, spec, pat) in enumerate(ranked)]


def flatten_keys(rows: list[tuple[str, int, list[str], str]], spark: SparkSession | None = None) -> list[ContextKey]:
    """One entry per keyword, in file order."""
    flat = [(key, win, lab, pat) for lab, win, keys, pat in rows if _usable(pat, lab, spark) for key in keys]
    if len(flat) > NER_ORD - CONTEXT_ORD:
        raise ValueError(f"more than {NER_ORD - CONTEXT_ORD} keywords")
    return [ContextKey(CONTEXT_ORD + i, key, win, lab, pat) for i, (key, win, lab, pat) in enumerate(flat)]


def invert_synonyms(canonical: dict[str, list[str]]) -> dict[str, str]:
    """Upper-cased name -> canonical label; a later entry wins."""
    out: dict[str, str] = {}
    for label, names in canonical.items():
        out.update({name.upper(): label for name in [*names, label]})
    return out


def default_catalog() -> Catalog:
    return Catalog(order_rules(fixed.TEXT_RULES), flatten_keys(fixed.CONTEXT_RULES), invert_synonyms(fixed.SYNONYMS))


def _read_json(spark: SparkSession, path: str, schema: str) -> list | None:
    """Rows of a small JSON file; None if it is absent, [] if it cannot be parsed."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True).collect()
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("%s not found, defaults are used", path)
        return None
    if any(r["_corrupt_record"] is not None for r in rows):
        log.error("%s cannot be parsed", path)
        return []
    return rows


def load_catalog(
    spark: SparkSession,
    rules_path: str | None = None,
    context_path: str | None = None,
    synonyms_path: str | None = None,
) -> Catalog:
    """The default catalog with any of its three parts replaced from JSON files."""
    base = default_catalog()
    rules, keys, synonyms = base.rules, base.keys, base.synonyms
    if rules_path and (rows := _read_json(spark, rules_path, TEXT_RULE_SCHEMA)) is not None:
        rules = order_rules([(r.label, r.specificity, r.pattern) for r in rows], spark)
    if context_path and (rows := _read_json(spark, context_path, CONTEXT_RULE_SCHEMA)) is not None:
        keys = flatten_keys([(r.label, r.window, r["keys"], r.value_regex) for r in rows], spark)
    if synonyms_path:
        try:
            text = spark.read.text(synonyms_path, wholetext=True)
            parsed = text.select(F.from_json("value", "map<string,array<string>>").alias("m"))
            pairs = parsed.select(F.posexplode_outer(F.map_entries("m"))).orderBy("pos").collect()
            synonyms = invert_synonyms({p.col.key: p.col.value for p in pairs if p.col is not None})
        except PySparkException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("%s not found, defaults are used", synonyms_path)
    return Catalog(rules, keys, synonyms)
