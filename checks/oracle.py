"""The same results in DuckDB SQL, written independently: windows and joins over exploded rows.

RE2 knows ASCII words only, so patterns run on a copy of the text whose accented
letters are replaced by an underscore (same length, still a word character).
"""

from __future__ import annotations

import re
from types import SimpleNamespace

from checks import standins as st
from checks.queries import (
    CAP_RATIO, CHUNK_WORDS, FACTOR, MIX, PIECE, PSEUDO_LIMIT, PSEUDO_TOKENS, READABLE, REGEX_KEYS, TOKENS_KEPT, rules_in_file_order,
)
from maskwright.functions.text import SPACE
from maskwright.plans.notes import NOTES_SQL
from maskwright.sources import fixed_values as fixed
from maskwright.sources.catalog import default_catalog

CATALOG = default_catalog()
WS = SPACE.replace(r"\x85", r"\x{85}")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_(ctes: dict[str, str], *names: str, final: str) -> str:
    """A query with the named CTEs and all they read, in order."""
    need: list[str] = []

    def add(name: str) -> None:
        if name in need:
            return
        for other in ctes:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", ctes[name]):
                add(other)
        need.append(name)

    for n in [*names, *[c for c in ctes if re.search(rf"\b(?:FROM|JOIN)\s+{c}\b", final)]]:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in need) + "\n" + final


MASK = "regexp_replace({}, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def regex_rows(source: str, keys: str, pattern: str, extra: str) -> str:
    """Matches of one pattern over ``source`` (keys, text, k)."""
    p = lit(pattern)
    lengths = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    start = lengths.format("g[1:i]") + " + " + lengths.format("e[1:i-1]")
    return f"""SELECT {keys}, CAST(p AS INT) AS start, CAST(p + n AS INT) AS "end", substr(text, p + 1, n) AS text, {extra} FROM (
      SELECT {keys}, text, CAST({start} AS BIGINT) AS p, length(e[i]) AS n FROM (
        SELECT {keys}, text, e, g, unnest(range(1, len(e) + 1)) AS i FROM (
          SELECT {keys}, text, regexp_extract_all(k, {p}) AS e, string_split_regex(k, {p}) AS g
          FROM {source} WHERE regexp_matches(k, {p}))))"""


def rule_rows(source: str, keys: str, rules) -> str:
    return "\nUNION ALL\n".join(
        regex_rows(source, keys, r.pattern, f"{lit(r.label)} AS label, 'regex' AS source, {r.specificity} AS specificity, {r.ord} AS ord")
        for r in rules
    )


def key_rows(source: str, keys: str, context_keys) -> str:
    def one(k) -> str:
        v, key = lit(k.pattern), lit(k.key)
        pos = f"coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + i * {len(k.key)}"
        return f"""SELECT {keys}, CAST(s AS INT) AS start, CAST(s + n AS INT) AS "end", substr(text, s + 1, n) AS text,
          {lit(k.label)} AS label, 'context' AS source, 85 AS specificity, {k.ord} AS ord FROM (
          SELECT {keys}, text, CAST(pos + length(string_split_regex(w, {v})[1]) AS BIGINT) AS s, length(regexp_extract(w, {v})) AS n FROM (
            SELECT {keys}, text, pos, substr(k, pos + 1, {k.window}) AS w FROM (
              SELECT {keys}, text, k, CAST({pos} AS BIGINT) AS pos FROM (
                SELECT {keys}, text, k, g, unnest(range(1, len(g))) AS i FROM (
                  SELECT {keys}, text, k, string_split(lower(text), {key}) AS g FROM {source} WHERE contains(lower(text), {key})))))
          WHERE regexp_matches(w, {v}))"""

    return "\nUNION ALL\n".join(one(k) for k in context_keys)


def found_rows(source: str, rules) -> str:
    return "\nUNION ALL\n".join(
        regex_rows(source, "doc_id", p, f"{lit(lab)} AS label, CAST(0.9 AS DOUBLE) AS score") for lab, p in rules
    )


SYN = "MAP {" + ", ".join(f"{lit(n.upper())}: {lit(lab)}" for n, lab in {n.upper(): lab for lab, names in fixed.SYNONYMS.items() for n in [*names, lab]}.items()) + "}"


def canonical(label: str) -> str:
    return f"coalesce({SYN}[upper({label})], upper({label}))"


KEYWORD = "(" + "|".join(fixed.ORG_KEYWORDS) + ")"
WORDS = f"'[^{WS}]+'"
STRIP = f"'^[{WS}]+|[{WS}]+$'"


def word_rows(source: str) -> str:
    return regex_rows(f"(SELECT doc_id, text, text AS k FROM {source})", "doc_id", f"[^{WS}]+", "i AS no").replace(
        "length(e[i]) AS n FROM", "length(e[i]) AS n, i FROM"
    )


def bio_rows(words: str, spans: str) -> str:
    """Words with tags: first word of a span B, others I, later spans win; then repaired."""
    return f"""SELECT doc_id, no, word, CASE WHEN raw = 'O' THEN 'O'
        WHEN raw LIKE 'I-%' AND NOT coalesce(prev <> 'O' AND substr(prev, 3) = substr(raw, 3), false) THEN 'B-' || substr(raw, 3) ELSE raw END AS tag
      FROM (SELECT doc_id, no, word, raw, lag(raw) OVER (PARTITION BY doc_id ORDER BY no) AS prev FROM (
        SELECT w.doc_id, w.no, w.text AS word, coalesce(arg_max(h.tag, h.turn), 'O') AS raw
        FROM {words} w LEFT JOIN (
          SELECT doc_id, no, turn, CASE WHEN no = min(no) OVER (PARTITION BY doc_id, turn) THEN 'B-' ELSE 'I-' END || label AS tag
          FROM (SELECT w.doc_id, w.no, s.turn, s.label FROM {words} w
                JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, start) AS turn FROM {spans}) s
                ON w.doc_id = s.doc_id AND w.start < s."end" AND w."end" > s.start)) h
        ON w.doc_id = h.doc_id AND w.no = h.no GROUP BY 1, 2, 3))"""


def sanitized(source: str) -> str:
    """Repair of ``(sent_id, no, word, tag)``; tags may be untyped."""
    prefix = lambda t: f"CASE WHEN contains({t}, '-') THEN split_part({t}, '-', 1) ELSE 'B' END"
    typ = lambda t: f"CASE WHEN contains({t}, '-') THEN substr({t}, instr({t}, '-') + 1) ELSE {t} END"
    return f"""SELECT * EXCLUDE (tag, prev), CASE WHEN tag = 'O' THEN tag ELSE
        CASE WHEN {prefix('tag')} = 'I' AND NOT coalesce(prev <> 'O' AND {prefix('prev')} IN ('B', 'I') AND {typ('prev')} = {typ('tag')}, false)
             THEN 'B' ELSE {prefix('tag')} END || '-' || {typ('tag')} END AS tag
      FROM (SELECT *, lag(tag) OVER (PARTITION BY sent_id ORDER BY no) AS prev FROM {source})"""


def merged(person: bool, address: bool) -> str:
    """Islands of winners joined by a short gap."""
    strip_gap = f"regexp_replace(gap, {STRIP}, '', 'g')"
    tests = []
    if person:
        tests.append(
            "(pl = 'PERSON' AND label = 'PERSON' AND (regexp_matches(gap, '^[ .''-]*\\n?$') "
            f"OR (length(gap) < 7 AND regexp_full_match({strip_gap}, '[a-zß-öø-ÿ]+'))))"
        )
    if address:
        tests.append(
            "(pl IN ('ADDRESS_LINE', 'LOCATION') AND label IN ('ADDRESS_LINE', 'LOCATION') AND length(gap) < 5 "
            f"AND regexp_full_match(gap, '[,{WS}]*'))"
        )
    return f"""SELECT doc_id, min(start) AS start, max("end") AS "end", max(specificity) AS specificity,
        CASE WHEN bool_or(label = 'ADDRESS_LINE') THEN 'ADDRESS_LINE' ELSE min(label) END AS label,
        first(score ORDER BY start) AS score, any_value(body) AS body FROM (
      SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM (
        SELECT *, coalesce({' OR '.join(tests)}, false) AS joins FROM (
          SELECT *, substr(body, pe + 1, start - pe) AS gap FROM (
            SELECT k.*, n.text AS body, lag(k."end") OVER w AS pe, lag(k.label) OVER w AS pl FROM kept k JOIN notes n USING (doc_id)
            WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.start)))))
      GROUP BY doc_id, run"""


def tag_case(tags: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(word, {lit(p)}) THEN {lit(t)}" for t, p in tags) + " ELSE 'O' END"


def splits(source: str, val: float, test: float, strata: str = "0") -> str:
    """Splits by md5 rank; sizes ceil(n * test), then ceil(rest * val / (1 - test)), apportioned to strata."""
    def draw(left: str, ratio: float, src: str) -> str:
        total = f"sum({left}) OVER ()"
        return f"""SELECT * EXCLUDE (exact, train), CAST(floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, s)
            <= train - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS keep_{left} FROM (
            SELECT *, {left} / {total} * train AS exact FROM (SELECT *, {total} - ceil({total} * {ratio!r}::DOUBLE) AS train FROM ({src})))"""

    sizes = draw("keep_n", val / (1.0 - test), draw("n", test, f"SELECT {strata} AS s, count(*) AS n FROM {source} GROUP BY 1"))
    return f"""SELECT r.* EXCLUDE (s, rn), CASE WHEN rn <= z.n - z.keep_n THEN 'test' WHEN rn <= z.n - z.keep_keep_n THEN 'validation' ELSE 'train' END AS split
      FROM (SELECT *, {strata} AS s, row_number() OVER (PARTITION BY {strata} ORDER BY md5('{st.SEED}' || CAST(sent_id AS VARCHAR))) AS rn FROM {source}) r
      JOIN ({sizes}) z ON r.s = z.s"""


def mix(table: str, include_pseudo: str, number: str, name: str) -> str:
    """Capped, repeated and augmented PII and pseudo rows, as one ordered list."""
    f = MIX["factor"]
    order = f"SELECT *, row_number() OVER (ORDER BY turn, sent_id) AS rn, count(*) OVER () AS n FROM ({table} {include_pseudo})"
    copies = f"SELECT *, unnest(range(0, {int(f)} + CASE WHEN rn <= CAST(floor(n * {f - int(f)!r}) AS BIGINT) THEN 1 ELSE 0 END)) AS copy FROM ({order})"
    cols = "corpus, sent_id, CAST(copy AS INT) AS copy"
    return f"""SELECT {number} AS {name}, {cols}, false AS augmented, true AS is_pii, tokens, labels FROM ({copies})
      UNION ALL SELECT {number}, {cols}, true, true, {SWAP.format('tokens')}, labels FROM ({copies}) WHERE regexp_matches(labels, '[^O ]')"""


ACC_LOW, ACC_UP = "àáâäãçèéêëìíîïñòóôöõùúûü", "ÀÁÂÄÃÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜ"
SWAP = "replace(translate({}, " + lit("abcdefghijklmnopqrstuvwxyz" + ACC_LOW + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ACC_UP) + ", " + lit(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ACC_UP + "abcdefghijklmnopqrstuvwxyz" + ACC_LOW
) + "), 'ß', 'SS')"

TAGS = "string_agg(tag, ' ' ORDER BY no) AS labels"
TOKENS = "string_agg(word, ' ' ORDER BY no) AS tokens"

CTES = {
    "notes": NOTES_SQL,
    "turns": "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations",
    "texts": "SELECT 'notes' AS src, doc_id, text FROM notes UNION ALL SELECT 'documents', doc_id, text FROM documents",
    "masked": f"SELECT src, doc_id, text, {MASK.format('text')} AS k FROM texts",
    "masked_notes": f"SELECT doc_id, text, {MASK.format('text')} AS k FROM notes",
    "masked_documents": f"SELECT doc_id, text, {MASK.format('text')} AS k FROM documents",
    "masked_turns": f"SELECT doc_id, text, {MASK.format('text')} AS k FROM turns",
    "ner": found_rows("masked_notes", st.NER_RULES),
    "recognised": f"""SELECT doc_id, start, "end", text, label, 'spacy' AS source, score, CASE WHEN label = 'ORG' AND
        (regexp_matches(before, {lit(KEYWORD)}) OR regexp_matches(lower(text), {lit(KEYWORD)})) THEN 80 ELSE 60 END AS specificity,
        200000 AS ord FROM (SELECT r.doc_id, r.start, r."end", r.text, {canonical('r.label')} AS label, r.score,
          lower(substr(n.text, greatest(r.start - 20, 0) + 1, r.start - greatest(r.start - 20, 0))) AS before
        FROM ner r JOIN notes n USING (doc_id))""",
    "candidates": f"""SELECT doc_id, start, "end", text, label, source, specificity, ord, CAST(NULL AS DOUBLE) AS score FROM ({rule_rows('masked_notes', 'doc_id', CATALOG.rules)})
      UNION ALL SELECT doc_id, start, "end", text, label, source, specificity, ord, NULL FROM ({key_rows('masked_notes', 'doc_id', CATALOG.keys)})
      UNION ALL SELECT doc_id, start, "end", text, label, source, specificity, ord, score FROM recognised""",
    "grouped": """SELECT *, sum(CASE WHEN pm IS NULL OR start >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, ord) AS grp
      FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM candidates)""",
    "winner": """SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY doc_id, grp ORDER BY specificity DESC, "end" - start DESC, start, "end" DESC, ord) = 1""",
    "kept": f"SELECT * FROM winner WHERE NOT (upper(label) = 'ORG' AND regexp_replace(lower(text), {STRIP}, '', 'g') IN ('nric', 'cvc', 'ssn', 'iban'))",
    "final_rows": f"SELECT doc_id, start, \"end\", substr(body, start + 1, \"end\" - start) AS text, label, specificity, score, start AS ord FROM ({merged(True, True)})",
    "shown": f"SELECT * FROM (SELECT doc_id, start, \"end\", text, {canonical('label')} AS label, score FROM final_rows) WHERE label <> 'IGNORE'",
    "marks": """SELECT *, '***[' || label || '#' || CAST(number AS VARCHAR) || ']***' AS placeholder FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, label ORDER BY start) AS INT) AS number FROM shown)""",
    "rewritten": """SELECT n.doc_id, coalesce(r.head || substr(n.text, r.last + 1), n.text) AS redacted_text FROM notes n LEFT JOIN (
      SELECT doc_id, string_agg(gap || placeholder, '' ORDER BY start) AS head, max("end") AS last FROM (
        SELECT m.*, substr(n.text, coalesce(lag(m."end") OVER w, 0) + 1, m.start - coalesce(lag(m."end") OVER w, 0)) AS gap
        FROM marks m JOIN notes n USING (doc_id) WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.start)) GROUP BY doc_id) r USING (doc_id)""",
    "entities": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) AS INT) AS entity_no, label AS type, placeholder,
      CASE WHEN length(text) > 10 THEN substr(text, 1, 10) || '...' ELSE text END AS value_preview, score AS confidence, text FROM marks""",
    # the documents table: e-mail and name rules and all others, without recogniser
    "doc_candidates": f"""SELECT doc_id, start, "end", text, label, specificity, ord, CAST(NULL AS DOUBLE) AS score FROM ({rule_rows('masked_documents', 'doc_id', CATALOG.rules)})
      UNION ALL SELECT doc_id, start, "end", text, label, specificity, ord, NULL FROM ({key_rows('masked_documents', 'doc_id', CATALOG.keys)})""",
    "note_words": word_rows("notes"),
    "tagged": bio_rows("note_words", "final_rows").replace("SELECT doc_id, no, word, CASE WHEN raw", "SELECT doc_id AS sent_id, no, word, CASE WHEN raw", 1),
    "damaged": """SELECT sent_id, no, word, CASE WHEN (sent_id + no - 1) % 7 = 0 AND tag <> 'O' THEN substr(tag, 3)
      WHEN (sent_id + no - 1) % 3 = 0 AND tag LIKE 'B-%' THEN 'I-' || substr(tag, 3) ELSE tag END AS tag FROM tagged""",
    "gen_words": f"SELECT doc_id, i AS no, e[i] AS text FROM (SELECT doc_id, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {WORDS}) AS e FROM documents))",
    "gen": f"SELECT doc_id AS sent_id, no, text AS word, {tag_case([(t, p) for t, p in st.GENERAL_TAGS]).replace('word', 'text')} AS tag FROM gen_words",
    "turn_spans": f"SELECT *, start AS ord FROM ({found_rows('masked_turns', st.PSEUDO_RULES)}) WHERE label IN ({', '.join(map(lit, st.PSEUDO_GROUPS))})",
    "turn_words": word_rows("turns"),
    "pseudo_rows": bio_rows("turn_words", "turn_spans").replace("SELECT doc_id, no, word, CASE WHEN raw", "SELECT doc_id AS sent_id, no, word, CASE WHEN raw", 1),
    "pii_sents": f"SELECT sent_id, {TOKENS}, {TAGS} FROM tagged GROUP BY 1",
    "pseudo_sents": f"SELECT sent_id, count(*) AS n_tokens, {TOKENS}, {TAGS} FROM pseudo_rows GROUP BY 1",
    "gen_sents": f"SELECT sent_id, {TOKENS}, {TAGS} FROM gen GROUP BY 1",
    "gen_all": "SELECT d.doc_id AS sent_id, coalesce(g.tokens, '') AS tokens, coalesce(g.labels, '') AS labels FROM documents d LEFT JOIN gen_sents g ON d.doc_id = g.sent_id",
    "pii_split": splits("pii_sents", st.VAL, st.TEST),
    "gen_split": splits("gen_all", st.VAL, st.TEST),
    "held_out": """SELECT 'pii_' || CASE split WHEN 'validation' THEN 'val' ELSE split END AS eval_set, sent_id, labels FROM pii_split WHERE split <> 'train'
      UNION ALL SELECT 'conll_' || CASE split WHEN 'validation' THEN 'valid' ELSE split END, sent_id, labels FROM gen_split WHERE split <> 'train'""",
    "held_out_tags": "SELECT eval_set, eval_set || ':' || CAST(sent_id AS VARCHAR) AS sent_id, sent_id AS sid, no, t[no] AS tag FROM (SELECT *, unnest(range(1, len(t) + 1)) AS no FROM (SELECT *, string_split(labels, ' ') AS t FROM held_out WHERE labels <> ''))",
    "true_tags": sanitized("held_out_tags"),
    "pred_tags": """SELECT eval_set, sent_id, sid, no, CASE WHEN (sid + no - 1) % 7 = 0 THEN 'O' WHEN (sid + no - 1) % 11 = 0 THEN 'B-MISC'
      WHEN (sid + no - 1) % 13 = 0 AND tag <> 'O' THEN 'I-PERSON' ELSE tag END AS tag FROM true_tags""",
}


def entities_of(source: str) -> str:
    """Lenient B/I/O entities: a run of one type without a B inside."""
    return f"""SELECT eval_set, sid, typ AS type, CAST(min(no) - 1 AS INT) AS start, CAST(max(no) - 1 AS INT) AS "end" FROM (
      SELECT *, sum(opens) OVER (PARTITION BY sent_id ORDER BY no) AS run FROM (
        SELECT *, CASE WHEN tag LIKE 'B-%' OR prev IS NULL OR prev = 'O' OR substr(prev, 3) <> typ THEN 1 ELSE 0 END AS opens FROM (
          SELECT *, substr(tag, 3) AS typ, lag(tag) OVER (PARTITION BY sent_id ORDER BY no) AS prev FROM {source})
        WHERE tag <> 'O'))
      GROUP BY eval_set, sent_id, sid, typ, run"""


CTES["true_ents"] = entities_of("true_tags")
CTES["pred_ents"] = entities_of("pred_tags")
CTES["counted"] = """SELECT coalesce(t.eval_set, p.eval_set) AS eval_set, coalesce(t.type, p.type) AS entity_type,
  count(t.type) AS t, count(p.type) AS p, count(CASE WHEN t.type IS NOT NULL AND p.type IS NOT NULL THEN 1 END) AS h
  FROM true_ents t FULL JOIN pred_ents p ON t.eval_set = p.eval_set AND t.sid = p.sid AND t.type = p.type AND t.start = p.start AND t."end" = p."end"
  GROUP BY 1, 2"""


def scored(source: str) -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM (
      SELECT *, CASE WHEN p > 0 THEN h / p ELSE 0.0::DOUBLE END AS precision, CASE WHEN t > 0 THEN h / t ELSE 0.0::DOUBLE END AS recall FROM {source})"""


CTES["scores"] = scored("counted")
CTES["report_rows"] = f"""SELECT eval_set, entity_type, precision, recall, f1, CAST(NULL AS DOUBLE) AS macro_f1 FROM scores
  UNION ALL SELECT eval_set, 'overall', precision, recall, f1, round(macro_f1, 9) FROM ({scored('(SELECT eval_set, sum(t) AS t, sum(p) AS p, sum(h) AS h, avg(f1) AS macro_f1 FROM scores GROUP BY 1)')})"""
LABEL_RANK = """CASE WHEN label = 'O' THEN 0 ELSE 1 END, CASE WHEN label = 'O' THEN '' WHEN contains(label, '-') THEN substr(label, instr(label, '-') + 1) ELSE label END,
  CASE WHEN label = 'O' OR label LIKE 'B-%' OR NOT contains(label, '-') THEN 0 ELSE 1 END, label"""
CTES["pii_vocab"] = f"SELECT label, CAST(row_number() OVER (ORDER BY {LABEL_RANK}) - 1 AS INT) AS id FROM (SELECT DISTINCT tag AS label FROM tagged UNION SELECT 'O')"
CTES["union_vocab"] = f"SELECT label, CAST(row_number() OVER (ORDER BY {LABEL_RANK}) - 1 AS INT) AS id FROM (SELECT tag AS label FROM tagged UNION SELECT tag FROM gen UNION SELECT tag FROM pseudo_rows UNION SELECT 'O')"
CTES["limited"] = f"""SELECT * FROM (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (ORDER BY sent_id) - 1 AS rows_before FROM pseudo_sents) WHERE rows_before < {PSEUDO_LIMIT} AND before < {PSEUDO_TOKENS}"""
CTES["train"] = "SELECT sent_id, tokens, labels FROM pii_split WHERE split = 'train'"
CTES["base"] = "SELECT count(*) AS n FROM train"
for _name, _src, _ratio in (("pseudo_capped", "pseudo_sents", MIX["pseudo_ratio"]), ("gen_capped", "gen_all", MIX["general_ratio"])):
    CTES[_name] = f"""SELECT sent_id, tokens, labels FROM (SELECT *, row_number() OVER (ORDER BY sent_id) AS rn FROM {_src})
      WHERE rn <= (SELECT CASE WHEN floor(n * {_ratio!r}::DOUBLE) > 0 THEN floor(n * {_ratio!r}::DOUBLE) ELSE 1e18 END FROM base)"""
_PII = "SELECT 'pii' AS corpus, 1 AS turn, sent_id, tokens, labels FROM train"
_PSEUDO = "UNION ALL SELECT 'pseudo', 2, sent_id, tokens, labels FROM pseudo_capped"
_GEN = "SELECT {} AS {}, 'conll' AS corpus, sent_id, 0 AS copy, false AS augmented, false AS is_pii, tokens, labels FROM gen_capped"


def damaged_ctes() -> dict[str, str]:
    """The CTEs with recogniser spans damaged by document, and what is left of them."""
    hurt = """SELECT CASE doc_id % 9 WHEN 7 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, text, score,
      CAST(CASE doc_id % 9 WHEN 1 THEN -start - 1 WHEN 2 THEN NULL ELSE start END AS INT) AS start,
      CAST(CASE doc_id % 9 WHEN 3 THEN start WHEN 4 THEN "end" + 100000 WHEN 5 THEN NULL ELSE "end" END AS INT) AS "end",
      CASE doc_id % 9 WHEN 6 THEN NULL ELSE label END AS label FROM ner_found"""
    judged = f"""SELECT h.*, CASE WHEN n.doc_id IS NULL THEN 'no such document' WHEN start IS NULL OR "end" IS NULL THEN 'no offset'
      WHEN label IS NULL THEN 'no label' WHEN start < 0 THEN 'before the text' WHEN "end" <= start THEN 'empty'
      WHEN "end" > length(n.text) THEN 'beyond the text' END AS reason FROM ({hurt}) h LEFT JOIN notes n ON h.doc_id = n.doc_id"""
    return CTES | {"ner_found": CTES["ner"], "ner_damaged": judged, "ner": "SELECT * EXCLUDE (reason) FROM ner_damaged WHERE reason IS NULL"}


def oracle_sql() -> dict[str, str]:
    damaged = damaged_ctes()
    q = lambda final: with_(CTES, final=final)
    span = 'doc_id, start, "end", text, label, specificity'
    few = 'src, doc_id, start, "end", text, label, specificity'
    regex = {k: f"SELECT {few} FROM ({rule_rows('masked', 'src, doc_id', [r])})" for k, r in zip(REGEX_KEYS, rules_in_file_order())}
    by_label = {lab: [k for k in CATALOG.keys if k.label == lab] for lab in dict.fromkeys(k.label for k in CATALOG.keys)}
    # order, flattening and inversion of the catalogs are done in SQL, from the values in file order
    in_file = [SimpleNamespace(ord=i, label=lab, pattern=p, specificity=n) for i, (lab, n, p) in enumerate(fixed.TEXT_RULES)]
    rules = ", ".join(f"({r.ord}, {lit(r.label)}, {lit(r.pattern)}, {r.specificity})" for r in in_file)
    ranked = f"SELECT *, CAST(row_number() OVER (ORDER BY specificity DESC, pos) - 1 AS INT) AS ord FROM (VALUES {rules}) v(pos, label, pattern, specificity)"
    key_lists = ", ".join(f"({i}, {lit(lab)}, {win}, {lit(p)}, [{', '.join(map(lit, ks))}])" for i, (lab, win, ks, p) in enumerate(fixed.CONTEXT_RULES))
    flat_keys = f"""SELECT CAST(100000 + row_number() OVER (ORDER BY pos, i) - 1 AS INT) AS ord, ks[i] AS key, win, label, value_regex FROM (
      SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM (VALUES {key_lists}) v(pos, label, win, value_regex, ks))"""
    synonym_lists = ", ".join(f"({i}, {lit(lab)}, [{', '.join(map(lit, [*names, lab]))}])" for i, (lab, names) in enumerate(fixed.SYNONYMS.items()))
    inverted = f"""SELECT upper(name) AS synonym, arg_max(label, pos) AS canonical FROM (
      SELECT pos, label, unnest(names) AS name FROM (VALUES {synonym_lists}) v(pos, label, names)) GROUP BY 1"""
    vocab_tags = lambda col: f"SELECT sent_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY no) AS {col} FROM tagged JOIN pii_vocab ON tag = label GROUP BY 1"
    out = {
        "docs_valid": "SELECT doc_id, text FROM documents WHERE length(text) >= 1",
        "rule_catalog": q(f"""SELECT v.ord, v.label, v.pattern, v.specificity, count(s.ord) AS n_spans FROM ({ranked}) v
          LEFT JOIN ({rule_rows('masked', 'src, doc_id', in_file)}) s ON v.pos = s.ord GROUP BY ALL"""),
        "catalog_files": q(f"""SELECT v.ord, v.label, v.specificity, count(s.ord) AS n_spans FROM ({ranked}) v
          LEFT JOIN ({rule_rows('masked', 'src, doc_id', in_file)}) s ON v.pos = s.ord GROUP BY v.ord, v.label, v.specificity, v.pattern"""),
        "context_catalog": q(f"""SELECT v.ord, v.key, v.win AS "window", v.label, v.value_regex, count(s.ord) AS n_spans FROM ({flat_keys}) v
          LEFT JOIN ({key_rows('masked', 'src, doc_id', CATALOG.keys)}) s ON v.ord = s.ord GROUP BY ALL"""),
        "label_synonyms": q(f"""SELECT v.synonym, v.canonical, count(s.label) AS n_spans FROM ({inverted}) v
          LEFT JOIN ner s ON v.synonym = upper(s.label) GROUP BY ALL"""),
        "tagged_corpus_load": q(f"SELECT tokens, labels FROM (SELECT sent_id, {TOKENS}, {TAGS} FROM ({sanitized('damaged')}) GROUP BY 1) WHERE sent_id % 11 <> 0"),
        "conll_load": q(f"""SELECT 'train' AS split, {TOKENS}, {TAGS} FROM damaged GROUP BY sent_id
          UNION ALL SELECT 'validation', tokens, labels FROM gen_sents"""),
        "paragraph_chunks": f"""SELECT doc_id, CAST(p - 1 AS INT) AS para_no, CAST(c AS INT) AS chunk_no, array_to_string(w[c * {CHUNK_WORDS} + 1:(c + 1) * {CHUNK_WORDS}], ' ') AS text,
            CAST(len(w[c * {CHUNK_WORDS} + 1:(c + 1) * {CHUNK_WORDS}]) AS INT) AS n_words FROM (
          SELECT doc_id, p, w, unnest(range(0, CAST(ceil(len(w) / {CHUNK_WORDS}) AS BIGINT))) AS c FROM (
            SELECT doc_id, p, regexp_extract_all(paras[p], {WORDS}) AS w FROM (
              SELECT doc_id, paras, unnest(range(1, len(paras) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS paras FROM documents))))""",
        "ner_spans_rejected": with_(damaged, final="SELECT doc_id, start, \"end\", label, reason FROM ner_damaged WHERE reason IS NOT NULL"),
        "redact_damaged_spans": with_(damaged, final="SELECT doc_id, redacted_text FROM rewritten"),
        "ner_spans_in": q('SELECT doc_id, start, "end", label, score FROM ner'),
        "sink_labels": q("SELECT label, id FROM union_vocab"),
        "sink_labels_all": q("SELECT unnest(['labels', 'label2id', 'id2label']) AS sink, id, label FROM union_vocab"),
        "sink_metrics": q("SELECT * FROM report_rows"),
        "regex_spans": q(f"SELECT {few} FROM ({rule_rows('masked', 'src, doc_id', CATALOG.rules)})"),
        "context_spans": q(f"SELECT {few} FROM ({key_rows('masked', 'src, doc_id', CATALOG.keys)})"),
        "ner_label_normalise": q('SELECT doc_id, start, "end", text, label, score FROM recognised'),
        "synonym_table": """SELECT o_orderkey, coalesce(c_mktsegment, upper(label)) AS label FROM (
          SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'client#' ELSE 'customer#' END || lpad(o_custkey::VARCHAR, 9, '0') AS label FROM orders)
          LEFT JOIN customer ON upper(c_name) = upper(label)""",
        "org_context_boost": q("SELECT doc_id, start, \"end\", text, specificity FROM recognised WHERE label = 'ORG'"),
        "all_spans": q('SELECT doc_id, start, "end", text, label, source, specificity FROM candidates'),
        "span_order": q('SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, ord) AS INT) AS rank, start, "end", label, specificity FROM candidates'),
        "overlap_groups": q('SELECT doc_id, CAST(grp AS INT) AS group_no, start, "end", label, specificity FROM grouped'),
        "overlap_winner": q('SELECT doc_id, start, "end", label, source, specificity FROM winner'),
        "false_positive_filter": q('SELECT doc_id, start, "end", label, source, specificity FROM kept'),
        "merge_person": q(f'SELECT doc_id, start, "end", substr(body, start + 1, "end" - start) AS text, label, specificity FROM ({merged(True, False)})'),
        "merge_address": q(f'SELECT doc_id, start, "end", substr(body, start + 1, "end" - start) AS text, label, specificity FROM ({merged(False, True)})'),
        "final_spans": q(f"SELECT {span} FROM final_rows"),
        "span_funnel": q("""SELECT n.doc_id, coalesce(c.n, 0) AS n_candidates, coalesce(f.n, 0) AS n_final FROM notes n
          LEFT JOIN (SELECT doc_id, count(*) AS n FROM candidates GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM final_rows GROUP BY 1) f USING (doc_id)"""),
        "span_funnel_total": q("SELECT (SELECT count(*) FROM notes) AS n_docs, (SELECT count(*) FROM candidates) AS n_candidates, (SELECT count(*) FROM final_rows) AS n_final"),
        "canonical_label": q(f'SELECT doc_id, start, "end", label, {canonical("label")} AS canonical FROM final_rows'),
        "drop_ignore": q('SELECT doc_id, start, "end", label FROM shown'),
        "placeholder_number": q("SELECT doc_id, start, label, number FROM marks"),
        "placeholder_format": q("SELECT doc_id, start, placeholder FROM marks"),
        "redact_text": q("SELECT doc_id, redacted_text FROM rewritten"),
        "redact_bucketed": q("SELECT doc_id, redacted_text FROM rewritten"),
        "redact_span_stream": q("SELECT doc_id, redacted_text FROM rewritten"),
        "entity_rows": q("SELECT doc_id, entity_no, type, placeholder, value_preview, confidence FROM entities"),
        "placeholder_map": q("SELECT doc_id, placeholder, text AS original FROM marks"),
        "redaction_response": q("""SELECT r.doc_id, r.redacted_text, coalesce(m.placeholders, '') AS placeholders, coalesce(m.n, 0) AS n_entities, coalesce(m.n, 0) AS n_map
          FROM rewritten r LEFT JOIN (SELECT doc_id, string_agg(placeholder, ',' ORDER BY start) AS placeholders, count(*) AS n FROM marks GROUP BY 1) m USING (doc_id)"""),
        "entity_reveal": q("""SELECT doc_id, entity_no, replace(type, '_', ' ') AS entity_type, CASE WHEN length(v) > 32 THEN substr(v, 1, 32) || '…' ELSE v END AS shown
          FROM (SELECT *, CASE WHEN contains(placeholder, 'PHONE_SG') THEN value_preview ELSE text END AS v FROM entities)"""),
        "entity_counts": q("SELECT n.doc_id, count(m.doc_id) AS n_entities FROM notes n LEFT JOIN marks m ON n.doc_id = m.doc_id GROUP BY 1"),
        "size_class": """SELECT doc_id, CASE WHEN u > 10000 THEN 'over-limit' WHEN u > 9000 THEN 'near-limit' ELSE 'ok' END AS size_class
          FROM (SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS u FROM documents)""",
        "sanitize_bio": q(f"SELECT sent_id, {TOKENS}, {TAGS} FROM ({sanitized('damaged')}) GROUP BY 1"),
        "label_order": q(f"SELECT CAST(row_number() OVER (ORDER BY {LABEL_RANK}) AS INT) AS rank, label FROM (SELECT DISTINCT tag AS label FROM damaged)"),
        "label_vocab": q("SELECT label, id FROM union_vocab"),
        "encode_labels": q(vocab_tags("ner_tags")),
        "has_pii_flag": q("SELECT sent_id, bool_or(tag <> 'O') AS has_pii FROM tagged GROUP BY 1"),
        "spans_to_bio": q("SELECT sent_id, tokens, labels FROM pii_sents"),
        "interval_tags": q("SELECT sent_id, CAST(no AS BIGINT) AS no, word, tag FROM tagged"),
        "split_random": q("SELECT sent_id, split FROM pii_split"),
        "pseudo_label_filter": q("SELECT sent_id, tokens, labels FROM pseudo_sents"),
        "pseudo_label_limit": q("SELECT sent_id, CAST(n_tokens AS INT) AS n_tokens FROM limited"),
        "pseudo_label_rows": q(f"SELECT sent_id, tokens, labels FROM pseudo_sents ORDER BY sent_id LIMIT {PSEUDO_LIMIT}"),
        "pseudo_label_stats": q("""SELECT (SELECT count(*) FROM turns) AS processed_docs, count(*) AS emitted_rows,
          CAST(sum(CASE WHEN sent_id IN (SELECT doc_id FROM turn_spans) THEN 0 ELSE 1 END) AS BIGINT) AS empty_entities, CAST(sum(n_tokens) AS BIGINT) AS total_tokens FROM limited"""),
        "cap_by_ratio": q(f"""SELECT d.sent_id, CAST(CASE WHEN tokens = '' THEN 0 ELSE len(string_split(tokens, ' ')) END AS INT) AS n_tokens
          FROM (SELECT *, row_number() OVER (ORDER BY sent_id) AS rn FROM gen_all) d WHERE rn <= (SELECT floor(count(*) * {CAP_RATIO}) FROM conversations)"""),
        "oversample": q(f"""SELECT sent_id, CAST(unnest(range(0, {int(FACTOR)} + CASE WHEN rn <= floor(n * {FACTOR - int(FACTOR)}) THEN 1 ELSE 0 END)) AS INT) AS copy, tokens
          FROM (SELECT *, row_number() OVER (ORDER BY sent_id) AS rn, count(*) OVER () AS n FROM pii_sents)"""),
        "augment_swapcase": q(f"""SELECT sent_id, false AS augmented, tokens, labels FROM pii_sents
          UNION ALL SELECT sent_id, true, {SWAP.format('tokens')}, labels FROM pii_sents WHERE regexp_matches(labels, '[^O ]')"""),
        "joint_mix": q(f"{mix(_PII, '', '1', 'phase')} UNION ALL {mix(_PII, _PSEUDO, '2', 'phase')} UNION ALL {_GEN.format(1, 'phase')} UNION ALL {_GEN.format(2, 'phase')}"),
        "sequential_mix": q(f"{mix(_PII, _PSEUDO, '2', 'stage')} UNION ALL {_GEN.format(1, 'stage')}"),
        "align_subwords": q(f"""SELECT sent_id, '-100 ' || string_agg(CAST(id AS VARCHAR) || repeat(' -100', CAST(ceil(length(word) / {PIECE}) AS INT) - 1), ' ' ORDER BY no) || ' -100' AS aligned
          FROM tagged JOIN pii_vocab ON tag = label GROUP BY 1"""),
        "truncate_tokens": q(f"SELECT sent_id, {TOKENS}, {TAGS} FROM tagged WHERE no <= {TOKENS_KEPT} GROUP BY 1"),
        "split_sizes": q("SELECT 'pii' AS corpus, split, count(*) AS n_rows FROM pii_split GROUP BY 2 UNION ALL SELECT 'conll', split, count(*) FROM gen_split GROUP BY 2"),
        "split_table": q("""SELECT corpus, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation,
          count(*) FILTER (split = 'test') AS test, count(*) AS total FROM (SELECT 'pii' AS corpus, split FROM pii_split UNION ALL SELECT 'conll', split FROM gen_split) GROUP BY 1"""),
        "eval_sets": q("SELECT eval_set, sent_id, eval_set LIKE 'pii%' AS is_pii, CAST(CASE WHEN labels = '' THEN 0 ELSE len(string_split(labels, ' ')) END AS INT) AS n_tokens FROM held_out"),
        "decode_predictions": q("""SELECT h.eval_set, h.sent_id, coalesce(t.true_tags, '') AS true_tags, coalesce(t.pred_tags, '') AS pred_tags FROM held_out h LEFT JOIN (
          SELECT t.eval_set, t.sid, string_agg(t.tag, ' ' ORDER BY t.no) AS true_tags, string_agg(p.tag, ' ' ORDER BY t.no) AS pred_tags
          FROM true_tags t JOIN pred_tags p ON t.sent_id = p.sent_id AND t.no = p.no WHERE (t.no - 1) % 5 <> 4 GROUP BY 1, 2) t ON h.eval_set = t.eval_set AND h.sent_id = t.sid"""),
        "bio_entities": q('SELECT eval_set, sid AS sent_id, type, start, "end" FROM pred_ents'),
        "ner_scores_overall": q(f"SELECT precision, recall, f1 FROM ({scored('(SELECT sum(t) AS t, sum(p) AS p, sum(h) AS h FROM counted)')})"),
        "ner_scores_by_type": q(f"SELECT entity_type, precision, recall, f1, CAST(t AS BIGINT) AS support FROM ({scored('(SELECT entity_type, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM counted GROUP BY 1)')})"),
        "ner_macro_f1": q(f"SELECT round(avg(f1), 9) AS macro_f1 FROM ({scored('(SELECT entity_type, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM counted GROUP BY 1)')})"),
        "ner_report": q("SELECT * FROM report_rows"),
    }
    out.update({f"regex_{k}": q(sql) for k, sql in regex.items()})
    out.update({f"context_{lab.lower()}": q(f"SELECT {few} FROM ({key_rows('masked', 'src, doc_id', ks)})") for lab, ks in by_label.items()})
    # redaction without recogniser spans: the same CTEs over other candidates
    plain = {k: v for k, v in CTES.items()}
    plain["candidates"] = CTES["doc_candidates"].replace("masked_documents", "masked_notes")
    on_docs = {**plain, "candidates": CTES["doc_candidates"], "notes": "SELECT doc_id, text FROM documents"}
    out["redact_documents"] = with_(on_docs, final="SELECT doc_id, redacted_text FROM rewritten")
    out["redact_stream"] = out["redact_documents"]
    out["entity_counts_by_source"] = with_(on_docs, final="SELECT d.lang, d.source, m.label AS entity_type, count(*) AS n_entities FROM marks m JOIN documents d USING (doc_id) GROUP BY 1, 2, 3")
    out["entity_counts_cube"] = with_(on_docs, final="""SELECT d.lang, d.source, m.label AS entity_type, CAST(grouping(d.lang, d.source, m.label) AS INT) AS level, count(*) AS n_entities
      FROM marks m JOIN documents d USING (doc_id) GROUP BY CUBE (d.lang, d.source, m.label)""")
    out["span_funnel_observed"] = out["span_funnel_total"]
    out["sink_redacted"] = with_(plain, final="""SELECT doc_id, 'redacted' AS sink, NULL::VARCHAR AS name, redacted_text AS value FROM rewritten
      UNION ALL SELECT doc_id, 'entities', placeholder, value_preview FROM entities UNION ALL SELECT doc_id, 'vault', placeholder, text FROM marks""")
    out["restore_text"] = q("""SELECT 'notes' AS src, doc_id, CASE WHEN doc_id % 3 = 0 THEN '***[EMAIL#1]*** ' || text || ' ***[DATE#2]******[PERSON#1]***' ELSE text END AS restored_text
      FROM notes UNION ALL SELECT 'documents', doc_id, text FROM documents""")
    readable = ", ".join(map(lit, READABLE))
    shown = plain["marks"].replace("SELECT *, '***['", f"SELECT * EXCLUDE (text), text, CASE WHEN label IN ({readable}) THEN text ELSE '***['", 1).replace("']***' AS placeholder", "']***' END AS placeholder", 1)
    out["restore_labels"] = with_({**plain, "marks": shown}, final="SELECT doc_id, redacted_text AS restored_text FROM rewritten")
    seats = """SELECT doc_id, placeholder, CAST(start + coalesce(sum(length(placeholder) - length(text)) OVER (
      PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS seat FROM marks"""
    out["unrestored"] = with_(plain, final=f"""SELECT doc_id, seat + 1 AS "at", placeholder, 'not in the text' AS reason FROM ({seats}) WHERE doc_id % 5 = 1
      UNION ALL SELECT -doc_id - 1, seat, placeholder, 'no such document' FROM ({seats}) WHERE doc_id % 5 = 2
      UNION ALL SELECT doc_id, seat, placeholder, 'two originals' FROM ({seats}), range(2) WHERE doc_id % 5 = 3""")
    flagged = {**CTES, "flagged": "SELECT sent_id, bool_or(tag <> 'O') AS has_pii FROM tagged GROUP BY 1"}
    flagged["flag_split"] = splits("flagged", 0.15, 0.2, "CAST(has_pii AS INT)")
    out["split_stratified"] = with_(flagged, final="SELECT sent_id, has_pii, split FROM flag_split")
    return out
