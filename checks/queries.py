"""One query per operator, over whole tables. Results are scalar columns, so that they compare with SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as st
from maskwright.functions import bio
from maskwright.functions import text as tx
from maskwright.operators import adjudicate, detect, evaluate, interval, labels, mixes, redact, restore, splits
from maskwright.plans.redaction import entity_cube, entity_totals, funnel, observed, redact_documents
from maskwright.sources import corpora, sinks
from maskwright.sources import fixed_values as fixed
from maskwright.sources.bucketed import scratch_bucketed
from maskwright.sources.catalog import default_catalog, load_catalog
from maskwright.sources.names import canonical_rows, invert
from maskwright.sources.spans import ner_spans_in, valid_documents
from maskwright.sources.spans import ner_spans_rejected as span_rejects
from maskwright.streaming.redact_stream import Wait, start_joined_sink, start_text_sink

Query = Callable[[SparkSession, str], DataFrame]
CATALOG = default_catalog()

# parameters shared with oracle.py
CHUNK_WORDS = 16
PSEUDO_LIMIT, PSEUDO_TOKENS = 400, 8000
CAP_RATIO = 0.5
FACTOR = 2.5
MIX = {"pseudo_ratio": 0.02, "general_ratio": 0.05, "factor": 1.5, "augment": True}
TOKENS_KEPT = 8
BUCKETS = 8
READABLE = ["EMAIL", "PERSON"]
PIECE = 4  # letters per sub-word piece
PERIOD_ROWS = 500_000  # documents that a run of the stream with spans takes, about
REGEX_KEYS = [
    "nric_sg", "passport_id", "email", "phone_sg", "bank_account_sg", "date", "account_id", "address_line",
    "card_cvc", "org", "person_titled", "person_two_words",
]


def rules_in_file_order():
    from maskwright.sources.fixed_values import TEXT_RULES

    by_pattern = {r.pattern: r for r in CATALOG.rules}
    return [by_pattern[p] for _, _, p in TEXT_RULES]


def joined(*columns: str) -> list[Column]:
    return [F.array_join(c, " ").alias(c) for c in columns]


def spans_of(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return detect.span_rows(df, *keep, spans=column)


# --- scans, sources, sinks ---------------------------------------------------

def docs_valid(spark, sf):
    return valid_documents(st.table(spark, sf, "documents")).select("doc_id", "text")


def rule_catalog(spark, sf):
    """The ordered rules with their number of matches."""
    rows = [(r.ord, r.label, r.pattern, r.specificity) for r in CATALOG.rules]
    rules = spark.createDataFrame(rows, "ord int, label string, pattern string, specificity int")
    counts = st.texts(spark, sf).transform(lambda df: tx.each(df, ord=detect.text_spans("text", CATALOG.rules)["ord"]))
    n = counts.groupBy("ord").agg(F.count(F.lit(1)).alias("n_spans"))
    return rules.join(n, "ord", "left").select("ord", "label", "pattern", "specificity", F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def context_catalog(spark, sf):
    """One row per keyword with its number of findings."""
    rows = [(k.ord, k.key, k.window, k.label, k.pattern) for k in CATALOG.keys]
    keys = spark.createDataFrame(rows, "ord int, key string, window int, label string, value_regex string")
    counts = st.texts(spark, sf).transform(lambda df: tx.each(df, ord=detect.context_spans("text", CATALOG.keys)["ord"]))
    n = counts.groupBy("ord").agg(F.count(F.lit(1)).alias("n_spans"))
    return keys.join(n, "ord", "left").select(
        "ord", "key", "window", "label", "value_regex", F.coalesce("n_spans", F.lit(0)).alias("n_spans")
    )


def label_synonyms(spark, sf):
    """The inverted synonyms with the recogniser spans of each name."""
    names = spark.createDataFrame(list(CATALOG.synonyms.items()), "synonym string, canonical string")
    n = st.ner_rows(st.notes(spark, sf)).groupBy(F.upper("label").alias("synonym")).agg(F.count(F.lit(1)).alias("n_spans"))
    return names.join(n, "synonym", "left").select("synonym", "canonical", F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def tagged_corpus_load(spark, sf):
    """Damaged notes written as CSV with list literals (some of unequal length), and read back."""
    literal = lambda c: F.concat(
        F.lit("['"), F.array_join(F.transform(c, lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))), "', '"), F.lit("']")
    )
    damaged = st.damaged_notes(spark, sf)
    longer = F.when(F.col("sent_id") % 11 == 0, F.concat("labels", F.array(F.lit("O")))).otherwise(F.col("labels"))
    path = sinks.scratch_path(spark, "corpus")
    damaged.select(literal(F.col("tokens")).alias("tokens"), literal(longer).alias("labels")).write.csv(path, header=True, escape='"')
    return corpora.read_tagged_csv(spark, path).select(*joined("tokens", "labels"))


def conll_load(spark, sf):
    """Notes and documents written as CoNLL files, one with either line end in turn, and read back."""
    def block(df: DataFrame) -> DataFrame:
        lines = F.zip_with("tokens", "labels", lambda t, l: F.concat_ws(" ", t, F.lit("X"), F.lit("Y"), l))
        return df.select(F.concat(F.lit("-DOCSTART- -X- -X- O\n"), F.array_join(lines, "\n")).alias("value"))

    path = sinks.scratch_path(spark, "conll")
    notes = block(st.damaged_notes(spark, sf))
    ends = F.when(F.contains("value", F.lit("nric")), F.replace(F.col("value"), F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("value"))
    notes.select(ends.alias("value")).write.option("lineSep", "\r\n\r\n").text(f"{path}/train.txt")
    block(st.general(spark, sf)).write.option("lineSep", "\n\n").text(f"{path}/valid.txt")
    return corpora.read_conll(spark, path).select("split", *joined("tokens", "labels"))


def paragraph_chunks(spark, sf):
    return corpora.paragraph_chunks(st.table(spark, sf, "documents"), chunk_words=CHUNK_WORDS)


def ner_spans(spark, sf):
    docs = st.notes(spark, sf)
    return ner_spans_in(valid_documents(docs), st.ner_rows(docs)).select("doc_id", "start", "end", "label", "score")


def damaged_spans(spark, sf):
    """Recogniser spans of the notes with offsets and labels damaged by document."""
    doc = F.col("doc_id")
    start = F.when(doc % 9 == 1, -F.col("start") - 1).when(doc % 9 == 2, F.lit(None)).otherwise(F.col("start"))
    end = F.when(doc % 9 == 3, F.col("start")).when(doc % 9 == 4, F.col("end") + 100_000).when(doc % 9 == 5, F.lit(None)).otherwise(F.col("end"))
    label = F.when(doc % 9 == 6, F.lit(None)).otherwise(F.col("label"))
    known = F.when(doc % 9 == 7, doc + 1_000_000_000).otherwise(doc)
    return st.ner_rows(st.notes(spark, sf)).select(known.alias("doc_id"), start.alias("start"), end.alias("end"), label.alias("label"), "score")


def ner_spans_rejected(spark, sf):
    return span_rejects(st.notes(spark, sf), damaged_spans(spark, sf)).select("doc_id", "start", "end", "label", "reason")


def redact_damaged_spans(spark, sf):
    """Notes redacted with damaged recogniser spans: the good ones count, the others do no harm."""
    docs = st.notes(spark, sf)
    return redact_documents(docs, ner_spans=damaged_spans(spark, sf)).select("doc_id", "redacted_text")


def catalog_files(spark, sf):
    """The rules as JSON files, loaded, with the number of findings of each."""
    path = sinks.scratch_path(spark, "catalog")
    rules = [(lab, pat, spec) for lab, spec, pat in fixed.TEXT_RULES]
    spark.createDataFrame([(json.dumps([{"label": a, "pattern": p, "specificity": n} for a, p, n in rules]),)], "v string").coalesce(1).write.text(path)
    loaded = load_catalog(spark, rules_path=path).rules
    table = spark.createDataFrame([(r.ord, r.label, r.specificity) for r in loaded], "ord int, label string, specificity int")
    found = st.texts(spark, sf).transform(lambda df: tx.each(df, ord=detect.text_spans("text", loaded)["ord"]))
    n = found.groupBy("ord").agg(F.count(F.lit(1)).alias("n_spans"))
    return table.join(n, "ord", "left").select("ord", "label", "specificity", F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def sink_redacted(spark, sf):
    """The three written tables, one below the other."""
    path = sinks.scratch_path(spark, "redaction")
    sinks.write_redaction(redact_documents(st.notes(spark, sf)), path)
    read = {t: spark.read.parquet(f"{path}/{t}") for t in sinks.TABLES}
    none = F.lit(None).cast("string")
    return (
        read["redacted"].select("doc_id", F.lit("redacted").alias("sink"), none.alias("name"), F.col("redacted_text").alias("value"))
        .unionByName(read["entities"].select("doc_id", F.lit("entities").alias("sink"), F.col("placeholder").alias("name"), F.col("value_preview").alias("value")))
        .unionByName(read["vault"].select("doc_id", F.lit("vault").alias("sink"), F.col("placeholder").alias("name"), F.col("original").alias("value")))
    )


def sink_labels(spark, sf):
    path = sinks.scratch_path(spark, "labels")
    sinks.write_labels(label_vocab(spark, sf), path)
    return spark.read.schema("label string, id int").json(f"{path}/label2id")


def sink_labels_all(spark, sf):
    """The ordered list and both maps, as written."""
    path = sinks.scratch_path(spark, "labels")
    sinks.write_labels(label_vocab(spark, sf), path)
    # one file, in order
    listed = spark.read.text(f"{path}/labels").select(F.monotonically_increasing_id().cast("int").alias("id"), F.col("value").alias("label"))
    maps = [spark.read.schema(schema).json(f"{path}/{name}") for name, schema in (("label2id", "label string, id int"), ("id2label", "id int, label string"))]
    parts = [df.select(F.lit(name).alias("sink"), "id", "label") for name, df in zip(("labels", "label2id", "id2label"), (listed, *maps), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sink_metrics(spark, sf):
    path = sinks.scratch_path(spark, "metrics")
    scores = ner_report(spark, sf)
    sinks.write_metrics(scores, path)
    return spark.read.schema(scores.schema).json(path)


# --- detection ---------------------------------------------------------------

def _found(spark, sf, spans: Column) -> DataFrame:
    return spans_of(st.texts(spark, sf).select("src", "doc_id", spans.alias("spans")), "spans", "src", "doc_id").select(
        "src", "doc_id", "start", "end", "text", "label", "specificity"
    )


def regex_spans(spark, sf):
    return _found(spark, sf, detect.text_spans("text", CATALOG.rules))


def regex_one(rule) -> Query:
    return lambda spark, sf: _found(spark, sf, detect.text_spans("text", [rule]))


def context_spans(spark, sf):
    return _found(spark, sf, detect.context_spans("text", CATALOG.keys))


def context_one(label: str) -> Query:
    keys = [k for k in CATALOG.keys if k.label == label]
    return lambda spark, sf: _found(spark, sf, detect.context_spans("text", keys))


def _recognised(spark, sf) -> DataFrame:
    docs = st.notes_with_ner(spark, sf)
    spans = detect.recogniser_spans(F.col("text"), F.col("ner"), CATALOG)
    return spans_of(docs.select("doc_id", spans.alias("spans")), "spans", "doc_id")


def ner_label_normalise(spark, sf):
    return _recognised(spark, sf).select("doc_id", "start", "end", "text", "label", "score")


def synonym_table(spark, sf):
    """Orders labelled by their customers' names, mapped to market segments by a table of all customers; every tenth has another name."""
    lists = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_mktsegment").alias("canonical"), F.array(F.lower("c_name")).alias("names"), F.col("c_custkey").alias("pos")
    )
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    label = F.concat(F.when(F.col("o_orderkey") % 10 == 0, "client#").otherwise("customer#"), number)
    rows = st.table(spark, sf, "orders").select("o_orderkey", label.alias("label"))
    return canonical_rows(rows, sinks.as_table(invert(lists), "names"))


def org_context_boost(spark, sf):
    return _recognised(spark, sf).filter("label = 'ORG'").select("doc_id", "start", "end", "text", "specificity")


def all_spans(spark, sf):
    return spans_of(st.detected(spark, sf), "spans", "doc_id").select("doc_id", "start", "end", "text", "label", "source", "specificity")


# --- adjudication ------------------------------------------------------------

def _step(spark, sf, step: Callable[[Column], Column]) -> DataFrame:
    """Notes with one step of adjudication applied to their candidate spans."""
    found = st.detected(spark, sf)
    return found.select("doc_id", "text", tx.let(F.col("spans"), lambda s: tx.let(adjudicate.ordered(s), step)).alias("spans"))


def _winners(s: Column) -> Column:
    return tx.let(adjudicate.overlap_groups(s), adjudicate.winners)


def _kept(s: Column) -> Column:
    return tx.let(_winners(s), adjudicate.drop_false_positives)


def span_order(spark, sf):
    ranked = _step(spark, sf, lambda s: s).select("doc_id", F.posexplode_outer("spans").alias("pos", "s")).filter("s is not null")
    return ranked.select("doc_id", (F.col("pos") + 1).alias("rank"), "s.start", "s.end", "s.label", "s.specificity")


def overlap_groups(spark, sf):
    groups = _step(spark, sf, adjudicate.overlap_groups).select("doc_id", F.posexplode_outer("spans").alias("pos", "g"))
    rows = tx.each(groups.withColumn("group_no", F.col("pos") + 1), "doc_id", "group_no", s=F.col("g"))
    return rows.select("doc_id", "group_no", "s.start", "s.end", "s.label", "s.specificity")


def overlap_winner(spark, sf):
    return spans_of(_step(spark, sf, _winners), "spans", "doc_id").select("doc_id", "start", "end", "label", "source", "specificity")


def false_positive_filter(spark, sf):
    return spans_of(_step(spark, sf, _kept), "spans", "doc_id").select("doc_id", "start", "end", "label", "source", "specificity")


def _merged(spark, sf, **kinds) -> DataFrame:
    step = lambda s: tx.let(_kept(s), lambda k: adjudicate.merge_neighbours(k, F.col("text"), **kinds))
    return spans_of(_step(spark, sf, step), "spans", "doc_id").select("doc_id", "start", "end", "text", "label", "specificity")


def merge_person(spark, sf):
    return _merged(spark, sf, address=False)


def merge_address(spark, sf):
    return _merged(spark, sf, person=False)


def final_spans(spark, sf):
    return spans_of(st.adjudicated(spark, sf), "final", "doc_id").select("doc_id", "start", "end", "text", "label", "specificity")


def span_funnel(spark, sf):
    return funnel(st.adjudicated(spark, sf))


def span_funnel_total(spark, sf):
    return span_funnel(spark, sf).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_candidates").alias("n_candidates"), F.sum("n_final").alias("n_final")
    )


def span_funnel_observed(spark, sf):
    """The totals as they are seen while the final spans are written."""
    found, totals = observed(st.adjudicated(spark, sf))
    sinks.as_table(found.select("doc_id", "final"), "final")
    return spark.createDataFrame([totals.get], "n_docs bigint, n_candidates bigint, n_final bigint")


# --- redaction ---------------------------------------------------------------

def canonical_label(spark, sf):
    rows = spans_of(st.adjudicated(spark, sf), "final", "doc_id")
    return rows.select("doc_id", "start", "end", "label", CATALOG.canonical(F.col("label")).alias("canonical"))


def drop_ignore(spark, sf):
    shown = st.adjudicated(spark, sf).withColumn("shown", redact.visible(F.col("final"), CATALOG))
    return spans_of(shown, "shown", "doc_id").select("doc_id", "start", "end", "label")


def _marks(spark, sf) -> DataFrame:
    return tx.each(redact.mark(st.adjudicated(spark, sf), CATALOG), "doc_id", m=F.col("marks")).select("doc_id", "m.*")


def placeholder_number(spark, sf):
    return _marks(spark, sf).select("doc_id", "start", "label", "number")


def placeholder_format(spark, sf):
    return _marks(spark, sf).select("doc_id", "start", "placeholder")


def _response(spark, sf) -> DataFrame:
    docs = st.notes(spark, sf)
    return redact_documents(docs, ner_spans=st.ner_rows(docs))


def redact_text(spark, sf):
    return _response(spark, sf).select("doc_id", "redacted_text")


def redact_bucketed(spark, sf):
    """Notes and their recogniser spans stored in buckets by document, and redacted in place."""
    notes = st.notes(spark, sf)
    docs, spans = scratch_bucketed(notes, "notes", BUCKETS), scratch_bucketed(st.ner_rows(notes), "spans", BUCKETS)
    return redact_documents(docs, ner_spans=spans).select("doc_id", "redacted_text")


def redact_documents_text(spark, sf):
    return redact_documents(st.table(spark, sf, "documents")).select("doc_id", "redacted_text")


def _marked_notes(spark, sf) -> DataFrame:
    """Notes, every third one between strings that look like placeholders."""
    false = F.concat(F.lit("***[EMAIL#1]*** "), F.col("text"), F.lit(" ***[DATE#2]******[PERSON#1]***"))
    return st.notes(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, false).otherwise(F.col("text")).alias("text"))


def restore_text(spark, sf):
    """Notes and documents redacted, and restored from the written tables."""
    def there_and_back(docs: DataFrame, name: str) -> DataFrame:
        path = sinks.scratch_path(spark, f"restore-{name}")
        sinks.write_redaction(redact_documents(docs, seats=True), path)
        read = {t: spark.read.parquet(f"{path}/{t}") for t in ("redacted", "vault")}
        return restore.restore(read["redacted"], read["vault"]).select(F.lit(name).alias("src"), "doc_id", "restored_text")

    return there_and_back(_marked_notes(spark, sf), "notes").unionByName(there_and_back(st.table(spark, sf, "documents"), "documents"))


def restore_labels(spark, sf):
    """Notes restored for a reader who may see some labels only."""
    result = sinks.as_table(redact_documents(st.notes(spark, sf), seats=True).select("doc_id", "redacted_text", "seats"), "seats")
    vault = restore.vault_rows(result, "doc_id")
    return restore.restore(result.drop("seats"), vault, labels=READABLE).select("doc_id", "restored_text")


def unrestored(spark, sf):
    """Vault rows damaged by document: shifted, doubled, or of no document."""
    result = sinks.as_table(redact_documents(st.notes(spark, sf), seats=True).select("doc_id", "redacted_text", "seats"), "seats")
    doc = F.col("doc_id")
    vault = restore.vault_rows(result, "doc_id")
    hurt = vault.withColumn("at", F.when(doc % 5 == 1, F.col("at") + 1).otherwise(F.col("at"))).withColumn("doc_id", F.when(doc % 5 == 2, -doc - 1).otherwise(doc))
    double = hurt.filter("doc_id % 5 = 3").withColumn("original", F.lit("?"))
    # dealt by document first: grouping where the files are read would sort a whole file split in one task's memory
    return restore.unrestored(result.drop("seats"), hurt.unionByName(double).repartition("doc_id"))


def entity_rows(spark, sf):
    return redact.entity_rows(_response(spark, sf), "doc_id")


def placeholder_map(spark, sf):
    return redact.vault_rows(_response(spark, sf), "doc_id")


def redaction_response(spark, sf):
    return _response(spark, sf).select(
        "doc_id", "redacted_text",
        F.array_join("entities.placeholder", ",").alias("placeholders"),
        F.size("entities").cast("bigint").alias("n_entities"),
        F.size("map").cast("bigint").alias("n_map"),
    )


def entity_reveal(spark, sf):
    """Listing of the entities; the vault lacks the phone numbers, which fall back to their preview."""
    result = sinks.as_table(_response(spark, sf).select("doc_id", "entities", "map"), "response")
    vault = redact.vault_rows(result, "doc_id").filter(~F.contains("placeholder", F.lit("PHONE_SG")))
    return redact.reveal(redact.entity_rows(result, "doc_id"), vault)


def entity_counts(spark, sf):
    return _response(spark, sf).select("doc_id", F.size("entities").cast("bigint").alias("n_entities"))


def entity_counts_by_source(spark, sf):
    return entity_totals(redact_documents(st.table(spark, sf, "documents")), "lang", "source")


def entity_counts_cube(spark, sf):
    """Entities of the documents by language, source and label, with all subtotals."""
    return entity_cube(redact_documents(st.table(spark, sf, "documents")), "lang", "source")


def size_class(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", redact.size_class(F.col("text")).alias("size_class"))


def redact_stream(spark, sf):
    """Documents streamed from files to files in one run, and read back."""
    schema = st.table(spark, sf, "documents").schema
    # a table is one file or a folder of files; the pattern is met by either
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    path = sinks.scratch_path(spark, "stream")
    start_text_sink(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "redacted_text")


def redact_span_stream(spark, sf):
    """Notes and their recogniser spans as two streams, the spans found up to two seconds later; a row of a later day lets all leave."""
    path = sinks.scratch_path(spark, "span-stream")
    at = F.timestamp_seconds(F.col("doc_id") + 86_400)
    notes = st.notes(spark, sf)
    spans = st.ner_rows(notes).withColumn("found_at", F.timestamp_seconds(F.col("doc_id") + 86_400 + F.pmod(F.col("start"), F.lit(3))))
    end = F.timestamp_seconds(F.lit(10**11))
    sides = {
        "docs": notes.select("doc_id", at.alias("at"), "text"),
        "spans": spans.select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "label", "score", "found_at"),
    }
    # one run a period, as rows come in time: state never holds more than two periods
    rows, cores = notes.count(), spark.sparkContext.defaultParallelism
    periods = -(-rows // PERIOD_ROWS)
    # full rounds of tasks, each as small as those of the notes
    parts = cores * max(1, -(-min(rows, PERIOD_ROWS) // (st.TASK_ROWS["orders"] * cores)))
    shares = [i / periods for i in range(1, periods)]
    cuts = sorted({int(x) for x in notes.approxQuantile("doc_id", shares, 0.001)}) if shares else []
    doc = F.col("doc_id")
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        early = F.coalesce(doc < low, F.lit(True)) if low is not None else F.lit(False)
        late = doc >= high if high is not None else F.lit(False)
        for name, df in sides.items():
            # a row without a key belongs to the first period
            mine = df.filter(F.coalesce(~early & ~late, F.lit(True)))
            mine.coalesce(cores).write.parquet(f"{path}/{name}/part={2 * i}")
            if high is None:
                last = spark.range(1).select(*[end.alias(c) if k == "timestamp" else F.lit(-1).cast(k).alias(c) if c == "doc_id" else F.lit(None).cast(k).alias(c) for c, k in df.dtypes])
                last.coalesce(1).write.parquet(f"{path}/{name}/part={2 * i + 1}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{path}/{name}/part=*") for name, df in sides.items()]
        for query in start_joined_sink(*streams, f"{path}/out", f"{path}/state", Wait("2 seconds", "1 second"), state_parts=parts, more=high is not None):
            query.awaitTermination()
    return spark.read.parquet(f"{path}/out/redacted").filter("doc_id >= 0").select("doc_id", "redacted_text")


# --- label data --------------------------------------------------------------

def sanitize_bio(spark, sf):
    return labels.sanitize_bio(st.damaged_notes(spark, sf)).select("sent_id", *joined("tokens", "labels"))


def label_order(spark, sf):
    """Distinct raw labels in order."""
    seen = st.damaged_notes(spark, sf).transform(lambda df: tx.each(df, label=F.array_distinct("labels"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ordered = seen.agg(F.array_sort(F.transform(F.collect_list("label"), bio.order_key)).alias("o"))
    return ordered.select(F.posexplode("o").alias("rank", "k")).select((F.col("rank") + 1).alias("rank"), "k.label")


def label_vocab(spark, sf):
    return labels.label_vocab(st.tagged_notes(spark, sf), st.general(spark, sf), st.pseudo(spark, sf))


def encode_labels(spark, sf):
    corpus = sinks.as_table(st.tagged_notes(spark, sf), "tagged")
    coded = labels.encode_labels(corpus, labels.label_vocab(corpus))
    return coded.select("sent_id", F.array_join(F.transform("ner_tags", lambda x: x.cast("string")), " ").alias("ner_tags"))


def has_pii_flag(spark, sf):
    return labels.with_has_pii(st.tagged_notes(spark, sf)).select("sent_id", "has_pii")


def spans_to_bio(spark, sf):
    return st.tagged_notes(spark, sf).select("sent_id", *joined("tokens", "labels"))


def interval_tags(spark, sf):
    """The same tags from stored words and stored spans."""
    placed = F.transform("final", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    found = sinks.as_table(st.adjudicated(spark, sf).select("doc_id", "text", placed.alias("final")), "final")
    words = sinks.as_table(interval.word_rows(found), "words")
    spans = found.select("doc_id", F.posexplode_outer("final").alias("ord", "s")).filter("s is not null")
    rows = interval.tag_rows(words, spans.select("doc_id", "ord", "s.start", "s.end", "s.label"))
    return rows.select(F.col("doc_id").alias("sent_id"), F.col("no").cast("long").alias("no"), "word", "tag")


def split_random(spark, sf):
    return st.split_notes(spark, sf).select("sent_id", "split")


def split_stratified(spark, sf):
    flagged = sinks.as_table(labels.with_has_pii(st.tagged_notes(spark, sf)).select("sent_id", "has_pii"), "flags")
    return splits.assign_splits(flagged, "sent_id", 0.15, 0.2, st.SEED, stratify="has_pii")


def pseudo_label_filter(spark, sf):
    return st.pseudo(spark, sf).select("sent_id", *joined("tokens", "labels"))


def pseudo_label_limit(spark, sf):
    """Turns labelled in growing ranges of keys until a limit is met."""
    label = lambda docs: labels.spans_to_bio(st.with_groups(docs), "spans")
    kept = mixes.labelled_until(st.turns(spark, sf), label, PSEUDO_LIMIT, PSEUDO_TOKENS)
    return kept.select("sent_id", F.size("tokens").alias("n_tokens"))


def pseudo_label_rows(spark, sf):
    """The same for a limit of rows alone, with the labels."""
    label = lambda docs: labels.spans_to_bio(st.with_groups(docs), "spans")
    return mixes.labelled_until(st.turns(spark, sf), label, PSEUDO_LIMIT).select("sent_id", *joined("tokens", "labels"))


def pseudo_label_stats(spark, sf):
    docs = sinks.as_table(st.conversation_docs(spark, sf), "turns")
    rows = labels.spans_to_bio(docs, "spans").join(docs.select(F.col("doc_id").alias("sent_id"), "spans"), "sent_id")
    return mixes.pseudo_stats(docs, mixes.pseudo_limit(sinks.as_table(rows, "pseudo"), PSEUDO_LIMIT, PSEUDO_TOKENS))


def cap_by_ratio(spark, sf):
    capped = mixes.cap_by_ratio(sinks.as_table(st.general(spark, sf), "general"), CAP_RATIO, st.table(spark, sf, "conversations").count())
    return capped.select("sent_id", F.size("tokens").alias("n_tokens"))


def oversample(spark, sf):
    return mixes.oversample(sinks.as_table(st.tagged_notes(spark, sf), "tagged"), FACTOR).select("sent_id", "copy", *joined("tokens"))


def augment_swapcase(spark, sf):
    rows = st.tagged_notes(spark, sf).withColumn("is_pii", F.lit(True))
    return labels.add_swapcase(rows).select("sent_id", "augmented", *joined("tokens", "labels"))


def _train(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    pii = sinks.as_table(st.split_notes(spark, sf).filter("split = 'train'").drop("split"), "train")
    gen = sinks.as_table(st.general(spark, sf), "general")
    return pii, sinks.as_table(st.pseudo(spark, sf), "pseudo"), gen


def joint_mix(spark, sf):
    pii, pseudo, gen = _train(spark, sf)
    return mixes.curriculum_mix(pii, pseudo, gen, **MIX).select(
        "phase", "corpus", "sent_id", "copy", "augmented", "is_pii", *joined("tokens", "labels")
    )


def sequential_mix(spark, sf):
    pii, pseudo, gen = _train(spark, sf)
    return mixes.sequential_mix(pii, gen, pseudo, **MIX).select(
        "stage", "corpus", "sent_id", "copy", "augmented", "is_pii", *joined("tokens", "labels")
    )


def align_subwords(spark, sf):
    """Word numbers of pieces of PIECE letters, with a null at both ends, as a tokeniser gives them."""
    corpus = sinks.as_table(st.tagged_notes(spark, sf), "tagged")
    coded = labels.encode_labels(corpus, labels.label_vocab(corpus))
    none = F.array(F.lit(None).cast("int"))
    pieces = F.flatten(F.transform("tokens", lambda t, i: F.array_repeat(i, F.ceil(F.length(t) / PIECE).cast("int"))))
    aligned = labels.align_subwords(coded.withColumn("word_ids", F.concat(none, pieces, none)))
    return aligned.select("sent_id", F.array_join(F.transform("aligned", lambda x: x.cast("string")), " ").alias("aligned"))


def truncate_tokens(spark, sf):
    return labels.truncate(st.tagged_notes(spark, sf), TOKENS_KEPT).select("sent_id", *joined("tokens", "labels"))


def split_sizes(spark, sf):
    return splits.split_sizes(st.corpora(spark, sf))


def split_table(spark, sf):
    return splits.split_table(st.corpora(spark, sf))


def eval_sets(spark, sf):
    return splits.eval_sets(st.corpora(spark, sf)).select("eval_set", "sent_id", "is_pii", F.size("labels").alias("n_tokens"))


# --- evaluation --------------------------------------------------------------

def decode_predictions(spark, sf):
    """Logits that favour the predicted tag; every fifth position is ignored."""
    names = ["O", "B-MISC", "I-PERSON", *[f"{p}-{t}" for t in ("ACCOUNT_ID", "ADDRESS_LINE", "BANK_ACCOUNT_SG", "CARD_CVC", "DATE", "EMAIL", "IGNORE", "LOCATION", "NRIC_SG", "ORG", "PASSPORT_ID", "PER", "PERSON", "PHONE_SG") for p in "BI" if (p, t) != ("I", "PERSON")]]
    index = F.array(*[F.lit(n) for n in names])
    at = lambda tag: (F.array_position(index, tag) - 1).cast("int")
    classes = F.sequence(F.lit(0), F.lit(len(names) - 1))
    favour = lambda best: F.transform(classes, lambda c: F.when(c == best, 2.5).otherwise((c * 37 % 100) / 100.0).cast("float"))
    # a tag is looked up once, not once a class
    logits = F.transform("pred_tags", lambda tag: tx.let(at(tag), favour))
    ids = F.transform("true_tags", lambda tag, i: F.when(i % 5 == 4, bio.IGNORED).otherwise(at(tag)))
    # MISC of the general corpus is untyped before repair and B-MISC after it
    rows = st.predictions(spark, sf).withColumns({"logits": logits, "label_ids": ids})
    return evaluate.decode_predictions(rows, names).select("eval_set", "sent_id", *joined("true_tags", "pred_tags"))


def bio_entities(spark, sf):
    rows = st.predictions(spark, sf)
    return evaluate.entity_rows(rows, "pred_tags", "eval_set", "sent_id")


def ner_scores_overall(spark, sf):
    return evaluate.scores_overall(st.predictions(spark, sf))


def ner_scores_by_type(spark, sf):
    return evaluate.scores_by_type(st.predictions(spark, sf))


def ner_macro_f1(spark, sf):
    return evaluate.macro_f1(st.predictions(spark, sf)).withColumn("macro_f1", F.round("macro_f1", 9))


def ner_report(spark, sf):
    # a mean depends on the order of summing in its last digit
    return evaluate.report(st.predictions(spark, sf)).withColumn("macro_f1", F.round("macro_f1", 9))


def queries() -> dict[str, Query]:
    plain = [
        docs_valid, rule_catalog, context_catalog, label_synonyms, tagged_corpus_load, conll_load, paragraph_chunks,
        sink_redacted, sink_labels, sink_labels_all, sink_metrics, regex_spans, context_spans, ner_label_normalise, synonym_table, org_context_boost,
        all_spans, span_order, overlap_groups, overlap_winner, false_positive_filter, merge_person, merge_address,
        final_spans, span_funnel, span_funnel_total, span_funnel_observed, canonical_label, drop_ignore, placeholder_number,
        placeholder_format, redact_text, redact_bucketed, restore_text, restore_labels, unrestored, entity_rows, placeholder_map, redaction_response, entity_reveal,
        ner_spans_rejected, redact_damaged_spans, catalog_files, entity_counts, entity_counts_by_source, entity_counts_cube, size_class, redact_stream, redact_span_stream, sanitize_bio, label_order, label_vocab,
        encode_labels, has_pii_flag, spans_to_bio, interval_tags, split_random, split_stratified, pseudo_label_filter,
        pseudo_label_limit, pseudo_label_rows, pseudo_label_stats, cap_by_ratio, oversample, augment_swapcase, joint_mix, sequential_mix,
        align_subwords, truncate_tokens, split_sizes, split_table, eval_sets, decode_predictions, bio_entities, ner_scores_overall,
        ner_scores_by_type, ner_macro_f1, ner_report,
    ]
    out = {f.__name__: f for f in plain}
    out["ner_spans_in"] = ner_spans
    out["redact_documents"] = redact_documents_text
    for name, rule in zip(REGEX_KEYS, rules_in_file_order()):
        out[f"regex_{name}"] = regex_one(rule)
    for label in dict.fromkeys(k.label for k in CATALOG.keys):
        out[f"context_{label.lower()}"] = context_one(label)
    return out
