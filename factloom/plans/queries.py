"""The queries of the engine's own operators over the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import comparators, numbers, qualifiers, text
from factloom.functions.periods import period, relation
from factloom.functions.render import fact_line
from factloom.functions.repair import repair_comparators
from factloom.functions.units import magnitude, unit_info
from factloom.operators import candidates, chunking, clusters, compare, concepts, evaluation, extraction, graph_index, grounding, precheck, relationships, routing, search, tables, verification
from factloom.operators.normalise import by_dictionary, with_period, with_value
from factloom.plans import knowledge
from factloom.plans.derived import document_pages, event_logs, line_facts, project_facts, table, vector_facts, whole_cents
from factloom.sources.shared import durable
from factloom.streaming import profiles
from factloom.streaming.ingest import drain, log_windows, read_stream, state_folder, take_new

KNN_MOST = 0.75


def grounding_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages that are grounded in documents, by language."""
    docs = table(spark, d, "documents")
    found = grounding.find_passages(table(spark, d, "benchmark"), docs)
    return found.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_matches"))


def grounding_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a document's first line is not grounded in the rest of it."""
    docs = table(spark, d, "documents").withColumn("line", F.substring_index("text", "\n", 1))
    rest = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("text").substr(F.lit(20), F.length("text")))
    g = text.grounding(F.col("line"), rest)
    return docs.groupBy(F.coalesce(g["reason"], F.lit("passed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def classified(spark: SparkSession, d: str) -> DataFrame:
    pages = document_pages(spark, d).withColumns({"digit_ratio": routing.digit_ratio(F.col("text")), "numeric_line_count": routing.numeric_lines(F.col("text"))})
    return routing.classify_page(pages)


def route_pages(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("document_id", "page_number", "content_type", F.round("digit_ratio", 9).alias("digit_ratio"))


def document_profile(spark: SparkSession, d: str) -> DataFrame:
    return routing.document_profile(classified(spark, d))


def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.build_chunks(classified(spark, d))
    return chunks.select("document_id", "page_number", "chunk_index", "char_start", "char_end", F.length("leading_context").alias("context_chars"))


def plan_batches(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.build_chunks(classified(spark, d)).withColumn("table_markdown", F.when(F.col("page_number") % 9 == 0, "| t |"))
    return chunking.plan_batches(chunks).select("document_id", "chunk_index", "batch")


def page_phases(spark: SparkSession, d: str) -> DataFrame:
    pages = chunking.phases(document_pages(spark, d))
    return pages.groupBy("document_id").agg(F.count_if(F.col("phase") == 1).alias("fast"), F.count_if(F.col("phase") == 2).alias("later"), F.max("page_number").alias("pages")).withColumn("seconds", chunking.budget_seconds(F.col("pages")))


def anchor_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines, upper-cased on every second page, anchored in the document."""
    lines = document_pages(spark, d).where(F.length("text") > 0)
    evidence = F.when(F.col("page_number") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    pages = lines.withColumn("evidence_text", evidence).withColumn("char_start", (F.col("page_number") * 1000).cast("int"))
    return grounding.anchor(pages).select("document_id", "page_number", "anchor_start", "anchor_end", "exact")


def normalize_units(spark: SparkSession, d: str) -> DataFrame:
    known = by_dictionary(line_facts(spark, d), F.col("value.unit"), unit_info, "q")
    return known.select("fact_id", magnitude(F.col("value.number"), F.col("q")).alias("magnitude"), "q.dimension", "q.currency", "q.base_unit")


def half_steps(spark: SparkSession, d: str) -> DataFrame:
    return line_facts(spark, d).select("fact_id", comparators.half_step(whole_cents(F.col("value.number"))).alias("half"))


def value_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The interval of each line. A line without a figure or a unit keeps what is known of it: the side that its comparator leaves open, and which ends are its own."""
    c, number = F.col, F.col("value.number")
    facts = line_facts(spark, d).withColumn("_told", number.isNotNull() & (c("value.unit").isNotNull() | (number == 0)))
    stood_in = facts.withColumn("value", c("value").withField("number", F.coalesce(number, F.lit(1.0))))
    bound = lambda x: F.when(c("_told") | (F.abs(x) == float("inf")), x)
    return with_value(stood_in, F.lit("quantitative"), "value", "v", whole_cents(number)).select(
        "fact_id", bound(c("v.interval.low")).alias("low"), bound(c("v.interval.high")).alias("high"), "v.interval.low_closed", "v.interval.high_closed", F.when(c("value.unit").isNotNull(), c("v.dimension")).alias("dimension")
    )


def normalize_periods(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct label once."""
    labels = line_facts(spark, d).select(F.col("period.raw_label").alias("label")).distinct()
    return labels.withColumn("p", period(F.col("label"))).select("label", "p.kind", F.col("p.start_date").cast("string").alias("start_date"), F.col("p.end_date").cast("string").alias("end_date"))


def period_relations(spark: SparkSession, d: str) -> DataFrame:
    """How the periods of a supplier's facts lie to those of the next supplier's, by part."""
    labels = line_facts(spark, d).select("entity", "attribute", F.col("period.raw_label").alias("label")).distinct()
    known = labels.select("label").distinct().withColumn("p", period(F.col("label")))
    sides = labels.join(known, "label").select("attribute", F.regexp_extract("entity", r"\d+", 0).cast("long").alias("s"), "p")
    a, b = sides.select("attribute", "s", F.col("p").alias("a")), sides.select("attribute", (F.col("s") - 1).alias("s"), F.col("p").alias("b"))
    return a.join(b, ["attribute", "s"]).groupBy(relation(F.col("a"), F.col("b")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def comparator_phrases(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("over ", "at least ", "fewer than ", "up to ", "roughly ", "between ", "no more than ", "", "north of ", "shy of ")))
    said = F.concat(F.get(words, (F.col("l_partkey") % 10).cast("int")), F.col("l_quantity").cast("int").cast("string"), F.lit(" units"))
    return table(spark, d, "lineitem").groupBy(comparators.phrase_comparator(said).alias("comparator")).agg(F.count(F.lit(1)).alias("n"))


def assumption_flags(spark: SparkSession, d: str) -> DataFrame:
    known = with_period(line_facts(spark, d), F.col("period.raw_label"), "p")
    facts = known.withColumn("f", qualifiers.assumptions(F.col("fact_kind"), F.col("entity_resolved"), F.col("value.comparator"), F.col("p")))
    return facts.select("fact_id", F.array_join("f", ",").alias("flags"), F.round(qualifiers.penalised(F.col("extraction_confidence"), F.col("f")), 9).alias("confidence"))


def significant_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    stated = F.array_sort(F.map_entries("qualifiers"))
    known = by_dictionary(line_facts(spark, d), stated, lambda e: qualifiers.significant(F.map_from_entries(e)), "q")
    return known.groupBy(F.col("q")["basis"].alias("basis"), F.col("q")["audited"].alias("audited")).agg(F.count(F.lit(1)).alias("n"))


def precheck_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of facts in a block, by what the rules make of them."""
    return precheck.outcome_counts(line_facts(spark, d).withColumn("written", whole_cents(F.col("value.number")))).groupBy("outcome", "reason").agg(F.sum("n").alias("n"))


def open_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of facts in a block that corroborate or are left open."""
    return precheck.open_pairs(line_facts(spark, d).withColumn("written", whole_cents(F.col("value.number")))).select("fact_id_a", "fact_id_b", "outcome", "reason")


def knn_candidates(spark: SparkSession, d: str) -> DataFrame:
    near = candidates.nearest(vector_facts(spark, d), k=8, most=KNN_MOST)
    return near.select("fact", "other", "rank", F.round("distance", 9).alias("distance"))


def candidates_by_project(spark: SparkSession, d: str) -> DataFrame:
    """The nearest eight of the same kind in each of three projects, whose facts share ids."""
    near = candidates.nearest(project_facts(spark, d), k=8, most=KNN_MOST)
    return near.select("project_id", "fact", "other", "rank", F.round("distance", 9).alias("distance"))


def graph_candidates(spark: SparkSession, d: str) -> DataFrame:
    """About the ten nearest of every fact whose id is divisible by 50, by an index of all facts in shards of 512."""
    facts = vector_facts(spark, d)
    index = durable(graph_index.build(facts, group=("project_id",), shard=512))
    near = graph_index.search(index, facts.where("fact_id % 50 = 0"), group=("project_id",))
    return near.select("fact", "other", "rank", F.round("distance", 9).alias("distance"))


def knn_other_kind(spark: SparkSession, d: str) -> DataFrame:
    """The nearest three of other kinds for facts of kind 0."""
    near = candidates.nearest(vector_facts(spark, d), k=3, most=None, group=("project_id",), of=F.col("fact_kind") == 0, among=F.col("fact_kind") != 0)
    return near.select("fact", "other", "rank", F.round("distance", 9).alias("distance"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    near = candidates.nearest(vector_facts(spark, d), k=8, most=KNN_MOST)
    kind = F.when((F.col("fact_id_a") + F.col("fact_id_b")) % 3 == 0, "contradicts").otherwise("corroborates")
    return relationships.ordered(near).select("fact_id_a", "fact_id_b", F.round(1 - F.col("distance"), 9).alias("confidence")).dropDuplicates(["fact_id_a", "fact_id_b"]).withColumn("type", kind)


def edges_deduped(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("fact_id_a", "fact_id_b", "type")


def edges_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Edges that touch the facts of each document."""
    docs = vector_facts(spark, d).select("fact_id", "document_id")
    ends = edges(spark, d).select("fact_id_a", "fact_id_b", F.explode(F.array("fact_id_a", "fact_id_b")).alias("fact_id"))
    return ends.join(docs, "fact_id").groupBy("document_id").agg(F.count_distinct("fact_id_a", "fact_id_b").alias("n_edges"))


def disputed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Disputed edges between facts."""
    return relationships.disputes(edges(spark, d), vector_facts(spark, d)).select("fact_id_a", "fact_id_b")


def disputed_edges_all(spark: SparkSession, d: str) -> DataFrame:
    """Disputed edges between facts of all documents."""
    return relationships.disputes(edges(spark, d), vector_facts(spark, d)).select("fact_id_a", "fact_id_b")


def facts_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of verified facts of one kind, by falling time."""
    page = tables.list_facts(line_facts(spark, d), offset=200, limit=200, fact_kind="quantitative", verification_status="verified")
    return page.select("fact_id")


def facts_by_status(spark: SparkSession, d: str) -> DataFrame:
    return tables.counts_by(line_facts(spark, d), "verification_status")


def relationships_by_type(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The facts found for a question, by meaning and by words."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.col("source").alias("entity"), F.col("lang").alias("attribute"), F.col("text").alias("evidence_text"))
    facts = vector_facts(spark, d).join(docs, "fact_id", "left").withColumn("verification_status", F.lit("verified"))
    (question,) = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").collect()
    return search.hybrid(facts, "under the mit license", question["embedding"]).select("place", "fact_id")


def evidence_passages(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.build_chunks(classified(spark, d))
    return search.passages(chunks, "license")


def evaluation_overall(spark: SparkSession, d: str) -> DataFrame:
    _, facts, logs = event_logs(spark, d)
    out = evaluation.overall(facts, logs)
    return out.select("project_id", "grounding_checks", "grounding_pass", "verify_calls", "facts_total", F.round("grounding_pass_rate", 9).alias("pass_rate"), F.round("verified_rate", 9).alias("verified_rate"))


def evaluation_per_document(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.per_document(*event_logs(spark, d))
    return out.select("project_id", "document_id", "facts_total", "grounding_checks", "grounding_pass", "dropped_for_grounding", F.round("grounding_pass_rate", 9).alias("pass_rate"))


def evaluation_timeline(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.timeline(evaluation.per_document(*event_logs(spark, d)))
    return out.select("project_id", "document_id", "index", "cumulative_facts", *[F.round(c, 9).alias(c) for c in ("grounding_pass_rate", "verified_rate", "needs_review_rate")])


def survivorship(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.survivorship(evaluation.per_document(*event_logs(spark, d)))
    return out.withColumn("yield_rate", F.round("yield_rate", 9))


def mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    means = clusters.mean_embedding(vector_facts(spark, d))
    return means.select("document_id", F.posexplode("doc_embedding").alias("pos", "x")).select("document_id", "pos", F.round("x", 6).alias("x"))


def assign_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as documents that arrive by id; those of a kind are a project."""
    docs = vector_facts(spark, d).select(F.col("fact_kind").alias("project_id"), F.col("fact_id").alias("document_id"), F.col("fact_id").alias("created_at"), F.col("embedding").alias("doc_embedding"))
    return clusters.assign(docs, join=0.3)


def concept_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts of the same type and size, whether they name the same."""
    parts = table(spark, d, "part").select("p_type", "p_size", "p_name").distinct()
    pairs = parts.select("p_type", "p_size", F.col("p_name").alias("label_a")).join(parts.select("p_type", "p_size", F.col("p_name").alias("label_b")), ["p_type", "p_size"])
    return concepts.decide(pairs.where("label_a < label_b").select("label_a", "label_b").distinct()).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def concept_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Concepts by brand, with part names as aliases, over a table that knows those of small parts."""
    part = table(spark, d, "part")
    at = lambda df: df.select(F.lit("p").alias("project_id"), F.lit("attribute").alias("kind"), F.col("p_brand").alias("canonical_name"), F.col("p_name").alias("alias"), F.col("p_partkey").cast("string").alias("document_id"), F.timestamp_seconds(F.col("p_partkey")).alias("seen_at"))
    empty = spark.createDataFrame([], "project_id string, kind string, canonical_name string, raw_aliases array<string>, first_seen_document_id string, first_seen_at timestamp")
    known = concepts.upsert(empty, at(part.where("p_size < 25")))
    out = concepts.upsert(known, at(part.where("p_size >= 25")))
    return out.select("canonical_name", F.size("raw_aliases").alias("n_aliases"), F.element_at("raw_aliases", 1).alias("first_alias"), "first_seen_document_id")


def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files that intake rejects, by reason; a document's text stands for a file's content."""
    files = table(spark, d, "documents").select(F.lit("p").alias("project_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.concat(F.lit("%PDF"), "text").cast("binary").alias("content"))
    none = spark.createDataFrame([], "project_id string, content_hash string")
    return tables.intake(files, none).groupBy(F.coalesce("reject_reason", F.lit("taken")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table after every fifth document is deleted."""
    docs, facts, logs = event_logs(spark, d)
    near = facts.select(F.col("fact_id").alias("fact_id_a"), (F.col("fact_id") + 7).alias("fact_id_b"))
    seen = docs.select(F.col("document_id").alias("first_seen_document_id"))
    left = tables.delete_documents(docs.where("document_id % 5 = 0"), docs, docs.select("document_id"), facts, near, logs, seen)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    mentions = left["canonical_concepts"].agg(F.count("first_seen_document_id").alias("n")).select(F.lit("mentions").alias("name"), "n")
    out = mentions
    for c in counts:
        out = out.unionByName(c)
    return out


def verify_states(spark: SparkSession, d: str) -> DataFrame:
    """Lines as facts with scripted verdicts, by the state that they end in."""
    c = F.col
    verdict = lambda n: F.when(n % 7 < 3, "supported").when(n % 7 < 5, "partially_supported").when(n % 7 == 5, "not_supported")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", (c("l_linenumber") != 7).alias("grounded"), F.lit("too short").alias("reason"),
        verdict(c("l_orderkey")).alias("verdict_1"), (c("l_discount") * 10).alias("confidence_1"), F.when(c("l_orderkey") % 11 == 0, "timeout").alias("error_1"),
        F.when(c("l_partkey") % 2 == 0, "unit").alias("correction"), verdict(c("l_partkey")).alias("verdict_2"), (c("l_tax") * 10).alias("confidence_2"), F.lit(None).cast("string").alias("error_2"),
    )
    return verification.verify(rows).groupBy("verification_status", F.substring_index("note", ":", 1).alias("note")).agg(F.count(F.lit(1)).alias("n"))


def dual_reading(spark: SparkSession, d: str) -> DataFrame:
    """Facts of uneven lines borne out, or not, by those of even lines of the same order."""
    facts = line_facts(spark, d).withColumn("chunk_index", F.lit(0)).withColumn("document_id", F.substring_index("fact_id", "-", 1)).withColumns({"entity": F.lit("one"), "attribute": F.lit("one")})
    line = F.split("fact_id", "-")[1].cast("int")
    out = verification.corroborate(facts.where(line % 2 == 1).dropDuplicates(["fact_id"]), facts.where(line % 2 == 0))
    return out.groupBy("agrees", "status").agg(F.count(F.lit(1)).alias("n"))


def read_twice(spark: SparkSession, d: str) -> DataFrame:
    facts = line_facts(spark, d).dropDuplicates(["fact_id"]).withColumns({"anchor": F.lit(1), "verifier_confidence": F.lit(None).cast("double")})
    return verification.read_twice(facts, terms=("metric 49",)).select("document_id", "fact_id")


def correction_diff(spark: SparkSession, d: str) -> DataFrame:
    """Which fields a scripted correction of each order changes."""
    o = table(spark, d, "orders")
    old = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    new = F.struct(F.lit("F").alias("status"), F.upper("o_orderpriority").alias("priority"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("customer"))
    fields = F.array_join(F.array_sort(F.map_keys(tables.changes(old, new, ["status", "priority", "customer"]))), ",")
    return o.groupBy(fields.alias("fields")).agg(F.count(F.lit(1)).alias("n"))


def accounting_figures(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in the accounts' way, read back."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    plain = F.concat((cents / 100).cast("decimal(18,2)").cast("string"))
    written = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("Rs ("), plain, F.lit(") cr"))).otherwise(F.concat(F.lit("rose "), plain))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.parse_figure(written).alias("figure"))


def tool_trace(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as tool loops: what each step comes to."""
    action = F.when(F.col("turn") % 4 == 3, F.when(F.col("conv_id") % 2 == 0, "conclude").otherwise("get_relationships")).when(F.col("turn") % 2 == 1, "get_relationships").otherwise("search_facts")
    steps = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("step"), action.alias("action"), (F.col("conv_id") + F.col("turn")).alias("fact_id"))
    known = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("fact_id"))
    return search.tool_trace(steps, known).select("conversation", "step", "action", "outcome")


def synthesised_answers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as questions, answered from their lines; some fail, some have no facts; two lines of some orders are disputed."""
    key = F.col("o_orderkey")
    facts = line_facts(spark, d).dropDuplicates(["fact_id"]).withColumn("answer_id", F.substring_index("fact_id", "-", 1).cast("long"))
    asked = table(spark, d, "orders").select(F.explode(F.array(key, -key - 1)).alias("answer_id"))
    said = F.to_json(F.struct(F.concat(F.lit(" as [F"), (key % 4 + 1).cast("string"), F.lit("] says ")).alias("answer"), F.array(F.lit("F2"), F.lit("F99")).alias("cited_markers")))
    answers = table(spark, d, "orders").where(key % 7 != 0).select(key.alias("answer_id"), F.when(key % 11 == 0, "no object").otherwise(said).alias("text"), F.when(key % 5 == 0, "timeout").alias("error_type"))
    ends = facts.groupBy("answer_id").agg(F.min("fact_id").alias("fact_id_a"), F.max("fact_id").alias("fact_id_b")).where((F.col("answer_id") % 3 == 0) & (F.col("fact_id_a") != F.col("fact_id_b")))
    edges_ = ends.select("fact_id_a", "fact_id_b", F.when(F.col("answer_id") % 2 == 0, "contradicts").otherwise("corroborates").alias("type"), F.lit(None).cast("string").alias("basis"), F.lit("e").alias("explanation"))
    out = search.synthesise(asked, facts, edges_, answers)
    return out.select("answer_id", "answer", F.coalesce("error", F.lit("")).alias("error"), F.array_join(F.transform("citations", lambda c: c["marker"]), ",").alias("cited"), F.size("disagreements").alias("disagreements"))


def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers that cite some of their lines."""
    facts = line_facts(spark, d).dropDuplicates(["fact_id"]).withColumn("answer_id", F.substring_index("fact_id", "-", 1).cast("long"))
    answers = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("as [F"), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit("] says")).alias("text"),
        F.array(F.lit("F2")).alias("cited"), F.when(F.col("o_orderkey") % 5 == 0, "timeout").alias("error"),
    )
    cited = search.citations(answers, search.markers(facts))
    return cited.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_cited"))


QUERIES = {
    f.__name__: f
    for f in (
        grounding_benchmark, grounding_reasons, route_pages, document_profile, chunk_offsets, plan_batches, page_phases, anchor_lines, normalize_units, half_steps,
        value_intervals, normalize_periods, period_relations, comparator_phrases, assumption_flags, significant_qualifiers, precheck_outcomes, open_pairs, knn_candidates, candidates_by_project, graph_candidates,
        knn_other_kind, edges_deduped, edges_by_document, disputed_edges, disputed_edges_all, facts_page, facts_by_status, relationships_by_type, hybrid_search, evidence_passages,
        evaluation_overall, evaluation_per_document, evaluation_timeline, survivorship, mean_embedding, assign_clusters, concept_decisions, concept_upsert,
        duplicate_documents, cascade_delete, verify_states, dual_reading, read_twice, correction_diff, accounting_figures, tool_trace, synthesised_answers, answer_citations,
    )
}


def stream_log_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type, from a stream."""
    out = drain(log_windows(read_stream(spark, d, "events")))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "n_positive")


def stream_new_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive, each content once."""
    store = state_folder(spark)
    take_new(read_stream(spark, d, "documents"), store)
    return spark.read.parquet(store).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def streamed_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a stream of documents that arrive by id; those of a kind are a project: their clusters and the profile after the last."""
    docs = read_stream(spark, d, "embeddings").select(F.col("label").alias("project_id"), F.col("vec_id").alias("document_id"), F.col("vec_id").alias("created_at"), F.col("embedding").alias("doc_embedding"))
    store = f"{state_folder(spark)}/placed"
    profiles.run(profiles.placements(docs, join=0.3), store, state_folder(spark))
    placed = spark.read.parquet(store)
    return placed.select("project_id", "document_id", "sub_cluster_id", F.round("similarity", 9).alias("similarity"), "off_domain", "place", F.col("profile.document_count").alias("documents_after"))


def comparator_repair(spark: SparkSession, d: str) -> DataFrame:
    """Comparators of quantities after the words before them are read."""
    words = F.array(*map(F.lit, ("over ", "at least ", "fewer than ", "up to ", "roughly ", "between ", "no more than ", "", "north of ", "shy of ")))
    said = F.concat(F.lit("more than all; "), F.get(words, (F.col("l_partkey") % 10).cast("int")), F.col("l_quantity").cast("int").cast("string"), F.lit(" units sent"))
    facts = table(spark, d, "lineitem").select(
        F.lit("quantitative").alias("fact_kind"), said.alias("evidence_text"), F.struct(F.lit("eq").alias("comparator"), F.col("l_quantity").alias("number")).alias("value")
    )
    return repair_comparators(facts).groupBy(F.col("value.comparator").alias("comparator"), "repaired").agg(F.count(F.lit(1)).alias("n"))


def proposed_facts(chunks: DataFrame) -> DataFrame:
    """Two facts for each chunk: with evidence cut from its text, and with evidence, or something else, altered by rule."""
    c = F.col
    cut = F.substring("text", (F.length("text") / 3).cast("int") + 1, F.lit(40))
    rule = c("document_id") + c("chunk_index")
    number = 700_000_000 + c("document_id") % 1000
    halves = F.concat(F.substring(cut, 1, 20), F.lit(" as stated "), F.substring(cut, 21, 20))
    altered = F.when(rule % 6 == 0, F.upper(cut)).when(rule % 6 == 1, halves).when(rule % 6 == 2, F.reverse(cut)).when(rule % 6 == 3, F.concat(F.lit("over "), number.cast("string"), F.lit(" units, "), cut)).otherwise(cut)
    missing = F.when(rule % 6 == 5, -1 - c("chunk_index")).otherwise(c("chunk_index"))
    of = lambda i, evidence, entity, index: F.struct(F.lit(i).alias("i"), evidence.alias("evidence_text"), entity.alias("entity"), index.cast("int").alias("chunk_index"))
    both = F.array(of(0, cut, F.lit("Acme"), c("chunk_index")), of(1, altered, F.when(rule % 6 == 4, " ").otherwise("Acme"), missing))
    return chunks.select("document_id", rule.alias("rule"), number.alias("number"), F.explode(both).alias("f")).select(
        "document_id", "f.chunk_index", "f.evidence_text", "f.entity", F.lit("Volume").alias("attribute"), F.lit(True).alias("entity_resolved"),
        F.when(c("rule") % 7 == 0, "status").when(c("rule") % 7 == 1, "qualitative").otherwise("quantitative").alias("fact_kind"),
        F.struct(F.lit("eq").alias("comparator"), c("number").cast("double").alias("number"), F.lit(None).cast("double").alias("number_high"), F.lit("units").alias("unit"), F.lit("open").alias("state"), F.lit("as stated").alias("text")).alias("value"),
        F.struct(F.lit("FY24").alias("raw_label")).alias("period"), F.create_map(F.when(c("f.i") == 0, "column").otherwise("basis"), F.lit("stated")).alias("qualifiers"), F.lit(0.9).alias("extraction_confidence"),
    )


def finalise_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Facts proposed for every chunk of every document, by what becomes of them."""
    at = f"{state_folder(spark)}/chunks"  # written once, as each branch of finalise reads them
    chunking.build_chunks(classified(spark, d)).select("document_id", "chunk_index", "text", "char_start").write.parquet(at)
    chunks = spark.read.parquet(at).withColumns({"confidence_ceiling": F.lit(1.0), "table_markdown": F.when(F.col("document_id") % 9 == 0, "| t |")})
    kept, dropped = extraction.finalise(proposed_facts(chunks), chunks)
    return extraction.statistics(kept, dropped)


def fact_lines(spark: SparkSession, d: str) -> DataFrame:
    """Facts of lines as they are shown."""
    line = fact_line(F.col("fact_kind"), F.col("entity"), F.col("attribute"), F.col("value"), F.col("period.raw_label"), F.col("document_id"))
    return line_facts(spark, d).select("fact_id", line.alias("line"))


def compare_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as facts of twenty documents, compared, by what the rules make of the pairs."""
    facts = vector_facts(spark, d).withColumns(
        {
            "fact_kind": F.lit("quantitative"), "verification_status": F.lit("verified"), "entity": F.concat(F.lit("e"), F.col("fact_kind") % 3), "attribute": F.concat(F.lit("a"), F.col("fact_kind") % 2), "entity_resolved": F.lit(True),
            "value": F.struct(F.lit("eq").alias("comparator"), (F.col("fact_id") % 3).cast("double").alias("number"), F.lit(None).cast("double").alias("number_high"), F.lit("units").alias("unit"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("text")),
            "period": F.struct(F.lit("FY24").alias("raw_label")), "qualifiers": F.create_map(F.lit("basis"), F.lit("actual")),
        }
    )
    concepts_ = spark.createDataFrame([("p", "entity", "e0", ["e0", "e1"])], "project_id string, kind string, canonical_name string, raw_aliases array<string>")
    none = spark.createDataFrame([], "fact_id_a long, fact_id_b long")
    decided, _ = compare.compare(facts, none, concepts_, most=KNN_MOST)
    return decided.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {f.__name__: f for f in (stream_log_windows, stream_new_documents, streamed_profiles, comparator_repair, finalise_candidates, fact_lines, compare_vectors)}
QUERIES |= knowledge.QUERIES
