"""Search and answers: facts by meaning and by words, passages, tool steps, cited markers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import is_object, strip
from factloom.functions.values import plain_number
from factloom.operators.relationships import DISPUTES
from factloom.operators.views import with_document_name
from factloom.schemas import ANSWERING

#: Results of a search; characters around a hit; steps and tool calls of the loops.
FOUND, PASSAGES, BEFORE, AFTER, CONTEXT = 8, 5, 160, 200, 1800
STEPS, TOOL_CALLS, MOST_RESULT, TOOL_FACTS = 5, 3, 2000, 6
#: What an answer says without facts, and after a failure.
NO_FACTS = "This project has no verified facts that address that question."
FAILED = "The answer could not be synthesised. The relevant facts are cited below."


def cosine_distance(a: Column, b: Column) -> Column:
    """In doubles, whatever the elements are."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return 1 - F.try_divide(product(a, b), F.sqrt(product(a, a)) * F.sqrt(product(b, b)))


def hybrid(facts: DataFrame, query: str, vector: list[float], *, kind: str | None = None, limit: int = FOUND) -> DataFrame:
    """Facts nearest to the vector, then facts that hold the query; each once, at its first place.

    The kind limits the nearest only. `%` and `_` in the query are wildcards.
    """
    usable = facts.where(F.col("verification_status").isin(*ANSWERING))
    near = usable.where(F.col("embedding").isNotNull())
    near = near if kind is None else near.where(F.col("fact_kind") == kind)
    distance = cosine_distance(F.col("embedding"), F.array(*map(F.lit, map(float, vector))))
    by_meaning = near.withColumn("_d", distance).orderBy("_d", "fact_id").limit(limit).withColumn("_source", F.lit(0))
    like = f"%{query.strip()}%"
    holds = F.ilike("entity", F.lit(like)) | F.ilike("attribute", F.lit(like)) | F.ilike("evidence_text", F.lit(like))
    by_words = usable.where(holds).orderBy("fact_id").limit(limit).withColumns({"_d": F.lit(0.0), "_source": F.lit(1)})
    both = by_meaning.unionByName(by_words)
    first = F.row_number().over(W.partitionBy("fact_id").orderBy("_source"))
    once = both.withColumn("_n", first).where("_n = 1")
    return once.withColumn("place", F.row_number().over(W.orderBy("_source", "_d", "fact_id"))).drop("_n", "_source", "_d")


def passages(chunks: DataFrame, query: str, *, limit: int = PASSAGES) -> DataFrame:
    """document_id, chunk_index, snippet: chunks that hold the query, in order, with what stands around it."""
    at = F.instr(F.lower("text"), F.lit(query.lower()))
    start = F.greatest(at - BEFORE, F.lit(1))
    return (
        chunks.where(F.ilike("text", F.lit(f"%{query}%")))
        .select("document_id", "chunk_index", F.col("text").substr(start, at + len(query) + AFTER - start).alias("snippet"))
        .orderBy("document_id", "chunk_index")
        .limit(limit)
    )


def tool_line(filename: Column) -> Column:
    """A fact as a tool lists it."""
    v = F.col("value")
    figure = F.concat_ws(" ", F.coalesce(v["comparator"], F.lit("eq")), F.coalesce(plain_number(v["number"]), F.lit("?")), F.when(v["unit"] != "", v["unit"]))
    other = F.coalesce(F.when(v["state"] != "", v["state"]), F.when(v["text"] != "", v["text"]), F.lit("?"))
    label = F.coalesce(F.when(F.col("period.raw_label") != "", F.col("period.raw_label")), F.lit("-"))
    return F.concat(
        F.lit("- ["), F.col("fact_id").cast("string"), F.lit("] "), F.col("entity"), F.lit(" / "), F.col("attribute"), F.lit(" = "), F.when(F.col("fact_kind") == "quantitative", figure).otherwise(other),
        F.lit(" ["), label, F.lit("] ("), filename, F.lit(", p"), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(") status="), F.col("verification_status"),
    )


def search_facts(facts: DataFrame, documents: DataFrame, query: str, *, limit: int = TOOL_FACTS) -> DataFrame:
    """fact_id, line: facts of any status that hold the query, by id. `%` and `_` in the query are wildcards."""
    like = F.lit(f"%{query.strip()}%")
    hits = facts.where(F.ilike("entity", like) | F.ilike("attribute", like) | F.ilike("evidence_text", like)).orderBy("fact_id").limit(limit)
    return with_document_name(hits, documents).select("fact_id", tool_line(F.col("filename")).alias("line"))


def surrounding_context(wanted: DataFrame, facts: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """wanted (fact_id) with output: where each fact is from, its evidence, and the beginning of the page's text."""
    known = with_document_name(facts, documents).select("fact_id", "document_id", "chunk_index", "page_number", "evidence_text", "filename", F.lit(True).alias("_fact"))
    pages = chunks.select("document_id", "chunk_index", F.col("text").alias("_page"))
    joined = wanted.join(known, "fact_id", "left").join(pages, ["document_id", "chunk_index"], "left")
    page = F.concat(F.substring("_page", 1, CONTEXT), F.when(F.length("_page") > CONTEXT, " ...").otherwise(""))
    body = F.when(F.col("_page").isNull(), "(no stored page text)").otherwise(F.concat(F.lit("--- page text ---\n"), page))
    head = F.concat(F.lit("["), F.col("fact_id").cast("string"), F.lit("] ("), F.col("filename"), F.lit(", p"), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(")"))
    found = F.concat_ws("\n", head, F.concat(F.lit("evidence: "), F.coalesce("evidence_text", F.lit(""))), body)
    return joined.select("fact_id", F.when(F.col("_fact").isNull(), F.concat(F.lit("["), F.coalesce(F.col("fact_id").cast("string"), F.lit("")), F.lit("] fact not found in this project"))).otherwise(found).alias("output"))


def tool_trace(steps: DataFrame, known: DataFrame, *, most: int = STEPS) -> DataFrame:
    """steps (conversation, step, action, fact_id) that a loop would take, with what each comes to.

    A loop takes `most` steps at most and ends with the first conclusion or error; an unknown
    fact_id is noted and the loop goes on.
    """
    order = W.partitionBy("conversation").orderBy("step")
    ended = F.sum(F.col("action").isin("conclude", "error").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    taken = steps.withColumns({"place": F.row_number().over(order), "_ended": F.coalesce(ended, F.lit(0))}).where((F.col("place") <= most) & (F.col("_ended") == 0))
    ids = known.select("fact_id").distinct().withColumn("_known", F.lit(True))
    outcome = F.when(F.col("action") == "error", "ended by error").when(F.col("action") == "conclude", "concluded").when((F.col("action") == "get_relationships") & F.col("_known").isNull(), "unknown fact").otherwise("ran")
    return taken.join(ids, "fact_id", "left").withColumn("outcome", outcome).drop("_ended", "_known")


def markers(facts: DataFrame) -> DataFrame:
    """facts of an answer with marker F1, F2, ...: figures first, then by entity and attribute."""
    order = W.partitionBy("answer_id").orderBy(F.col("fact_kind") != "quantitative", F.lower("entity"), F.lower("attribute"), "fact_id")
    return facts.withColumn("marker", F.concat(F.lit("F"), F.row_number().over(order).cast("string")))


def citations(answers: DataFrame, marked: DataFrame) -> DataFrame:
    """answer_id, marker, fact_id of the facts that an answer (text, cited, error) cites.

    Markers in the text count with those listed. After an error, or if none is known, all are cited.
    """
    found = F.array_distinct(F.concat(F.coalesce("cited", F.array().cast("array<string>")), F.regexp_extract_all("text", F.lit(r"\[(F\d+)\]"), F.lit(1))))
    wanted = answers.select("answer_id", "error", found.alias("found"))
    joined = marked.join(wanted, "answer_id").withColumn("_hit", F.array_contains("found", F.col("marker")) & F.col("error").isNull())
    some = F.max("_hit").over(W.partitionBy("answer_id"))
    return joined.withColumn("_some", some).where(F.col("_hit") | ~F.col("_some")).select("answer_id", "marker", "fact_id")


def synthesise(questions: DataFrame, gathered: DataFrame, edges: DataFrame, answers: DataFrame) -> DataFrame:
    """questions (answer_id) with answer, error, citations (marker, fact_id) and disagreements (marker_a, marker_b, type, basis, explanation).

    gathered are the facts of each answer (answer_id and what markers reads), answers what a model says (answer_id, text, error_type): an
    object of answer and cited_markers. A question without facts is told so, whatever a model says. After an error, or a text
    that is no object, the answer says that it failed and all its facts are cited; else those that are listed or named as
    [F1] in the answer, markers of no fact left out. Disagreements are the disputed edges with both ends among the facts.
    """
    marked = markers(gathered)
    said = F.from_json("text", "answer string, cited_markers array<string>")
    told = answers.dropDuplicates(["answer_id"]).select("answer_id", said.alias("_said"), F.col("error_type").alias("_e"), is_object(F.col("text")).alias("_object"), F.lit(True).alias("_there"))
    some = gathered.select("answer_id").distinct().withColumn("_facts", F.lit(True))
    known = questions.select("answer_id").join(some, "answer_id", "left").join(told, "answer_id", "left")
    error = F.when(F.col("_facts").isNull(), None).when(F.col("_there").isNull(), "missing").when(F.col("_e").isNotNull(), F.col("_e")).when(~F.col("_object"), "no JSON object")
    read = known.withColumn("error", error.cast("string")).withColumn(
        "answer", F.when(F.col("_facts").isNull(), NO_FACTS).when(F.col("error").isNotNull(), FAILED).otherwise(strip(F.coalesce("_said.answer", F.lit(""))))
    )
    found = F.array_distinct(F.concat(F.coalesce("_said.cited_markers", F.array().cast("array<string>")), F.regexp_extract_all("answer", F.lit(r"\[(F\d+)\]"), F.lit(1))))
    wanted = read.select("answer_id", "error", found.alias("_found"))
    number = F.substring("marker", 2, 9).cast("int")
    cited = marked.join(wanted, "answer_id").where(F.col("error").isNotNull() | F.array_contains("_found", F.col("marker")))
    # The facts of one answer are few: what a search gathers.
    listed = cited.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "marker", "fact_id"))).alias("_c"))
    side = lambda s: marked.select("answer_id", F.col("fact_id").alias(f"fact_id_{s}"), F.col("marker").alias(f"marker_{s}"), number.alias(f"_{s}"))
    disputed = edges.where(F.col("type").isin(*DISPUTES)).join(side("a"), "fact_id_a").join(side("b"), ["answer_id", "fact_id_b"])
    apart = disputed.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("_a", "_b", "marker_a", "marker_b", "type", "basis", "explanation"))).alias("_d"))
    names = ("marker_a", "marker_b", "type", "basis", "explanation")
    return (
        read.join(listed, "answer_id", "left")
        .join(apart, "answer_id", "left")
        .select(
            "answer_id", "answer", "error",
            F.coalesce(F.transform("_c", lambda c: F.struct(c["marker"].alias("marker"), c["fact_id"].alias("fact_id"))), F.array()).alias("citations"),
            F.coalesce(F.transform("_d", lambda x: F.struct(*[x[n].alias(n) for n in names])), F.array()).alias("disagreements"),
        )
    )
