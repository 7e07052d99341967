"""Views: what lists, statuses, look-ups and tables on a screen read."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.values import plain_number
from factloom.operators import relationships
from factloom.schemas import STATUSES

#: Columns that a table of facts is sorted by.
SORTS = ("entity", "attribute", "value", "period", "status")


def latest_first(df: DataFrame, key: str) -> DataFrame:
    """Documents or projects by falling time; ties by key."""
    return df.orderBy(F.desc("created_at"), key)


def lookup(df: DataFrame, **equal) -> DataFrame:
    """The rows with these values, one if they are a key; none if there is none."""
    out = df
    for column, value in equal.items():
        out = out.where(F.col(column).eqNullSafe(F.lit(value)))
    return out


def with_document_name(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """facts with the filename of their document, `?` if it is not there."""
    names = documents.select("document_id", "filename").dropDuplicates(["document_id"])
    return facts.join(names, "document_id", "left").withColumn("filename", F.coalesce("filename", F.lit("?")))


def document_status(documents: DataFrame, chunks: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """documents with chunk_count, fact_count, facts_by_status (a map) and relationship_count; 0 and empty where there is nothing.

    An edge counts once for a document, whether one of its ends or both are there.
    """
    n_chunks = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    counts = F.array(*[F.struct(F.lit(s).alias("key"), F.count_if(F.col("verification_status") == s).alias("value")) for s in STATUSES])
    n_facts = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("fact_count"), F.map_from_entries(F.filter(counts, lambda e: e["value"] > 0)).alias("facts_by_status"))
    ends = edges.select("fact_id_a", "fact_id_b", F.explode(F.array("fact_id_a", "fact_id_b")).alias("fact_id"))
    n_edges = ends.join(facts.select("fact_id", "document_id"), "fact_id").groupBy("document_id").agg(F.count_distinct("fact_id_a", "fact_id_b").alias("relationship_count"))
    out = documents.join(n_chunks, "document_id", "left").join(n_facts, "document_id", "left").join(n_edges, "document_id", "left")
    return out.na.fill(0, ["chunk_count", "fact_count", "relationship_count"]).withColumn("facts_by_status", F.coalesce("facts_by_status", F.create_map().cast("map<string,bigint>")))


def sort_key(by: str) -> Column:
    """What a table of facts is sorted by."""
    if by not in SORTS:
        raise ValueError(f"no such sort: {by}")
    v = F.col("value")
    return {
        "entity": F.lower("entity"),
        "attribute": F.lower("attribute"),
        "value": F.coalesce(plain_number(v["number"]), v["state"], v["text"], F.lit("")),
        "period": F.coalesce(F.col("period.raw_label"), F.lit("")),
        "status": F.col("verification_status"),
    }[by]


def sorted_facts(facts: DataFrame, by: str, *, rising: bool = True) -> DataFrame:
    key = sort_key(by)
    return facts.orderBy(key.asc() if rising else key.desc(), "fact_id")


def evidence_steps(facts: DataFrame, order: list[Column], within: str = "document_id") -> DataFrame:
    """facts with previous_fact and next_fact, the neighbours in the order; null at the ends."""
    steps = W.partitionBy(within).orderBy(*order)
    return facts.withColumns({"previous_fact": F.lag("fact_id").over(steps), "next_fact": F.lead("fact_id").over(steps)})


class Project:
    """The reads of one project: each method returns a DataFrame over the project's tables."""

    def __init__(self, project_id: str, tables: dict[str, DataFrame]):
        self.project_id = project_id
        self.tables = {name: df.where(F.col("project_id") == project_id) for name, df in tables.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def documents(self) -> DataFrame:
        return latest_first(self["documents"], "document_id")

    def document(self, document_id: str) -> DataFrame:
        return lookup(self["documents"], document_id=document_id)

    def document_by_hash(self, content_hash: str) -> DataFrame:
        return lookup(self["documents"], content_hash=content_hash)

    def status(self, document_id: str | None = None) -> DataFrame:
        documents = self["documents"] if document_id is None else self.document(document_id)
        return document_status(documents, self["chunks"], self["facts"], self["fact_relationships"])

    def facts(self, **options) -> DataFrame:
        from factloom.operators.tables import list_facts

        return list_facts(self["facts"], **options)

    def fact(self, fact_id: str) -> DataFrame:
        return lookup(self["facts"], fact_id=fact_id)

    def relationships(self, **options) -> DataFrame:
        return relationships.listed(self["fact_relationships"], **options)

    def relationship(self, relationship_id: str) -> DataFrame:
        return relationships.detail(lookup(self["fact_relationships"], relationship_id=relationship_id), self["facts"])

    def counts(self) -> DataFrame:
        """kind, name, n: facts by status, relationships by type."""
        of = lambda table, column, kind: self[table].groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
        return of("facts", "verification_status", "facts").unionByName(of("fact_relationships", "type", "relationships"))

    def vocabulary(self) -> DataFrame:
        """document_id, entity: the distinct entities of each document."""
        return self["facts"].where(F.trim("entity") != "").select("document_id", F.trim("entity").alias("entity")).distinct()

    def ontology(self) -> DataFrame:
        from factloom.operators.concepts import ontology

        return ontology(self["canonical_concepts"], self["documents"])

    def evaluation(self) -> DataFrame:
        from factloom.operators.evaluation import overall

        return overall(self["facts"], self["verification_logs"])

    def evidence(self, fact_id: str | None = None) -> DataFrame:
        """Facts, or one, with the boxes of their evidence; the tables `words` and `pages` tell the layout."""
        from factloom.operators import evidence

        facts = self["facts"] if fact_id is None else self.fact(fact_id)
        return evidence.view(facts, self["documents"], self["chunks"], self["words"], self["pages"])
