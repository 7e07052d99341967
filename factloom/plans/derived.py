"""Fact tables derived by rule from the given tables, with the SQL that derives the same."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("INR Crore", "INR million", "Rs. Lakh", "USD billion", "%", "bps", "kg", "thousand tonnes", "sq ft", "days", "shipments", "widgets")
COMPARATORS = ("gt", "gte", "lt", "lte", "approx", "eq", "eq", None)
STATUSES = ("pending", "verified", "auto_corrected", "needs_review", "rejected")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions for each split of the files that are read.
FINER = 8


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table by keys, in partitions whose number grows with the table, so that none grows; they are not merged, as their few bytes are many rows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, FINER * df.rdd.getNumPartitions()), *keys)


def _choose(index: Column, values: tuple) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each row of lineitem."""
    c = F.col
    y, m = F.year("l_shipdate"), F.month("l_shipdate")
    fy = y + F.when(m >= 4, 1).otherwise(0)
    quarter = F.floor((m + 8) % 12 / 3).cast("int") + 1
    two = lambda n: F.lpad((n % 100).cast("string"), 2, "0")
    labels = (
        F.concat(F.lit("FY"), fy),
        F.concat(F.lit("FY "), fy - 1, F.lit("-"), two(fy)),
        F.concat(F.lit("Q"), quarter, F.lit(" FY"), fy),
        F.concat(F.lit("H"), F.when(quarter <= 2, 1).otherwise(2), F.lit(" FY"), fy),
        F.concat(F.lit("CY"), y),
        F.date_format("l_shipdate", "yyyy-MM-dd"),
    )
    value = F.struct(
        _choose(c("l_orderkey") % 8, COMPARATORS).alias("comparator"),
        c("l_extendedprice").alias("number"),
        F.lit(None).cast("double").alias("number_high"),
        _choose(c("l_partkey") % 12, UNITS).alias("unit"),
        F.when(c("l_returnflag") == "R", " Sent  back").when(c("l_returnflag") == "A", "Accepted").otherwise("none").alias("state"),
        F.lit("as stated").alias("text"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.lit("p").alias("project_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"),
        F.concat(F.lit("d"), (c("l_orderkey") % 50).cast("string")).alias("document_id"),
        F.when(c("l_linenumber") == 6, "status").when(c("l_linenumber") == 7, "qualitative").otherwise("quantitative").alias("fact_kind"),
        F.concat(F.lit("Supplier "), c("l_suppkey")).alias("entity"),
        F.concat(F.lit("Metric "), c("l_partkey") % 50).alias("attribute"),
        (c("l_linenumber") != 1).alias("entity_resolved"),
        value.alias("value"),
        F.struct(F.get(F.array(*labels), (c("l_suppkey") % 6).cast("int")).alias("raw_label")).alias("period"),
        F.create_map(F.lit("Basis"), F.when(c("l_linestatus") == "O", "consol").otherwise("standalone"), F.lit("audit_status"), F.when(c("l_returnflag") == "N", "no").otherwise("yes")).alias("qualifiers"),
        _choose(c("l_quantity").cast("int") % 5, STATUSES).alias("verification_status"),
        (c("l_discount") * 5).alias("extraction_confidence"),
        c("l_shipdate").alias("created_at"),
    )


def whole_cents(price: Column) -> Column:
    """A price as it is written: to the cent. Behind that a double may hold noise."""
    return F.round(price * 100) / 100


LINE_FACTS = """
ln AS (
  SELECT *, year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m FROM lineitem),
lq AS (SELECT *, y + CASE WHEN m >= 4 THEN 1 ELSE 0 END AS fy, ((m + 8) % 12) // 3 + 1 AS q FROM ln),
lf AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id, 'd' || (l_orderkey % 50) AS document_id,
    CASE l_linenumber WHEN 6 THEN 'status' WHEN 7 THEN 'qualitative' ELSE 'quantitative' END AS fact_kind,
    'Supplier ' || l_suppkey AS entity, 'Metric ' || (l_partkey % 50) AS attribute, l_linenumber <> 1 AS resolved,
    ['gt', 'gte', 'lt', 'lte', 'approx', 'eq', 'eq', NULL][l_orderkey % 8 + 1] AS comparator, l_extendedprice AS n,
    ['INR Crore', 'INR million', 'Rs. Lakh', 'USD billion', '%', 'bps', 'kg', 'thousand tonnes', 'sq ft', 'days', 'shipments', 'widgets'][l_partkey % 12 + 1] AS unit,
    ['currency', 'currency', 'currency', 'currency', 'percent', 'percent', 'mass', 'mass', 'area', 'duration', 'count', 'unknown'][l_partkey % 12 + 1] AS dim,
    ['INR', 'INR', 'INR', 'USD', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL][l_partkey % 12 + 1] AS currency,
    ['INR', 'INR', 'INR', 'USD', 'fraction', 'fraction', 'kg', 'kg', 'm2', 'day', 'unit', ''][l_partkey % 12 + 1] AS base_unit,
    ([1e7, 1e6, 1e5, 1e9, 1, 1, 1, 1e3, 1, 1, 1, 1]::DOUBLE[])[l_partkey % 12 + 1] AS scale,
    ([1, 1, 1, 1, 1e-2, 1e-4, 1, 1e3, 0.09290304, 1, 1, 1]::DOUBLE[])[l_partkey % 12 + 1] AS factor,
    CASE l_suppkey % 6 WHEN 0 THEN 'FY' || fy WHEN 1 THEN 'FY ' || (fy - 1) || '-' || lpad((fy % 100)::VARCHAR, 2, '0')
      WHEN 2 THEN 'Q' || q || ' FY' || fy WHEN 3 THEN 'H' || CASE WHEN q <= 2 THEN 1 ELSE 2 END || ' FY' || fy
      WHEN 4 THEN 'CY' || y ELSE strftime(l_shipdate, '%Y-%m-%d') END AS label,
    CASE l_suppkey % 6 WHEN 2 THEN 'quarter' WHEN 3 THEN 'half' WHEN 4 THEN 'calendar_year' WHEN 5 THEN 'date' ELSE 'fiscal_year' END AS period_kind,
    (CASE l_suppkey % 6 WHEN 2 THEN make_date(fy - 1, 4, 1) + INTERVAL (3 * (q - 1)) MONTH
      WHEN 3 THEN make_date(fy - 1, 4, 1) + INTERVAL (CASE WHEN q <= 2 THEN 0 ELSE 6 END) MONTH
      WHEN 4 THEN make_date(y, 1, 1) WHEN 5 THEN l_shipdate::DATE ELSE make_date(fy - 1, 4, 1) END)::DATE AS d0,
    (CASE l_suppkey % 6 WHEN 2 THEN make_date(fy - 1, 4, 1) + INTERVAL (3 * q) MONTH - INTERVAL 1 DAY
      WHEN 3 THEN make_date(fy - 1, 4, 1) + INTERVAL (CASE WHEN q <= 2 THEN 6 ELSE 12 END) MONTH - INTERVAL 1 DAY
      WHEN 4 THEN make_date(y, 12, 31) WHEN 5 THEN l_shipdate::DATE ELSE make_date(fy, 3, 31) END)::DATE AS d1,
    CASE WHEN l_linestatus = 'O' THEN 'consolidated' ELSE 'standalone' END AS basis, CASE WHEN l_returnflag = 'N' THEN 'false' ELSE 'true' END AS audited,
    CASE l_returnflag WHEN 'R' THEN 'sent back' WHEN 'A' THEN 'accepted' ELSE 'none' END AS state,
    ['pending', 'verified', 'auto_corrected', 'needs_review', 'rejected'][l_quantity::INTEGER % 5 + 1] AS status,
    l_discount * 5 AS confidence, l_shipdate AS created_at
  FROM lq),
lh AS (
  SELECT *, round(n * 100)::BIGINT AS cents FROM lf),
ls AS (
  SELECT *, CASE WHEN cents = 0 THEN 0.5 WHEN cents % 10 <> 0 THEN 0.005 WHEN cents % 100 <> 0 THEN 0.05
    ELSE 0.5 * pow(10, length((cents // 100)::VARCHAR) - length(rtrim((cents // 100)::VARCHAR, '0'))) END::DOUBLE AS half,
    (n * scale) * factor AS magnitude FROM lh),
li AS (
  SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE magnitude / n END AS ratio,
    CASE comparator WHEN 'gt' THEN n WHEN 'gte' THEN n WHEN 'lt' THEN '-inf'::DOUBLE WHEN 'lte' THEN '-inf'::DOUBLE
      WHEN 'approx' THEN n - greatest(abs(n) * 0.05::DOUBLE, 0.5::DOUBLE, half) ELSE n - half END AS low,
    CASE comparator WHEN 'gt' THEN 'inf'::DOUBLE WHEN 'gte' THEN 'inf'::DOUBLE WHEN 'lt' THEN n WHEN 'lte' THEN n
      WHEN 'approx' THEN n + greatest(abs(n) * 0.05::DOUBLE, 0.5::DOUBLE, half) ELSE n + half END AS high,
    coalesce(comparator, '') NOT IN ('gt', 'lt', 'lte') AS low_closed, coalesce(comparator, '') IN ('lte', 'approx') AS high_closed FROM ls),
facts AS (
  SELECT *, CASE WHEN abs(low) = 'inf'::DOUBLE THEN low ELSE low * ratio END AS base_low,
    CASE WHEN abs(high) = 'inf'::DOUBLE THEN high ELSE high * ratio END AS base_high FROM li)"""


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each line of a document, with a geometry by rule."""
    c = F.col
    lines = table(spark, sf_dir, "documents").select(c("doc_id").alias("document_id"), "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    page = c("pos") + 1
    return lines.select(
        "document_id",
        page.cast("int").alias("page_number"),
        "text",
        F.length("text").alias("char_count"),
        (600.0 + c("document_id") % 5 * 100).alias("width"),
        F.lit(800.0).alias("height"),
        ((c("document_id") * 3 + page) % 10 / 20).alias("image_area_ratio"),
        (page % 3).alias("image_count"),
        (page % 6).alias("drawing_count"),
        F.lit(False).alias("table_scan_skipped"),
        F.array().cast("array<struct<rows:array<array<string>>,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>").alias("tables"),
        c("source").alias("producer"),
        F.lit(None).cast("string").alias("creator"),
    )


PAGES = """
pg AS (
  SELECT doc_id AS document_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
pc AS (
  SELECT *, length(text) AS char_count, 600.0 + document_id % 5 * 100 AS width, (document_id * 3 + page) % 10 / 20 AS image_area, page % 3 AS image_count, page % 6 AS drawings,
    CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) END AS digits FROM pg),
paged AS (
  SELECT *, CASE WHEN char_count < 15 AND image_area < 0.15 AND drawings < 5 THEN 'empty'
      WHEN char_count < 25 AND (image_area >= 0.15 OR image_count >= 1) THEN 'image_only' ELSE 'text_native' END AS content_type FROM pc)"""


def event_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, facts and logs: a user is a document, an event is a fact and its log."""
    e = table(spark, sf_dir, "events").withColumn("project_id", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")))
    kind = F.col("event_type")
    docs = e.groupBy("project_id", F.col("user_id").alias("document_id")).agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).cast("int").alias("n"))
    docs = docs.withColumn(
        "extraction_stats",
        F.struct(
            F.when(F.col("document_id") % 4 == 0, 0).otherwise(F.col("n") + 3).alias("candidates_returned"), F.when(F.col("document_id") % 4 == 0, 0).otherwise(F.col("n")).alias("candidates_kept"),
            (F.col("document_id") % 3).cast("int").alias("dropped_invalid"), (F.col("document_id") % 2).cast("int").alias("dropped_no_column_context"),
        ),
    )
    facts = e.select("project_id", F.col("event_id").alias("fact_id"), F.col("user_id").alias("document_id"), F.when(kind == "error", "rejected").when(kind == "signup", "needs_review").when(kind == "purchase", "auto_corrected").otherwise("verified").alias("verification_status"))
    logs = e.select(
        "project_id", F.col("event_id").alias("fact_id"), F.when(kind.isin("purchase", "signup"), "independent_verify").otherwise("grounding_check").alias("stage"),
        F.when(kind == "error", "fail").when(kind == "purchase", "supported").when(kind == "signup", "partially_supported").otherwise("pass").alias("result"),
    )
    return docs, facts, logs


LOGS = """
ev AS (
  SELECT *, 'p' || (user_id % 3) AS project_id, user_id AS document_id,
    CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'needs_review' WHEN 'purchase' THEN 'auto_corrected' ELSE 'verified' END AS status,
    event_type NOT IN ('purchase', 'signup') AS is_check, event_type NOT IN ('purchase', 'signup', 'error') AS is_pass FROM events),
pd AS (
  SELECT project_id, document_id, min(ts) AS created_at, count(*)::BIGINT AS facts_total, count(*) FILTER (status = 'verified')::BIGINT AS facts_verified,
    count(*) FILTER (status = 'needs_review')::BIGINT AS facts_needs_review, count(*) FILTER (is_check)::BIGINT AS checks, count(*) FILTER (is_check AND is_pass)::BIGINT AS passed FROM ev GROUP BY 1, 2)"""


def vector_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("p").alias("project_id"), F.col("vec_id").alias("fact_id"), F.col("label").alias("fact_kind"), (F.col("vec_id") % 20).alias("document_id"), "embedding", (F.col("vec_id") % 20 * 50 + F.floor(F.col("vec_id") / 20) % 50).cast("int").alias("chunk_index")
    )


def project_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each embedding, in three projects; each id names a fact in all of them. Some embeddings are null, cut short, or hold a null."""
    c, e = F.col, F.col("embedding")
    odd = F.when(c("vec_id") % 41 == 7, F.lit(None)).when(c("vec_id") % 29 == 3, F.slice(e, 1, 8)).when(c("vec_id") % 37 == 5, F.concat(F.array(F.lit(None).cast("float")), F.slice(e, 2, 63))).otherwise(e)
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("p"), (c("vec_id") % 3).cast("string")).alias("project_id"), F.floor(c("vec_id") / 3).alias("fact_id"), (c("label") % 5).alias("fact_kind"), odd.alias("embedding")
    )


PROJECT_FACTS = """
pf AS (
  SELECT 'p' || (vec_id % 3) AS project_id, vec_id // 3 AS fact_id, label % 5 AS fact_kind,
    CASE WHEN vec_id % 29 = 3 THEN embedding[1:8] ELSE embedding END::DOUBLE[] AS e FROM embeddings WHERE vec_id % 41 <> 7 AND (vec_id % 37 <> 5 OR vec_id % 29 = 3))"""
