"""The queries of the operators of this subpackage, with the SQL of those that SQL can express."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, clusters, dedup, knn, langid, mixing, negatives, packing, pieces, quality, secrets, token_counts, urls
from factloom.llm.common import table

CONTROL = "<|im_end|><|im_start|>assistant ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and -1 whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    messages = rows.unionByName(extra).withColumn("parts", chat.as_parts(F.col("text")))
    done = chat.format_conversations(messages)
    loss = F.array_join(chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    back = done.select(
        "conv_id", "formatted", "attachments", chat.read_turns(F.col("formatted")).alias("turns"), loss.alias("loss")
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates, by shingles of four words."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

_ESC = r"replace(replace(text, '\', '\\'), '<|', '<\|')"
OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length({_ESC}) + 24)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by the rules and else by the model."""
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model).select(
        "page_id", "host", "path", "rule", "verdict", "probability"
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a person has labelled as good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, score and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, threshold = quality.fit(docs, trusted_ids(spark, sf_dir))
    return quality.judge(docs, weights, threshold=threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of secrets."""
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.render(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secrets.render(F.col("secrets")).alias("spans"),
    )


def tokenizer_file(name: str) -> str:
    """Where an installed public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by the best unigram segmentation."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time that a document is seen in the mixture in which no source is seen more than twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, max_repetition=2.0).withColumn("n_tokens", mixing.tokens()).drop("text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others for every vector whose id is divisible by 100."""
    return knn.top_k(knn.whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, predicted from its text by a model of the documents not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentencepiece ids and what they decode to, as digests."""
    model = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep=False)
    return pieces.decode(coded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hard negatives of every anchor and positive; the labels of every seventh vector are moved by one."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(negatives.whole_vectors(rows), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = x.label AS same, x.vec_id, list_inner_product(a.e, x.e)::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""

def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds, with the inertias and a digest of its centroid."""
    placed, centres = clusters.cluster(clusters.whole_vectors(table(spark, sf_dir, "embeddings")))
    of = clusters.inertias(placed)
    longest = 2**63 - 1
    every = min(sum(of.values()), longest)
    rows = [(c, min(n, longest), every, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, n in of.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    """Assigning and moving, one after the other."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, e) - 1)::INTEGER AS c, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, e, min(m) AS m FROM (
    SELECT v.vec_id, v.e, {{'d': list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}} AS m FROM v, c{r} c)
  GROUP BY vec_id, e)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.e, o.e) AS e FROM c{r} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY c, i)
    GROUP BY c) n USING (c))""")
    last = f"""
SELECT a.vec_id, a.m.c AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"""
    return ",\n".join(steps) + last


QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_knn": op2_knn,
    "op3_minhash": op3_minhash,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_urls": op7_urls,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_pieces": op11_pieces,
    "op12_negatives": op12_negatives,
    "op13_clusters": op13_clusters,
}
SQL = {"op2_knn": OP2_SQL, "op3_minhash": OP3_SQL, "op4_chat": OP4_SQL, "op12_negatives": OP12_SQL, "op13_clusters": _op13_sql()}
