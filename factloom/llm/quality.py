"""Quality rules: fixed base counts, and a hashed n-gram log-likelihood ratio between two multinomials.

The trusted-target and the raw-corpus model are multinomials over hash buckets of word unigrams
and bigrams. The raw one counts every n-gram of every document; the target one counts those of
trusted documents, of which at most `max_trusted` take part (those with the smallest hash of
their id; that bound is a parameter). A document's score is the sum of the log ratios of its
n-grams over their number, in millionths of a nat as whole numbers, so that it is the same in
any order of summing. A document is kept if the score is the threshold at least; the threshold comes
from trusted documents that are held out.

Windows of words are compared by 64-bit hashes.

Defined results: a null or empty text has no words and fails the base rules; a document without
n-grams scores 0; without trusted documents every score is 0 and only the base rules reject; a
trusted id that occurs more than once counts once; a score that ties with the threshold is kept;
repeated rows are documents of their own; very long texts are read whole; no rows give no rows; other columns stay,
whatever their names, but for those of the names that are added.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.llm.common import BLANKS, packed, text_of, unpacked, words

MICRO = 1_000_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of held-out trusted documents that may score under the threshold.
MISSED = 0.005


def _tail(arr: Column, start: int) -> Column:
    """arr from the start-th element (from 1) on; empty past its end."""
    return F.slice(arr, F.lit(start), F.greatest(F.size(arr) - (start - 1), F.lit(0)))


def with_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words, and _h with a 64-bit hash of each."""
    return docs.withColumn("_words", words(text_of(text))).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def buckets(h: Column, n_buckets: int) -> Column:
    """Buckets of the unigrams, then of the bigrams."""
    ahead = F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
    return F.concat(
        F.transform(h, lambda x: F.pmod(x, F.lit(n_buckets)).cast("int")),
        F.zip_with(ahead, _tail(h, 2), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n_buckets)).cast("int")),
    )


def held_out(doc_id: Column) -> Column:
    """Whether a trusted document stays out of the model that the threshold is found with."""
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(2)) == 1


def chosen(trusted: DataFrame, most: int) -> DataFrame:
    return trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(raw: list[int], target: list[int], alpha: float) -> list[int]:
    if not sum(target):
        return [0] * len(raw)
    a, b = math.log(sum(target) + alpha * len(raw)), math.log(sum(raw) + alpha * len(raw))
    return [round(MICRO * (math.log(t + alpha) - a - math.log(r + alpha) + b)) for t, r in zip(target, raw)]


def quantile_of(values: list[float], share: float) -> float:
    """The value that at most so large a share lies under; without values, under every score."""
    return sorted(values)[math.floor(share * len(values))] if values else -math.inf


def fit(docs: DataFrame, trusted: DataFrame, *, n_buckets: int = 8192, max_trusted: int = 20_000, alpha: float = 1.0, missed: float = MISSED) -> tuple[list[int], float]:
    """Log ratio of each bucket, target over raw, in millionths; and the threshold.

    The threshold is the score that a share `missed` of held-out trusted documents stays under: half of
    them, by hash, are scored by a model that has not counted them as targets. Those that fail the
    base rules don't count. What reaches the driver is n_buckets counts and max_trusted scores.
    """
    ids = chosen(trusted, max_trusted)
    marked = with_hashes(docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("_target", F.when(held_out(F.col("doc_id")), 2).otherwise(1))), "doc_id", "left"))
    counted = (
        marked.select("_target", F.explode(buckets(F.col("_h"), n_buckets)).alias("b"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("_target").alias("target"), F.count(F.when(F.col("_target") == 1, 1)).alias("half"))
        .collect()
    )
    raw, target, half = ([0] * n_buckets for _ in range(3))
    for r in counted:
        raw[r["b"]], target[r["b"]], half[r["b"]] = r["raw"], r["target"], r["half"]
    held = docs.select("doc_id", "text").join(F.broadcast(ids.where(held_out(F.col("doc_id")))), "doc_id")
    # Told apart here, as a filter would be moved below the join and judge every document.
    scored = judge(held, log_ratios(raw, half, alpha)).select("score", "base_failed").collect() if sum(half) else []
    return log_ratios(raw, target, alpha), quantile_of([r["score"] for r in scored if not r["base_failed"]], missed)


def fit_weights(docs: DataFrame, trusted: DataFrame, **options) -> list[int]:
    """The log ratios alone."""
    return fit(docs, trusted, **options)[0]


def repeated_words(h: Column) -> Column:
    """Words (as hashes) in windows of WINDOW words that occur twice or more."""
    many = F.size(h) - (WINDOW - 1)
    wins = F.when(
        many > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.zip_with(starts, _tail(starts, 2), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0).cast("long"), lambda n, x: n + x
        )

    def starts_of(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(ordered, lambda o: let(starts_of(o), covered))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), found).otherwise(F.lit(0).cast("long"))

    return let(wins, count)


def judge(docs: DataFrame, weights: list[int], *, threshold: float = -math.inf, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept."""
    table = F.from_json(F.lit(str(weights)), "array<int>")
    t = text_of(F.col("row").getField(text))
    lines = F.filter(F.split(t, "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != "")

    def of_hashes(h: Column) -> Column:
        n = F.size(h).cast("long")
        total = F.aggregate(buckets(h, len(weights)), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
        score = total / F.greatest(2 * n - 1, F.lit(1)) / MICRO

        def verdict(x: Column) -> Column:
            failed = (n < 20) | (100 * x["n_repeat_words"] > 30 * n)
            return F.struct(
                n.alias("n_words"),
                x["n_repeat_words"].alias("n_repeat_words"),
                x["score"].alias("score"),
                failed.alias("base_failed"),
                (~failed & (x["score"] >= threshold)).alias("kept"),
            )

        return let(F.struct(repeated_words(h).alias("n_repeat_words"), score.alias("score")), verdict)

    judged = let(F.transform(words(t), lambda w: F.xxhash64(w)), of_hashes)
    added = {
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        **{c: F.col(f"judged.{c}") for c in ("n_words", "n_repeat_words", "score", "base_failed", "kept")},
    }
    return unpacked(packed(docs).withColumn("judged", judged), docs.columns, added)
