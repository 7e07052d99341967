"""URL filters: explicit rules, and logistic regression on hashed character n-grams of host and path.

The n-grams and the hashing run as SQL functions and Spark ML's HashingTF; training and scoring are Spark ML's
LogisticRegression. The labelled table is small by its nature: a few hundred URLs that a person
has judged. The default one joins well-known hosts (factloom.llm.hosts), each with several paths, and made-up ones of
stems that occur in more than one host, so that what is learnt carries over to hosts that were not seen.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is
judged by the model on no n-grams, which is its intercept. Very long urls are read whole. Rows
stay as many as they were, repeated ones too; other columns stay, whatever their names, but for
those of the names that are added. No rows give no rows.
"""

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import WORDS, ascii_lower, packed, unpacked
from factloom.llm.hosts import ALLOWED, BLOCKED, stems

#: The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Stems of the hosts and paths in the default labelled table; a host joins two of a kind.
BAD = (
    "spam", "farm", "cheap", "pills", "casino", "win", "free", "money", "xxx", "cams", "click", "bait", "replica", "watch", "loan", "fast", "bet", "bonus",
    "poker", "slots", "adult", "hot", "viagra", "deal", "crypto", "profit",
)
GOOD = (
    "library", "museum", "news", "science", "garden", "recipe", "history", "weather", "school", "research", "public", "health", "travel", "music", "city",
    "archive", "open", "data", "art", "nature", "law", "sport", "forum", "guide", "docs", "wiki",
)
#: Paths of bad hosts, of good ones, and of any.
BAD_PATHS = ("/buy-now/offer", "/win/bonus?x=1", "/pills/cheap", "/promo/click")
GOOD_PATHS = ("/article/12", "/about", "/docs/index", "/archive/news")
ANY_PATHS = ("/en/12", "/de/645/", "/fr/31.html", "/es/825.html", "/", "", "/en/news?page=2", "/index.html")
#: A host joins a stem with the stems so many places on.
STEPS = (1, 4, 9)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, host, stem, label (1: block): about two thousand rows, whatever is judged.

    Well-known hosts come with their stem. Made-up hosts of two stems are as many of one label as of the other; besides them
    stand ordinary words, alone and in pairs, so that what is in no list is allowed.
    """
    tops, signs, subs = ("com", "org", "net", "info"), ("-", ""), ("", "www.", "m.", "blog.")
    named = [(1.0, f"{a}{signs[(i + n) % 2]}{BAD[(i + n) % len(BAD)]}", BAD_PATHS) for i, a in enumerate(BAD) for n in STEPS]
    named += [(0.0, f"{a}{signs[(i + n) % 2]}{GOOD[(i + n) % len(GOOD)]}", GOOD_PATHS) for i, a in enumerate(GOOD) for n in STEPS]
    plain = [w for w in WORDS if w.isascii()]
    named += [(0.0, f"{a}{plain[(7 * i + 1) % len(plain)] if i % 2 else ''}", GOOD_PATHS) for i, a in enumerate(plain)]
    rows = []
    known = [(label, stem, host) for label, lines in ((1.0, BLOCKED), (0.0, ALLOWED)) for stem, found in stems(lines).items() for host in found]
    for i, (label, stem, host) in enumerate(known):
        some = ((BAD_PATHS if label else GOOD_PATHS)[i % 4], "/", *(ANY_PATHS[(i + k) % len(ANY_PATHS)] for k in (0, 3, 5)))
        rows += [(f"https://{subs[(i + k) % 3]}{host}{path}", host, f"{stem}/{label:.0f}", label) for k, path in enumerate(some)]
    for i, (label, name, paths) in enumerate(named):
        host = f"{name}.{tops[i % 4]}"
        some = (paths[i % len(paths)], *(ANY_PATHS if i < 3 * (len(BAD) + len(GOOD)) else [ANY_PATHS[(i + k) % len(ANY_PATHS)] for k in (0, 3, 5)]))
        rows += [(f"https://{subs[(i + k) % 4]}{host}{path}", host, None, label) for k, path in enumerate(some)]
    return spark.createDataFrame(rows, "url string, host string, stem string, label double")


def host_of(url: Column) -> Column:
    bare = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return ascii_lower(F.substring_index(bare, "/", 1))


def _after(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, F.lit("://"))
    return F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    bare = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.instr(bare, F.lit("/"))
    return F.when(at > 0, bare.substr(at, F.length(bare))).otherwise(F.lit(""))


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of host and path; a mark says which of them they are from."""

    def of(text: Column, mark: str, n: int) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        many = F.length(padded) - n + 1
        return F.when(
            (text != "") & (many > 0),
            F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.concat(F.lit(mark), padded.substr(i, F.lit(n)))),
        ).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(t, m, n) for n in sizes for t, m in ((host, "h:"), (path, "p:"))])


def _features(df: DataFrame, n_features: int) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=n_features).transform(
        df.withColumn("_grams", grams(F.col("host"), F.col("path")))
    )


def train(labelled: DataFrame, *, n_features: int = 16384, reg: float = 0.01) -> LogisticRegressionModel | None:
    """A model from url and label (1: block); None if not both labels occur."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0.0, 1.0)).select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")
    )
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=50).fit(_features(rows, n_features))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text; ties to the smaller text) and its verdict; null if none."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda value: reduce(
        lambda acc, r: F.when(fits(r[1], r[2]), F.lit(value(r))).otherwise(acc), reversed(ordered), F.lit(None).cast("string")
    )
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def judge_urls(pages: DataFrame, model: LogisticRegressionModel | None, *, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, probability (of block, by the model) and verdict.

    Without a model (no labelled table with both labels) a url that fits no rule is allowed.
    """
    row = packed(pages).withColumns({"host": host_of(F.col("row").getField(url)), "path": path_of(F.col("row").getField(url))})
    scored = row if model is None else model.transform(_features(row, model.numFeatures)).withColumn("p", vector_to_array("probability")[1])
    chance = F.lit(0.0) if model is None else F.col("p")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return unpacked(
        scored, pages.columns,
        {"host": F.col("host"), "path": F.col("path"), "rule": rule, "probability": chance, "verdict": F.coalesce(verdict, F.when(chance > 0.5, "block").otherwise("allow"))},
    )
