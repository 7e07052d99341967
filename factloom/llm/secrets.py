"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two models of order one are trained from labelled samples: random strings and ordinary
identifiers. The chance of a character after another mixes their bigram with that of their
classes (upper, lower, digit, sign), so that unseen words of letters stay ordinary. Base spans are
cut out of a run of token characters; each piece of 20 or more that is left is judged:

1. The piece is a secret if the mean log ratio of its transitions is over the threshold.
2. If not, ordinary text may be joined to a secret: each part of 20 or more between / = _ - is
   judged as if it stood alone; and a running sum of the log ratios over the threshold gives the
   stretches whose excess reaches LEAST_EXCESS, which are widened to whole parts.

Spans are in code points, end exclusive. Spark has no positions for matches, so they are
summed up from the lengths of the matches and of the pieces between them.

Defined results: a null or empty text has no spans; ties in start are ordered by kind as listed
in KINDS; repeated rows are texts of their own; very long texts are read whole; no rows give no
rows; other columns stay, whatever their names, but `secrets` is replaced.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.llm.common import WORDS, packed, text_of, unpacked

#: The base patterns of the contract. Those of access and hex hold their least
#: length, as their runs are maximal; assign is checked after the match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Least length of a secret by the models; the signs that part a run; and the excess (thousandths) that a stretch needs.
LEAST, SEPARATORS, LEAST_EXCESS = 20, "/_=-", 16_000


def labelled_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """text, random (boolean): n random strings of four alphabets and n ordinary identifiers, by rule.

    Ordinary are UUIDs, digests whose groups are parted by dashes and fingerprints, too: they name things and hide nothing.
    """
    ids = spark.range(n, numPartitions=1)
    digest = F.unhex(F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256))
    base64 = F.base64(digest)
    bare, one = F.regexp_replace(base64, "[^A-Za-z0-9]", ""), F.col("id") % 4
    random = F.when(one == 0, F.lower(F.hex(digest))).when(one == 1, base64).when(one == 2, F.upper(bare)).otherwise(F.lower(bare))
    word = lambda k: F.get(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    a, b, c = word(1), word(2), word(3)
    k = F.col("id") % 13
    code = F.lower(F.hex(F.unhex(F.sha2(F.concat(F.lit("name"), F.col("id").cast("string")), 256))))
    grouped = lambda *ends: F.concat_ws("-", *[F.substring(code, a + 1, b - a) for a, b in zip((0, *ends), ends)])
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64("id"), F.lit(15_000)).cast("int")).cast("string")
    ordinary = (
        F.when(k == 0, F.concat_ws("_", a, b, c))
        .when(k == 1, F.concat(a, F.initcap(b), F.initcap(c)))
        .when(k == 2, F.concat(a, b, c))
        .when(k == 3, F.concat(F.lit("/"), a, F.lit("/"), b, F.lit("-"), c, (F.col("id") % 10).cast("string")))
        .when(k == 4, F.upper(F.concat(a, b, c)))
        .when(k == 5, F.upper(F.concat_ws("_", a, b, c)))
        .when(k == 6, F.repeat(F.get(F.array(*map(F.lit, "=-_+/")), (F.col("id") / 10 % 5).cast("int")), 30))
        .when(k == 7, F.repeat(day, 2))
        .when(k == 8, F.pmod(F.xxhash64("id"), F.lit(10**17)).cast("string"))
        .when(k == 9, grouped(8, 12, 16, 20, 32))
        .when(k == 10, F.upper(grouped(8, 12, 16, 20, 32)))
        .when(k == 11, grouped(7, 15, 23, 31, 39, 47))
        .otherwise(F.repeat(F.substring(F.concat(a, b), 1, 1), 20))
    )
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(
        ids.select(ordinary.alias("text"), F.lit(False).alias("random"))
    )


def _kind_of(ch: str) -> str:
    return "upper" if "A" <= ch <= "Z" else "lower" if "a" <= ch <= "z" else "digit" if "0" <= ch <= "9" else "sign"


def train(samples: DataFrame, *, share: float = 0.8) -> list[int]:
    """Log ratio of each pair of characters of ALPHABET, random over ordinary, in thousandths.

    share is the weight of the bigram against that of the classes. What reaches the driver is
    at most two counts for each pair.
    """
    at = {c: i for i, c in enumerate(ALPHABET)}
    pairs = (
        samples.where(F.length("text") > 1)
        .select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    size = {k: sum(_kind_of(c) == k for c in ALPHABET) for k in ("upper", "lower", "digit", "sign")}

    def chances(random: bool) -> dict[tuple[str, str], float]:
        seen = {(r["pair"][0], r["pair"][1]): r["count"] for r in pairs if r["random"] == random and r["pair"][0] in at and r["pair"][1] in at}
        first = dict.fromkeys(ALPHABET, 0)
        kinds = {(a, b): 1.0 for a in size for b in size}
        for (a, b), n in seen.items():
            first[a] += n
            kinds[_kind_of(a), _kind_of(b)] += n
        total = {a: sum(kinds[a, b] for b in size) for a in size}
        out = {}
        for a in ALPHABET:
            for b in ALPHABET:
                ka, kb = _kind_of(a), _kind_of(b)
                by_kind = kinds[ka, kb] / total[ka] / size[kb]
                w = share if first[a] else 0.0
                out[a, b] = w * (seen.get((a, b), 0) / max(first[a], 1)) + (1 - w) * by_kind
        return out

    one, two = chances(True), chances(False)
    return [round(1000 * (math.log(one[a, b]) - math.log(two[a, b]))) for a in ALPHABET for b in ALPHABET]


def _found(text: Column, pattern: str, matches: Column, kind: int) -> Column:
    """Spans of all matches of a pattern."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["match"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).cast(SPANS).alias("spans"))

    both = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
    )
    return F.when(F.size(matches) > 0, F.aggregate(both, start, add, lambda acc: acc["spans"])).otherwise(F.array().cast(SPANS))


def _pieces(run: Column, base: Column) -> Column:
    """What sorted base spans leave of a run, in pieces of LEAST characters or more."""
    span = lambda start, end: F.array(F.struct(start.alias("start"), F.lit(3).alias("kind"), end.alias("end")))
    start = F.struct(run["start"].alias("at"), F.array().cast(SPANS).alias("out"))

    def cut(acc: Column, b: Column) -> Column:
        out = F.when(b["start"] > acc["at"], F.concat(acc["out"], span(acc["at"], b["start"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), out.cast(SPANS).alias("out"))

    over = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    left = F.aggregate(over, start, cut, lambda acc: F.concat(acc["out"], span(acc["at"], run["end"])))
    return F.filter(left, lambda p: p["end"] - p["start"] >= LEAST)


def _stretches(steps: Column, begin: Column, s: Column) -> Column:
    """Spans of the stretches of a piece s whose excess reaches LEAST_EXCESS, widened to whole parts.

    A stretch ends at its highest sum once the sum has fallen by LEAST_EXCESS from there, so no
    stretch with that much is passed over.
    """
    none = F.array().cast("array<struct<from:int,to:int>>")
    zero = F.lit(0)
    start = F.struct(
        zero.alias("at"), zero.alias("part"), zero.cast("long").alias("sum"), zero.cast("long").alias("best"),
        zero.alias("from"), zero.alias("to"), none.alias("out"),
    )
    stretch = lambda acc: F.array(F.struct(acc["from"].alias("from"), acc["to"].alias("to"))).cast("array<struct<from:int,to:int>>")
    closed = lambda acc: F.when(acc["best"] >= LEAST_EXCESS, F.concat(acc["out"], stretch(acc))).otherwise(acc["out"])

    def add(acc: Column, step: Column) -> Column:
        # at is the place of the step's first character, part the start of the part that it is in
        part = F.when(step["sign"], acc["at"] + 1).otherwise(acc["part"])
        now = acc["sum"] + step["excess"]
        stop = now <= F.greatest(zero.cast("long"), acc["best"] - LEAST_EXCESS)
        higher = now > acc["best"]
        return F.struct(
            (acc["at"] + 1).alias("at"), part.alias("part"), F.when(stop, 0).otherwise(now).cast("long").alias("sum"),
            F.when(stop, 0).when(higher, now).otherwise(acc["best"]).cast("long").alias("best"),
            F.when(acc["sum"] > 0, acc["from"]).otherwise(part).cast("int").alias("from"),
            F.when(higher, acc["at"] + 2).otherwise(acc["to"]).cast("int").alias("to"),
            F.when(stop, closed(acc)).otherwise(acc["out"]).alias("out"),
        )

    def widened(x: Column) -> Column:
        end = F.greatest(x["to"], x["to"] - 1 + F.length(F.regexp_extract(s.substr(x["to"], F.length(s)), f"^[^{SEPARATORS}]*", 0)))
        return F.struct((begin + x["from"]).alias("start"), F.lit(3).alias("kind"), (begin + end).alias("end"))

    wide = F.transform(F.aggregate(steps, start, add, closed), widened)
    return F.array_distinct(F.filter(wide, lambda x: x["end"] - x["start"] >= LEAST)).cast(SPANS)


def scan(docs: DataFrame, model: list[int], *, threshold: float = 0.35, text: str = "text") -> DataFrame:
    """docs with secrets: an array of (start, kind, end), kind being an index of KINDS, by start, then kind."""
    t = text_of(F.col("row").getField(text))
    n = len(ALPHABET)
    limit = round(1000 * threshold)
    weights = F.from_json(F.lit(str(model)), "array<int>")
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    found = packed(docs).withColumns({"_assign": every(ASSIGN), "_access": every(ACCESS), "_hex": every(HEX), "_run": every(RUN)})
    long_enough = F.transform("_assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    codes = lambda s: F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # excess of each transition over the threshold, and whether its first character parts the run
    steps = lambda s: let(
        codes(s),
        lambda k: F.zip_with(
            F.slice(k, F.lit(1), F.length(s) - 1), F.slice(k, F.lit(2), F.length(s) - 1),
            lambda a, b: F.struct((F.get(weights, a * n + b) - limit).alias("excess"), F.get(signs, a).alias("sign")),
        ),
    )
    signs = F.array(*[F.lit(c in SEPARATORS) for c in ALPHABET])
    random = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, step: acc + step["excess"]) > 0
    flagged = lambda spans, flags: F.transform(
        F.filter(F.zip_with(spans, flags, lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda x: x["f"]), lambda x: x["s"]
    )
    base = F.concat(
        flagged(_found(t, ASSIGN, F.col("_assign"), 0), long_enough),
        _found(t, ACCESS, F.col("_access"), 1),
        _found(t, HEX, F.col("_hex"), 2),
    )
    of = lambda x: t.substr(x["start"] + 1, x["end"] - x["start"])

    def judged(piece: Column) -> Column:
        def by_steps(s: Column, x: Column) -> Column:
            pattern = f"[^{SEPARATORS}]{{{LEAST},}}"
            parts = F.transform(
                _found(s, pattern, F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), 3),
                lambda p: F.struct((piece["start"] + p["start"]).alias("start"), p["kind"].alias("kind"), (piece["start"] + p["end"]).alias("end")),
            )
            return F.when(random(x), F.array(piece).cast(SPANS)).otherwise(
                let(
                    _stretches(x, piece["start"], s),
                    lambda wide: F.concat(
                        wide,
                        F.filter(parts, lambda p: ~F.exists(wide, lambda w: (w["start"] <= p["start"]) & (p["end"] <= w["end"])) & random(steps(of(p)))),
                    ).cast(SPANS),
                )
            )

        return let(of(piece), lambda s: let(steps(s), lambda x: by_steps(s, x)))

    runs = F.flatten(F.transform(_found(t, RUN, F.col("_run"), 3), lambda r: _pieces(r, F.col("_base"))))
    judged_runs = F.when(F.size("_run") > 0, F.flatten(F.transform(runs, judged))).otherwise(F.array().cast(SPANS))
    all_spans = found.withColumn("_base", F.sort_array(base)).withColumn("_runs", judged_runs)
    return unpacked(all_spans, docs.columns, {"secrets": F.sort_array(F.concat("_base", "_runs"))})


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, *, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs, scanned before, with every span of the text (overlapping ones as one) replaced by the mark."""
    t = text_of(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = t.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        )

    clean = F.aggregate(
        "secrets", start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), t.substr(acc["at"] + 1, F.length(t)))
    )
    return docs.withColumn(text, F.when(F.size("secrets") > 0, clean).otherwise(F.col(text)))
