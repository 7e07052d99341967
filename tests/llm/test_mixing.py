"""Mixing against the contract of its docstring."""

import math
import re
from collections import Counter, defaultdict

from hashes import xxhash64  # same folder

from factloom.llm import mixing
from factloom.llm.common import table
from factloom.llm.queries import op5_mixing


def cost(text):
    """Runs of letters, of digits, of signs."""
    return max(1, len(re.findall(r"[^\W\d_]+|\d+|(?:[^\s\w]|_)+", text or "")))


def test_query(spark, sf):
    docs = table(spark, sf, "documents").collect()
    own = {d["doc_id"]: (d["source"], cost(d["text"])) for d in docs}
    total = defaultdict(int)
    for s, n in own.values():
        total[s] += n
    rows = op5_mixing(spark, sf).collect()
    times = Counter(r["doc_id"] for r in rows)
    assert set(times) == set(own) and max(times.values()) <= 2
    seen, longest = defaultdict(int), max(n for _, n in own.values())
    for r in rows:
        assert (r["source"], r["n_tokens"]) == own[r["doc_id"]]
        seen[r["source"]] += r["n_tokens"]
    target = {r["source"]: r["repetition"] for r in rows}
    assert abs(max(target.values()) - 2) < 1e-6 and min(target.values()) == 1
    for s in total:
        assert -longest < seen[s] - target[s] * total[s] <= 1
    # Weights follow one exponent.
    w = {r["source"]: r["weight"] for r in rows}
    assert abs(sum(w.values()) - 1) < 1e-9
    z = sum(total.values())
    (a, b) = (max(total, key=total.get), min(total, key=total.get))
    t = math.log(w[a] / w[b]) / math.log(total[a] / total[b])
    for s in total:
        assert abs(w[s] - (total[s] / z) ** t / sum((x / z) ** t for x in total.values())) < 1e-6


def test_entropy_target_and_budget(spark):
    rows = [(i, "a" if i % 10 else "b", "word " * 20) for i in range(2000)] + [(5000 + i, None, None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    shares = df.groupBy("source").agg((mixing.F.sum(mixing.tokens()) / 40050.0).alias("p"))
    t = mixing.bisect_exponent(shares.select("p"), max_repetition=None, target_entropy=0.5, budget_ratio=None)
    p = [r["p"] ** t for r in shares.collect()]
    p = [x / sum(p) for x in p]
    assert abs(-sum(x * math.log(x) for x in p) - 0.5) < 1e-6
    out = mixing.mix(df, max_repetition=None, target_entropy=None, budget=20_000, block_rows=64).withColumn("n", mixing.tokens()).groupBy("source").agg(mixing.F.sum("n").alias("n")).collect()
    assert all(abs(r["n"] - 20_000 / 3) < 26 for r in out) and len(out) == 3


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, 9), (1, None, None, 9), (None, "x", "", 9)], "doc_id long, source string, text string, rest int")
    out = mixing.mix(df).collect()
    assert Counter(r["doc_id"] for r in out)[1] >= 2 and all(r["rest"] == 9 for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def plain_order(seed, epoch, *what):
    return xxhash64((seed, "i"), (epoch, "i"), *what)


def test_members_of_the_part_equal_brute_force(spark, sf):
    """Whole epochs, then the longest beginning of the next one's permutation that the rest of the budget covers."""
    seed, size = 17, 4096
    docs = [(d["doc_id"], d["source"], cost(d["text"])) for d in table(spark, sf, "documents").collect()]
    rows = op5_mixing(spark, sf).collect()
    repetition = {r["source"]: r["repetition"] for r in rows}
    seen = defaultdict(set)
    for r in rows:
        seen[r["source"], r["epoch"]].add(r["doc_id"])
    for source, rep in repetition.items():
        own = [(i, n) for i, s, n in docs if s == source]
        total, key = sum(n for _, n in own), "" if source is None else "s" + source
        whole = math.floor(rep + 1e-9)
        rest = round(max(rep - whole, 0) * total)
        blocks = -(-len(own) // size)
        at = lambda i: xxhash64((seed, "i"), "block", i) % blocks
        order = sorted(own, key=lambda x: (plain_order(seed, whole, key, at(x[0])), at(x[0]), plain_order(seed, whole, x[0])))
        part, upto = set(), 0
        for i, n in order:
            upto += n
            if upto > rest:
                break
            part.add(i)
        for e in range(whole):
            assert seen[source, e] == {i for i, _ in own}
        assert seen[source, whole] == part


def test_columns_of_any_name_stay_and_counts_may_be_given(spark):
    names = ["_whole", "_rest", "_blocks", "_src", "row", "n", "WEIGHT"]
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "x " * i, *range(7)) for i in range(30)], "doc_id long, source string, text string, " + ", ".join(f"`{c}` int" for c in names))
    out = mixing.mix(df).collect()
    assert {r["doc_id"] for r in out} == set(range(30)) and all([r[c] for c in names[:6]] == list(range(6)) and isinstance(r["weight"], float) for r in out)
    same = mixing.mix(df.withColumn("many", mixing.tokens()), counts="many").collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in same) == sorted((r["doc_id"], r["epoch"]) for r in out)
