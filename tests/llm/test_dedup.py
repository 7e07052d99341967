"""Near-dedup against all pairs, on a table with hot groups."""

import random
import re

import numpy as np
import pandas as pd

from factloom.llm import dedup, graph, sketch
from factloom.llm.common import table
from factloom.llm.queries import op3_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute(docs, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert {tuple(r) for r in op3_minhash(spark, sf).collect()} == brute(docs, 4)


def test_hot_groups(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    docs = [(i, " ".join(base)) for i in range(40)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    docs += [(100 + i, edited(base, rng.randrange(1, 7))) for i in range(160)]  # around the threshold
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs += [(400 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(25))) for i in range(80)]  # share, aren't alike
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 5)
    assert {tuple(r) for r in dedup.near_duplicates(df, size=5).collect()} == want
    monkeypatch.setattr(dedup, "SMALL", 4)  # the blocks do nearly all
    monkeypatch.setattr(dedup, "BLOCK", 30)
    monkeypatch.setattr(dedup, "BLOCK_ITEMS", 2_000)  # a dozen texts
    assert {tuple(r) for r in dedup.near_duplicates(df, size=5).collect()} == want


def test_partners_and_links_of_a_block():
    """Registers tell who needs its set; links are what all pairs between components give."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(300)) for _ in range(10)]
    shingler = sketch.Shingler(5)
    sets = [shingler(t) for t in texts]
    regs = [sketch.registers(s) for s in sets]
    bucket = int(sketch.bands(regs[0])[0])
    rows = pd.DataFrame({"bucket": bucket, "rep": range(50), "n": [len(s) for s in sets], "comp": range(50), "blk": [i % 2 for i in range(50)], "block_a": 0, "block_b": 1, "regs": [r.tobytes() for r in regs], "items": [s.view(np.int64) for s in sets]})
    partners = dedup.block_partners(rows.drop(columns="items"), 80)
    assert not set(partners["rep"]) & set(range(40, 50))
    links = {tuple(x) for x in dedup.block_links(rows, 80).values.tolist()}
    first = [sketch.bands(r) for r in regs]
    want = set()
    for i in range(50):
        for j in range(i + 1, 50):
            same = np.nonzero(first[i] == first[j])[0]
            if i % 2 != j % 2 and len(same) and first[i][same[0]] == bucket:
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    want.add((i, j))
    assert links == want and {x for pair in want for x in pair} <= set(partners["rep"])


def test_edges(spark):
    docs = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one TWO"), (10, "É one"), (11, "é one"), (12, "a b c d e"), (13, "a b c d e"), (14, "z " * 60_000), (15, "z " * 70_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long")
    assert {tuple(r) for r in dedup.near_duplicates(df, size=4).collect()} == brute(docs, 4)
    assert dedup.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "c d"), (2, "c d"), (2, "c d")], "doc_id long, text string")
    got = sorted((tuple(r) for r in dedup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False)], key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[800:]
    assert (np.maximum(sketch.registers(a), sketch.registers(b)) == sketch.registers(x)).all()
    est = sketch.joint_estimate(sketch.registers(a)[None], sketch.registers(b)[None], np.array([2000]), np.array([2200]))
    assert abs(est[0] - 0.4) < 0.12


def test_hot_classes_are_joined_apart(spark, sf, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_ROWS", 2)
    monkeypatch.setattr(dedup, "HOT_CLASSES", 2)
    texts = ["one two three four five six seven"] * 40 + ["a b c d e f g h"] * 9 + ["k l m n o p"] * 5 + ["", None] * 6 + ["single words stand alone here"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b c d e f g h")], "doc_id long, text string")
    out = dedup.near_duplicates(df, size=4).collect()
    assert len(out) == len(texts) + 1
    want = brute(list(enumerate(texts)), 4)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert got == want
    (none,) = [r for r in out if r["doc_id"] is None]
    assert none["component_id"] is None and none["kept"]


def test_one_of_each(spark):
    a, b, c = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "x y z"
    rows = [(1, a), (1, a), (2, a), (2, b), (3, c), (3, c), (3, b), (4, None), (4, None), (4, ""), (None, a), (None, a), (5, c)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, digest int")
    near = dedup.durable(dedup.near_rows(df, size=5))
    out = dedup.one_of_each(df.drop("digest"), near, 5).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted([(1, a), (2, b), (3, c), (4, ""), (0, a), (0, a)])
    plain = df.where("doc_id IS NULL OR doc_id IN (5)").drop("digest")
    assert dedup.one_of_each(plain, dedup.near_rows(plain, size=5), 5).count() == 3
