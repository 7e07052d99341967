"""Packing: exact pieces, gapless sequences, and no more sequences than best-fit decreasing needs by much."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import packing
from factloom.llm.common import table
from factloom.llm.packing_plan import plan, solve
from factloom.llm.pretokens import PATTERN, Encoder, pretokens
from factloom.llm.queries import op10_packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def cut(ids, capacity):
    n = len(ids)
    starts = [0, *range(n % capacity or capacity, n, capacity)]
    return [(a, ids[a:b]) for a, b in zip(starts, [*starts[1:], n])]


def check(rows, texts, capacity):
    t = Tokenizer.from_file(FILE)
    want = []
    for doc, text in texts:
        for k, (a, ids) in enumerate(cut([*t.encode(text or "", add_special_tokens=False).ids, 0], capacity)):
            want.append((doc, k, a, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= capacity
    return len(places)


def best_fit_decreasing(lengths, capacity):
    free, bins = [0] * (capacity + 1), 0
    for x in sorted(lengths, reverse=True):
        room = next((r for r in range(x, capacity + 1) if free[r]), 0)
        if room:
            free[room] -= 1
        else:
            room, bins = capacity, bins + 1
        free[room - x] += 1
    return bins


def test_query(spark, sf):
    rows = op10_packing(spark, sf).collect()
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    n = check(rows, texts, 2048)
    assert n <= best_fit_decreasing([r["length"] for r in rows], 2048)


def test_edges(spark):
    texts = [(1, None), (1, None), (2, ""), (3, "<|endoftext|> a <|endoftext|>"), (None, "x" * 30_000), (4, "word " * 3000), (5, "日本語 ١٢٣ ²³ é   \n\n  z"), (6, "it's a\n test's   "), (7, "😀" * 500)]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, length int")
    for capacity in (16, 64):
        check(packing.pack(df, FILE, capacity=capacity).collect(), texts, capacity)
    assert packing.pack(df.limit(0), FILE).count() == 0


def test_memo_equals_tokenizer_on_odd_texts():
    rng = random.Random(5)
    chars = "aZ é ß ²½ªº_'s't 0٣९ \t\n\r\x0b\x0c\x85  ​日😀,.!-́﻿\x00ÿĀſƀ"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000)]
    t = Tokenizer.from_file(FILE)
    for text, raw in zip(texts, Encoder(FILE)(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
        assert "".join(pretokens(text)) == text
    assert PATTERN.startswith("'s|")


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    for scale in (50, 2000, 60_000):
        lengths = np.clip(rng.lognormal(5.5, 1.2, scale).astype(int), 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        runs, n = plan(counts, 2048)
        assert (np.bincount(runs[:, 0], runs[:, 1], minlength=2049).astype(int) == counts).all()
        assert n <= best_fit_decreasing(lengths, 2048) * 1.001 + 1
    runs, n = plan(np.zeros(2049, int), 2048)
    assert (len(runs), n) == (0, 0)


def test_plan_beats_best_fit_where_fits_are_tight():
    rng = np.random.default_rng(3)
    lengths = rng.integers(650, 720, 20_000)
    _, n = plan(np.bincount(lengths, minlength=2049), 2048)
    assert n < 0.97 * best_fit_decreasing(lengths, 2048)


def test_plan_is_between_its_bound_and_best_fit():
    rng = np.random.default_rng(8)
    cases = [rng.integers(1, 60, 5000), rng.integers(690, 1000, 3000), rng.choice([683, 1024, 342, 700, 410], 5000), np.clip(rng.lognormal(6.3, 1, 11_000).astype(int), 1, 2048), [1] * 9000, [2048] * 7]
    for lengths in cases:
        counts = np.bincount(lengths, minlength=2049)
        p = solve(counts, 2048)
        assert (np.bincount(p.runs[:, 0], p.runs[:, 1], minlength=2049).astype(int) == counts).all()
        assert p.bound <= p.sequences <= best_fit_decreasing(lengths, 2048)
    # every length takes part in the program, short ones too
    p = solve(np.bincount(rng.integers(1, 60, 50_000), minlength=2049), 2048)
    assert p.from_program > 0.2 * p.sequences and p.sequences <= p.bound + 1


def test_query_needs_as_many_as_best_fit(spark):
    sf = "/root/testdata/sf0.1"
    cut_ = packing.pieces(table(spark, sf, "documents"), FILE, capacity=2048).groupBy("length").count().collect()
    counts = np.zeros(2049, np.int64)
    for r in cut_:
        counts[r["length"]] = r["count"]
    p = solve(counts, 2048)
    lengths = np.repeat(np.arange(2049), counts)
    assert p.bound <= p.sequences <= best_fit_decreasing(lengths, 2048) and p.from_program > 0
    print(p.sequences, p.from_program, p.bound)
