"""Token counts against a plain forward pass over each pre-token alone."""

import random
import tracemalloc

import public_tokenizers
import regex

from factloom.llm import token_counts
from factloom.llm.common import table
from factloom.llm.queries import op1_tokens

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def forward(token, cost):
    raw = token.encode()
    best = [(0, 0)] + [None] * len(raw)
    for d in range(1, len(raw) + 1):
        best[d] = min((best[a][0] + cost[raw[a:d]], best[a][1] + 1) for a in range(d) if raw[a:d] in cost)
    return best[-1]


def test_query(spark, sf):
    cost, memo = token_counts.costs(FILE), {}
    rows = {r["doc_id"]: r for r in op1_tokens(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        found = regex.findall(public_tokenizers.PATTERN, d["text"] or "")
        for t in found:
            memo.setdefault(t, forward(t, cost) if t not in memo else None)
        r = rows[d["doc_id"]]
        assert (r["n_pretokens"], r["n_tokens"]) == (len(found), sum(memo[t][1] for t in found))
        assert abs(r["score"] + sum(memo[t][0] for t in found) / 1e6) < 1e-6


def test_edges(spark):
    texts = [None, "", " ", "日本語 😀", "x" * 20_000, "a a a"]
    df = spark.createDataFrame([(i % 2, t, 3) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    out = token_counts.token_counts(df, FILE).collect()
    assert len(out) == len(texts) and sorted(r["n_tokens"] for r in out)[:2] == [0, 0]
    assert token_counts.token_counts(df.limit(0), FILE).count() == 0


def test_full_trie_starts_anew():
    cost = token_counts.costs(FILE)
    small, large = token_counts.Trie(cost, most=5), token_counts.Trie(cost)
    for t in (" the", " then", " theory", "<|x|>", " the"):
        assert small.count(t) == large.count(t)


def test_long_pre_tokens_stay_out_of_the_trie():
    t, rng = token_counts.Trie(token_counts.costs(FILE)), random.Random(1)
    for n in (1, 2, 50, 400):
        for letters in ("etaoin", "x", "abcdefghijklmnopqrstuvwxyz", "0123456789", "日本é"):
            token = "".join(rng.choice(letters) for _ in range(n))
            assert t.rolled(token.encode()) == t.count(token) == forward(token, t.cost)[::-1]
    nodes, known = t.nodes, len(t.terminal)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    tracemalloc.start()
    n, cost = t.count(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (t.nodes, len(t.terminal)) == (nodes, known) and cost > 0
    assert peak < 500_000  # the text and the ring
    many, _ = t.count(long * 50)  # five million letters
    assert abs(many - 50 * n) <= 50 and (t.nodes, len(t.terminal)) == (nodes, known)
