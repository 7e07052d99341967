"""Language identification: accuracy on held-out documents, and the model's own arithmetic."""

import math
import re
import zlib
from collections import Counter, defaultdict

from factloom.llm import langid
from factloom.llm.common import table
from factloom.llm.queries import op6_langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = op6_langid(spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98


def test_edges(spark):
    docs = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "text", None), (5, "", "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(df)
    ask = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "123 !?"), (4, "the"), (5, "hunde"), (6, "日本"), (None, "und " * 50_000), (8, "x" * 50_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.predict(ask, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0
    assert out[4]["lang_pred"] == "en" and out[5]["lang_pred"] == "de" and out[None]["lang_pred"] == "de"
    assert out[6]["lang_pred"] in ("de", "en")
    assert langid.predict(ask, model).count() == 9
    assert {r["lang_pred"] for r in langid.predict(ask, langid.train(df.limit(0))).collect()} == {"und"}
    assert langid.predict(ask.limit(0), model).count() == 0


def test_known_words_come_before_grams():
    m = langid.Model(["a", "b"], [(0, "cat", "a", 9), (0, "cat", "b", 1), (4, "cats", "b", 50), (1, "t", "a", 5)], {(0, "a"): 10, (0, "b"): 10, (4, "b"): 50, (1, "a"): 5})
    score = dict(zip(("cat", "cats", "t"), m.totals([["cat"], ["cats"], ["t"]], 10)))
    assert score["cat"].argmax() == 0 and score["cats"].argmax() == 1 and score["t"].argmax() == 0
    assert len(m.places("cat")) == 1 and len(m.places("cats")) == 4
    assert (m.totals([["cat", "t"]], 0)[0] == score["cat"] + score["t"]).all()


def brute(train, texts):
    """A plain version of the model: {key: (language, score)}."""
    counts = defaultdict(Counter)
    for text, lang in train:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[0, lang][w] += 1
            marked = f"^{w}$"
            for n in (1, 2, 3, 4):
                counts[n, lang].update(marked[i : i + n] for i in range(len(marked) - n + 1))
    langs = sorted({k for _, k in counts})
    known = [set().union(*(counts[n, x] for x in langs)) for n in range(5)]
    total = {k: sum(c.values()) for k, c in counts.items()}
    logs = lambda n, item: [math.log((counts[n, x][item] + 0.5) / (total[n, x] + 0.5 * (len(known[n]) + 1))) for x in langs]

    def of_word(w):
        if w in known[0]:
            return logs(0, w)
        marked, rows = f"^{w}$", []
        for i in range(1, len(marked) - 1):
            gram = next(((n, marked[i : i + n]) for n in (4, 3, 2, 1) if marked[i : i + n] in known[len(marked[i : i + n])] and len(marked[i : i + n]) == n), None)
            rows.append(logs(*gram) if gram else [math.log(0.5 / (total[1, x] + 0.5 * (len(known[1]) + 1))) for x in langs])
        return [sum(c) / len(rows) for c in zip(*rows)]

    out = {}
    for key, text in texts:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            out[key] = ("und", 0.0)
            continue
        sums = [sum(c) for c in zip(*map(of_word, found))]
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        out[key] = (langs[best], 1 / sum(math.exp(max(s - sums[best], -700)) for s in sums))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents").collect()
    held = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
    want = brute([(d["text"], d["lang"]) for d in docs if not held(d) and d["lang"] and d["text"]], [(d["doc_id"], d["text"]) for d in docs])
    for r in op6_langid(spark, sf).collect():
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6


def test_ties_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "same", "b", 5), (2, "same", "a", 5)], "doc_id long, text string, lang string, score int").withColumn("lang_pred", langid.F.lit(1))
    model = langid.train(df)
    out = langid.predict(df, model)
    assert out.columns == ["doc_id", "lang_pred", "score"]
    assert all((r["lang_pred"], r["score"]) == ("a", 0.5) for r in out.collect())
