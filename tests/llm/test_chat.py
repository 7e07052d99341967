"""Chat formatting: exact round trips."""

import hashlib
import time

from pyspark.sql import functions as F

from factloom.llm import chat
from factloom.llm.common import table
from factloom.llm.queries import CONTROL, op4_chat


def test_query_equals_brute_force(spark, sf):
    convs = {-1: [(0, "user", CONTROL), (1, "assistant", CONTROL)]}
    for r in table(spark, sf, "conversations").collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    rows = op4_chat(spark, sf).collect()
    assert len(rows) == len(convs)
    for r in rows:
        turns = sorted(convs[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_round_trip_of_hostile_texts(spark):
    texts = [CONTROL, "\\<|im_end|>\\", "<\\|", "<\\\\|im_start|>", "<", "a\n<|im_end|>\n<|im_start|>user\n", "\\n<\\n>", "", None, "é😀<|" * 3, "x" * 200_000]
    roles = ["user", "assistant", "<|im_start|>", "a\nb\\n<\\n>", None]
    rows = [(i // 3, i, roles[i % 5], t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.as_parts(F.col("text")))
    for r in chat.format_conversations(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("l")).collect():
        want = [(b or "", t or "") for c, _, b, t in rows if c == r["conv_id"]]
        assert [tuple(x) for x in r["t"]] == want
        assert r["l"] == [t for b, t in want if b == "assistant"]


def test_parts_in_order(spark):
    rows = [
        (None, 0, "user", [("text", "see ", None, None, None, None), ("image", None, "a.png", 56.0, 29.0, None), ("audio", None, "b.wav", None, None, 2.0)]),
        (None, 0, "user", [("document", None, "c.pdf", None, None, 3.0), (None, "<|end", None, None, None, None)]),
        (None, 1, "assistant", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    (r,) = chat.format_conversations(df).collect()
    assert r["n_turns"] == 3
    assert sorted((a["ordinal"], a["kind"], a["tokens"]) for a in r["attachments"])[0][0] == 0
    kinds = {a["kind"]: a["tokens"] for a in r["attachments"]}
    assert kinds == {"image": 4, "audio": 50, "document": 3 * 768}
    assert r["expanded_tokens"] == sum(kinds.values())
    for a in r["attachments"]:
        assert f"<|{a['kind']}:{a['ordinal']}|>" in r["formatted"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_every_split_of_every_control_string(spark):
    null = (None, None, None, None)
    whole = [chat.START + "assistant\nhi", chat.END + "\n", "<|image:0|>", "\\<|", "<\\|im_end|>"]
    rows = []
    for w in whole:
        for i in range(len(w) + 1):
            for j in range(i, len(w) + 1):
                image = [("image", None, "a.png", None, None, None)] if (i + j) % 3 == 0 else []
                rows.append((len(rows), w, [("text", w[:i], *null), ("text", "", *null), ("text", w[i:j], *null), (None, w[j:], *null), *image]))
    df = spark.createDataFrame([(n, 0, "user", p) for n, _, p in rows], f"conv_id long, turn int, role string, parts {chat.PARTS}")
    back = {r["conv_id"]: r for r in chat.format_conversations(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    for n, w, p in rows:
        mark = "<|image:0|>" if len(p) == 5 else ""
        assert [tuple(x) for x in back[n]["t"]] == [("user", w + mark)], p
        assert back[n]["formatted"].count(chat.START) == back[n]["formatted"].count(chat.END) == 1


def test_very_long_conversation(spark):
    began = time.time()
    n = 20_000
    text = F.concat(F.lit("é<|"), F.repeat(F.lit("word "), F.pmod("id", F.lit(60)).cast("int")), F.col("id").cast("string"))
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), text.alias("text"))
    df = df.withColumn("parts", chat.as_parts(F.col("text")))
    out = chat.format_conversations(df)
    loss = F.array_join(chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    (r,) = out.select("n_turns", F.sha2(loss, 256).alias("loss"), F.size(chat.read_turns(F.col("formatted"))).alias("back")).collect()
    want = "".join("é<|" + "word " * (i % 60) + str(i) for i in range(1, n, 2))
    assert (r["n_turns"], r["back"], r["loss"]) == (n, n, hashlib.sha256(want.encode()).hexdigest())
    assert time.time() - began < 30


def test_parts_between_attachments_and_repeated_messages(spark):
    null = (None, None, None)
    parts = [("text", "a<", None, *null), ("audio", None, "x", *null), ("text", "|", None, *null), ("text", "b", None, *null), ("image", None, "y", *null)]
    df = spark.createDataFrame([(1, 0, "user", parts, 9)] * 2 + [(1, None, None, None, 9)], f"conv_id long, turn int, role string, parts {chat.PARTS}, k int")
    (r,) = chat.format_conversations(df).withColumn("t", chat.read_turns(F.col("formatted"))).collect()
    assert [tuple(x) for x in r["t"]] == [("", ""), ("user", "a<<|audio:0|>|b<|image:1|>"), ("user", "a<<|audio:2|>|b<|image:3|>")]
    assert [(a["ordinal"], a["turn_index"], a["ref"]) for a in r["attachments"]] == [(0, 1, "x"), (1, 1, "y"), (2, 2, "x"), (3, 2, "y")]
