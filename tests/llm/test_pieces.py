"""SentencePiece encoding: every text against the library itself, the table of chunks, odd rows."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import pieces
from factloom.llm.queries import op11_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b ", "▁", "a▁ b", "\n", "a\r\n b\t", "　a", "ﬁ x", "é é", "\x00a b", "<s> </s> <unk>", "<0x0A>",
    "\U0001f642 x\U0001f642", "​   ", "x" * 5000, "ab" * 3000 + "  " * 40 + "c", "한국어 中文", " \U0010ffff",
]


def test_no_piece_crosses(library):
    assert pieces.crosses([library.id_to_piece(i) for i in range(library.get_piece_size())]) == []
    assert pieces.crosses(["▁a", "▁▁", "a▁b", "a▁"]) == ["a▁b", "a▁"]


def test_odd_texts(library):
    table = pieces.ChunkTable(MODEL)
    for _ in range(2):  # the second time from the table
        assert [list(memoryview(r).cast("i")) for r in table(ODD)] == library.encode(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁ab\n<0x>"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_texts(texts):
    table = pieces.chunk_table(MODEL)
    assert [list(memoryview(r).cast("i")) for r in table(texts)] == table.model.encode(texts)


def test_each_chunk_is_segmented_once_and_the_table_is_bounded(library):
    table = pieces.ChunkTable(MODEL)
    table(["one two two one", "two one one"])
    assert table.segmented == 2
    small = pieces.ChunkTable(MODEL, most=20, longest=5)
    texts = [f"word{i} some long-chunk{i} words" for i in range(50)]
    for t in texts:
        assert list(memoryview(small([t])[0]).cast("i")) == library.encode(t)
        assert small.size <= 20 + len(t) + 1 and max(map(len, small.ids), default=0) <= 5


def test_texts_that_the_table_may_not_answer(library, monkeypatch):
    table = pieces.ChunkTable(MODEL)
    table.whole = True
    assert [list(memoryview(r).cast("i")) for r in table(ODD)] == library.encode(ODD)


def test_columns_nulls_and_clashes(spark, library):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, None, None), (3, "", 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, `_given.a` string")
    done = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert done.columns == ["doc_id", "text", "_given.a", "ids", "decoded"]
    got = sorted((r["doc_id"], r["ids"], r["decoded"], r["_given.a"]) for r in done.collect() if r["doc_id"] != 2)
    assert got == [(1, library.encode("a b"), "a b", "x")] * 2 + [(3, [], "", "y")]
    assert [(r["ids"], r["decoded"]) for r in done.where("doc_id = 2").collect()] == [([], "")]
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
    assert pieces.encode(docs, MODEL, keep=False).columns == ["doc_id", "_given.a", "ids"]
    nulls = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert pieces.decode(nulls, MODEL).first()["decoded"] == ""
    some = spark.createDataFrame([(1, None), (2, library.encode("a b")), (3, []), (4, [*library.encode("c d")])], "k int, ids array<int>").coalesce(1)
    assert [r["decoded"] for r in pieces.decode(some, MODEL).orderBy("k").collect()] == ["", "a b", "", "c d"]
    holes = some.withColumn("ids", F.concat(F.array(F.lit(None).cast("int")), "ids"))
    assert [r["decoded"] for r in pieces.decode(holes, MODEL).orderBy("k").collect()] == ["", "a b", "", "c d"]


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op11_pieces(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert got == want
    assert op11_pieces(spark, sf).select(F.col("n_tokens")).dtypes == [("n_tokens", "bigint")]
