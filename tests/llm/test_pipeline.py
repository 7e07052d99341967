"""The pipeline's stages, each against what it got, and its last one exactly."""

import pytest
from test_packing import check  # same folder

import corpus_pipeline
from factloom.llm import dedup, mixing, quality, secrets
from factloom.llm.queries import trusted_ids


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    sf, top = "/root/testdata/sf0.001", tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, sf).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return sf, [*out, docs]


def test_columns_and_stages(kept):
    _, frames = kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    for df in frames[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_what_its_operator_says(spark, kept):
    sf, (raw, good, single, clean, mixed, _) = kept
    weights, threshold = quality.fit(raw, trusted_ids(spark, sf))
    want = {r["doc_id"] for r in quality.judge(raw, weights, threshold=threshold).select("doc_id", "kept").collect() if r["kept"]}
    assert {r["doc_id"] for r in good.collect()} == want and len(want) < raw.count()
    first = {r["doc_id"] for r in dedup.near_duplicates(good, size=5).collect() if r["kept"]}
    assert {r["doc_id"] for r in single.collect()} == first
    model = secrets.train(secrets.labelled_samples(spark))
    assert {r["doc_id"] for r in clean.collect()} == first
    left = secrets.scan(clean, model).collect()
    assert not any(r["secrets"] for r in left)
    assert all(r["n_chars"] == len(r["text"]) for r in left if "<secret>" in r["text"])
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in mixing.mix(clean).collect())


def test_packing_is_exact(kept):
    _, (*_, mixed, packed) = kept
    check(packed.collect(), [(r["doc_id"], r["text"]) for r in mixed.collect()], 2048)


def test_run(spark, kept):
    sf, frames = kept
    assert corpus_pipeline.run(spark, sf).count() == frames[-1].count()


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_odd_tables(spark, case, tmp_path):
    """No rows at all; and nulls in every column, repeated rows, shared ids, a very long text, columns with clashing names."""
    long = " ".join(f"w{i % 900}x{i}" for i in range(40_000))
    text = " ".join(f"plain{i} words{i}" for i in range(30))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (1, text + " other ending here", None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text, "en", None, 9), (4, long, "en", "a", 5), (5, text + f" token=abcdef{'9' * 30}", "de", "a", 7)]
    rows = [(*r, 1, 2, 3) for r in (rows if case == "odd" else [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, row int, secrets int")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, 1, 0)] if case == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
    if case == "empty":
        assert seen == [0] * 6
    else:
        single = spark.read.parquet(f"{tmp_path}/near_dedup").collect()
        # one of the repeated rows, and the other text of that document; the row without an id; the long one; 5 is a copy of 1
        ending = len(text + " other ending here")
        assert sorted((r["doc_id"] or 0, len(r["text"])) for r in single) == sorted([(0, len(text)), (1, len(text)), (1, ending), (4, len(long))])
        assert seen[1] == 6 and seen[2] == 4 and seen[5] >= 4
