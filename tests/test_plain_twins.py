"""Queries that SQL doesn't express, against plain Python; sources, text forms and the command line."""

import json

import numpy as np
from pyspark.sql import functions as F

from factloom import __main__ as cli
from factloom.functions import render
from factloom.operators import chunking, precheck, relationships, routing
from factloom.plans import queries
from factloom.plans.derived import document_pages, line_facts
from factloom.sources import tables as stores


def test_anchored_lines(spark, sf):
    plain = str.maketrans("‘’“”–—", "''\"\"--")

    def form(text):
        kept = [(c, i) for i, ch in enumerate(text) for c in (" " if ch.isspace() else ch.translate(plain).lower())]
        out = []
        for c, i in kept:
            if c != " " or (out and out[-1][0] != " "):
                out.append((c, i))
        if out and out[-1][0] == " ":
            out.pop()
        return "".join(c for c, _ in out), [i for _, i in out]

    def where(evidence, text):
        if not evidence.strip():
            return None
        if evidence in text:
            return text.index(evidence), text.index(evidence) + len(evidence), True
        (e, _), (t, at) = form(evidence), form(text)
        if e in t:
            return at[t.index(e)], at[t.index(e) + len(e) - 1] + 1, False
        words = e.split()
        a, b = t.find(words[0]), t.rfind(words[-1])
        if len(words) >= 3 and 0 <= a <= b and at[b + len(words[-1]) - 1] + 1 - at[a] <= max(3 * len(evidence), 200):
            return at[a], at[b + len(words[-1]) - 1] + 1, False
        return None

    pages = document_pages(spark, sf).where(F.length("text") > 0).select("document_id", "page_number", "text", F.upper("text").alias("big")).collect()
    want = {}
    for r in pages:
        p = r["page_number"]
        w = where(r["big"] if p % 2 == 0 else r["text"], r["text"])
        want[r["document_id"], p] = (w[0] + 1000 * p, w[1] + 1000 * p, w[2]) if w else (None, None, None)
    got = {(r["document_id"], r["page_number"]): (r["anchor_start"], r["anchor_end"], r["exact"]) for r in queries.anchor_lines(spark, sf).collect()}
    assert got == want


def test_clusters_by_arrival(spark, sf):
    """The fold, written out, over each label's vectors in the order of their ids."""
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    want, state = {}, {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        centres, sizes = state.setdefault(r["label"], ([], []))
        v = np.asarray(r["embedding"], float)
        near = [float(unit(v) @ c) for c in centres]
        k = int(np.argmax(near)) if near else -1
        if near and near[k] >= 0.3:
            centres[k] = unit((centres[k] * sizes[k] + v) / (sizes[k] + 1))
            sizes[k] += 1
            want[r["vec_id"]] = (f"sc_{k + 1}", False)
        else:
            centres.append(unit(v))
            sizes.append(1)
            want[r["vec_id"]] = (f"sc_{len(sizes)}", len(sizes) > 1)
    got = {r["document_id"]: (r["sub_cluster_id"], r["off_domain"]) for r in queries.assign_clusters(spark, sf).collect()}
    assert got == want


def test_hot_blocks_give_the_same_pairs(spark, sf, monkeypatch):
    facts = line_facts(spark, sf).where("fact_kind = 'status' AND entity IN ('Supplier 1', 'Supplier 2')").dropDuplicates(["fact_id"]).withColumn("attribute", F.lit("one"))
    pairs = lambda: sorted((r["fact_id_a"], r["fact_id_b"], r["outcome"], r["reason"]) for r in precheck.pairs_in_blocks(facts).collect())
    whole = pairs()
    monkeypatch.setattr(precheck, "BLOCK", 7)
    assert pairs() == whole and len(whole) > 100
    monkeypatch.setattr(precheck, "MOST_BROADCAST", 0)
    assert pairs() == whole


def test_details_tell_what_the_rule_looked_at(spark, sf):
    ready = precheck.comparable(line_facts(spark, sf).dropDuplicates(["fact_id"])).select("fact_id", "entity", "attribute", "cmp")
    a, b = ready.withColumnRenamed("cmp", "x"), ready.select(F.col("fact_id").alias("other"), "entity", "attribute", F.col("cmp").alias("y"))
    rows = a.join(b, ["entity", "attribute"]).where("fact_id < other").select(precheck.decide(F.col("x"), F.col("y")).alias("d"), precheck.detail(F.col("x"), F.col("y")).alias("m")).collect()
    names = {}
    for r in rows:
        names.setdefault(r["d"]["reason"].split(":")[0], set()).add(tuple(sorted(r["m"])))
    assert names["periods do not meet"] == {("period_a", "period_b", "relation")}
    assert names["different dimensions"] <= {("dimension_a", "dimension_b")}
    assert all("audited_a" in k or "basis_a" in k for k in names["significant qualifiers differ"])


def test_an_edge_needs_both_facts(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y")], "fact_id int, entity string")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "fact_id_a int, fact_id_b int")
    (r,) = relationships.detail(edges, facts).collect()
    assert (r["fact_a"]["entity"], r["fact_b"]["entity"]) == ("x", "y")


def test_stores_and_snapshots(spark, tmp_path):
    one = spark.createDataFrame([("p", "n", None), ("q", "m", None)], "project_id string, name string, created_at timestamp")
    stores.write_table(one, str(tmp_path), "projects")
    stores.write_table(one.where("project_id = 'p'").withColumn("name", F.lit("new")), str(tmp_path), "projects", "overwrite")
    assert {(r["project_id"], r["name"]) for r in stores.read_table(spark, str(tmp_path), "projects").collect()} == {("p", "new"), ("q", "m")}
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "a.json").write_text(json.dumps({"project": {"name": "One"}, "documents": [{"ref": "d1", "filename": "a.pdf"}], "facts": [{"ref": "f1"}, {"ref": "f2"}], "relationships": [], "concepts": []}, indent=1))
    loaded = stores.load_snapshot(spark, str(tmp_path / "snap"))
    assert loaded["facts"].count() == 2 and loaded["facts"].select("id").distinct().count() == 2 and loaded["documents"].first()["row"]["filename"] == "a.pdf"
    assert [r["id"] for r in loaded["facts"].orderBy("id").collect()] == [r["id"] for r in stores.load_snapshot(spark, str(tmp_path / "snap"))["facts"].orderBy("id").collect()]
    stores.save_snapshot({"facts": loaded["facts"]}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "facts")).count() == 2


def test_shown_forms(spark):
    row = spark.createDataFrame([("", "page"), ("before", "page")], "c string, t string")
    assert [r[0] for r in row.select(chunking.prompt_text(F.col("c"), F.col("t"))).collect()][0] == "page"
    assert "before" in row.select(chunking.prompt_text(F.col("c"), F.col("t"))).collect()[1][0]
    said = spark.createDataFrame([("a"  + chr(34) * 5 + "b" + chr(34) * 2,)], "e string")
    assert said.select(render.fence(F.col("e"))).first()[0] == "a" + chr(34) * 2 + "b" + chr(34) * 2
    v = "struct<comparator:string,number:double,number_high:double,unit:string>"
    shown = spark.createDataFrame([(("range", 3.0, 4.5, "km"),), (("gte", 7.0, None, None),), ((None, 2.0, None, "kg"),)], f"v {v}")
    assert [r[0] for r in shown.select(render.display_value(F.col("v"))).collect()] == ["3–4.5 km", "≥ 7", "~ 2 kg"]
    boxes = spark.createDataFrame([([(10.0, 20.0, 50.0, 100.0)],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert tuple(boxes.select(render.relative_boxes(F.col("b"), F.lit(100.0), F.lit(200.0))).first()[0][0]) == (0.1, 0.1, 0.5, 0.5)
    blocks = spark.createDataFrame([(1200.0, [(700.0, 1.0, "c"), (0.0, 9.0, "b"), (0.0, 1.04, "a"), (5.0, 1.0, "a2")])], "w double, b array<struct<x0:double,y0:double,text:string>>")
    assert blocks.select(routing.reading_order(F.col("b"), F.col("w"))).first()[0] == ["a", "a2", "b", "c"]


def test_command_line(spark, sf, tmp_path):
    cli.main(["retried_documents", sf, "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as N

    import pytest

    from factloom.sources.shared import shared_folder

    session = lambda master, folder: N(sparkContext=N(master=master, applicationId="a"), conf=N(get=lambda key, default: folder or default))
    assert shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None))
    assert shared_folder(session("local[4]", None)) == shared_folder(session("local[4]", None))
