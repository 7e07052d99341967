"""Snapshots: what is saved is loaded again, several projects at once; a write that fails leaves nothing."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.schemas import TABLES
from factloom.sources import snapshots


def empty_but(spark, table, rows):
    """Rows as dicts; what they do not name is null."""
    schema = spark.createDataFrame([], TABLES[table]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def store(spark):
    doc = lambda p, d: {"project_id": p, "document_id": d, "filename": f"{d}.pdf", "page_count": 3, "doc_embedding": [0.5, 1.0], "extraction_stats": (1, 2, 3, 4, 5, 6)}
    value = ("gt", 5.0, None, "kg", None, "more than 5 kg")
    fact = lambda p, f, d: {"project_id": p, "fact_id": f, "document_id": d, "entity": "Acme", "value": value, "qualifiers": {"basis": "actual", "scope": None}, "evidence_text": 'a "b"\nc é', "period": ("FY24", None, None)}
    return spark.createDataFrame([("p1", "First/one"), ("p2", "Zweites é")], "project_id string, name string"), {
        "documents": empty_but(spark, "documents", [doc("p1", "d1"), doc("p1", "d2"), doc("p2", "d1"), doc("p9", "d7")]),
        "facts": empty_but(spark, "facts", [fact("p1", "f1", "d1"), fact("p1", "f2", "d2"), fact("p2", "f1", "d1")]),
        "fact_relationships": empty_but(spark, "fact_relationships", [{"project_id": "p1", "relationship_id": "r1", "fact_id_a": "f1", "fact_id_b": "f2", "type": "contradicts", "confidence": 0.5}]),
        "canonical_concepts": empty_but(spark, "canonical_concepts", [{"project_id": "p2", "kind": "entity", "canonical_name": "Acme", "raw_aliases": ["Acme", "acme"], "first_seen_document_id": "d1"}, {"project_id": "p1", "kind": "entity", "canonical_name": "B"}]),
        "verification_logs": empty_but(spark, "verification_logs", [{"project_id": "p1", "log_id": "l1", "fact_id": "f2", "stage": "grounding_check", "result": "pass"}]),
        "chunks": empty_but(spark, "chunks", [{"project_id": "p1", "document_id": "d2", "chunk_index": 0, "text": "t", "has_table": False}]),
    }


def rows(df):
    return sorted((repr(sorted(r.asDict(recursive=True).items(), key=lambda e: e[0])) for r in df.collect()))


def test_round_trip(spark, tmp_path):
    projects, tables = store(spark)
    snapshots.save(projects, tables, str(tmp_path / "one"))
    first = snapshots.load(spark, str(tmp_path / "one"))
    assert {t: df.count() for t, df in first.items()} == {"projects": 2, "documents": 3, "facts": 3, "fact_relationships": 1, "canonical_concepts": 2, "verification_logs": 1, "chunks": 1}
    plain = {k: df for k, df in first.items() if k != "projects"}
    snapshots.save(first["projects"], plain, str(tmp_path / "two"))
    again = snapshots.load(spark, str(tmp_path / "two"))
    assert {t: rows(df) for t, df in again.items()} == {t: rows(df) for t, df in first.items()}

    names = {r["project_id"]: r["name"] for r in first["projects"].collect()}
    docs = {(names[r["project_id"]], r["ref"]): r for r in first["documents"].collect()}
    assert set(docs) == {("First/one", "d1"), ("First/one", "d2"), ("Zweites é", "d1")} and len({r["document_id"] for r in docs.values()}) == 3
    facts = {(names[r["project_id"]], r["ref"]): r for r in first["facts"].collect()}
    assert all(r["document_id"] == docs[p, {"f1": "d1", "f2": "d2"}[ref]]["document_id"] for (p, ref), r in facts.items())
    one = facts["First/one", "f1"]
    assert one["evidence_text"] == 'a "b"\nc é' and one["qualifiers"] == {"basis": "actual", "scope": None} and one["value"]["number"] == 5.0 and one["period"]["raw_label"] == "FY24"
    (edge,) = first["fact_relationships"].collect()
    assert (edge["fact_id_a"], edge["fact_id_b"]) == (one["fact_id"], facts["First/one", "f2"]["fact_id"])
    seen = {r["canonical_name"]: r["first_seen_document_id"] for r in first["canonical_concepts"].collect()}
    assert seen == {"Acme": docs["Zweites é", "d1"]["document_id"], "B": None}


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    projects, tables = store(spark)
    bad = tables | {"verification_logs": tables["verification_logs"].withColumn("issue", F.raise_error(F.lit("gone wrong")).cast("string"))}
    with pytest.raises(Exception, match="gone wrong"):
        snapshots.save(projects, bad, str(tmp_path / "s"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, str(tmp_path / "s"))
    snapshots.save(projects, tables, str(tmp_path / "s"))
    with pytest.raises(Exception, match="gone wrong"):
        snapshots.save(projects, bad, str(tmp_path / "s"))
    assert snapshots.load(spark, str(tmp_path / "s"))["facts"].count() == 3  # the earlier one stands
    snapshots.save(projects.limit(0), {"facts": tables["facts"]}, str(tmp_path / "none"))
    assert snapshots.load(spark, str(tmp_path / "none"))["facts"].count() == 0
