"""Table schemas and the fixed names of states."""

VALUE = "struct<comparator:string,number:double,number_high:double,unit:string,state:string,text:string>"
PERIOD = "struct<raw_label:string,start_date:string,end_date:string>"
ANCHOR = "struct<chunk_index:int,page_number:int,char_start:int,char_end:int,matched_text:string,exact:boolean>"
STATS = "struct<candidates_returned:int,candidates_kept:int,dropped_invalid:int,dropped_no_column_context:int,unanchored:int,chunks_failed:int>"
TABLE = "struct<rows:array<array<string>>,header_rows:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"

#: Spark schemas of the tables. Every row belongs to one project.
TABLES = {
    "projects": "project_id string, name string, created_at timestamp",
    "documents": f"project_id string, document_id string, filename string, content_hash string, byte_size long, content_type_detected string, processing_status string, page_count int, extraction_stats {STATS}, doc_embedding array<float>, sub_cluster_id string, off_domain boolean, created_at timestamp",
    "chunks": "project_id string, document_id string, chunk_index int, page_number int, text string, leading_context string, char_start int, char_end int, content_type string, has_table boolean, table_markdown string, confidence_ceiling double",
    "facts": f"project_id string, fact_id string, document_id string, anchor {ANCHOR}, page_number int, fact_kind string, entity string, entity_resolved boolean, attribute string, value {VALUE}, period {PERIOD}, qualifiers map<string,string>, evidence_text string, embedding array<float>, verification_status string, extraction_confidence double, verifier_confidence double, created_at timestamp",
    "fact_relationships": "project_id string, relationship_id string, fact_id_a string, fact_id_b string, type string, basis string, explanation string, confidence double, created_at timestamp",
    "canonical_concepts": "project_id string, kind string, canonical_name string, raw_aliases array<string>, first_seen_document_id string, first_seen_at timestamp",
    "verification_logs": "project_id string, log_id string, fact_id string, stage string, result string, issue string, created_at timestamp",
}

#: Statuses whose facts are compared, and those whose facts answer questions.
COMPARED = ("verified", "auto_corrected")
ANSWERING = ("verified", "auto_corrected", "needs_review")
STATUSES = ("pending", "verified", "auto_corrected", "needs_review", "rejected")
RELATIONS = ("corroborates", "contradicts", "reconciled_by_context", "unrelated")
