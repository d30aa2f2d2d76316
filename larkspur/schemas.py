"""Schemas of the tables that pass between the plans."""

from __future__ import annotations

METADATA_COLUMNS = ("doc_id", "doc_name", "doc_date", "source_url", "exams_id", "tema")
METADATA = ", ".join(f"{c} string" for c in METADATA_COLUMNS)
DATASET_COLUMNS = ("id", "exam", "question_type", "question", "ground_truth_answer", "ground_truth_ref", "ground_truth_doc_id")
CHUNK = "doc_id string, section_seq int, part_seq int, tipo_seccion string, seccion string, content string, n_tokens int"
QUERY_RECORD = "row_id string, exam string, question_type string, question string, condensed_query string, actual_off_topic boolean, verdict string, duration_ms double"
RANK_RECORD = "row_id string, exam string, question_type string, condensed_query string, ranks map<string,int>, retrieve_ms double"
GENERATION_RECORD = (
    "row_id string, exam string, question_type string, question string, ground_truth_answer string, status string, relevance string, answer string, "
    "correctness int, faithfulness int, correctness_reason string, faithfulness_reason string, zeroed_reason string, judge_model string, session_id string, timestamp_utc string, durations_ms map<string,double>"
)
