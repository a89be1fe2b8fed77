"""Tables of the data model."""

from __future__ import annotations

#: Table name to DDL; vectors are ARRAY<FLOAT>, computed with in DOUBLE.
TABLES = {
    "paper": "id LONG, local_doi STRING, title STRING, title_embedding ARRAY<FLOAT>, authors ARRAY<STRING>, abstract STRING, abstract_embedding ARRAY<FLOAT>, college STRING, program STRING, summary STRING, uploaded_by LONG, uploaded_at TIMESTAMP, file STRING, tags ARRAY<STRING>, is_indexed BOOLEAN, is_registered BOOLEAN, status STRING, year INT, citation_count_cached INT, matched_count_cached INT, views LONG, merged_html STRING, images_folder STRING",
    "chunk": "id LONG, paper_id LONG, title STRING, authors ARRAY<STRING>, page INT, chunk_id INT, text STRING, embedding ARRAY<FLOAT>",
    "saved": "user_id LONG, paper_id LONG, saved_at TIMESTAMP",
    "citation": "source_paper_id LONG, matched_paper_id LONG, raw_citation STRING, score DOUBLE, matched_at TIMESTAMP",
    "figure": "paper_id LONG, image STRING, page_number INT, created_at TIMESTAMP",
    "tag": "id LONG, name STRING, description STRING, embedding ARRAY<FLOAT>, is_active BOOLEAN, created_at TIMESTAMP",
    "user": "id LONG, email STRING, is_staff BOOLEAN, is_superuser BOOLEAN, date_joined TIMESTAMP",
}

#: The colleges and programs that papers may name, and the programs of each college.
COLLEGES = ("ccs", "cba", "cas", "coe", "cihm")
PROGRAMS = ("bsit", "bscs", "bsba", "bse", "bsa", "bshm", "bsece")
COLLEGE_PROGRAMS = {"ccs": ("bsit", "bscs"), "cba": ("bsba", "bsa"), "cas": ("bsem", "bsee"), "coe": ("bsece",), "cihm": ("bshm",)}
STATUSES = ("pending", "processing", "complete", "failed")
