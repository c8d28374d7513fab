"""Schemas of the inputs and of the index tables, as DDL."""

DOCUMENTS = "doc_id STRING, text STRING"
QUERIES = "query_id STRING, text STRING"
QRELS = "query_id STRING, doc_id STRING, relevance INT"

INDEX = {
    "docs": "pos BIGINT, doc_id STRING, dl BIGINT, norm DOUBLE",
    "forward": "part BIGINT, pos BIGINT, doc_id STRING, dl BIGINT, norm DOUBLE, bag ARRAY<STRUCT<term: STRING, tf: BIGINT, first_pos: INT>>",
    "postings": "term STRING, pos BIGINT, tf BIGINT, first_pos INT, tfidf DOUBLE, dl BIGINT",
    "terms": "term STRING, df BIGINT, ctf BIGINT, idf_standard DOUBLE, idf_smooth DOUBLE, idf_bm25 DOUBLE, idf_bim DOUBLE, bim_pt DOUBLE, p_collection DOUBLE",
    "corpus": "n BIGINT, adl DOUBLE, total_tokens BIGINT, mu DOUBLE, k1 DOUBLE, b DOUBLE, k2 DOUBLE",
    "texts": "doc_id STRING, text STRING",
}
