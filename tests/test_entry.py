import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"bm25", "vsm", "bim", "lm_dirichlet", "rocchio_prf", "rm3", "hybrid_rrf"} <= set(sql)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "doc_id", "rank", "score"] and out.count() > 0
