"""The driver's contract."""

import __spark_entry__ as entry
import pytest


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster_id", "vec_id", "cluster_size"] and df.count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["knn_topk_batch", "gated_pairs", "line_windows", "context_budget", "cache_upsert", "report_json", "sim_clusters",
                                  "chunk_pack", "dedent_units", "extract_units", "unit_order", "ingest_status", "files_read", "report_clusters", "overlap_gate", "overlap_join", "knn_inverted_exact", "structure_join", "structure_pairs", "cache_resume", "job_update"])
def test_oracle(spark, sf, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    expected = con.sql(entry.oracle_sql()[name])
    assert sorted(expected.columns) == columns

    def rows(found, names):
        at = [names.index(c) for c in columns]
        return sorted(str([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in at]) for r in found)

    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(expected.fetchall(), list(expected.columns))


def test_files_of_the_query_are_the_same_in_every_process(monkeypatch):
    import time

    from lexigrid.plans import catalogue

    now = time.time()
    made = []
    for later in (0, 1000):
        monkeypatch.setattr(time, "time", lambda later=later: now + later)
        made.append(catalogue._docx("p", "q"))
    assert made[0] == made[1]
