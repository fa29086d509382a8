"""The queries of this subpackage on the smallest tables: their SQL, and what must hold where SQL can't express them."""

import duckdb
import pytest

from quaysift.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["evidence_id", "fin_row_id"], "p2_found": ["chunk_key"], "p3_found": ["tbl", "row_key"], "p4_found": ["tbl", "row_key", "pii_kind"], "p7_found": ["item_id", "doc_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows and df.columns == COLUMNS.get(name, df.columns)
    if name in COLUMNS:
        assert len(set(rows)) == len(rows)
    if name in queries.SQL:
        tables = duckdb.connect()
        tables.execute(f"CREATE VIEW doc_chunks AS SELECT * FROM '{SMALL}/doc_chunks.parquet'")
        assert sorted(map(tuple, rows)) == sorted(tables.execute(queries.SQL[name]).fetchall())
    if name == "p1_links":
        assert all(0.5 <= r.confidence <= 1 for r in rows) and len({round(r.confidence, 3) for r in rows}) > 3
    if name == "p2_pieces":
        by = {}
        for r in rows:
            by.setdefault(r.chunk_key, []).append(r)
        texts = dict(duckdb.sql(f"SELECT chunk_key, text FROM '{SMALL}/doc_chunks.parquet'").fetchall())
        for key, parts in by.items():
            parts.sort(key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(parts[0].n_pieces))
            assert parts[0].content_start == 0 and parts[-1].end == len(texts[key])
            assert all(b.content_start == a.end for a, b in zip(parts, parts[1:]))
            assert all(r.end - r.start <= 800 and r.content_start - r.start <= 120 and r.piece_text == texts[key][r.start : r.end] for r in parts)
    if name == "p4_redacted":
        assert all(any(mark in r.redacted for mark in ("[NAME]", "[EMAIL]", "[PHONE]", "[ID]", "[ADDRESS]")) for r in rows)
    if name == "p6_containers":
        fill, docs = {}, {}
        for r in rows:
            fill[r.target_name, r.container] = fill.get((r.target_name, r.container), 0) + r.tokens
            docs.setdefault(r.target_name, set()).add(r.doc_id)
        capacity = dict(duckdb.sql(f"SELECT target_name, capacity_tokens FROM '{SMALL}/pack_targets.parquet'").fetchall())
        n = duckdb.sql(f"SELECT count(DISTINCT doc_id) FROM '{SMALL}/documents.parquet'").fetchall()[0][0]
        assert all(total <= capacity[t] for (t, _), total in fill.items()) and all(len(d) == n for d in docs.values())
