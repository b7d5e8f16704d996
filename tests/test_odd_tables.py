"""Queries against their SQL where tables hold what the smallest ones lack: ties, long sentences, lines that look like headings."""

from __future__ import annotations

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.test_catalog import canonical


def same(spark, path, name, **tables):
    """The query's rows are those of its SQL; tables: rows, or files of rows, by name."""
    con = duckdb.connect()
    for table, parts in tables.items():
        parts = parts if isinstance(parts, list) else [parts]
        (path / f"{table}.parquet").mkdir()
        for i, rows in enumerate(parts):
            pq.write_table(rows, path / f"{table}.parquet" / f"part-{i}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    got = queries()[name](spark, str(path)).toPandas()
    want = con.execute(oracle_sql()[name]).df()
    assert len(got)
    pd.testing.assert_frame_equal(canonical(got), canonical(want), check_dtype=False)


def documents(*texts):
    n = len(texts)
    return pa.table({"doc_id": list(range(1, n + 1)), "text": list(texts), "lang": ["de"] * n, "source": ["s"] * n, "n_chars": [len(t) for t in texts]})


def test_latest_versions_of_equal_numbers(spark, tmp_path):
    # the first rows as stored are in the smaller file, which is read last
    many = pa.table({"l_orderkey": [k % 50 for k in range(5000)], "l_linenumber": [7] * 5000, "l_partkey": list(range(5000))})
    few = pa.table({"l_orderkey": list(range(60)), "l_linenumber": [7] * 60, "l_partkey": [-1 - k for k in range(60)]})
    same(spark, tmp_path, "latest_versions", lineitem=[few, many])


def test_sentence_chunks_keep_line_ends_at_cuts(spark, tmp_path):
    same(spark, tmp_path, "sentence_chunks", documents=documents("x" * 399 + "\n" + "y" * 500 + ".", "x" * 399 + " " + "y" * 500, "a b. c"))


@pytest.mark.parametrize("name", ["line_nodes", "parsed_chunks", "tree_round_trip", "registry_trees", "rebuild_run"])
def test_addresses_are_no_headings(spark, tmp_path, name):
    # an address at the start of a short line, numbers, a list and a legal number: the length rule alone counts
    texts = ["56.187.231.175 Keit in lich auf.\nUng sich.", "eins\n1. zwei\ndrei", "vier " * 200, "第一条 a\n第二条 b\n第三条 c", "# fünf\nsechs"] * 3
    labels = pa.table({"doc_id": [1, 2, 5], "quality": [1, 0, 1], "toxic": [0, 1, 0]})
    same(spark, tmp_path, name, documents=documents(*texts), labels=labels)


def without_text(*more):
    texts = ["", " \n ", None, "Text.", *more] * 6
    return documents(*[t or "" for t in texts]).set_column(1, "text", pa.array(texts))


def test_outcomes_of_files_without_text(spark, tmp_path):
    # the second label of a document makes no second file
    labels = pa.table({"doc_id": [1, 2, 5, 5], "quality": [1, 0, 1, 0], "toxic": [0, 1, 0, 0]})
    same(spark, tmp_path, "rebuild_outcomes", documents=without_text("\u3000"), labels=labels)


def test_rebuild_of_files_without_text(spark, tmp_path):
    labels = pa.table({"doc_id": [1, 2, 5], "quality": [1, 0, 1], "toxic": [0, 1, 0]})
    same(spark, tmp_path, "rebuild_run", documents=without_text(), labels=labels)
