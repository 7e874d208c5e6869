"""The queries against their SQL in DuckDB, and the parts that SQL can't express against known counts."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from readloom import queries as q

CHEAP = ["node_table", "edge_table", "edge_weight", "degrees", "introns", "chain_nodes", "chain_edges", "traverse_paths", "read_first_paths", "is_connected", "is_cyclic_unbucketed", "topology_simple",
         "gtf_lines", "vcf_lines", "json_nodes", "dot_lines", "links_for_ids", "merge_rename", "chain_build", "load_nodes", "load_edges", "load_errors", "load_string", "summary_lines", "split_text", "fasta_lookup"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_oracle(spark, sf_dir, duck, name):
    got = q.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = duck.sql(q.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert Counter(map(str, (tuple(r) for r in got.select(*cols).collect()))) == Counter(map(str, want.select(*cols).fetchall()))


def test_registry():
    assert set(q.ORACLE_SQL) <= set(q.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_and_histogram(spark, sf_dir):
    assert Counter(r.topology for r in __spark_entry__.entry(spark).collect()) == {"UniquePath": 232, "NotDefined": 165}
