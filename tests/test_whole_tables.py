"""Queries on arrays of a customer's orders take every customer."""

import pytest

from larkspur.queries import QUERIES

SF = "/root/testdata/sf0.01"
NAMES = ["update_push", "update_pop", "update_pull", "update_pull_all", "update_add_to_set", "update_pull_documents", "lookup_array_key"]


@pytest.mark.parametrize("name", NAMES)
def test_every_customer(spark, name):
    want = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().collect()}
    got = [r._id for r in QUERIES[name](spark, SF).select("_id").collect()]
    assert set(got) == want and len(got) == len(want)
