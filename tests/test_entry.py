from __future__ import annotations

import os

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["dense_topk", "hybrid_rrf", "segment_legalised", "pipeline_status", "hit_rate_grouping_sets"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
