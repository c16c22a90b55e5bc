"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

import pytest

from passages.plans import registry
from tests.conftest import rows

ORACLE = registry.oracle_sql()
#: Queries without SQL, and where they are held against something else.
ELSEWHERE = {
    "txt1_structure_text": "test_sources_streams", "txt2_clean_text": "test_sources_streams", "chk1_recursive_chunks": "test_features", "chk1_lateral_chunks": "test_features", "chk6_build_chunks": "test_ingest",
    "idx1_embed": "test_ingest", "ret3_knn_ann": "test_ingest", "ret3_stored_cells": "test_features", "ret5_segmented_query": "test_features", "ret6_lexical": "test_features, test_channels", "ret7_best_extent": "test_features",
    "set9_distractors": "test_features", "ctx10_full": "test_ingest",
}


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf, duck, name):
    found = registry.queries()[name](spark, sf).toPandas()
    if name in ORACLE:
        assert rows(found) == rows(duck.sql(ORACLE[name]).df())
    else:
        assert len(found) > 0


def test_queries_without_sql_are_listed():
    assert set(registry.queries()) - set(ORACLE) == set(ELSEWHERE)
