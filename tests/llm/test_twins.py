"""Corpus queries that SQL can express against their DuckDB twins."""

import pytest

from lodestrata.llm.queries import ORACLE, QUERIES

from ..twins import compared


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins_agree(spark, sf_dir, name):
    own, twin = compared(spark, sf_dir, QUERIES[name], ORACLE[name])
    assert own == twin and own
