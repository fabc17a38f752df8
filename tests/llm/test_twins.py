"""Registered queries of the subpackage against their SQL twins, and the registry itself."""

from __future__ import annotations

import re

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as driver
import corpus_pipeline
from proofline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_twin(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None


def test_all_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES if name != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert QUERIES.keys() <= driver.queries().keys() and ORACLE.keys() <= driver.oracle_sql().keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicate", "personal_data", "source_mix", "packing"]
