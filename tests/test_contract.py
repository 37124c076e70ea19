from pathlib import Path

import __spark_entry__
import pytest


def test_names_agree():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(q) > 50 and set(o) <= set(q)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
