"""The registered queries of the subpackage: against their oracle, or by the rows they must have."""

import pytest
from oracle import compare, connect

from pipeops.llm.queries import ORACLES, QUERIES

#: The table that has a row for every row of the result; the others report findings or totals.
ROW_PER = {
    "op1_byte_bpe": "documents", "op3_quality_machine": "documents", "op5_arc_to_warc": "pages", "op6_style_tree": "pages", "op7_simhash": "documents",
    "op9_weak_pii": "documents", "op11_language_bayes": "documents", "op13_periodic_runs": "documents",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, connect(sf_dir), ORACLES[name]) is None
    elif name in ROW_PER:
        assert df.count() == spark.read.parquet(f"{sf_dir}/{ROW_PER[name]}.parquet").count()
    else:  # findings: op2, op4; the smallest tables need not hold one
        assert df.count() >= 0
