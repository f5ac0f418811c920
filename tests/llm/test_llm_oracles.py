import pytest

from bandlake.llm.catalog import ORACLES, QUERIES
from tests.test_oracles import SF, cells, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)
