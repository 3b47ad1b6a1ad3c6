import pytest

from meridia.llm.queries import ORACLES, QUERIES

from ..compare import difference


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_text_query_equals_its_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert difference(QUERIES[name](spark, folder), ORACLES[name], folder) == ""
