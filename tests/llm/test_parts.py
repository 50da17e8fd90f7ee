"""Those parts of results that SQL can say, against DuckDB."""

import pytest
from conftest import same_as_sql

from tensorloom.llm import oracles, queries


@pytest.mark.parametrize("name", ["rules_ablation", "pii_base", "mixing_targets"])
def test_oracle(spark, data, duck, name):
    same_as_sql(queries.queries()[name](spark, data), duck, oracles.oracle_sql()[name])
