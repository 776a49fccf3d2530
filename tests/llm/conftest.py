import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(1, str(Path(__file__).parent.parent))

from llm_rows import make, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
