import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(autouse=True)
def _reach(spark):
    from foreshock.llm.base import reach

    reach(spark)
