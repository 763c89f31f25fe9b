import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siltstone.session import local_session  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", memory="8g", name="tests")


@pytest.fixture(scope="session")
def functions(spark):
    """Rows of FUNCTIONS from short tuples: (id, file, class, name, code, calls, imports)."""
    from siltstone.schemas import FUNCTIONS

    def make(*rows):
        full = []
        for func_id, file, class_name, name, code, calls, imports in rows:
            n = code.count("\n") + 1
            full.append(
                (func_id, file, class_name, name, 1, n, [], n, 0, '"""' in code, list(calls), list(imports), file, code)
            )
        return spark.createDataFrame(full, FUNCTIONS)

    return make
