import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the Python workers


@pytest.fixture(scope="session")
def spark():
    from quaymark import session

    os.environ.setdefault("BENCH_CPUS", "4")
    built = session.build("tests", shuffle_partitions=4)
    yield built
    built.stop()
