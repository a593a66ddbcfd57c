import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from recordlake.session import build_session

    s = build_session("local[4]", shuffle_partitions=4, app="recordlake-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from recordlake.session import scratch_dir

    return scratch_dir(spark, "test")


def local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def write_text(path: str, lines: list[str]) -> str:
    """Land a text file atomically: write a hidden temp file (Spark skips names
    starting with '.'), then rename it, so a running file stream never lists a
    half-written file."""
    path = local(path)
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    tmp = os.path.join(folder, "." + os.path.basename(path) + ".tmp")
    with open(tmp, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    os.replace(tmp, path)
    return path
