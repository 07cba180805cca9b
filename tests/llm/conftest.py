import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

from awkward_rows import ROWS

CLASHES = ("at", "id", "digest", "fp", "body", "shard", "slot", "copies", "gone", "n", "part", "score", "kept", "item")


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) rows, with other columns whose names the operators also use."""

    def make(rows):
        head = "doc_id long, text string, lang string, source string, n_chars long, "
        schema = head + ", ".join(f"`{c}` string" for c in CLASHES)
        full = [(i, t, None, "s", None if t is None else len(t), *["?"] * len(CLASHES)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def awkward(table):
    return table(ROWS)


@pytest.fixture(scope="session")
def nothing(table):
    return table([])
