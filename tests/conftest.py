import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tabsmith.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def csv(tmp_path):
    """Writes rows (header first) as they are and gives the path."""

    def write(*lines, name="data.csv"):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(path)

    return write


@pytest.fixture(scope="session")
def cities(spark):
    counts = {"Koeln": 22, "Cologne": 18, "Cologne Deutz": 16, "Porto (North)": 34, "Porto": 28, "Lyon": 32}
    names = [c for c, n in counts.items() for _ in range(n)]
    rows = [(i, c, (i * 7 % 41) / 4, f"seen {i} times") for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "id bigint, city string, amount double, notes string").cache()


@pytest.fixture(scope="session")
def locations(spark):
    counts = {"Oslo, Turin": 31, "Ghent, Basel, Malmo": 24, "Partly - Turin, Graz, Malmo": 27, "Riga": 21, "Split": 26, "Basel": 19}
    cells = [c for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame([(c, float(i)) for i, c in enumerate(cells)], "location string, amount double").cache()


@pytest.fixture(scope="session")
def experience(spark):
    counts = {"1-3 km": 24, "3-5 km": 33, "5-9 km": 28, "9-13 km": 35, "13-22 km": 20}
    spans = [s for s, n in counts.items() for _ in range(n)]
    rows = [(s, "Trails", float(i)) for i, s in enumerate(spans)]
    return spark.createDataFrame(rows, "distance_raw string, theme string, amount double").cache()


def pairs(df):
    return {tuple(r)[0]: tuple(r)[1] for r in df.collect()}
