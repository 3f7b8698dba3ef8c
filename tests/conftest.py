import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import DATA, database, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def folder():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def con(folder):
    return database(folder)


@pytest.fixture(scope="session")
def tickets(spark, folder):
    from ticketlab.operators import order_stats
    from ticketlab.sources import star

    return order_stats.pin(star.tickets(spark, folder))
