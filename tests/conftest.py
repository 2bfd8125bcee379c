import pytest

from lexmill.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 4, "4g")
    ship(session)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Values of columns over one row."""
    from pyspark.sql import functions as F

    def run(*columns, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
        row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
