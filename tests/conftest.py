import pytest

from parcelmill.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def tables(spark):
    from parcelmill.plans.bindings import Tables

    return Tables(spark, "/root/testdata/sf0.001")
