"""Every registered query runs on the smallest tables and equals its oracle SQL where there is one."""
import pytest

import __spark_entry__ as entry
from wordframe import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Empty at this size: nothing repeats, or no key is on both sides.
MAY_BE_EMPTY = {"v04_text_agreement", "v12_saved_folds"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok or (name in MAY_BE_EMPTY and note.startswith("rows 0")), note


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_shared():
    assert set(entry.oracle_sql()) <= set(entry.queries())
