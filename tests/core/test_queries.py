"""Every query of the count engine against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from oracle import connect, differences

from cellsift.plans import core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(core.FOUND))
def test_query(spark, con, name):
    if name in core.SQL:
        assert differences(spark, con, core.FOUND[name], core.SQL[name], SF) == ""
    else:
        assert not core.FOUND[name](spark, SF).isEmpty()
