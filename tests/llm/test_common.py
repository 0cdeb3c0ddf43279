import os

import pytest
from helpers import hard, rows

from veridoc.llm import common as C
from veridoc.llm import simhash


def _tables(spark):
    folder = C.shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(folder) if x.startswith("veridoc-")}


def test_work_tables_go_when_an_operator_ends(spark):
    before = _tables(spark)
    found = simhash.near_duplicates(hard(spark))
    assert len(_tables(spark) - before) == 1 and found.count() == 11
    with C.work_tables() as work:
        simhash.near_duplicates(hard(spark))
        kept = work.keep(C.materialize(spark.range(3)))
    assert len(_tables(spark) - before) == 2 and rows(kept.orderBy("id")) == [(0,), (1,), (2,)]
    with pytest.raises(ZeroDivisionError), C.work_tables():
        C.materialize(spark.range(3))
        1 / 0  # noqa: B018
    assert len(_tables(spark) - before) == 2


def test_the_setting_of_a_write_is_put_back(spark):
    before = spark.conf.get(C._CLEANUP, "false")
    with C._shuffles_cleaned(spark), C._shuffles_cleaned(spark):
        assert spark.conf.get(C._CLEANUP) == "true"
    assert spark.conf.get(C._CLEANUP) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        C.shared_dir(Session())
