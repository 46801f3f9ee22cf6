import os
from types import SimpleNamespace

import pytest

from ledgerloom.llm import common
from ledgerloom.llm.components import components


def folder(table):
    return table._written_at.removeprefix("file://").removeprefix("file:")


def test_tables_are_written_and_dropped(spark):
    rows = [(1, None, "x" * 300_000), (1, None, "x" * 300_000), (None, "", "é")]
    df = spark.createDataFrame(rows, "id long, text string, `_written_at` string")
    table = common.written(df, "test")
    assert sorted(map(tuple, table.collect()), key=str) == sorted(rows, key=str) and os.path.exists(folder(table))
    assert common.small_enough(table) and not common.small_enough(table, 0)
    looked = common.lookup(df.where("id > 5"), "test")
    assert looked.count() == 0 and looked.columns == df.columns
    common.dropped(table, looked)
    assert not os.path.exists(folder(table)) and not os.path.exists(folder(looked))


def test_components_leave_one_table(spark):
    shared = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(shared))
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(3, 3), (3, 3), (5, 4), (None, 7), (40, 41), (40, 41)], "a long, b long")
    found = components(links)
    assert {r.node: r.component for r in found.collect()} == {**{i: 0 for i in range(21)}, 40: 40, 41: 40}
    assert len(set(os.listdir(shared)) - before) == 1
    common.dropped(found)
    assert components(links.where("a > 99")).count() == 0


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(sparkContext=context))
