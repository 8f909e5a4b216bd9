"""Streams over tables that are folders of files."""

import os

import pytest
from conftest import SMALL
from oracle import compare, connect
from veilwright.plans.all_queries import ORACLES, QUERIES
from veilwright.sources.tables import read_table


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables that streams read, in several files each; their files have other names than the table."""
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in ("documents", "orders", "events", "customer"):
        read_table(spark, SMALL, name).repartition(3).write.parquet(os.path.join(folder, f"{name}.parquet"))
    return folder


@pytest.mark.parametrize("name", ["stream_scan", "stream_first_texts", "stream_alerts", "stream_admissions"])
def test_a_table_in_several_files_is_streamed(spark, parts, name):
    difference, rows, _ = compare(QUERIES[name](spark, parts), connect(SMALL), ORACLES[name])
    assert (difference, rows > 0) == ("", True)


def test_no_task_reads_a_whole_arrival(spark, parts):
    written = QUERIES["stream_reloaded"](spark, parts)
    folder = os.path.dirname(os.path.dirname(os.path.dirname(written.inputFiles()[0].removeprefix("file://").removeprefix("file:"))))
    arrived = [f for f in os.listdir(os.path.join(folder, "in")) if f.endswith(".parquet")]
    assert len(arrived) > 4  # one file for each arrival went through one task
    difference, _, _ = compare(written, connect(SMALL), ORACLES["stream_reloaded"])
    assert difference == ""
