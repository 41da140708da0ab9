"""Batches that are brought again change nothing: files, and a database over embedded Derby."""

import pytest

from chronoloom.sources import sinks, tables
from chronoloom.streaming import streams

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def _rows(spark, url):
    return sorted(tuple(r) for r in spark.read.format("jdbc").options(url=url, dbtable="target", driver=DRIVER).load().select("K", "SEQ", "V").collect())


@pytest.fixture
def derby(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    connection = sinks._connection(spark, url, DRIVER)
    sinks._run(connection, "CREATE TABLE target (k INT NOT NULL, seq INT, v VARCHAR(20))")
    connection.close()
    for _ in range(2):  # a ledger that is there stays
        sinks.create_ledger(spark, url, "target", DRIVER)
    return url


def _frame(spark, *rows):
    return spark.createDataFrame(rows, "k int, seq int, v string")


def test_a_batch_counts_once(spark, derby):
    write = sinks.to_jdbc(derby, "target", ["k"], ["seq"], "s1", DRIVER)
    first, second = _frame(spark, (1, 1, "a"), (2, 1, "b"), (1, 2, "c")), _frame(spark, (2, 5, "d"), (3, 5, None))
    write(first, 0)
    assert _rows(spark, derby) == [(1, 2, "c"), (2, 1, "b")]
    write(second, 1)
    after = [(1, 2, "c"), (2, 5, "d"), (3, 5, None)]
    assert _rows(spark, derby) == after
    for again in ((first, 0), (second, 1), (first, 0)):
        write(*again)
        assert _rows(spark, derby) == after
    # The numbers of another stream are its own.
    sinks.to_jdbc(derby, "target", ["k"], ["seq"], "s2", DRIVER)(_frame(spark, (1, 9, "z")), 0)
    assert _rows(spark, derby)[0] == (1, 9, "z")


def test_a_failed_try_leaves_nothing(spark, derby):
    write = sinks.to_jdbc(derby, "target", ["k"], ["seq"], "s1", DRIVER)
    write(_frame(spark, (1, 1, "a")), 0)
    with pytest.raises(Exception, match="(?i)null"):  # a null key is refused by the table, after rows have been deleted
        write(_frame(spark, (1, 2, "b"), (None, 2, "c")), 1)
    assert _rows(spark, derby) == [(1, 1, "a")]
    write(_frame(spark, (1, 2, "b")), 1)
    assert _rows(spark, derby) == [(1, 2, "b")]


def test_a_stream_that_breaks_off_goes_on(spark, derby, tmp_path):
    """The second batch is written but never noted by the stream; the next call brings it again."""
    for k in range(3):
        tables.save(_frame(spark, (k, k, f"v{k}"), (9, k, f"last{k}")).coalesce(1), str(tmp_path / "in"), mode="append")
    write = sinks.to_jdbc(derby, "target", ["k"], ["seq"], "s1", DRIVER)
    seen = []

    def breaks(df, number):
        write(df, number)
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("lost")

    source = lambda: spark.readStream.schema("k int, seq int, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception):
        streams.deliver(source(), breaks, str(tmp_path / "progress"))
    streams.deliver(source(), breaks, str(tmp_path / "progress"))
    assert seen == [0, 1, 1, 2]
    assert _rows(spark, derby) == [(0, 0, "v0"), (1, 1, "v1"), (2, 2, "v2"), (9, 2, "last2")]


def test_files_of_a_batch_are_replaced(spark, tmp_path):
    write = sinks.to_files(str(tmp_path / "out"))
    write(_frame(spark, (1, 1, "half"), (2, 1, "half")), 0)
    write(_frame(spark, (1, 1, "a")), 0)
    write(_frame(spark), 1)
    write(_frame(spark, (1, 2, "b")), 2)
    got = sinks.read_batches(spark, str(tmp_path / "out"), "k int, seq int, v string").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a", 0), (1, 2, "b", 2)]
    assert sinks.latest(_frame(spark, (1, 1, "a"), (1, 2, "b")), ["k"], ["seq"]).first().v == "b"
