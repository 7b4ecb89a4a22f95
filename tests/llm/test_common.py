import pyarrow as pa
import pytest

from tessera.llm.common import WRITING, connected, sliced, written


def test_settings_are_put_back(spark):
    names = [*WRITING, "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in names]
    assert written(spark.range(10), "t").count() == 10
    assert [spark.conf.get(k) for k in names] == before
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        written(spark.range(1).selectExpr("1 div id AS x"), "t")
    assert [spark.conf.get(k) for k in names] == before


def test_slices_are_bounded():
    b = pa.record_batch([pa.array([b"x" * n for n in (1, 10, 100_000, 5, 5, 70_000, 1)])], names=["t"])
    got = list(sliced([b, b.slice(0, 0)], 3, 50_000))
    assert pa.Table.from_batches(got).combine_chunks() == pa.Table.from_batches([b])
    assert all(s.num_rows <= 3 and (s.num_rows == 1 or s.nbytes <= 50_000 + 100) for s in got)


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 70), (101, 70), (70, 102), (5, None), (7, 7)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(61)} | {k: 70 for k in (70, 100, 101, 102)}
