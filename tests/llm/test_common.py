import pytest

from lineward.llm.common import scratch, written


def files_of(df):
    return df.inputFiles()


def test_tables_between_are_deleted_and_kept_ones_stay(spark):
    df = spark.range(10)
    with scratch(spark):
        outer = written(df, "outer")
        with scratch(spark):
            gone, kept = written(df, "gone"), written(df, "kept", kept=True)
            assert gone.count() == 10
        assert kept.count() == 10 and outer.count() == 10
        with pytest.raises(Exception, match="(?i)does not exist|not found"):
            spark.read.parquet(*{f.rsplit("/", 1)[0] for f in files_of(gone)})
    for table in (outer, kept):
        with pytest.raises(Exception, match="(?i)does not exist|not found"):
            spark.read.parquet(*{f.rsplit("/", 1)[0] for f in files_of(table)})
    assert written(df, "after").count() == 10


def test_tables_are_deleted_after_a_failure(spark):
    with pytest.raises(ValueError, match="stop"), scratch(spark):
        made = written(spark.range(3), "made")
        raise ValueError("stop")
    with pytest.raises(Exception, match="(?i)does not exist|not found"):
        spark.read.parquet(*{f.rsplit("/", 1)[0] for f in files_of(made)})
