import pytest
from pyspark.sql import functions as F

from hearthstat.sources import io, schemas


def test_csv_with_spaces_in_header(spark, tmp_path):
    (tmp_path / "records.csv").write_text(
        "Support Year,Support Month,Support Month Date Format,Subscriber Count,Disbursement Amount\n"
        "2018,01,01/2018,1200,15.5\n2019,02,02/2019,,7\n"
    )
    df = io.read_csv(spark, str(tmp_path / "records.csv"), schemas.SUBSCRIBER_RECORDS)
    rows = df.select("Support Month", F.col("`Subscriber Count`").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("01", 1200), ("02", None)]


def test_codes_keep_zeros_and_unnamed_columns_load(spark, tmp_path):
    (tmp_path / "areas.csv").write_text("State FIPS,State Name,Census Block Group,,\n01,Alabama,010159819031,,\n72,Puerto Rico,720371604007,,\n")
    rows = io.read_csv(spark, str(tmp_path / "areas.csv"), schemas.HIGH_COST_AREA_LIST).collect()
    assert [(r["State FIPS"], r["Census Block Group"], r["_c3"]) for r in rows] == [
        ("01", "010159819031", None), ("72", "720371604007", None),
    ]


def test_written_csv_reads_back(spark, tmp_path):
    df = io.literal_frame(spark, [(1.0, 1.5, 2.5, 3.5), (2.0, None, 0.0, 1.0)], schemas.MONTHLY_PROJECTION)
    io.write_csv(df, str(tmp_path / "out"))
    back = io.read_csv(spark, str(tmp_path / "out"), schemas.MONTHLY_PROJECTION)
    assert sorted(back.collect(), key=lambda r: r.months) == sorted(df.collect(), key=lambda r: r.months)
    with pytest.raises(Exception):
        io.write_csv(df, str(tmp_path / "out"))


def test_parquet_table_catalog_table_and_query(spark, tmp_path):
    df = io.literal_frame(spark, [("01", "x", "true", 3.0)], "state_id string, k string, high_cost_indicator string, total_households double")
    io.write_parquet(df, str(tmp_path / "t.parquet"), partition_by=["k"])
    assert io.read_table(spark, "t", str(tmp_path)).count() == 1
    df.createOrReplaceTempView("io_test_view")
    assert io.read_table(spark, "io_test_view").first().state_id == "01"
    assert io.read_query(spark, "SELECT sum(total_households) AS t FROM io_test_view").first().t == 3.0


def test_jdbc_options_split_the_read():
    options = io.jdbc_options("jdbc:postgresql://host/db", "SELECT * FROM t", "id", 0, 1000, 16, user="u")
    assert options["dbtable"] == "(SELECT * FROM t) AS source_query" and "query" not in options
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("id", "0", "1000", "16")
    assert io.jdbc_options("jdbc:x", "SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x", "SELECT 1", "id")


def test_small_frames(spark):
    grid = io.period_grid(spark, 1, 72)
    assert io.shape(grid) == (72, 1) and grid.dtypes == [("months", "int")]
    assert io.peek(grid, 3).count() == 3
    assert io.literal_frame(spark, [("01", "Ohio", 5, 2022)], schemas.STATES).dtypes[2] == ("total_households", "bigint")


def test_csv_header_must_fit_the_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "a.csv"), "a int, b int")
    (tmp_path / "c.csv").write_text("a,\nx,2\n")
    assert io.read_csv(spark, str(tmp_path / "c.csv"), "a int, spare int").collect()[0] == (None, 2)
    with pytest.raises(Exception):
        io.read_csv(spark, str(tmp_path / "c.csv"), "a int, spare int", mode="FAILFAST").collect()


def test_every_csv_file_must_have_the_header(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n3,4\n")
    (folder / "2.csv").write_text("a,b\n5,6\n")
    assert sorted(map(tuple, io.read_csv(spark, str(folder), "a int, b int").collect())) == [(1, 2), (3, 4), (5, 6)]
    (folder / "3.csv").write_text("b,a\n7,8\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.read_csv(spark, str(folder), "a int, b int").collect()
    (folder / "3.csv").write_text("a,b,c\n7,8,9\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.read_csv(spark, str(folder), "a int, b int").collect()
    assert io.read_csv(spark, [str(folder / "1.csv"), str(folder / "2.csv")], "a int, b int").count() == 3


def test_files_with_unnamed_columns_are_compared_too(spark, tmp_path):
    folder = tmp_path / "unnamed"
    folder.mkdir()
    (folder / "1.csv").write_text("a,\n1,2\n9,9\n")
    (folder / "2.csv").write_text("a,\n3,4\n")
    assert sorted(map(tuple, io.read_csv(spark, str(folder), "a int, spare int").collect())) == [(1, 2), (3, 4), (9, 9)]
    for other in ("spare,a\n5,6\n", "a,spare\n5,6\n", "a,,more\n5,6,7\n"):
        (folder / "3.csv").write_text(other)
        with pytest.raises(Exception, match="(?i)header"):
            io.read_csv(spark, str(folder), "a int, spare int").collect()
