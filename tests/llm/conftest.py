import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The shared folder of the session; the operators never choose one themselves."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
