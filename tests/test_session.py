import pytest

from factloom import session


def test_partitions_follow_the_cluster():
    assert session.initial_partitions(8, 200) == 200
    assert session.initial_partitions(4000, 200) == 32_000
    assert session.initial_partitions(100_000, 200) == session.MAX_PARTITIONS
    assert session.initial_partitions(10, 60_000) == 60_000


def test_local_session_keeps_its_partitions(spark):
    session.configure(spark)
    assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


class _Cluster:
    """A session that looks like one on a cluster, with or without a shared folder."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": "yarn", "applicationId": "app"})()


def test_scratch_folder_is_shared_on_a_cluster():
    assert session.scratch_dir(_Cluster("hdfs://shared/x/"), "t").startswith("hdfs://shared/x/t-")
    with pytest.raises(RuntimeError):
        session.scratch_dir(_Cluster(None), "t")


def test_cut_lineage_keeps_rows(spark):
    df = session.cut_lineage(spark.range(10).toDF("a"))
    assert df.count() == 10 and "FileScan" in df._jdf.queryExecution().executedPlan().toString()
