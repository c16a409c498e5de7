import pytest

from touchline.llm import common, warc


@pytest.mark.parametrize("rows, total", [(30_000, 60_000), (30_000, 10**11), (30_000, 10**15), (1, 2), (5, 6)])
def test_the_sample_holds_its_part_at_any_size(rows, total):
    edge = common.sample_edge(rows, total)
    assert -(1 << 63) <= edge < 1 << 63 and abs((edge + 1 + (1 << 63)) / (1 << 64) - rows / total) < 1e-15


def test_bounded_sample(spark):
    df = spark.range(20_000).withColumn("text", common.F.lit("one repeated text"))
    assert common.bounded_sample(df, 20_000, by=["id"]).count() == 20_000
    few = common.bounded_sample(df, 2_000, by=["id", "text"])
    assert 1_700 < few.count() < 2_300 and sorted(few.collect()) == sorted(common.bounded_sample(df.repartition(3), 2_000, by=["id", "text"]).collect())


class Session:
    """As much of a session as ``shared_dir`` asks for."""

    def __init__(self, master, conf=None, at=None):
        self.sparkContext, self.conf = self, self
        self.master, self.told, self.at = master, conf, at

    def get(self, name, other):
        return self.told or other

    def getCheckpointDir(self):  # noqa: N802
        return self.at

    def setCheckpointDir(self, path):  # noqa: N802
        self.at = path


def test_the_shared_folder():
    assert common.shared_dir(Session("spark://host:7077", "/mnt/shared")) == "/mnt/shared"
    assert common.shared_dir(Session("yarn", None, "file:/mnt/set")) == "file:/mnt/set"
    local = Session("local[4]")
    assert common.shared_dir(local) == local.at
    with pytest.raises(RuntimeError):
        common.shared_dir(Session("spark://host:7077"))


@pytest.mark.parametrize("folder, path", [("/tmp/a b", "/tmp/a b"), ("file:/tmp/x", "/tmp/x"), ("file:///tmp/x", "/tmp/x"), ("file:/tmp/a%20b", "/tmp/a b"), ("mock://tmp/x", "x")])
def test_any_form_of_folder_opens(folder, path):
    assert warc.opened(folder)[1] == path


def test_archives_below_a_file_uri(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://x/", f"page {i} " * 200) for i in range(20)], "page_id long, url string, html string")
    folder = f"file:{tmp_path}/w"
    assert sorted(r["page_id"] for r in warc.read(spark, warc.write(pages, folder), folder).collect()) == list(range(20))
