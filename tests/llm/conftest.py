import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Texts that every operator must take: null, empty, blank, special, repeated, and one beyond a batch's usual size.
ODD = [None, "", " \t\n", "a", "ends <|endoftext|> here", "naïve ﬁ İ ǅ 漢字 🙂 é", "It's  the dog's 12½ ²", "same text twice", "same text twice", "long word " * 30_000, "x" * 50_000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated and null ids and further columns whose names clash with the operators' own."""
    rows = [(i if t is not None else None, t, 1.5, "s", i, "k", True) for i, t in enumerate(ODD)] + [(3, "a", 1.5, "s", 3, "k", True)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, key string, n long, w string, kept boolean").repartition(3)
