import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null, empty, long and repeated texts, null and repeated ids, and columns with clashing names."""
    long = " ".join(f"word{i}" for i in range(5000))
    same = " ".join(f"copy{i}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (6, same), (6, same), (None, same),
        (7, same + " tail"), (8, "under the MIT License and CC BY-NC 4.0"), (9, "one two"), (10, "One TWO"),
        (11, "Éa Σας <|endoftext|> don't 12 漢字"),
    ]
    wide = [(i, t, "x", 1, 2, "k", 0) for i, t in rows]
    return spark.createDataFrame(
        wide, "doc_id long, text string, id string, grp int, n int, key string, row int"
    )
