import pytest
from pyspark.sql import SparkSession

from core_helpers import INSTANCE
from linkloom.graph import SCHEMAS, Graph
from linkloom.session import configure


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("linkloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Three pages on two sites; a tag, plain links, a citation and a ring."""
    t = INSTANCE + "~/"
    data = {
        "pages": [
            ("https://a.example/1", 10, 100, 50, "A one", None, None, True),
            ("https://a.example/2", 20, 200, None, "A two", "second", None, True),
            ("https://b.example/1", 30, None, None, None, None, "https://b.example/i.png", False),
            ("https://b.example/2", 40, 400, 400, "B two", None, None, True),
        ],
        "terms": [(t + "red", "red", 1), (t + "blue", "blue", 2)],
        "term_usage": [(t + "red", 11)],
        "edges": [
            ("https://a.example/1", t + "red", "term", 11),
            ("https://a.example/1", t + "blue", "term", 12),
            ("https://a.example/2", t + "red", "term", 21),
            ("https://a.example/1", "https://b.example/1", "page", 13),
            ("https://a.example/2", "https://b.example/1", "page", 22),
            ("https://a.example/2", "https://b.example/2", "page", 23),
        ],
        "relations": [
            ("https://a.example/1", "https://b.example/1", "Cite", ["red"], 13),
            ("https://a.example/2", "https://b.example/1", "Link", [], 22),
            ("https://a.example/2", "https://b.example/2", "Bookmark", ["blue"], 23),
        ],
        "origins": [
            ("https://a.example", True, False),
            ("https://b.example", True, True),
            ("https://c.example", False, False),
        ],
        "origin_pages": [
            ("https://a.example", "https://a.example/1"),
            ("https://a.example", "https://a.example/2"),
            ("https://b.example", "https://b.example/1"),
            ("https://b.example", "https://b.example/2"),
        ],
        "rings": [("https://ring.example", 1)],
        "ring_members": [("https://ring.example", "https://a.example"), ("https://ring2.example", "https://b.example")],
        "endorsements": [("https://a.example", "https://c.example")],
        "assertions": [("x1", "https://a.example", "https://z.example/", "Z", None, ["red", "blue"], 5)],
    }
    return Graph(instance=INSTANCE, **{n: spark.createDataFrame(data[n], s) for n, s in SCHEMAS.items()})
