import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from evisift.session import local_session  # noqa: E402
from evisift.vocabulary import Vocabulary  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "4", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vocab():
    return Vocabulary.standard()


@pytest.fixture
def docs_of(spark):
    """A documents table from ``{file name: text}``."""
    from pyspark.sql import functions as F

    from evisift.functions.text import clean

    def build(texts):
        rows = [(i, f"in/{name}", name, text) for i, (name, text) in enumerate(texts.items())]
        docs = spark.createDataFrame(rows, "doc_id long, source_file string, filename string, text string")
        docs = docs.withColumn("content_hash", F.sha2("text", 256)).withColumn("text", clean(F.col("text")))
        return docs.withColumns({
            "parse_status": F.when(F.length("text") > 0, "ok").otherwise("empty"),
            "error": F.when(F.length("text") == 0, "no text"),
        })

    return build


@pytest.fixture
def apply(spark):
    """Evaluate a column function on a list of values."""
    from pyspark.sql import functions as F

    def run(function, values, type_="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {type_}")
        found = rows.select("i", function(F.col("v")).alias("r")).collect()
        return [r.r for r in sorted(found, key=lambda r: r.i)]

    return run
