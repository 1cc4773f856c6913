import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ck")))
    return session


@pytest.fixture()
def scratch(spark):
    from kgspark.storage import Scratch

    return Scratch(spark)


@pytest.fixture(scope="session")
def base(spark):
    """The ontology of the rule fixtures."""
    from kgspark.plans.star import make_ontology

    return make_ontology(
        spark, "base", ["Thing", "Person", "Writer", "Place", "Book"],
        [("Person", "Thing"), ("Writer", "Person"), ("Place", "Thing"), ("Book", "Thing")],
        [("hasAuthor", ["Book"], ["Person"]), ("bornIn", ["Person"], ["Place"])],
        [("hasTitle", ["Book"])],
    )
