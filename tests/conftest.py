import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bagscope.session import local_session

    session = local_session(4, shuffle_partitions=4, app="bagscope-tests")
    yield session
    session.stop()


# Hand-made repertoires: repeats, a null, a short sequence, an empty repertoire ("e").
SEQUENCES = [
    ("a", "CASSLEETQYF", "V1", "J1"), ("a", "CASSF", "V1", "J2"), ("a", "CASSF", "V1", "J2"), ("a", "AAAAA", "V2", "J1"),
    ("b", "CASSLEETQYF", "V1", "J1"), ("b", None, "V1", "J1"), ("b", "CA", "V3", None),
    ("c", "CASSLQ", "V1", "J1"), ("c", None, "V1", "J1"), ("d", "CASSLQ", "V1", None),
]
LABELS = [("a", 1), ("b", 1), ("c", 0), ("d", 0), ("e", 0)]
SCHEMA = "repertoire_id string, junction_aa string, v_call string, j_call string"


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.createDataFrame(SEQUENCES, SCHEMA)


@pytest.fixture(scope="session")
def tiny_labels(spark):
    return spark.createDataFrame(LABELS, "repertoire_id string, label int")
