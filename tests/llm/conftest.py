import os
import random

import pytest
from cases import EDGE, SCHEMA, with_columns

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(with_columns(EDGE), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def prose():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("aeiourstnlmdp") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
