import os
import random
import sys

# linear algebra threads of the driver would wait for each other on a busy machine
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "the of and sun moon river stone light under over small great green blue house tree wind rain road field".split()


@pytest.fixture
def prose():
    """Made-up prose from a seed: sentences of some words."""

    def make(seed, n):
        rng = random.Random(seed)
        out = []
        while n > 0:
            k = min(n, rng.randint(4, 12))
            out.append(" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ly", "er"]) for _ in range(k)).capitalize() + ".")
            n -= k
        return " ".join(out)

    return make


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, more) with a clashing column of any name."""

    def make(rows, clash="score"):
        return spark.createDataFrame([(i, t, "own") for i, t in rows], f"doc_id long, text string, {clash} string")

    return make
