import numpy as np
import pytest

from catchmark.llm.queries import PIECES, RANKS, WORD_BPE, vocabulary
from catchmark.llm.shipping import ship

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, prefix string, kind string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def paths():
    return {"ranks": vocabulary(RANKS), "words": vocabulary(WORD_BPE), "pieces": vocabulary(PIECES)}


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with some columns named like the operators' own."""

    def make(texts, langs=None, sources=None, ids=None):
        n = len(texts)
        ids, langs, sources = ids or list(range(n)), langs or ["en"] * n, sources or ["a"] * n
        rows = [(i, t, g, s, None if t is None else len(t), "node", "prefix", "kind") for i, t, g, s in zip(ids, texts, langs, sources)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded prose of invented words: prose(k, n) is the k-th text of n words."""

    def make(k, n):
        g = np.random.default_rng([7, k])
        return " ".join("".join(g.choice(["an", "el", "to", "ri", "su", "mok"], g.integers(1, 4))) for _ in range(n))

    return make
