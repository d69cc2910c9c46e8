"""Small fixtures for the corpus operators."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and to in that it is was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) rows, with the usual columns and one whose name clashes with results."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, slot string")

    return make


@pytest.fixture(scope="session")
def prose():
    def text(seed, n):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(WORDS) for _ in range(n))

    return text
