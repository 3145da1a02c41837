import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
DATA = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 97}" for i in range(30_000))
BASE = " ".join(f"base{i}" for i in range(80))
#: Nulls in every column, empty, blank and long texts, repeated rows, copies, near copies, ids that repeat with other texts.
MESSY = [
    (1, "The cat sat on the mat. " * 3, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "fr", "b"),
    (5, LONG, "en", "a"),
    (6, LONG, "en", None),
    (7, BASE, "de", "b"),
    (8, BASE + " tail", "de", "b"),
    (8, BASE + " tail", "de", "b"),
    (9, BASE.replace("base70", "other"), None, "c"),
    (9, "Une phrase en français, avec l'été.\n\nDeux paragraphes.", "fr", "c"),
    (None, BASE, "de", None),
    (None, None, None, None),
    (11, "123 456 !!! 😀", "en", "c"),
    (12, "x", "en", "é"),
    (13, "don't can't we'll 'quoted' it''s  two  spaces\r\n", "en", "z"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """With extra columns whose names operators use for their own."""
    rows = [(*r, len(r[1]) if r[1] is not None else None, i, "x", 1) for i, r in enumerate(MESSY)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, bucket string, copies int").repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return documents.orderBy("doc_id").collect()
