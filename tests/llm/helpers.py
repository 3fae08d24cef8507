from __future__ import annotations

import random
import re

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "one two three"), (5, "word " * 30000), (6, "x" * 40000), (7, "é中\U0001f600 \x00 nul\r\n▁ end  ")]
SCHEMA = "doc_id long, text string, id string, lang string, n int"


def odd_docs(spark):
    """Null, empty, blank, repeated, very long texts; extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "clash", "en", 1) for i, t in ODD], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
