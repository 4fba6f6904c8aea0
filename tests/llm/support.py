"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}{rnd.choice(['', '.', ',', 'é'])}" + rnd.choice(["", "", "", "\n"]) for _ in range(n))


def awkward_rows(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    base = prose(rnd, 120)
    rows = [(k, prose(rnd, rnd.randrange(1, 90)), "en", f"s{k % 3}", 1) for k in range(40)]
    rows += [(100 + k, base, "en", "s0", 1) for k in range(12)]  # a group of copies
    rows += [(120, base.replace("w1", "w2", 1), "en", "s1", 1), (121, base.replace(" ", "\t \n"), None, "s1", None)]
    rows += [(130, None, "en", None, None), (131, "", "en", "s0", 0), (132, " \n\t ", "fr", "s0", 3), (133, "one", None, None, 3)]
    rows += [(140, "x" * 50_000, "en", "s2", 1), (141, "again " * 9_000, "en", "s2", 1), (142, prose(rnd, 4000) + "  \x1c\u0085 end", "de", "s1", 1)]
    rows += [(None, "an identifier is missing here", "en", "s1", 1), (None, base, "en", "s1", 1)]
    rows += [(150, "ties and repeated rows", "en", "s1", 1)] * 3
    rows += [(160, "Straße İstanbul ΣΑΣ ﬁ é <|endoftext|> it's we'll 12345 ###$$$", "de", "s2", 1)]
    return rows


def awkward(spark: SparkSession, seed: int = 1) -> DataFrame:
    return spark.createDataFrame(awkward_rows(seed), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows_of(df: DataFrame, *names: str) -> list[tuple]:
    """Rows in an order of their own, to compare as multisets."""
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=repr)
