"""Plain versions of the operators, over lists in memory."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "river", "Stone", "über", "café", "don't", "we'll", "night", "moon,", "x1", "42", "日本", "a.b"]) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text): nulls, empty, blank and long texts, copies, repeated rows, a row without an id."""
    rng = random.Random(seed)
    out: list[tuple] = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "A b C"), (6, "!!! ... ???"), (7, "x" * 5000), (8, sentence(rng, 6000))]
    base = sentence(rng, 200)
    out += [(9, base), (10, base), (11, base + " end"), (11, base + " end")]
    out += [(20 + i, sentence(rng, rng.randrange(1, 120))) for i in range(40)]
    out += [(70, "<|endoftext|> a  b   c 's <|endoftext|>"), (71, " tabs and'll\r\n\r\n 'Re"), (72, "\U0001f600\U0001f600 ok"), (-5, base)]
    out += [(None, "no id here")]
    return out


def frame(spark, rows, **extra):
    """documents with all their columns; `extra` ones clash with what operators add."""
    from pyspark.sql import functions as F

    full = [(i, t, None if i is None or i % 7 == 0 else ("de" if i % 3 else "en"), None if i is None else f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))
