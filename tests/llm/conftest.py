import random

import pytest

random.seed("long")
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choices(WORDS, k=20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, t string, score int, host string, spans string, n_words string"


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), 1, "x", 2, "y", "z", None)


SHARED = prose(60, "shared")
TEXTS = [
    row(1, prose(80, 1) + "\nboiler plate line\n" + prose(40, 2)),
    row(2, None),
    row(3, ""),
    row(4, " \t\n "),
    row(5, prose(80, 5) + ' password = "hunter22" ' + "AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2),
    row(5, prose(80, 5) + ' password = "hunter22" ' + "AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2),
    row(6, "one two"),
    row(7, LONG),
    row(8, prose(30, 8) + " " + SHARED + " " + prose(30, 9)),
    row(9, prose(20, 10) + " " + SHARED.upper() + " " + prose(50, 11), None),
    row(10, prose(80, 5) + ' password = "hunter22" ' + "AKIA" + "B" * 16 + " " + "0123456789abcdef" * 2, "b"),
    row(None, prose(70, 12)),
    row(11, "same words here " * 40),
    row(12, "Grüße 中文 <|endoftext|> naïve 🙂 Licensed under CC BY-NC 4.0. All rights reserved"),
    *[row(20 + k, f"{prose(60, 100 + k)}\nboiler plate line") for k in range(12)],
    row(40, "boiler plate line\n" * 3 + " ".join(f"q{i}" for i in range(50)), "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows, and columns named like internal ones."""
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return sorted(map(str, rows))
