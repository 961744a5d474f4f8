"""Small tables and brute-force versions for the tests of the text operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, sha string, bands long, word string, item string"

#: Nulls, empty and blank texts, ties in case, repeated rows, a long text, odd characters.
EDGE = [
    (1, "The cat sat on the mat and looked at the dog.", "en"),
    (2, "the CAT sat on the mat and looked at the dog.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "  \n\t \n", "de"),
    (6, "123 456 !!", "de"),
    (7, "Der Hund lief über die Straße.\nDer Hund lief über die Straße.\n", "de"),
    (7, "Der Hund lief über die Straße.\nDer Hund lief über die Straße.\n", "de"),
    (8, "wort " * 3000 + "ende", "de"),
    (9, "one two", None),
    (10, "ONE two", "en"),
    (None, "one two", "en"),
    (None, None, None),
    (11, "中文 🙂 ÉCOLE école\x00x\x85y", "fr"),
    (12, "a" * 5000, "en"),
    (13, "Released under the MIT License.\nThe cat sat on the mat and looked at the dog.", "en"),
    (-5, "x  y \n z <|endoftext|> w", "en"),
]


def edge_docs(spark):
    rows = [(i, t, lang, "s", 0 if t is None else len(t), 7, "k", 9, "w", "i") for i, t, lang in EDGE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def blank_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def random_texts(n: int, seed: int, words: int = 30, vocabulary: int = 40) -> list[str]:
    """Texts of few words, with exact and edited copies of each other."""
    rng = random.Random(seed)
    names = [f"w{i}" if i % 3 else f"W{i}é" for i in range(vocabulary)]
    out: list[str] = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            text = rng.choice(out).split(" ")
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(names)
        else:
            text = [rng.choice(names) for _ in range(rng.randrange(1, words))]
        out.append(" ".join(text))
    return out


def frame(spark, texts: list[str | None], first: int = 0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
