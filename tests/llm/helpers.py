"""Texts with every awkward case, and plain Python versions of the operators' definitions."""

import hashlib
import re

SCHEMA = "doc_id bigint, text string, lang string, n_words bigint, kept boolean, label string"


def prose(words, seed=0, vocabulary=97):
    """Deterministic running text of ``words`` words."""
    state, out = seed * 7919 + 13, []
    for _ in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{state % vocabulary}{'abcdefg'[state // 131 % 7]}")
    return " ".join(out)


def awkward_texts():
    base = prose(400, 1)
    return [
        None,
        "",
        " \n\t ",
        "one",
        "one two three",
        "ONE two three",
        base,
        base,
        base + " tail",
        base.replace("w5a", "W5A"),
        prose(60, 2) + " " + prose(120, 3),
        prose(120, 3) + " " + prose(60, 4),
        prose(5000, 5),
        "é" * 700,
        "spam " * 300,
        "x" * 1500,
        prose(30, 6) + "\n" + prose(30, 7) + "\r\n ß Straße İ Σίσυφος \x1c \x00",
    ]


def rows(texts=None, first=0):
    texts = awkward_texts() if texts is None else texts
    return [(first + at, text, None if at % 3 else "en", at, None, "x") for at, text in enumerate(texts)]


def frame(spark, data, parts=3):
    """Columns beside id and text have names that operators use themselves, and nulls."""
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
