"""Small tables with everything that goes wrong: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, h long, key2 string"


def prose(r: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = "".join(r.choice(["the", "ti", "on", "re", "sh", "ou", "er", "an"]) for _ in range(r.randint(1, 4)))
        out.append(w + ("." if r.random() < 0.12 else ""))
    return " ".join(out)


def rows(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    base = [prose(r, 120) for _ in range(14)]
    shared = prose(r, 70) + "."
    out = []
    for i, t in enumerate(base):
        out.append((i, t))
        words = t.split()
        words[r.randrange(len(words))] = "changed"
        out.append((100 + i, " ".join(words)))
    out += [(200 + i, base[0]) for i in range(40)]
    out += [(300 + i, prose(r, 30) + "\n" + shared + "\n" + prose(r, 30)) for i in range(12)]
    out += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "one two three"), (405, "one two three"), (None, base[1]), (None, None), (406, "x" * 20_000), (407, prose(r, 6000)), (408, "ü😀 " * 60), (408, "ü😀 " * 60), (409, "same id first " * 9), (409, "same id second " * 9)]
    langs, sources = ["en", "de", None], ["a", "b", "c", None]
    return [(d, t, langs[k % 3], "a" if k % 3 else sources[k % 4], None, k, -k, "clash") for k, (d, t) in enumerate(out)]


def documents(spark, seed: int = 5):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
