"""Small inputs with all the odd cases, and helpers for brute force."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty texts, repeated rows, copies, long and non-ASCII texts, ties."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Größe", "été", "中文字", "naïve,"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 30, 80, 200]))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5]) for i in range(12)]  # copies
    for i in range(12):  # near copies
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words)))
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(300 + i, f"head {i} {passage} tail {i} {passage}") for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one"), (405, "a b c d"), (406, "A b C d"), (None, base[0]), (None, None)]
    rows += [(0, base[0]), (407, "loop " * 500), (408, passage * 3)]
    rows += [(-5, base[3]), (409, " ".join(rng.choices(vocabulary, k=5000)))]
    return rows


def frame(spark, rows, extra=True):
    """A documents table with further columns, some with names that operators use themselves."""
    found = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        return found.selectExpr("doc_id", "text", "'x' as lang", "1 as chunk", "2 as key", "'s' as source", "cast(3 as long) as n_chars", "0.5 as score", "4 as n", "5 as node")
    return found
