"""Small document tables with every odd case, shared by the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, key string, bucket int"


def documents(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty and long texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(900)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, other = make(60), make(70)
    rows: list[tuple] = []

    def add(text, source="a", lang="en"):
        rows.append((len(rows) + 1, text, lang, source))

    base = make(150)
    add(base)
    add(base.upper(), "b")
    add(base.replace(" ", "\n"), None)
    w = base.split()
    for i in range(6):
        v = list(w)
        v[20 * i] = "changed"
        add(" ".join(v), "ab"[i % 2])
    for i in range(5):
        add(f"{make(20 + i)} {passage} {make(15)}", "c")
        add(f"{passage} {make(9)} {other}", "é")
    for n in (0, 1, 3, 4, 5, 12, 13, 14):
        add(make(n), "")
    add(None, None, None)
    add("", None)
    add("   \t\n ", "b")
    add("z" * 450, "b")
    add("y" * 450 + "z" * 230, "b")
    add("aé漢🙂 " * 120, "c", "fr")
    add(make(6000), "d")
    line = "one common line that many documents hold and that is long enough to be a window of words here"
    for _ in range(12):
        add(f"{make(12)}\n{line}\n{make(14)}", "a")
    for _ in range(40):
        add("the very same short text", "a")
    add(f"{line}\n{line}\n{line}", "a")
    rows.append((rows[0][0], rows[0][1], rows[0][2], rows[0][3]))  # a row that repeats
    rows.append((None, base, "en", "a"))
    return rows


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, lang, s, None if t is None else len(t), "x", 7, "k", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
