from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "re") for b in ("ba", "do", "fi", "gu", "li", "pa")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts of all kinds: plain, copies, near copies, null, empty, blank, one
    word, repetitive, very long, non-Latin, nulls in every column, twice the
    same row and twice the same doc_id."""
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(60, 260)), rng.choice("ab"), rng.choice(["s1", "s2", None]), 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "a", "s1", 0) for i in range(6)]
    for i in range(12):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words), "b", "s2", None))
    long = prose(rng, 30_000)
    rows += [
        (300, None, "a", "s1", None), (301, "", None, None, 0), (302, " \n\t ", "a", "s1", 3), (303, "word", "a", "s2", 4), (304, "la la la " * 200, "b", "s1", 1),
        (305, long, "a", "s3", 1), (306, long + " end", "a", "s3", 1), (307, "Ωμέγα 漢字 🙂 naïve ½ x\x0by\x0cz q " * 30, None, "s1", None),
        (None, prose(rng, 80), "a", "s1", 1), (None, None, None, None, None), (5, prose(rng, 90), "a", "s2", 1), rows[7], rows[7],
    ]
    return rows


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))
