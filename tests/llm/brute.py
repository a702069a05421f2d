"""Plain versions of the operators for small inputs, and documents with every odd case."""

from __future__ import annotations

import random
import re
import zlib

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, node string, topic int, row int, word string"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def shingles(text: str | None) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def crc(id_: object) -> int:
    return zlib.crc32(str(id_).encode())


def vocabulary(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abdeiklmnorstuäé") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(rng: random.Random, n: int, names: list[str]) -> str:
    return " ".join(rng.choice(names) for _ in range(n))


def edit(rng: random.Random, text: str, changes: int) -> str:
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
    return " ".join(w)


def documents(seed: int = 3) -> list[tuple]:
    """Near and exact copies, shared passages, nulls in every column, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    names = vocabulary(rng, 800)
    texts: list[str | None] = []
    base = prose(rng, 220, names)
    texts += [base] + [edit(rng, base, k % 9) for k in range(40)]  # one large group of near copies
    for _ in range(25):
        one = prose(rng, rng.randint(6, 180), names)
        texts += [one, edit(rng, one, rng.randint(0, 3)), one.upper(), one.replace(" ", " \n ", 3)]
    passage = prose(rng, 70, names)
    for _ in range(12):
        texts.append(prose(rng, 90, names) + " " + edit(rng, passage, rng.randint(0, 2)) + " " + prose(rng, 60, names))
    texts += [None, "", " \n\t ", "a", "a b c", "A  B\tC", prose(rng, 60_000, names), "z" * 50_000, "naïve \x00 ünï"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0"] * 5 + ["s1", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[60], (None, base, "en", "s0", 1), (None, None, None, None, None)]
    return [(*r, "score", None, 7, None, "w") for r in rows]
