"""A small corpus with nulls, empty and long texts, ties, repeated rows and columns whose names clash, and brute-force answers."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, bucket int, digest string, row_key string, seen long, label int"
WORDS = ["the", "of", "and", "river", "stone", "Über", "éclair", "morning", "seven", "light", "house", "green", "walk", "deep", "city", "song", "bread", "north", "cold", "fire"]


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    sentence = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))
    passage, base = sentence(40), sentence(120)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "  \n\t "), (4, "12 34 !?"), (5, "one"), (6, "one two three four"), (7, "one two three four"), (8, sentence(9000))]
    for i in range(10, 30):
        rows.append((i, sentence(r.randint(5, 60)) + "\n" + passage + " " + sentence(r.randint(0, 60))))
    for i in range(30, 45):  # near copies of different closeness
        w = base.split()
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = "changed" + str(r.randint(0, 9))
        rows.append((i, " ".join(w)))
    rows += [(i, base) for i in range(45, 50)] + [(50, sentence(80))] * 2 + [(51, "ha " * 400), (52, "x" * 1500), (53, "x" * 700), (None, sentence(70)), (54, passage)]
    rows += [(i, sentence(r.randint(20, 90))) for i in range(60, 80)]
    r.shuffle(rows)
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), -1, 0, 0, "d", "k", 9, 1) for i, t in rows], SCHEMA).repartition(3)


def smaller(a, b) -> bool:
    """A null doc_id is smaller than any other."""
    return (-(1 << 63) if a is None else a) < (-(1 << 63) if b is None else b)


def near_components(rows, percent=75):
    """component_id of each row, by comparing all pairs."""
    key = lambda i: -(1 << 63) if i is None else i
    sets: list[tuple[int, frozenset]] = []
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append((key(i), frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    back = lambda x: None if x == -(1 << 63) else x
    return sorted((str(back(i)), len(s), str(back(find(i)))) for i, s in sets)


def kept_words(rows, width=13):
    """Words that stay when windows of an earlier document go."""
    first: dict[tuple, list] = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), []).append(i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if any(smaller(j, i) for j in first[tuple(w[k : k + width])]):
                gone[k : k + width] = [True] * width
        out.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def kept_bytes(rows, length=200):
    count: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, t in data:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((str(i), len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
