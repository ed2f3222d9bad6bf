"""Small documents with every odd case."""
import random

SF = "/root/testdata/sf0.01"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def make_rows():
    rng = random.Random(5)
    passage = " ".join(words(rng, 90, 10_000))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (None, "no id here"), (None, None)]
    base = " ".join(words(rng, 300, 5_000))
    rows += [(10, base), (11, base), (12, base.replace("w1", "W1")), (13, base + " tail"), (13, base + " tail")]
    for i in range(14, 30):
        rows.append((i, " ".join(words(rng, rng.randrange(5, 120), 5_000)) + ("\n" if i % 2 else "  ") + passage + " " +
                     " ".join(words(rng, 40, 5_000))))
    rows.append((30, "a " * 500))
    rows.append((31, "ab" * 900 + "é" * 700))
    rows.append((32, " ".join(words(rng, 40_000, 50_000)) + " " + passage))
    rows.append((33, passage + "\x1c" + passage + " x  y \n\n z<|endoftext|> it's  'll"))
    rows.append((34, "x" * 400))
    rows.append((35, "x" * 399 + "y" + "x" * 401))
    edited = base.split()
    for i in range(40, 60):
        e = list(edited)
        for _ in range(i % 4):
            e[rng.randrange(len(e))] = f"edit{i}"
        rows.append((i, " ".join(e)))
    rows += [(60 + i, " ".join(words(rng, rng.randrange(0, 60)))) for i in range(30)]
    return rows


ROWS = make_rows()
