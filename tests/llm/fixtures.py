"""Small tables with the awkward cases every operator must take: nulls, empty and long texts,
ties, repeated rows, clashing extra columns."""

import random

LETTERS = "abcdefghijklmnop"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, part int, sig string, score double"


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 7))) for _ in range(n)]


def corpus(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    base = [words(rnd, rnd.randint(60, 160)) for _ in range(14)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    shared = words(rnd, 70)
    for i in range(6):  # a passage in different surroundings, with an edit
        own = list(shared)
        own[30 + i] = "changed"
        rows.append((100 + i, " ".join(words(rnd, 40) + own + words(rnd, 35))))
    for i in range(8):  # near copies of one text
        w = list(base[0])
        w[rnd.randrange(len(w))] = f"edit{i}"
        rows.append((200 + i, " ".join(w)))
    chain = list(base[1])
    for i in range(5):  # each is like the one before
        chain = chain[6:] + words(rnd, 2)
        rows.append((300 + i, " ".join(chain)))
    for i in range(9):  # copies that differ in white space and case
        rows.append((400 + i, "  ".join(base[2]) + "\n" * (i % 3) if i % 2 else " ".join(base[2]).upper()))
    rows += [(500, ""), (501, None), (502, " \t\n "), (503, "one two"), (504, "one  two"), (505, "One two"),
             (None, "one two"), (None, None), (None, " ".join(base[3])), (506, "x" * 5000), (507, "ab " * 4000),
             (508, "é ß Ω " * 30), (7, rows[7][1]), (7, rows[7][1]), (8, "another text of the same id " * 4)]
    return rows


def documents(spark, rows=None, slices: int = 3):
    rows = corpus() if rows is None else rows
    full = [(i, t, "en", "s", 0, k, k % 2, "sig", 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(spark.sparkContext.parallelize(full, slices), DOCS) if full else spark.createDataFrame([], DOCS)
