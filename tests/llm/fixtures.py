"""Small tables with nulls, empty and long texts, ties and repeated rows, and columns whose names clash."""

import random

WORDS = "the of and river stone light house walk green paper under moon small voice seven tree cold glass wind open".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        size = rng.randint(6, 14)
        words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(size)]
        words[0] = words[0].capitalize()
        words[-1] += "."
        out += words
    return " ".join(out[:n])


def near(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["zebra", "quartz", "violet"]) + str(rng.randint(0, 9))
    return " ".join(words)


def corpus() -> list[tuple]:
    """(doc_id, text): originals, exact and near copies, shared passages, and every odd case."""
    rows = [(k, prose(k, 30 + 7 * k)) for k in range(24)]
    rows += [(100 + k, rows[k][1]) for k in range(4)]  # exact copies
    rows += [(110 + k, rows[20][1].replace(" ", "  ").replace(".", ".\n")) for k in range(2)]  # equal but for white space
    rows += [(120 + k, near(rows[22][1], k, 2)) for k in range(6)]  # near copies
    passage = prose(999, 60)
    rows += [(140 + k, f"{prose(500 + k, 40)} {passage} {prose(600 + k, 40)}") for k in range(4)]
    rows += [(150, f"{passage} x {passage}")]  # the passage twice in one text
    rows += [(160, None), (161, ""), (162, "   \n\t"), (163, "one two"), (164, "one two"), (165, "é" * 150), (166, "日本 " * 90)]
    rows += [(None, rows[5][1]), (None, None), (170, rows[6][1]), (170, rows[6][1])]  # null keys, a repeated row
    rows += [(180, prose(77, 9000)), (181, "a" * 4000), (182, "ab " * 3000)]  # long ones
    return rows


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    rows = corpus() if rows is None else rows
    full = [(d, t, "en", f"src{(d or 0) % 3}", len(t or "")) for d, t in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
