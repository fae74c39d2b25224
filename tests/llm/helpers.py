"""Fixtures that every operator meets: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, part string, id string, hashes string, block string"


def word(n):
    return "w" + "".join(chr(97 + int(d)) for d in str(n))


def prose(rng, n, vocabulary=400):
    return " ".join(word(rng.randrange(vocabulary)) for _ in range(n))


def documents(spark, texts):
    """texts: (doc_id, text); the other columns bear names that operators use themselves."""
    return spark.createDataFrame([(i, t, "p", "x", None, "b") for i, t in texts], DOCS)


def hard_texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(25)]
    shared = prose(rng, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, t) for i, t in enumerate(base[:6])]  # copies
    for i in range(12):  # near copies
        words = base[7].split()
        words[rng.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words)))
    out += [(300 + i, f"{prose(rng, 30)} {shared} {prose(rng, 20)}") for i in range(8)]
    out += [(400, None), (401, ""), (402, "   \n\t "), (403, "one"), (404, "One two"), (405, "one two"), (None, base[0]), (0, base[0]), (0, base[0])]
    out.append((500, prose(rng, 40000)))
    return out
