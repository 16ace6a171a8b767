"""Small documents with every awkward case, and tables that are empty."""

import random

WORDS = "alpha beta gamma delta of the and in stone river cloud idle amber vivid Zürich ñandú".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, token string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def texts(seed=1, n=60):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    out = [None, "", "   \n\t ", "one", "one", "two words", base, base, "x" * 5000, "\n\n\n", "A B C D E F G H", "a b c d e f g h i"]
    for i in range(12):  # near copies of one text
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"edit{i}"
        out.append(" ".join(words))
    for _ in range(8):
        out.append(sentence(rng, rng.randrange(5, 60)) + "\n" + passage + "\n" + sentence(rng, rng.randrange(5, 60)))
    while len(out) < n:
        out.append("\n".join(sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6))))
    return out


def rows(found):
    """Documents with columns whose names clash with those that operators use inside."""
    return [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 7, "y") for i, t in enumerate(found)]


def documents(spark, found):
    return spark.createDataFrame(rows(found), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
