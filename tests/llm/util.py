"""Fixtures shared by the operator tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n bigint, rep bigint, sig string"


def documents(spark, rows):
    """Documents from (doc_id, text[, lang]), with further columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", len(r[1] or ""), None, -1, -2, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary):x}" for _ in range(n)]


def edited(words, seed, edits):
    rng, out = random.Random(seed), list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


class Union:
    def __init__(self, nodes):
        self.parent = {i: i for i in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
