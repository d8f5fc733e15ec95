from __future__ import annotations


def word(r):
    return "".join(r.choice(("the", "re", "on", "ti", "an", "er", "ou", "sh")) for _ in range(r.randint(1, 3)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
