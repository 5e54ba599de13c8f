"""Names shared by the corpus tests."""
from collections import Counter

SF_MID = "/root/testdata/sf0.01"


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(str(r[i]) for i in order) for r in rows)
