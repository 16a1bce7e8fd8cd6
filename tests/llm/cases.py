"""Small documents with every awkward case, and brute-force helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, blanks, a very long text, repeated rows, a null id."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    base = prose(rng, 200)
    words = base.split()
    near = words.copy()
    near[70] = "changed"
    rows = [(i, prose(rng, 120) + " " + (passage if i % 3 == 0 else "") + " " + prose(rng, 40), "en", "s0", 0) for i in range(12)]
    rows += [(20, base, "en", "s0", 0), (21, base, "en", "s1", 0), (22, " ".join(near), "de", None, 0)]
    rows += [(30, None, None, None, None), (31, "", "en", "s", 0), (32, " \n\t ", "en", "s", 0), (33, "é", "fr", "s", 1), (34, "?!", "fr", "s", 2)]
    rows += [(40, "a " * 300, "en", "s", 0), (41, "a b " * 200, "en", "s", 0), (42, "x" * 30_000, "en", "s", 0), (43, prose(rng, 6000), "en", "s", 0)]
    rows += [(50, prose(rng, 100), "en", "s", 0)] * 2 + [(None, prose(rng, 100), "en", "s", 0)]
    return rows
