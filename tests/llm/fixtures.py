"""Small tables with every awkward case, for all operators on documents."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `range` int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int, lines: int = 1) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n)]
    step = max(1, n // lines)
    return "\n".join(" ".join(words[k : k + step]) for k in range(0, n, step))


def texts() -> list[tuple]:
    base = prose(1, 300, 6)
    near = base.split(" ")
    near[100] = "changed"
    rows = [
        (7, base), (3, base), (3, base), (12, " ".join(near)), (None, prose(2, 80)), (None, None), (20, None), (21, ""), (22, " \n\t"),
        (23, "one"), (24, "one two"), (25, "ÄÖ ß — 日本語 𝔘nicode\x00 tail\r\nnext line"), (26, prose(3, 9000, 40)), (27, "spam " * 400),
        (28, prose(4, 200, 4) + "\n" + "\n".join(base.split("\n")[1:4])), (-5, prose(5, 60, 3)), (40, "A!\nA!\nb\n\nA!\n\n"),
    ]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s0", None, "x", 1) for i, t in rows], SCHEMA)
