"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, size long, key long, class string, `__key` string"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(("", "", "s", "ly", "er")) + rnd.choice(("", "", "", "x", "y", "z")) for _ in range(n))


def texts(seed: int = 5, n: int = 40) -> list[str | None]:
    rnd = random.Random(seed)
    out: list[str | None] = [None, "", " \n\t ", "one", "One", "two  words", "A b c d e", "a B\tc d  e", "no-letters 123 456"]
    base = [prose(rnd, rnd.randint(20, 120)) for _ in range(n // 4)]
    for b in base:
        w = b.split()
        out += [b, b.replace(" ", "\n", 3), b.upper()]
        for changes in (1, 2, 5, 12):
            v = list(w)
            for _ in range(changes):
                v[rnd.randrange(len(v))] = "changed" + str(rnd.randrange(1000))
            out.append(" ".join(v))
    shared = prose(rnd, 60)
    out += [f"{prose(rnd, 40)}\n{shared}\n{prose(rnd, 40)}" for _ in range(6)]
    out.append(prose(rnd, 60_000))  # a very long one
    return out


def rows(seed: int = 5) -> list[tuple]:
    out = [(i * 3 + 1, t, ("en", "de", None)[i % 3], ("src0", "src1", "b", None, "src0")[i % 5], i, i, "c", "k") for i, t in enumerate(texts(seed))]
    out += [out[10], out[10], (None, out[12][1], "en", "src0", 0, 0, "c", "k"), (None, "alone", "en", None, 0, 0, "c", "k"), (7, "same id, other text", "en", "b", 0, 0, "c", "k")]
    return out


def docs(spark, seed: int = 5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
