"""Small tables with the odd cases: nulls in any column, empty and long texts, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, row string, count int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    """n words by a linear congruence."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def rows(texts: list, first: int = 0) -> list[tuple]:
    return [(first + i, t, "en" if i % 3 else None, None, None, i, "k", "r", None) for i, t in enumerate(texts)]


def frame(spark, texts: list, first: int = 0):
    return spark.createDataFrame(rows(texts, first), SCHEMA)


def odd(spark):
    """Null, empty, white and very long texts, a row that is there twice, null ids."""
    long = sentence(5, 30_000)
    made = rows([None, "", " \t\n ", "one", sentence(1, 40), sentence(1, 40), long, long + " more"])
    return spark.createDataFrame([*made, made[4], made[0], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
