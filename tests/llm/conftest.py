import random

import pytest

WORDS = ["".join(p) for p in __import__("itertools").product("bdfgk", "aeiou", "lmnr", "aeo")]


@pytest.fixture(scope="session")
def words():
    return WORDS


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with everything that goes wrong: nulls, empties, copies, near copies, long texts, clashing columns."""
    rng = random.Random(5)

    def text(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    base = [text(rng.randint(30, 90)) for _ in range(12)]
    shared = text(14)
    rows = []
    for k in range(90):
        t = base[k % 12] if k % 3 == 0 else text(rng.randint(5, 120))
        if k % 5 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "Zzz"
            t = " ".join(w)
        if k % 4 == 0:
            t += f"\n  {shared.upper() if k % 8 else shared}  \n" + text(9)
        rows.append((k, t))
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "solo"), (204, "Solo"), (205, "a" * 400), (206, "b" + "a" * 300), (207, text(3000)), (208, "ä é 漢字🙂 <|x|> \\ \x0b y"), (None, base[0]), (None, None)]
    out = [(i, t, "en", "s", 1, f"doc{i}", 3.0) for i, t in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, doc string, score double"), rows
