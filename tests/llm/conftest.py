import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, fp string, shard string, hash string, score string"


def words(seed, n, pool=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}x{seed % 7}" for _ in range(n))


def awkward_texts():
    """Nulls, empties, blanks, ties, copies in other cases, a long text, odd letters, repeated lines."""
    base = words(1, 120)
    line = "The same long line of at least forty characters, again."
    out = [None, "", " \t\n", "Ä ö ß É", base, base.upper(), base + " tail", words(2, 30000), "one", "one two three", "a\n\n" + line + "\nb"]
    out += [f"{words(i, 60)}\n  {line.upper() if i % 2 else line} \t\n{words(i + 50, 20)}" for i in range(10, 18)]
    out += [base.replace("w", "v", 1), base.replace("w", "u", 2), "x" * 50_000, "​ ﬁ ſ K İ", line, line + "\n" + line]
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i * 3, t, [None, "en", "de"][i % 3], None, None, 1, "f", "s", "h", "c") for i, t in enumerate(awkward_texts())]
    rows += [(None, "no id at all", "en", *rows[0][3:]), rows[5], rows[5], (12, "another text under a known id", "en", *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
