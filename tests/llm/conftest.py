import random

import pytest

SYLLABLES = "ka lo mi ren ta sol ver du pin gra el os ith bar ne".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with nulls, copies, near copies, shared passages, ties, odd columns."""
    rng = random.Random(5)
    passage, long_passage = prose(rng, 50), prose(rng, 90)
    rows, i = [], 0

    def add(text, lang="xx", source="s", name=None):
        nonlocal i
        rows.append((i if name is None else name, text, lang, source, 1, "k"))
        i += 1

    for _ in range(12):
        add(prose(rng, rng.randint(1, 120)), source=rng.choice(["a", "b", None]))
    base = prose(rng, 150).split()
    for _ in range(10):  # near copies around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        add(" ".join(copy))
    for _ in range(5):  # shared passages at different places
        add(prose(rng, 30) + " " + passage + "\n" + prose(rng, 20) + " " + long_passage)
    add(passage + " " + passage)
    add("la " * 90)
    add("la " * 90, name=3)  # another row of the same id
    add(None)
    add("")
    add(" \t\n ")
    add("one two")
    add("ONE two")
    add("é\x0b§ … 漢字 " + prose(rng, 45))
    add("### $$$ 123")
    add(prose(rng, 4000))  # long
    add(None, lang=None, source=None)
    rows.append((None, prose(rng, 60), None, None, 1, "k"))
    rows.append((None, passage, "xx", "s", 1, "k"))
    rows.append(rows[2])
    rows.append(rows[2])
    schema = "doc_id bigint, text string, lang string, source string, k1 int, row string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
