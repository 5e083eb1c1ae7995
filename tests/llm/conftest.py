import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, m string, component long, removed int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def build(pairs):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2) for i, t in pairs], SCHEMA)

    return build


def words(seed, n, pool=5000):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Originals, near and exact copies, shared passages, nulls, empty and white texts, one very long text, odd spaces."""
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words(i, 60 + 7 * i))))
    base = words(99, 200)
    rows.append((30, " ".join(base)))
    for k in range(12):  # altered copies of 30
        changed = list(base)
        for j in range(k):
            changed[(17 * k + 31 * j) % 200] = f"x{k}.{j}"
        rows.append((40 + k, " ".join(changed)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, rows[3][1].upper()), (63, rows[30][1])]
    passage = " ".join(words(7, 60))
    rows += [(70 + k, " ".join(words(200 + k, 30)) + "\n" + passage + "\n" + " ".join(words(300 + k, 5 * k + 1))) for k in range(12)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, ""), (94, "one"), (95, "one two three"), (96, "one two three"), (97, "Ünï çödé naïve  double\tspaces\r\nend ")]
    rows.append((98, " ".join(words(5, 6000))))
    rows.append((99, "same line here again\n" * 40 + passage))
    return rows
