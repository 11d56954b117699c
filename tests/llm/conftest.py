import pytest

WORDS = [f"{a}{b}" for a in ("ra", "tol", "min", "se", "kor", "vi", "pa") for b in ("ne", "lo", "dith", "mas", "ru", "ek")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n)).capitalize()


def messy_rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies, odd white space and symbols."""
    import random

    rng = random.Random(11)
    base = [prose(rng, n) for n in (3, 4, 5, 12, 25, 60, 120, 400)]
    long = prose(rng, 6000)
    near = base[6].split(" ")
    near[60] = "zzz"
    shared = prose(rng, 45)
    texts = [*base, base[5], base[5], " ".join(near), None, "", "   \n\t ", "?!", "é É ß x \U0001F600\U0001F600 y", "a\x0bb\x1cc d",
             f"{prose(rng, 30)} {shared} {prose(rng, 9)}", f"{shared} {shared}", "\n".join([base[3], base[3], base[2], "", base[3]]), long, long + " tail", "x" * 5000, "w w w w w w w w w w w w"]
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s3")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[7], "en", "s1", 7), (None, None, None, None, None), (15, base[6], "en", "s2", 1)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(messy):
    """Columns named like those the operators add."""
    from pyspark.sql import functions as F

    names = ("n_words", "size", "row", "part", "bucket", "tag", "set_id", "before", "taken", "target", "shard", "slot", "score", "rejected", "key", "ids", "count", "start", "length")
    return messy.withColumns({n: F.lit("own") for n in names})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
