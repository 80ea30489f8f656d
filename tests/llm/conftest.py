import pytest
from pyspark.sql import functions as F

from sparkloom.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "node", "band", "seg", "tid", "cell", "slice", "place", "piece", "row", "text_key")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""
    ship(spark)

    def build(rows, extra=True):
        rows = [(i, t, lang[0] if lang else "en", "s", len(t) if t is not None else None) for i, t, *lang in rows]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        for c in CLASH if extra else ():
            df = df.withColumn(c, F.lit("x"))
        return df

    return build


WORDS = "the a river stone walks under green light until morning comes over quiet hills and nobody speaks about what was lost there long ago".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ly", "er"]) for _ in range(n))


EDGE = [(9990, None), (9991, ""), (9992, " \t\n"), (9993, "a"), (9994, "a"), (None, "no id here at all today"), (9995, "12 34 !?"), (9996, "x" * 3000), (9997, "Ünï¢ödé 中文 \U0001f600 text"), (9998, "b\x00c d")]
