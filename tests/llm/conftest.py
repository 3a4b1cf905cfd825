import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """DataFrame ``doc_id, text`` of a list of pairs, over several partitions."""
    def make(rows, schema=DOCS, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Writes tables as Parquet folders and returns their directory."""
    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make


WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "te", "su") for b in ("lan", "vor", "nix", "dap") for c in ("a", "is", "or", "en")]


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < 0.7 else r.choice(("the", "of", "and", "to")) for _ in range(n)) + "."


#: Nulls, empty and blank texts, ties and repeated rows, and a long text.
def odd_rows():
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(1, 60)), (4, prose(1, 60)), (5, prose(1, 60)), (6, "x" * 30_000),
            (7, prose(2, 5000)), (8, "é😀 ñ　日本"), (None, "some text here now"), (9, "<|endoftext|> a<|endoftext|>")]
