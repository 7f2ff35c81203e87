import pandas as pd
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys string, component string"


@pytest.fixture
def docs(spark):
    """A function from {doc_id: text} or [(doc_id, text)] to documents; with columns whose names operators use within."""

    def make(texts, lang="en", source="s"):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        return spark.createDataFrame([(i, t, lang, source, None, "k", "c") for i, t in pairs], SCHEMA)

    return make


@pytest.fixture
def sf():
    from pathlib import Path

    folder = Path("/root/testdata/sf0.001")
    if not folder.is_dir():
        pytest.skip("no test tables")
    return str(folder)


@pytest.fixture
def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def rows(df, *by) -> list[tuple]:
    return [tuple(r) for r in df.toPandas().sort_values(list(by)).astype(object).where(pd.notna, None).itertuples(index=False)] if by else [tuple(r) for r in df.collect()]
