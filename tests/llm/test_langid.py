"""A rare language is learned whatever the size of the table."""
import pytest
from pyspark.sql import SparkSession

from ledgermill.llm import langid


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 12)
    rows = [(i, "the and of with that " * 5, "en") for i in range(400)] + [(1000 + i, "der und nicht auch sich " * 5, "de") for i in range(4)]
    # Rows of one id share its place; the bound still holds.
    rows += [(1, "the and of with that " * 5, "en")] * 30
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["members"] == {"germanic": ["de", "en"]}
    assert langid.predict(model, "nicht der und auch")[0] == "de"
