import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, region long, size long, spans string"


@pytest.fixture()
def make_docs(spark):
    """Documents with extra columns whose names clash with those that operators make."""

    def make(texts, langs=None, sources=None):
        rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s0"), len(t or ""), 0.5, 1, 2, "x") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture()
def odd_texts():
    """Null, empty, blank, short, long and repeated texts."""
    prose = " ".join(f"word{k}" for k in range(40))
    return [None, "", " \n\t ", "one", "two words", prose, prose, prose + " end", prose.upper(), "é ü 漢字 \U0001f600 text with marks", " ".join(f"w{k % 977}" for k in range(60_000))]
