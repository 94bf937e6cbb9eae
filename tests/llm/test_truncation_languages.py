from pagewright.llm import truncation as tr
from tests.llm.test_truncation import corpus


def test_languages_beyond_a_thousand_are_judged(spark):
    rows = [(i, text, f"x{i}", source, cut) for i, text, _, source, cut in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cut boolean")
    found = {r.doc_id for r in tr.judged(df.drop("cut")).where("truncated").collect()}
    cut = {r[0] for r in rows if r[4]}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.95
