import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
from pagewright.llm import tokenizer as tk  # noqa: E402

PATH = f"{tk.TOKENIZERS}/{tk.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
if os.path.exists(PATH):
    RANKS = tk.read_ranks(PATH)
    MINE = tk.PrefixEncoder(RANKS)
    THEIRS = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab \n0.çğ-", max_size=80))
def test_ids_equal_the_public_library(text):
    assert MINE.encode(text) == THEIRS.encode_ordinary(text)


def test_appends_and_edits():
    g = tk.GrowingPiece(MINE, b"understand")
    g.append(b"ings of")
    assert g.ids == MINE.encode_piece("understandings of")
    g.replace(5, 10, b"")
    assert g.ids == MINE.encode_piece("underings of")


def test_column_with_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, "Ölçü", 7), (2, None, 7), (3, "", 7), (4, "a" * 5000, 7), (4, "a" * 5000, 7)], "doc_id long, text string, ids2 int")
    rows = tk.encoded(df).orderBy("doc_id").collect()
    assert [list(r.ids) for r in rows] == [THEIRS.encode_ordinary(x) for x in ("Ölçü", "", "", "a" * 5000, "a" * 5000)]
    assert tk.encoded(df.limit(0)).count() == 0
