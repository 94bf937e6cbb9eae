from pagewright.plans import sequences
from tests.small import saved


def test_all_titles_are_counted_with_their_label(spark, tmp_path):
    titles = ["7 / 2", "7/D-ed2", "7\\24", "7\\c", "7/ş", "6_5.soru", "7b", "7/a", "Okuma", None]
    d = saved(spark, tmp_path, entries=[(str(i), 7, t, 1, 1) for i, t in enumerate(titles)])
    got = {r.label: r.n for r in sequences.entry_labels(spark, d).collect()}
    assert got == {"2": 1, "d": 1, "24": 1, "c": 1, "ş": 1, "5": 1, "b": 1, "a": 1, None: 2}
