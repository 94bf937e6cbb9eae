from pagewright.plans import sequences
from tests.small import saved


def test_runs_of_letters_and_of_written_digits(spark, tmp_path):
    labels = {"letters": ["a", "B)"], "half": ["c", "ç"], "stops": ["3.", "4."], "mixed": ["a", "2"], "gap": ["a", "c"], "bare": [None], "same": ["a", "a)"]}
    d = saved(spark, tmp_path, [(f"{b}{i}", b, 1, x, 0, 10 * i, 9, 10 * i + 5) for b, xs in labels.items() for i, x in enumerate(xs)])
    got = {r.book_id: (r.has_run, r.n_labels) for r in sequences.confidence_runs(spark, d).collect()}
    assert got == {"letters": (True, 2), "half": (True, 2), "stops": (True, 2), "mixed": (False, 2), "gap": (False, 2), "bare": (False, 0), "same": (False, 1)}
