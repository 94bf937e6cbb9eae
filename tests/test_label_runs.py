import itertools
import random

from pagewright.operators import sequence
from pagewright.plans import sequences
from tests.small import saved


def brute(name, v):
    """(score, n) of the best of all subsequences that rise or restart at 1, of equal ones the first to end; a lone letter is none unless it is 1."""
    best = (0.0, 0, 0)
    for k in range(1, len(v) + 1):
        for c in itertools.combinations(range(len(v)), k):
            steps = [(v[i], v[j]) for i, j in itertools.pairwise(c)]
            if all(b > a or b == 1 for a, b in steps):
                best = max(best, (round(k - sum(0.01 * max(b - a - 1, 0) for a, b in steps if b > a), 6), -c[-1], k))
    return (0.0, 0) if name == "letter" and best[0] < 2 and (not v or v[-best[1]] != 1) else (best[0], best[2])


def test_label_runs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice(["digit", "letter"]), float(rng.choice([1, 1, 2, 3, 3.5, 4, 6]))) for g in range(12) for i in range(9)]
    rows += [(20, 0, "letter", 4.0), (20, 1, None, None), (21, 0, "digit", 4.0), (22, 0, None, None)]
    got = {r.k: (round(r.score, 6), r.n, r.n_kept) for r in sequence.longest_label_run(spark.createDataFrame(rows, "k int, o int, kind string, v double"), ["k"], "o", "kind", "v").collect()}
    assert got[20] == (0, 0, 0) and got[21] == (1, 1, 1) and got[22] == (0, 0, 0)
    for g in range(12):
        kinds = [brute(name, [v for k, _, kind, v in rows if k == g and kind == name]) for name in ("digit", "letter")]
        assert got[g][0] == max(kinds)[0] and got[g][2] == sum(n for _, n in kinds)


def test_number_labels_make_runs(spark, tmp_path):
    d = saved(spark, tmp_path, [(f"r{i}", "b", 1, x, 0, 10 * i, 9, 10 * i + 5) for i, x in enumerate(["1", "a", "2.", "3)", "1", "b)"])])
    assert [(r.n, r.n_kept) for r in sequences.dp_longest_run(spark, d).collect()] == [(4, 6)]
