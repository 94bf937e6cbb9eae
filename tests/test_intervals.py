import random

from hypothesis import given, settings
from hypothesis import strategies as st
import pandas as pd
import pytest

from pagewright.operators import intervals as iv


def brute(rows):
    """Periods, gaps and doubly claimed runs of (entity, owner, start, end) page by page."""
    out = set()
    for e in {r[0] for r in rows}:
        pages = {}
        for _, o, a, b in (r for r in rows if r[0] == e and r[2] is not None and r[3] is not None and r[3] >= r[2]):
            for p in range(a, b + 1):
                pages.setdefault(p, set()).update({o} if o is not None else set())
        for kind, hit in (("period", set(pages)), ("overlap", {p for p, o in pages.items() if len(o) > 1})):
            runs = [(p, next(q for q in range(p, 10**6) if q + 1 not in hit)) for p in sorted(hit) if p - 1 not in hit]
            out |= {(e, kind, *r) for r in runs}
            if kind == "period":
                out |= {(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:], strict=False)}
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "e string, o string, s int, t int")
    lab = iv.swept(df, ["e"], "o", "s", "t")
    out = {(r[0], "period", r[1], r[2]) for r in iv.periods(lab, ["e"], "last_page").collect()}
    out |= {(r[0], "gap", r[1], r[2]) for r in iv.gaps(lab, ["e"], "first_page").collect()}
    return out | {(r[0], "overlap", r[1], r[2]) for r in iv.claimed_twice(lab, ["e"], "o").collect()}


def test_islands_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.choice(["u", "v", "w", None]), a, a + rng.randint(-1, 6)) for a in (rng.randint(0, 300) for _ in range(120))]
    rows += [("a", "u", None, 3), ("b", "v", 4, None), rows[0], rows[0]]
    assert found(spark, rows) == brute(rows)


@pytest.fixture
def cut(spark):
    """Without adaptive coalescing the range sort has four partitions even for few rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_entity_over_all_partitions(spark, cut):
    rng = random.Random(5)
    rows = [("a", "u", i, i + 1) for i in range(0, 200, 2)]
    assert iv.islands(spark.createDataFrame(rows, "e string, o string, s int, t int"), ["e"], "s", "t").rdd.getNumPartitions() == 4
    assert found(spark, rows) == {("a", "period", 0, 199)}
    rows = [("a", rng.choice(["u", "v", None]), a, a + rng.randint(0, 40)) for a in (rng.randint(0, 900) for _ in range(80))]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(0, 6)), min_size=1, max_size=40), st.integers(1, 5))
def test_scan_is_the_same_in_any_cut(rows, cuts):
    rows = sorted((e, s, s + n) for e, s, n in rows)
    pdf = pd.DataFrame(rows, columns=["_entity", "_s", "_e"]).assign(_own=[s % 3 > 0 for _, s, _ in rows])
    whole, end = iv.scan(pdf, None, 1)
    state, parts = None, []
    for k in range(0, len(pdf), max(1, len(pdf) // cuts)):
        out, state = iv.scan(pdf.iloc[k: k + max(1, len(pdf) // cuts)].reset_index(drop=True), state, 1)
        parts.append(out)
    again = pd.concat(parts, ignore_index=True)
    assert state == end and again["island_start"].tolist() == whole["island_start"].tolist()
    for c in ("prev_end", "prev_owned"):
        assert again[c].fillna(-1).tolist() == whole[c].fillna(-1).tolist()
