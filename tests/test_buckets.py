from pagewright.plans import aggregates
from tests.small import saved


def test_buckets_follow_the_links_and_the_gates(spark, tmp_path):
    regions = [("a", "b", 1, "a", 0, 10, 90, 20), ("tall", "b", 2, "a", 0, 10, 90, 90), ("m", "b", 3, "a", 0, 10, 90, 20), ("d", "b", 4, None, 0, 10, 90, 20), ("w", "b", 5, None, 0, 10, 40, 20)]
    entries = [("ok", 1, "1/a", 1, 11), ("second", 1, "1/a", 1, 12), ("faulty", 2, "2/a", 1, 11), ("other", 3, "3/b", 1, 11), ("far", 4, "", 1, 60), ("beside", 5, "", 90, 11), ("lost", 5, "", None, None),
               ("zero", 4, "", 0, 0), ("blank", 6, "", 1, 1), ("nowhere", 99, "", 1, 1)]
    d = saved(spark, tmp_path, regions, entries, range(1, 7))
    got = {r.bucket: r.n for r in aggregates.bucket_histogram(spark, d).collect()}
    named = ("ok", "contested", "rule-violation", "label-mismatch", "drift", "wrong-side", "no-position", "anchor-excluded", "page-blank", "unresolved-page")
    assert got == dict.fromkeys(named, 1) | dict.fromkeys(("anchor-nogrow", "confidence-gated", "page-not-read"), 0)
