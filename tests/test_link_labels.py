import pytest

from pagewright.plans import joins
from tests.small import saved


@pytest.mark.parametrize("query", ["region_entry_links", "region_entry_links_native"])
def test_links_read_every_form_of_label(spark, tmp_path, query):
    regions = [("n2", "b", 12, "2.", 0, 10, 90, 15), ("n3", "b", 12, "3", 0, 18, 90, 23), ("s1", "b", 13, " Ş)", 0, 10, 90, 15), ("s2", "b", 13, "c", 0, 18, 90, 23)]
    # The icon of 12/3 stands in the region of 2, that of 13\Ş 9 % below its own region's top.
    entries = [("e3", 12, "12 / 3 ed2", 5, 11), ("es", 13, "13\\Ş", 5, 19)]
    d = saved(spark, tmp_path, regions, entries, (12, 13))
    assert {(r.entry_ord, r.region_ord) for r in joins.QUERIES[query](spark, d).collect()} == {("e3", "n3"), ("es", "s1")}
