"""Registered queries of the training-data problems, with SQL where SQL can express them."""

from __future__ import annotations

from pagewright.llm import confusables, entity, mixing, splits, tokenizer, truncation

_CODE = "nullif(nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), ''), '-')"
_GUID = "nullif(lower(regexp_replace({}, '^[\\s{{}}]+|[\\s{{}}]+$', '', 'g')), '')"

QUERIES = {
    "p1_found": entity.p1_found,
    "p1_matches": entity.p1_matches,
    "p4_found": splits.p4_found,
    "p4_splits": splits.p4_splits,
    "p4_shares": splits.p4_shares,
    "p5_found": confusables.p5_found,
    "p5_forms": confusables.p5_forms,
    "p6_ids": tokenizer.p6_ids,
    "p6_sizes": tokenizer.p6_sizes,
    "p7_mix": mixing.p7_mix,
    "p7_shares": mixing.p7_shares,
    "p8_found": truncation.p8_found,
    "p8_rates": truncation.p8_rates,
}

ORACLES = {
    "p4_found": f"""WITH RECURSIVE
b AS (SELECT DISTINCT {_GUID.format('book_id')} AS book, {_CODE.format('author_code')} AS a, {_CODE.format('series_code')} AS s,
  nullif(lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')), '') AS split FROM book_score WHERE book_id IS NOT NULL),
link AS (SELECT DISTINCT x.book AS u, y.book AS v FROM b x JOIN b y ON x.a = y.a UNION SELECT DISTINCT x.book, y.book FROM b x JOIN b y ON x.s = y.s UNION SELECT DISTINCT book, book FROM b),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT r.u AS book_id FROM reach r JOIN b ON b.book = r.v GROUP BY r.u HAVING count(DISTINCT b.split) > 1""",
}
