"""Registered queries of the general problems, each with its SQL."""

from __future__ import annotations

from pagewright.operators import intervals, references

_GUID = "nullif(lower(regexp_replace({}, '^[\\s{{}}]+|[\\s{{}}]+$', '', 'g')), '')"


def g(col: str) -> str:
    return _GUID.format(col)


_REFS = f"""
kb AS (SELECT {g('id')} AS kid, {g('klasoradi')} AS folder, kayit_zamani AS came, coalesce(silinme_zamani, TIMESTAMP '9999-12-31') AS gone FROM kitap),
raw AS (
  SELECT 'publisher_oge' AS ref_table, id AS ref_id, {g('id')} AS i, {g('kitapid')} AS kid, sayfano, kayit_zamani AS t FROM publisher_oge WHERE id IS NOT NULL
  UNION ALL SELECT 'kitapunite', id, {g('id')}, {g('kitapid')}, NULL, guncelleme_zamani FROM kitapunite WHERE id IS NOT NULL),
refs AS (SELECT v.ref_table, v.ref_id, v.kid, v.sayfano, f.t FROM
  (SELECT ref_table, i, kid, sayfano, min(ref_id) AS ref_id FROM raw GROUP BY ref_table, i, kid, sayfano) v
  JOIN (SELECT ref_table, i, min(t) AS t FROM raw GROUP BY ref_table, i) f USING (ref_table, i)),
bk AS (SELECT *, t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kb WHERE kb.kid = refs.kid AND kb.came <= refs.t AND kb.gone > refs.t) AS orphan FROM refs WHERE kid IS NOT NULL),
tg AS (SELECT DISTINCT kb.kid, s.printed_page, s.loaded_at AS came, coalesce(s.deleted_at, TIMESTAMP '9999-12-31') AS gone
  FROM sheets s JOIN (SELECT DISTINCT kid, folder FROM kb) kb ON kb.folder = {g('s.book_id')} WHERE s.printed_page IS NOT NULL),
pg AS (SELECT *, t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.kid = bk.kid AND tg.printed_page = bk.sayfano AND tg.came <= bk.t AND tg.gone > bk.t) AS lost
  FROM bk WHERE NOT orphan AND sayfano <> 0),
judged AS (SELECT DISTINCT ref_table, ref_id, 'kitapid' AS ref_field, t, orphan FROM bk
  UNION ALL SELECT ref_table, ref_id, 'sayfano', t, bool_or(lost) FROM pg GROUP BY ref_table, ref_id, t)
"""

_UNITS = f"""
numbered AS (SELECT *, row_number() OVER () AS rid FROM kitapunite),
ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce({g('id')}, rid::VARCHAR)
    ORDER BY guncelleme_zamani DESC NULLS LAST, kitapid DESC NULLS LAST, uniteid DESC NULLS LAST, baslangicsayfasi DESC NULLS LAST, bitissayfasi DESC NULLS LAST) AS rn FROM numbered),
u AS (SELECT {g('kitapid')} AS kitapid, {g('uniteid')} AS uniteid, baslangicsayfasi AS s, bitissayfasi AS e FROM ranked
  WHERE rn = 1 AND kitapid IS NOT NULL AND bitissayfasi >= baslangicsayfasi),
pages AS (SELECT kitapid, uniteid, unnest(range(s, e + 1)) AS p FROM u),
cov AS (SELECT kitapid, p, count(DISTINCT uniteid) AS n FROM pages GROUP BY kitapid, p),
per AS (SELECT kitapid, min(p) AS f, max(p) AS l FROM (SELECT kitapid, p, p - row_number() OVER (PARTITION BY kitapid ORDER BY p) AS k FROM cov) GROUP BY kitapid, k),
ovl AS (SELECT kitapid, min(p) AS f, max(p) AS l FROM (SELECT kitapid, p, p - row_number() OVER (PARTITION BY kitapid ORDER BY p) AS k FROM cov WHERE n >= 2) GROUP BY kitapid, k),
gap AS (SELECT * FROM (SELECT kitapid, l + 1 AS f, lead(f) OVER (PARTITION BY kitapid ORDER BY f) - 1 AS l FROM per) WHERE l IS NOT NULL)
"""

QUERIES = {
    "p2_found": references.p2_found,
    "p2_counts": references.p2_counts,
    "p3_found": intervals.p3_found,
}

ORACLES = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id, ref_field FROM judged WHERE orphan",
    "p2_counts": f"WITH {_REFS} SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS period, count(*) AS n_refs, count(*) FILTER (WHERE orphan) AS n_orphans FROM judged GROUP BY ALL",
    "p3_found": f"""WITH {_UNITS} SELECT kitapid, 'period' AS kind, f::INTEGER AS first_page, l::INTEGER AS last_page FROM per
UNION ALL SELECT kitapid, 'gap', f::INTEGER, l::INTEGER FROM gap UNION ALL SELECT kitapid, 'overlap', f::INTEGER, l::INTEGER FROM ovl""",
}
