"""The catalogue and what is known of each book: search, sections, enrichment, changes, recents, lookups and incremental work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators.prefix import numbered

#: Sections of the catalogue in their order: grades, then what has none.
GRADES = (9, 10, 11, 12, 0)


def filtered(books: DataFrame, tab: str | int = "all", query: str = "") -> DataFrame:
    """Books of a tab ('all', 'installed' or a grade) whose title or grade label holds the folded query; an empty query takes all."""
    own = F.lit(True) if tab == "all" else F.col("installed") if tab == "installed" else F.col("grade") == F.lit(tab)
    return books.where(F.coalesce(own, F.lit(False)) & tx.matches(F.lit(query), F.col("title"), F.col("grade_label")))


def only(rows: DataFrame, needles: list[str], columns: list[str]) -> DataFrame:
    """Rows any of whose ``columns`` holds any of the needles, without regard to case; no needles take all rows, a null holds none."""
    if not needles:
        return rows
    hit = F.lit(False)
    for n in needles:
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(n.lower())), F.lit(False))
    return rows.where(hit)


def sections(books: DataFrame) -> DataFrame:
    """(section, place, number, id) of books (id, title, grade, installed): installed ones lifted to their own section, the rest by grade.

    Sections without books are not there. Within one, books follow the folded title, then the id.
    """
    order = F.array_position(F.lit(list(GRADES)), F.coalesce("grade", F.lit(0)))
    here = F.coalesce("installed", F.lit(False))
    place = F.when(here, 0).when(order > 0, order).otherwise(len(GRADES)).cast("int")
    s = books.select(F.when(here, "installed").otherwise(F.when(order > 0, F.coalesce("grade", F.lit(0)).cast("string")).otherwise("0")).alias("section"), place.alias("place"), tx.fold(F.col("title")).alias("_t"), "id")
    return numbered(s, ["section", "place"], ["_t", "id"]).drop("_t")


def enriched(books: DataFrame, installed: DataFrame, sizes: DataFrame, bakes: DataFrame, downloads: DataFrame) -> DataFrame:
    """Books (id) with whether they are installed, their size, their labels' confidence ('none' without a bake) and a running download's state.

    Each side has one row an id or several, of which any counts (sizes: the greatest; downloads: the latest ``seq``).
    """
    i = installed.select("id").distinct().withColumn("installed", F.lit(True))
    s = sizes.groupBy("id").agg(F.max("size").alias("size"))
    b = bakes.groupBy("id").agg(F.max("confidence").alias("confidence"))
    d = downloads.groupBy("id").agg(F.max_by("state", "seq").alias("download"))
    out = books
    for side in (i, s, b, d):
        out = out.join(side, "id", "left")
    return out.withColumns({"installed": F.coalesce("installed", F.lit(False)), "confidence": F.coalesce("confidence", F.lit("none"))})


def changes(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, change): 'added', 'removed', 'changed' or 'same', by all columns that both sides have; nulls are equal."""
    common = [c for c in now.columns if c in before.columns and c != key]
    a = now.select(F.col(key), F.struct(F.lit(1).alias("_"), *common).alias("_now"))
    b = before.select(F.col(key), F.struct(F.lit(1).alias("_"), *common).alias("_before"))
    j = a.join(b, key, "full")
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now").eqNullSafe(F.col("_before")), "same").otherwise("changed")
    return j.select(key, change.alias("change"))


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in ``order``, which must be total for a defined result."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def recents(opened: DataFrame, user: str, book: str, at: str, most: int = 8) -> DataFrame:
    """Each user's last books, newest first, each once, at most ``most`` (a recents list), with ``place`` from 1."""
    last = opened.groupBy(user, book).agg(F.max(at).alias(at))
    return last.withColumn("place", F.row_number().over(W.partitionBy(user).orderBy(F.desc(at), book))).where(F.col("place") <= most)


def openable(recent: DataFrame, books: DataFrame, openable_: Column) -> DataFrame:
    """Recents (user, id, place) whose book is in the catalogue and ``openable_``; places close up, their order stays."""
    j = recent.join(books.where(openable_), "id")
    return j.withColumn("place", F.row_number().over(W.partitionBy("user").orderBy("place")))


def entries_of(manifests: DataFrame, books: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, unknown): manifest entries of the asked books, and asked ids that no book has. A known book without manifest has no entries."""
    known = ids.join(books.select("id"), "id", "left_semi")
    return manifests.join(known, manifests["book_id"] == known["id"], "left_semi"), ids.join(books.select("id"), "id", "left_anti")


def by_id(entries: DataFrame) -> DataFrame:
    """One row an id of entries (id, ord, ...): of equal ids the last counts."""
    return first_of_each(entries, ["id"], [F.desc("ord")])


def pages_with_activities(regions: DataFrame) -> DataFrame:
    """(book_id, page) with regions, pages as numbers in order, whatever their keys' type."""
    return regions.select("book_id", F.col("page").cast("int").alias("page")).distinct().orderBy("book_id", "page")


def summaries(regions: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """The side bar's list of (book_id, page, ord, id, label, headline): activities only, numbered on their page, with their entry and items.

    ``links`` (id, entry) may name several entries of a region, of which the smallest counts; ``items`` (id, part_index) are counted.
    """
    own = regions.where("kind = 'activity'")
    e = links.groupBy("id").agg(F.min("entry").alias("entry"))
    n = items.groupBy("id").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("part_index").alias("n_parts"))
    j = own.join(e, "id", "left").join(n, "id", "left").fillna(0, ["n_items", "n_parts"])
    at = F.row_number().over(W.partitionBy("book_id", "page").orderBy("ord", "id"))
    return j.select("book_id", "page", at.alias("number"), "id", shown_name(F.col("label"), F.col("headline"), at).alias("name"), F.col("entry").isNotNull().alias("interactive"), "entry", "n_items", "n_parts")


def shown_name(label: Column, headline: Column, number: Column) -> Column:
    """What a region is called: its label, else its headline, else its number on the page."""
    plain = F.regexp_replace(F.trim(label), r"[.):]+$", "")
    return F.coalesce(F.when(plain != "", plain), F.when(F.trim(headline) != "", clip(headline)), F.concat(F.lit("#"), number.cast("string")))


def clip(c: Column, most: int = 140) -> Column:
    """Text with single blanks, cut at ``most`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def resolved_path(kinds: list[tuple[str, DataFrame]], ids: DataFrame) -> DataFrame:
    """(id, kind, path): the first of the listings (name, (id, path)) that has the book, null where none has."""
    out, found = ids, []
    for k, (name, listing) in enumerate(kinds):
        out = out.join(listing.groupBy("id").agg(F.min("path").alias(f"_p{k}")), "id", "left")
        found.append((name, F.col(f"_p{k}")))
    kind = F.lit(None).cast("string")
    for name, p in reversed(found):
        kind = F.when(p.isNotNull(), name).otherwise(kind)
    return out.select("id", kind.alias("kind"), F.coalesce(*[p for _, p in found]).alias("path"))


def needs_work(wanted: DataFrame, done: DataFrame, same: list[str]) -> DataFrame:
    """Ids of ``wanted`` that no finished run covers: one with equal values of all ``same`` columns (fingerprint, profile, engine, ...; nulls are equal)."""
    cond = wanted["id"] == done["id"]
    for c in same:
        cond = cond & wanted[c].eqNullSafe(done[c])
    return wanted.join(done, cond, "left_anti")


def same_edition(pages: DataFrame, bake: DataFrame) -> DataFrame:
    """Books of (book_id, page_count) that a region document fits: as many pages, and no page's size off by more than one point.

    ``pages`` and ``bake`` have (book_id, page, width, height, page_count).
    """
    j = pages.join(bake.select("book_id", "page", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("page_count").alias("_n")), ["book_id", "page"])
    fits = (F.col("page_count") == F.col("_n")) & (F.abs(F.col("width") - F.col("_w")) <= 1) & (F.abs(F.col("height") - F.col("_h")) <= 1)
    return j.groupBy("book_id").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits"))


def status_pushed(books: DataFrame, statuses: DataFrame) -> DataFrame:
    """Books with the pushed download states: an id that the push lacks is cleared."""
    return books.drop("download").join(statuses.groupBy("id").agg(F.max("state").alias("download")), "id", "left")
