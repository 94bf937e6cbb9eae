"""References to records that do not exist, judged at the time of the referring row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.keys import guid, month
from pagewright.operators.skew import salted_join
from pagewright.session import reliable, table


def presence(parents: DataFrame, keys: list[str], came: str, gone: str) -> DataFrame:
    """Distinct (keys, _came, _gone) of a parent table; a parent with a null key or arrival never is there."""
    there = parents.where(" and ".join(f"`{k}` is not null" for k in [*keys, came]))
    forever = F.lit("9999-12-31").cast("timestamp_ntz")
    end = F.coalesce(F.col(gone).cast("timestamp_ntz"), forever)
    return there.groupBy(*keys, F.col(came).cast("timestamp_ntz").alias("_came")).agg(F.max(end).alias("_gone"))


def orphans(refs: DataFrame, there: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Distinct (keys, at) of ``refs`` for which no row of ``there`` (from ``presence``) holds at ``at``.

    Only distinct non-null foreign keys are shuffled, once, to a left anti-join against the parents;
    a null key or a null time is no reference. Hot keys are salted. An empty parent table makes every
    reference an orphan; an empty ``refs`` gives no row.
    """
    wanted = refs.where(" and ".join(f"`{k}` is not null" for k in [*keys, at])).select(*keys, at).distinct()
    return salted_join(wanted, there, keys, "left_anti", lambda a, b: (b("_came") <= a(at)) & (b("_gone") > a(at)), spread=[at])


def orphan_rows(refs: DataFrame, there: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows of ``refs`` with a column ``orphan`` (one of that name is replaced): the anti-join's keys joined back; null references are dropped.

    A reference without a time cannot be judged: it stays, as none.
    """
    refs = refs.drop("orphan")
    lost = orphans(refs, there, keys, at).withColumn("orphan", F.lit(True))
    kept = refs.where(" and ".join(f"`{k}` is not null" for k in keys))
    return kept.join(lost, [*keys, at], "left").withColumn("orphan", F.coalesce("orphan", F.lit(False)))


def counts_by_period(rows: DataFrame, at: str) -> DataFrame:
    """References and orphans per referring table, field and month of the referring row; those without a time have a null month."""
    return rows.groupBy("ref_table", "ref_field", month(at).alias("period")).agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_if("orphan").alias("n_orphans"))


def textbook_references(spark, sf_dir: str) -> DataFrame:
    """Every judged reference (ref_table, ref_id, ref_field, at, orphan) of publisher_oge and kitapunite.

    An id delivered several times is judged at its earliest time; a reference that its versions share
    is one. Rows without an id cannot be named and are left out. sayfano is judged only where kitapid is
    a reference that is no case; sayfano null or 0 is none.
    """
    kitap = table(spark, sf_dir, "kitap").select(guid("id").alias("kid"), guid("klasoradi").alias("folder"), "kayit_zamani", "silinme_zamani")

    def refs(name: str, time: str, page) -> DataFrame:
        rows = table(spark, sf_dir, name).where("id is not null").select(
            F.col("id").alias("ref_id"), guid("id").alias("_i"), guid("kitapid").alias("kid"), page.alias("sayfano"), F.col(time).cast("timestamp_ntz").alias("at"))
        versions = rows.groupBy("_i", "kid", "sayfano").agg(F.min("at").alias("at"), F.min("ref_id").alias("ref_id"))
        first = rows.groupBy("_i").agg(F.min("at").alias("at"))
        return versions.drop("at").join(first, "_i").select(F.lit(name).alias("ref_table"), "ref_id", "kid", "sayfano", "at")

    both = refs("publisher_oge", "kayit_zamani", F.col("sayfano")).unionByName(
        refs("kitapunite", "guncelleme_zamani", F.lit(None).cast("int")))
    books = reliable(orphan_rows(reliable(both), presence(kitap, ["kid"], "kayit_zamani", "silinme_zamani"), ["kid"], "at"))
    by_book = books.select("ref_table", "ref_id", F.lit("kitapid").alias("ref_field"), "at", "orphan").distinct()
    folders = kitap.where("kid is not null and folder is not null").select("kid", "folder").distinct()
    sheets = table(spark, sf_dir, "sheets").where("printed_page is not null").select(
        guid("book_id").alias("folder"), F.col("printed_page").alias("sayfano"), "loaded_at", "deleted_at")
    targets = presence(salted_join(sheets, folders, ["folder"]), ["kid", "sayfano"], "loaded_at", "deleted_at")
    pages = orphan_rows(books.where("not orphan and sayfano <> 0").drop("orphan"), targets, ["kid", "sayfano"], "at")
    by_page = pages.groupBy("ref_table", "ref_id", F.lit("sayfano").alias("ref_field"), "at").agg(F.bool_or("orphan").alias("orphan"))
    return by_book.unionByName(by_page)


def p2_found(spark, sf_dir: str) -> DataFrame:
    return textbook_references(spark, sf_dir).where("orphan").select("ref_table", "ref_id", "ref_field").distinct()


def p2_counts(spark, sf_dir: str) -> DataFrame:
    return counts_by_period(textbook_references(spark, sf_dir), "at")
