"""Documents and tables written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.functions import text as tx


def upsert(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``, in ``order``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(*order)


def library_manifest(books: DataFrame, new: DataFrame) -> DataFrame:
    """(count, books) of a library's manifest: ``new`` books put in by id, all in order of grade and folded title. A library is one document."""
    own = books.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    one = F.struct(F.coalesce("grade", F.lit(0)).alias("grade"), tx.fold(F.col("title")).alias("_t"), "id", F.struct(*own.columns).alias("book"))
    return own.agg(F.count(F.lit(1)).alias("count"), F.transform(F.sort_array(F.collect_list(one)), lambda x: x["book"]).alias("books"))


def _flat(r: Column, digits: int) -> Column:
    return F.array(*[F.bround(r[c], digits) for c in ("x0", "y0", "x1", "y1")])


def disjoint(parts: DataFrame) -> DataFrame:
    """``parts`` (book_id, page, ord, rect) as they are; the write fails where two of a sheet share more than one square point."""
    o = parts.select("book_id", "page", F.col("ord").alias("_o"), F.col("rect").alias("_q"))
    over = parts.join(o, ["book_id", "page"]).where((F.col("ord") < F.col("_o")) & (geo.overlap(F.col("rect"), F.col("_q")) > 1))
    bad = over.select(F.raise_error(F.concat_ws(" ", F.lit("regions overlap:"), "book_id", F.col("page").cast("string"), F.col("ord").cast("string"), F.col("_o").cast("string"))))
    bad.foreach(lambda _: None)
    return parts


def region_documents(regions: DataFrame, version: int = 2) -> DataFrame:
    """(book_id, json): one document a book; ``pages`` maps sheet numbers, in order, to their regions; absent fields and sheets are left out.

    The format puts a whole book into one document, which bounds a row.
    """
    optional = [c for c in ("label", "kind", "headline", "anchored", "ogeId", "items") if c in regions.columns]
    one = F.struct("ord", "id", _flat(F.col("rect"), 4).alias("rect"), *optional)
    page = regions.groupBy("book_id", "page").agg(F.transform(F.sort_array(F.collect_list(one)), lambda a: a.dropFields("ord")).alias("activities"))
    book = page.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page", "activities"))).alias("_p"))
    pages = F.map_from_entries(F.transform("_p", lambda p: F.struct(p["page"].cast("string").alias("key"), F.struct(p["activities"].alias("activities")).alias("value"))))
    return book.select("book_id", F.to_json(F.struct(F.lit(version).alias("version"), F.col("book_id").alias("bookId"), pages.alias("pages")), {"ignoreNullFields": "true"}).alias("json"))


def diagnostics_documents(blocks: DataFrame, sheets: DataFrame, prints: DataFrame) -> DataFrame:
    """(book_id, json): sizes of each sheet (three decimals) and its panels, solutions and markers (four), with the book's fingerprint."""
    per = blocks.groupBy("book_id", "page").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "rect")))), lambda b: _flat(b["rect"], 4)).alias(f"{k}s") for k in ("panel", "solution", "marker")])
    j = sheets.join(per, ["book_id", "page"], "left")
    none = F.array().cast("array<array<double>>")
    value = F.struct(F.bround("width", 3).alias("pageWidth"), F.bround("height", 3).alias("pageHeight"), *[F.coalesce(c, none).alias(c) for c in ("panels", "solutions", "markers")])
    book = j.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("page", value.alias("v")))).alias("_p")).join(prints, "book_id", "left")
    pages = F.map_from_entries(F.transform("_p", lambda p: F.struct(p["page"].cast("string").alias("key"), p["v"].alias("value"))))
    return book.select("book_id", F.to_json(F.struct(F.lit(1).alias("version"), F.col("book_id").alias("bookId"), "fingerprint", pages.alias("pages"))).alias("json"))


def trace_documents(drops: DataFrame) -> DataFrame:
    """(book_id, json) with the drops' histogram by stage and rule, most frequent first, ties by name."""
    n = drops.groupBy("book_id", "stage", "rule").agg(F.count(F.lit(1)).alias("n"))
    hist = n.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "stage", "rule", "n"))).alias("h"))
    return hist.select("book_id", F.to_json(F.struct("book_id", F.transform("h", lambda x: F.struct(x["stage"].alias("stage"), x["rule"].alias("rule"), x["n"].alias("n"))).alias("histogram"))).alias("json"))


def stroke_documents(strokes: DataFrame) -> DataFrame:
    """(book, json): one compact document a book, strokes by time and id, points with one decimal."""
    one = F.struct("created_ms", "id", "page", "kind", "width", F.transform("points", lambda x: F.bround(x, 1)).alias("points"))
    d = strokes.groupBy("book").agg(F.sort_array(F.collect_list(one)).alias("strokes"))
    return d.select("book", F.to_json(F.struct("book", "strokes")).alias("json"))


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Gzip JSON, partitioned by ``by``; the committer makes the files appear at once."""
    w = df.write.mode("overwrite").option("compression", "gzip")
    (w.partitionBy(*by) if by else w).json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """The ``json`` column of documents, one a line, gzip; the folder is replaced when all are written."""
    docs.select(F.col("json").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows as further JSON lines of a log; each write adds its own files, so writers do not wait for each other."""
    rows.write.mode("append").json(path)


def write_coco(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """A training set's tables, partitioned by split."""
    images.write.mode("overwrite").partitionBy("split").json(f"{path}/images")
    annotations.write.mode("overwrite").partitionBy("split").json(f"{path}/annotations")


def scorecard(rows: DataFrame, limits: dict[str, tuple[float, bool]]) -> tuple[str, bool]:
    """(Markdown, accepted) of one row of measures: a line a measure with its limit and mark; what was not measured does not pass."""
    r = rows.limit(1).collect()
    got = r[0].asDict() if r else {}
    lines, accepted = ["| measure | value | limit | |", "|---|---|---|---|"], True
    for name, (limit, at_most) in limits.items():
        v = got.get(name)
        mark = "NOT MEASURED" if v is None else "PASS" if (v <= limit if at_most else v >= limit) else "FAIL"
        accepted = accepted and mark == "PASS"
        lines.append(f"| {name} | {'-' if v is None else f'{v:.3g}'} | {'≤' if at_most else '≥'} {limit:g} | {mark} |")
    return "\n".join(lines), accepted
