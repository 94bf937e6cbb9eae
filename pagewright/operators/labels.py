"""Quality of page labels: judgement of each page, resolution of repeated asking, training sets in the COCO layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as geo
from pagewright.operators.prefix import numbered
from pagewright.operators.sampling import hash_order, systematic

#: Thinnest box, tallest share of a sheet, and the thinnest shared part that is more than a touch (points).
THIN, TALL, TOUCH = 6.0, 0.7, 6.0
KEYS = ["book_id", "page"]


def run_ok(labels: Column) -> tuple[Column, Column]:
    """Whether an array of labels is a plausible run, and how many repeat an earlier one.

    Labels lose blanks, case and closing stops or brackets; empty ones do not count. All must be single letters or numbers of at most two
    digits; the Latin letters must follow each other in the alphabet (others are passed over), the numbers count up by one.
    """
    got = F.filter(F.transform(labels, lambda x: F.regexp_replace(F.lower(F.trim(x)), r"[.)]+$", "")), lambda x: F.coalesce(x != "", F.lit(False)))
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter(got, lambda x: x.rlike(r"^\d{1,2}$")), lambda x: x.cast("int"))))
    letters = F.array_sort(F.array_distinct(F.transform(F.filter(got, lambda x: x.rlike("^[a-z]$")), F.ascii)))
    known = F.forall(got, lambda x: x.rlike(r"^(?:[a-zğışçöü]|\d{1,2})$"))

    def follows(xs: Column) -> Column:
        return (F.size(xs) == 0) | (F.array_max(xs) - F.array_min(xs) + 1 == F.size(xs))

    return F.coalesce(known & follows(numbers) & follows(letters), F.lit(True)), F.size(got) - F.size(F.array_distinct(got))


def takeable(block: Column, rect: Column, width: Column, height: Column, along: bool) -> Column:
    """Whether a region may be asked to hold a block whole: on the sheet (two points allowed), not too tall, and with ``along`` half beside it."""
    on = (block["x0"] >= -2) & (block["y0"] >= -2) & (block["x1"] <= width + 2) & (block["y1"] <= height + 2) & (geo.height(block) <= TALL * height)
    if along:
        on = on & (F.least(rect["y1"], block["y1"]) - F.greatest(rect["y0"], block["y0"]) >= 0.5 * geo.height(block))
    return on


def single_panels(blocks: DataFrame) -> DataFrame:
    """Blocks (book_id, page, kind, ord, rect) without the panels that enclose more than one marker, shrunk by two points."""
    m = blocks.where("kind = 'marker'").select(*KEYS, F.col("rect").alias("m"))
    many = blocks.where("kind = 'panel'").join(m, KEYS).where(geo.encloses(F.col("rect"), F.col("m"), -2.0)).groupBy(*KEYS, "ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return blocks.join(many.select(*KEYS, "ord", F.lit("panel").alias("kind")), [*KEYS, "ord", "kind"], "left_anti")


def cut_counts(boxes: DataFrame, blocks: DataFrame, sheets: DataFrame, by: list[str]) -> DataFrame:
    """(by, panels_cut, solutions_cut): pairs of a box and a block of its sheet that the box takes a part of; range joins on the sheet."""
    b = single_panels(blocks).where("kind in ('panel', 'solution')").select(*KEYS, "kind", F.col("rect").alias("block"))
    p = boxes.join(sheets.select(*KEYS, "width", "height"), KEYS).join(b, KEYS)
    r, k = F.col("rect"), F.col("block")
    ok = F.when(F.col("kind") == "panel", takeable(k, r, F.col("width"), F.col("height"), True)).otherwise(takeable(k, r, F.col("width"), F.col("height"), False))
    return p.where(ok & geo.cuts(r, k)).groupBy(*by).agg(F.count_if(F.col("kind") == "panel").alias("panels_cut"), F.count_if(F.col("kind") == "solution").alias("solutions_cut"))


def judged(pages: DataFrame, boxes: DataFrame, icons: DataFrame, blocks: DataFrame, band: float = 16.0, across: float = 0.1, miss_is_defect: bool = True) -> DataFrame:
    """One verdict a page of ``pages`` (book_id, page, width, height): counters, missed icons, the label run, defects and whether it passes.

    Boxes are (book_id, page, ord, label, rect), icons (book_id, page, id, x, y) in points, blocks (book_id, page, kind, ord, rect). An icon
    is missed where no box grown by ``band`` up and down and the greater of ``band`` and ``across`` of the width sideways holds it. Slivers,
    overlaps of more than a touch and, with ``miss_is_defect``, missed icons are defects; cuts and tall boxes are only counted.
    """
    own, r = boxes.join(pages, KEYS), F.col("rect")
    shape = own.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("boxes"), F.count_if((geo.width(r) < THIN) | (geo.height(r) < THIN)).alias("sliver"), F.count_if(geo.height(r) > TALL * F.col("height")).alias("tall"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("labels"))  # one page's labels
    other = boxes.select(*KEYS, F.col("ord").alias("ord2"), r.alias("q"))
    pairs = boxes.join(other, KEYS).where((F.col("ord") < F.col("ord2")) & (geo.overlap(r, F.col("q")) > 1))
    thin = F.least(F.least(r["x1"], F.col("q.x1")) - F.greatest(r["x0"], F.col("q.x0")), F.least(r["y1"], F.col("q.y1")) - F.greatest(r["y0"], F.col("q.y0"))) < TOUCH
    over = pairs.groupBy(*KEYS).agg(F.count_if(~thin).alias("overlap_major"), F.count_if(thin).alias("overlap_minor"))
    cut = cut_counts(boxes, blocks, pages, KEYS).select(*KEYS, (F.col("panels_cut") + F.col("solutions_cut")).alias("cut"))
    side = F.greatest(F.lit(band), across * F.col("width"))
    near = icons.join(pages, KEYS).join(boxes.select(*KEYS, "rect"), KEYS).where(
        F.col("x").between(r["x0"] - side, r["x1"] + side) & F.col("y").between(r["y0"] - band, r["y1"] + band)).select(*KEYS, "id").distinct().withColumn("_held", F.lit(1))
    seen = icons.join(near, [*KEYS, "id"], "left").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("icons"), F.count_if(F.col("_held").isNull()).alias("miss"))
    out = pages.select(*KEYS).join(shape, KEYS, "left").join(over, KEYS, "left").join(cut, KEYS, "left").join(seen, KEYS, "left")
    out = out.fillna(0, ["boxes", "sliver", "tall", "overlap_major", "overlap_minor", "cut", "icons", "miss"]).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    ok, repeats = run_ok(F.col("labels"))
    defects = F.array_compact(F.array(F.when(F.col("sliver") > 0, "sliver"), F.when(F.col("overlap_major") > 0, "overlap"), F.when((F.col("miss") > 0) & F.lit(miss_is_defect), "miss")))
    return out.withColumns({"labels_ok": ok, "duplicate_labels": repeats, "defects": defects}).withColumn("passes", F.size("defects") == 0)


def resolved(primary: DataFrame, failed: DataFrame, again: DataFrame, again_failed: DataFrame) -> DataFrame:
    """(book_id, page, verdict, source, request_failed) of every page asked: four keyed inputs, of which two say whether a label ``passes``.

    A page is trusted by its first label or else by the repeated one; rejected if the repeated one fails too or could not be had; else
    to be asked again. A page of the repeated inputs alone was never asked.
    """
    every = primary.select(*KEYS).union(failed.select(*KEYS)).distinct()
    p, a = primary.select(*KEYS, F.col("passes").alias("first")), again.select(*KEYS, F.col("passes").alias("second"))
    f, g = failed.select(*KEYS).distinct().withColumn("lost", F.lit(True)), again_failed.select(*KEYS).distinct().withColumn("lost_again", F.lit(True))
    j = every.join(p, KEYS, "left").join(a, KEYS, "left").join(f, KEYS, "left").join(g, KEYS, "left")
    first, second = F.coalesce("first", F.lit(False)), F.coalesce("second", F.lit(False))
    repeated = F.col("second").isNotNull() | F.col("lost_again").isNotNull()
    return j.select(*KEYS, F.when(first | second, "trusted").when(repeated, "rejected").otherwise("re-ask").alias("verdict"),
                    F.when(~first & (second | repeated), "reask").otherwise("primary").alias("source"), (F.col("lost").isNotNull() & F.col("first").isNull()).alias("request_failed"))


def reask_list(verdicts: DataFrame) -> DataFrame:
    """(book_id, pages): what to ask again of each book, in page order, with the defects joined by commas."""
    one = F.struct("page", F.array_join("defects", ",").alias("why"))
    return verdicts.where("verdict = 're-ask'").groupBy("book_id").agg(F.sort_array(F.collect_list(one)).alias("pages"))  # a book's pages


def summary(verdicts: DataFrame) -> DataFrame:
    """Counters of verdicts per book and, with a null book_id, in total."""
    n = {v: F.count_if(F.col("verdict") == v) for v in ("trusted", "re-ask", "rejected")}
    trusted = F.col("verdict") == "trusted"
    more = {"empty": F.count_if(trusted & (F.col("boxes") == 0)), "manifest_pages": F.count_if(F.col("icons") > 0), "manifest_trusted": F.count_if(trusted & (F.col("icons") > 0)), "labels_bad": F.count_if(~F.col("labels_ok"))}
    sums = {c: F.sum(c) for c in ("boxes", "cut", "sliver", "tall", "overlap_major", "overlap_minor", "miss", "icons")}
    return verdicts.rollup("book_id").agg(F.count(F.lit(1)).alias("pages"), *[v.alias(k.replace("-", "_")) for k, v in (n | more | sums).items()])


def split_books(books: DataFrame, seed: str = "1") -> DataFrame:
    """``books`` (book_id, template, held_out, labelled) with ``split``: of each template's labelled training books one, first in hash order, validates.

    A template with a single labelled book keeps it for training; held-out books stay out. A null template is 'subject'.
    """
    free = books.where(~F.col("held_out") & F.col("labelled")).withColumn("_t", F.coalesce("template", F.lit("subject"))).withColumn("_h", hash_order("book_id", seed=seed))
    best = free.groupBy("_t").agg(F.min_by("book_id", F.struct("_h", "book_id")).alias("book_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("book_id", F.lit(True).alias("_v"))
    return books.join(best, "book_id", "left").withColumn("split", F.when(F.col("held_out"), "heldout").when(F.col("_v"), "valid").otherwise("train")).drop("_v")


def trainable(books: DataFrame, held_out: DataFrame) -> DataFrame:
    """``books`` as they are; the run fails when one of them is held out."""
    leaked = books.join(held_out.select("book_id"), "book_id", "left_semi").withColumn("_bad", F.raise_error(F.concat(F.lit("held-out book: "), F.col("book_id"))))
    leaked.foreach(lambda _: None)
    return books


def clamped(box: Column, width: Column, height: Column) -> Column:
    """A pixel box (array x0, y0, x1, y1, corners in any order) as [x, y, w, h] within the image, one decimal, halves to the even."""
    def span(a: Column, b: Column, top: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0.0), F.least(a, b)), F.least(top, F.greatest(a, b))

    (x0, x1), (y0, y1) = span(F.get(box, F.lit(0)), F.get(box, F.lit(2)), width), span(F.get(box, F.lit(1)), F.get(box, F.lit(3)), height)
    return F.array(*[F.bround(v, 1) for v in (x0, y0, x1 - x0, y1 - y0)])


def coco(labels: DataFrame, splits: DataFrame, rendered: DataFrame, least: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, dropped) of trusted labels (book_id, page, width_px, height_px, boxes: arrays of pixels).

    Ids count from 0 within a split, by book, page and box. A page is dropped where its book has no split, no page was rendered, or a box
    has ``least`` pixels or less; the reason is the first of these.
    """
    j = labels.join(splits.select("book_id", "split"), "book_id", "left").join(rendered.select(*KEYS).distinct().withColumn("_r", F.lit(True)), KEYS, "left")
    w, h = F.col("width_px").cast("double"), F.col("height_px").cast("double")
    j = j.withColumn("own", F.transform(F.coalesce("boxes", F.array().cast("array<array<double>>")), lambda b: clamped(b, w, h)))
    thin = F.exists("own", lambda b: (b[2] <= least) | (b[3] <= least))
    why = F.when(F.col("split").isNull(), "book not in the selection").when(F.col("_r").isNull(), "no rendered page").when(thin, F.lit(f"a box of {least:.0f} px or less"))
    j = j.withColumn("why", why)
    kept = numbered(j.where("why is null"), ["split"], KEYS, "_n")
    name = F.concat("book_id", F.lit("_"), F.lpad(F.col("page").cast("string"), 4, "0"), F.lit(".jpg"))
    images = kept.select("split", (F.col("_n") - 1).alias("id"), name.alias("file_name"), "width_px", "height_px", "book_id", "page", F.size("own").alias("n_boxes"))
    flat = kept.select("split", (F.col("_n") - 1).alias("image_id"), F.posexplode("own").alias("at", "bbox"))
    notes = numbered(flat, ["split"], ["image_id", "at"], "_n").select(
        "split", (F.col("_n") - 1).alias("id"), "image_id", F.lit(1).alias("category_id"), "bbox", F.bround(F.col("bbox")[2] * F.col("bbox")[3], 1).alias("area"), F.lit(0).alias("iscrowd"))
    return images, notes, j.where("why is not null").select(*KEYS, "why")


def split_stats(images: DataFrame) -> DataFrame:
    """Books, pages, boxes and empty pages of each split."""
    return images.groupBy("split").agg(F.countDistinct("book_id").alias("books"), F.count(F.lit(1)).alias("pages"), F.sum("n_boxes").alias("boxes"), F.count_if(F.col("n_boxes") == 0).alias("empty"))


def admitted(sure: DataFrame, doubtful: DataFrame, icons: DataFrame, sheets: DataFrame) -> DataFrame:
    """Doubtful boxes that an icon vouches for: of each icon at no sure box, the best one that it stands at and at whose upper half.

    Boxes are (book_id, page, ord, score, rect), icons (book_id, page, id, x, y). A box taller than a region may be is never admitted.
    """
    at = icons.join(sheets.select(*KEYS, "width", "height"), KEYS)
    free = at.join(_at(at, sure).select(*KEYS, "id").distinct(), [*KEYS, "id"], "left_anti")
    r = F.col("rect")
    near = _at(free, doubtful).where((geo.height(r) <= (TALL - 0.005) * F.col("height")) & (F.col("y") >= (r["y0"] + r["y1"]) / 2))
    best = near.groupBy(*KEYS, "id").agg(F.max_by("ord", F.struct("score", -F.col("ord"))).alias("ord")).select(*KEYS, "ord").distinct()
    return doubtful.join(best, [*KEYS, "ord"], "left_semi")


def _at(icons: DataFrame, boxes: DataFrame) -> DataFrame:
    """Icons with the boxes they are hung at: 24 points above to 6 below, 6 % of the width to either side."""
    r, side = F.col("rect"), 0.06 * F.col("width")
    return icons.join(boxes, KEYS).where(F.col("x").between(r["x0"] - side, r["x1"] + side) & F.col("y").between(r["y0"] - 6, r["y1"] + 24))


def bound(icons: DataFrame, regions: DataFrame, sheets: DataFrame) -> DataFrame:
    """(book_id, page, ord, id): each free icon picks the tightest region it stands at, each region keeps the cheapest of its rivals.

    Icons are (book_id, page, id, x, y, label), regions (book_id, page, ord, rect, label) that no link holds. Two labels that differ
    exclude a pair. The cost is the join's: the distance to the top and half of that beyond the sides, in percent. Equal areas go to the earlier
    region, equal costs to the smaller id.
    """
    own = icons.withColumnRenamed("label", "i_label").join(sheets.select(*KEYS, "width", "height"), KEYS)
    near, r = _at(own, regions), F.col("rect")
    near = near.where(~F.coalesce((F.nullif("i_label", F.lit("")) != F.nullif(F.lower(F.trim("label")), F.lit(""))), F.lit(False)))
    side = F.greatest(r["x0"] - F.col("x"), F.col("x") - r["x1"], F.lit(0.0))
    cost = 100 * F.abs(F.col("y") - r["y1"]) / F.col("height") + 50 * side / F.col("width")
    wants = near.groupBy(*KEYS, "id").agg(F.min_by(F.struct("ord", cost.alias("cost")), F.struct(geo.area(r), F.col("ord"))).alias("w"))
    return wants.groupBy(*KEYS, F.col("w.ord").alias("ord")).agg(F.min_by("id", F.struct("w.cost", "id")).alias("id"))


def band_owner(icons: DataFrame, bands: DataFrame, above: float = 24.0, below: float = 6.0, across: float = 24.0) -> DataFrame:
    """(book_id, page, id, owner): the activity in whose band an icon falls, the tightest band, the first of equals.

    Bands are (book_id, page, ord, owner, x0, x1, bottom, top); an icon outside all of them gives no row.
    """
    near = icons.join(bands, KEYS).where(F.col("y").between(F.col("bottom") - below, F.col("top") + above) & F.col("x").between(F.col("x0") - across, F.col("x1") + across))
    size = F.greatest(F.lit(1.0), (F.col("top") - F.col("bottom")) * (F.col("x1") - F.col("x0")))
    return near.groupBy(*KEYS, "id").agg(F.min_by("owner", F.struct(size, F.col("ord"))).alias("owner"))



def subset(images: DataFrame, annotations: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Every k-th image by id, at most ``n`` of one split, and their annotations."""
    few = systematic(images, "id", n)
    return few, annotations.join(few.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def split_faults(splits: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, fault) of a stored split (book_id, split, template) against the catalogue (book_id, template): unknown or missing books, several splits, another template."""
    s, b = splits.groupBy("book_id").agg(F.countDistinct("split").alias("_n"), F.max("template").alias("_was")), books.select("book_id", F.col("template").alias("_now"), F.lit(True).alias("_b")).distinct()
    j = s.join(b, "book_id", "full")
    faults = F.array_compact(F.array(F.when(F.col("_b").isNull(), "unknown book"), F.when(F.col("_n").isNull(), "without split"), F.when(F.col("_n") > 1, "in several splits"), F.when(F.col("_was") != F.col("_now"), "template changed")))
    return j.select("book_id", F.explode(faults).alias("fault"))


def visible(stroke: Column, fill: Column) -> Column:
    """Whether a drawing can be seen: it is stroked, or filled with anything but white; colours are arrays of 0..1, null where there is none."""
    return stroke.isNotNull() | F.coalesce((F.size(fill) > 0) & ~F.forall(fill, lambda v: v >= 0.999), F.lit(False))


def is_aside(rotated: Column, size: Column, body: Column) -> Column:
    """Whether a line stands beside the text: turned, or in print under nine tenths of the body."""
    return F.coalesce(rotated, F.lit(False)) | F.coalesce(size < 0.9 * body, F.lit(False))
