"""Matching entities across sources without keys by loopy belief propagation with one-to-one factors.

Candidate pairs agree on at least one noisy attribute within a book and page; a pair's evidence is the sum of its
attributes' weights. Each pair is a binary variable, and each entity of either side a factor that lets at most one of
its pairs be true. Messages are exchanged by joins until no marginal moves; the marginals are the confidences.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.keys import guid
from pagewright.llm.confusables import consistent_text
from pagewright.operators.skew import HOT_ROWS, salted_join
from pagewright.session import release, table, written

#: What two records can show, per attribute, and its log-likelihood ratio (see the README for estimated ones, which find fewer).
WEIGHTS = {
    "base": {"all": 0.5},
    "page": {"same": 0.0, "title_only": -0.5, "number_only": -3.0, "next": -6.0},
    "label": {"same": 3.0, "unknown": 0.0},
    "name": {"same": 3.5, "other": -5.0, "unknown": 0.0},
    "place": {"close": 5.0, "far": -2.5, "unknown": 0.0},
    "says": {"nothing": -4.0, "something": 0.0},
}
#: An icon stands left of its region's left edge and near its top, in percent of the sheet.
LEFT, DOWN = (-1.0, 6.0), (-3.0, 4.0)
BIN = 8.0
_L = "([a-zçğıöşü]|[0-9]{1,3})"
# The habits in which titles name page, label and name (groups in that order, 0 where absent).
HABITS = (
    (rf"^([0-9]+)\.? ?sayfa {_L}\.? ?(?:soru|şıkkı)$", 1, 2, 0),
    (rf"^(?:sayfa|s) ?\.? ?([0-9]+) ?[_:\- ] ?{_L}(?:(?: ?[_\-:] ?| )(.*))?$", 1, 2, 3),
    (rf"^(.*\S) ?\(([0-9]+) ?[/\\] ?{_L}\)$", 2, 3, 1),
    (rf"^{_L} ?\(([0-9]+)\)$", 2, 1, 0),
    (rf"^([0-9]+) ?- ?{_L}\) ?(.*)$", 1, 2, 3),
    (rf"^([0-9]+) ?[/\\] ?{_L}(?:[ .\-]*ed[0-9]?)*$", 1, 2, 0),
    (rf"^(.*\S) ([0-9]+)\.{_L}$", 2, 3, 1),
)


def fold(col: str) -> Column:
    """Lower case by Turkish rules, blanks single."""
    return F.trim(F.regexp_replace(F.lower(F.translate(col, "İI", "iı")), r"\s+", " "))


def name_key(c: Column) -> Column:
    plain = F.trim(F.translate(F.regexp_replace(c, " (etkinliği|çalışması)$", ""), "ı", "i"))
    return F.when(plain != "", plain)


def label_key(c: Column) -> Column:
    plain = F.regexp_replace(c, r"^[\s(]+|[\s).:\-]+$", "")
    return F.when(plain != "", plain)


def parsed(f: Column) -> Column:
    """(page, label, name) of a folded title, each null where the title does not say it."""
    def part(habit: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(f, habit, group), F.lit("")) if group else F.lit(None).cast("string")

    out = None
    for habit, page, label, name in HABITS:
        made = F.struct(part(habit, page).cast("int").alias("page"), part(habit, label).alias("label"), name_key(part(habit, name)).alias("name"))
        out = F.when(f.rlike(habit), made) if out is None else out.when(f.rlike(habit), made)
    return out.otherwise(F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("label"), name_key(f).alias("name")))


def entries(spark, sf_dir: str) -> DataFrame:
    """One row an entry: (e: its id, book, page, title_page, label, name, x, y); positions in percent, null where unknown.

    An entry whose book is unknown has no counterpart and is left out; positions below 1 are parts of one.
    """
    raw = table(spark, sf_dir, "publisher_oge").where("id is not null and kitapid is not null").select(
        guid("id").alias("_i"), F.col("id").alias("oge_id"), guid("kitapid").alias("kid"), "sayfano", "title", "posx", "posy")
    once = raw.groupBy(F.xxhash64("_i"), "_i").agg(F.max(F.struct("kid", "sayfano", "title", "posx", "posy", "oge_id")).alias("r")).select("r.*")
    books = table(spark, sf_dir, "kitap").select(guid("id").alias("kid"), guid("klasoradi").alias("book")).where("kid is not null and book is not null").distinct()
    own = consistent_text(salted_join(once, books, ["kid"], keys_from=raw.select("kid")), "title", "title")
    px, py = F.nanvl("posx", F.lit(None).cast("double")), F.nanvl("posy", F.lit(None).cast("double"))
    part = (px < 1) & (py < 1)
    known = px.isNotNull() & py.isNotNull() & ~((px == 0) & (py == 0))
    own = own.withColumn("f", fold("title")).withColumn("t", parsed(F.col("f")))  # folded once, not in each habit
    return own.select(
        F.col("oge_id").alias("e"), "book", F.when(F.col("sayfano") != 0, F.col("sayfano")).alias("page"), F.col("t.page").alias("title_page"), F.col("t.label").alias("label"), F.col("t.name").alias("name"),
        F.when(known, F.when(part, px * 100).otherwise(px)).alias("x"), F.when(known, F.when(part, py * 100).otherwise(py)).alias("y"))


def regions(spark, sf_dir: str) -> DataFrame:
    """One row a region of kind 'activity': (r, book, page, label, head, left, top), page printed, edges in percent.

    A sheet without printed page gets it by the book's most frequent offset (smallest on a tie).
    """
    raw = table(spark, sf_dir, "activity").where("kind = 'activity' and activity_key is not null").select(
        F.col("activity_key").alias("r"), guid("book_id").alias("book"), F.col("page").alias("sheet"), "label", "headline", "rect")
    once = raw.groupBy(F.xxhash64("r"), "r").agg(F.max(F.struct("book", "sheet", "label", "headline", "rect")).alias("v")).select("r", "v.*")
    sheets = table(spark, sf_dir, "sheets").groupBy(guid("book_id").alias("book"), F.col("page").alias("sheet")).agg(
        F.min("printed_page").alias("printed"), F.max("width").alias("width"), F.max("height").alias("height"))
    votes = sheets.where("printed is not null").groupBy("book", (F.col("sheet") - F.col("printed")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    offsets = votes.groupBy("book").agg(F.max(F.struct("n", -F.abs("offset"), "offset")).alias("v")).select("book", "v.offset")
    placed = salted_join(once.where("book is not null").join(sheets, ["book", "sheet"], "left"), offsets, ["book"], "left", keys_from=raw.select("book"))
    placed = consistent_text(consistent_text(placed, "label", "label"), "headline", "headline")
    return placed.select(
        "r", "book", F.coalesce("printed", F.col("sheet") - F.col("offset")).alias("page"), label_key(fold("label")).alias("label"), name_key(fold("headline")).alias("head"),
        (100 * F.col("rect.x0") / F.col("width")).alias("left"), (100 * (1 - F.col("rect.y1") / F.col("height"))).alias("top"))


def classes(rows: DataFrame, key: str) -> DataFrame:
    """Rows that only their ``key`` tells apart as one row: ``key`` is their least, n their number.

    Such rows send and get the same messages, so pairs are formed between classes; copies are never paired one by one. Two
    copies have a half of one match each at most, so a pair over a half always is one of single records.
    """
    said = [c for c in rows.columns if c != key]
    # strings are aggregated by sorting, which is quick on a number
    return rows.groupBy(F.xxhash64(*said).alias("_h"), *said).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n")).drop("_h")


def _shared(rows: DataFrame, name: str, as_name: str, flag: str) -> DataFrame:
    """Texts of ``name`` that stand on more than one row, as (as_name, flag true)."""
    uses = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum("n").alias("uses")).where("uses > 1")
    return uses.select(F.col(name).alias(as_name), F.lit(True).alias(flag))


#: Kinds of blocks: what the two records agree on, the first that holds.
LABEL, NAME, PLACE, REST = range(4)


def candidates(e: DataFrame, r: DataFrame) -> DataFrame:
    """(e, r, n_e, n_r, pattern...) of pairs of classes that agree on a page and on label, name or place, or that nothing else tells apart.

    Blocks are equi-joined on 128 bits of (book, page, attribute), hot ones salted. A pair comes from the first block that both sides are in, so it
    comes once. Labels that differ exclude a pair. The pattern is what the two records show per attribute (the values of ``WEIGHTS``).
    """
    names, heads = _shared(e, "name", "head", "is_name"), _shared(r, "head", "name", "is_head")
    e = salted_join(e, heads, ["name"], "left", rows=e.count())
    r = salted_join(r.where("page is not null"), names, ["head"], "left", rows=r.count())
    none, told = F.lit(None).cast("struct<at:int,shows:string>"), F.col("title_page").isNotNull()

    def at(page, shows) -> Column:
        return F.when(page.isNotNull(), F.struct(page.cast("int").alias("at"), (F.lit(shows) if isinstance(shows, str) else shows).alias("shows"))).otherwise(none)

    page, title = F.col("page"), F.col("title_page")
    ways = F.array(at(page, F.when(~told | (title == page), "same").otherwise("number_only")), F.when(~title.eqNullSafe(page), at(title, "title_only")),
                   F.when(~told, at(page - 1, "next")), F.when(~told, at(page + 1, "next")))
    own = e.withColumn("p", F.explode(F.array_compact(ways))).select("*", "p.at", F.col("p.shows").alias("page_shows"), (F.col("p.shows") != "next").alias("near"))

    def key(kind: int, value: Column) -> Column:
        parts = [F.col("book"), F.col("at"), F.lit(kind), value]
        return F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"), F.lit(kind).alias("kind"))

    ybin, tbin = F.floor(F.col("y") / BIN), F.floor(F.col("top") / BIN)
    keys_e = F.array(
        F.when(F.col("near") & F.col("label").isNotNull(), key(LABEL, F.col("label"))), F.when(F.col("name").isNotNull(), key(NAME, F.col("name"))),
        *[F.when(F.col("near") & F.col("y").isNotNull(), key(PLACE, ybin + k)) for k in (-1, 0, 1)], F.when(F.col("near") & F.col("y").isNull(), key(REST, F.lit(0))))
    says = F.when(F.col("label").isNull() & F.col("is_head").isNull(), "nothing").otherwise("something")
    ek = own.select("e", F.col("n").alias("n_e"), F.explode(F.array_compact(keys_e)).alias("k"), F.col("page_shows").alias("page"), says.alias("says"), "near", "label", "name", "x", "y").select("*", "k.*").drop("k")
    keys_r = F.array(F.when(F.col("label").isNotNull(), key(LABEL, F.col("label"))), F.when(F.col("head").isNotNull(), key(NAME, F.col("head"))), F.when(F.col("top").isNotNull(), key(PLACE, tbin)), key(REST, F.lit(0)))
    side = r.withColumnRenamed("page", "at").select("r", F.col("n").alias("n_r"), F.explode(F.array_compact(keys_r)).alias("k"), F.col("label").alias("r_label"), "head", "is_name", "left", "top").select("*", "k.k1", "k.k2").drop("k")
    # a block holds at most the rows of its page, so without a crowded page no block is hot
    crowded = not own.groupBy("book", "at").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT_ROWS).isEmpty()
    pairs = salted_join(written(ek), side, ["k1", "k2"]) if crowded else ek.join(side, ["k1", "k2"])
    same_label, same_name = F.coalesce(F.col("label") == F.col("r_label"), F.lit(False)), F.coalesce(F.col("name") == F.col("head"), F.lit(False))
    by_label = same_label & F.col("near")
    first = F.when(by_label, LABEL).when(same_name, NAME).otherwise(F.col("kind"))
    pairs = pairs.where((F.col("kind") == first) & (F.col("label").isNull() | F.col("r_label").isNull() | same_label))
    dx, dy = F.col("left") - F.col("x"), F.col("y") - F.col("top")
    shown = {
        "label": F.when(same_label, "same").otherwise("unknown"),
        "name": F.when(same_name, "same").when(F.col("name").isNotNull() & F.col("is_name"), "other").otherwise("unknown"),
        "place": F.when(F.col("x").isNull() | F.col("left").isNull() | F.col("top").isNull(), "unknown").when(dx.between(*LEFT) & dy.between(*DOWN), "close").otherwise("far"),
    }
    return pairs.select("e", "r", "n_e", "n_r", "page", "says", *[c.alias(k) for k, c in shown.items()])


def weighed(pairs: DataFrame, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """``pairs`` with ``evidence``: the sum of the weights of what each attribute shows."""
    out = F.lit(weights["base"]["all"])
    for k, by in weights.items():
        if k != "base":
            out = out + F.element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), F.col(k))
    return pairs.withColumn("evidence", out)


def marginals(pairs: DataFrame, tolerance: float = 1e-3, most: int | None = None) -> DataFrame:
    """(e, r, n_e, n_r, confidence) of (e, r, evidence): marginals when each e and each r is in at most one true pair.

    A row stands for the pairs of ``n_e`` like entries with ``n_r`` like regions (1 where absent). A factor tells each of its pairs how
    likely it leaves it alone, given what the other side's factors said; an iteration is one aggregation and one join for
    each side, on rows that lie by that side. It ends when no marginal moves by more than ``tolerance``;
    with ``most``, a run that takes more iterations fails.
    """
    n_e, n_r = (F.col(c) if c in pairs.columns else F.lit(1) for c in ("n_e", "n_r"))
    now = written(pairs.select("e", "r", n_e.cast("double").alias("n_e"), n_r.cast("double").alias("n_r"), F.exp("evidence").alias("rho"), F.lit(1.0).alias("beta"), F.lit(0.0).alias("confidence")))
    for done in itertools.count(1):
        lie = now.repartition("e")
        by_e = lie.groupBy("e").agg(F.sum(F.col("n_r") * F.col("rho") * F.col("beta")).alias("s"))
        half = lie.join(by_e, "e").withColumn("alpha", 1 / (1 + F.greatest(F.col("s") - F.col("rho") * F.col("beta"), F.lit(0.0)))).drop("s").repartition("r")
        by_r = half.groupBy("r").agg(F.sum(F.col("n_e") * F.col("rho") * F.col("alpha")).alias("s"))
        full = half.join(by_r, "r").withColumn("beta", 1 / (1 + F.greatest(F.col("s") - F.col("rho") * F.col("alpha"), F.lit(0.0)))).drop("s")
        odds = F.col("rho") * F.col("alpha") * F.col("beta")
        before, now = now, written(full.select("e", "r", "n_e", "n_r", "rho", "beta", (odds / (1 + odds)).alias("confidence"), F.col("confidence").alias("was")))
        release(before)
        moved = now.agg(F.max(F.abs(F.col("confidence") - F.col("was")))).first()[0]
        if (moved or 0.0) <= tolerance:
            break
        if done == most:
            raise RuntimeError(f"marginals still move by {moved} after {most} iterations")
    return now.select("e", "r", F.col("n_e").cast("long").alias("n_e"), F.col("n_r").cast("long").alias("n_r"), "confidence")


def one_to_one(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs over ``least`` that are the best of both their sides; ties go to the smaller names."""
    best = F.row_number().over(W.partitionBy("e").orderBy(F.desc("confidence"), "r"))
    mate = F.row_number().over(W.partitionBy("r").orderBy(F.desc("confidence"), "e"))
    single = rows.where("n_e = 1 and n_r = 1") if "n_e" in rows.columns else rows
    return single.where(F.col("confidence") > least).withColumn("i", best).where("i = 1").withColumn("j", mate).where("j = 1").drop("i", "j")


def p1_matches(spark, sf_dir: str) -> DataFrame:
    """(oge_id, activity_key, confidence): one row a matched pair."""
    e, r = written(_numbered(classes(entries(spark, sf_dir), "e"), "e")), written(_numbered(classes(regions(spark, sf_dir), "r"), "r"))
    found = written(one_to_one(marginals(weighed(candidates(e.drop("e").withColumnRenamed("e_no", "e"), r.drop("r").withColumnRenamed("r_no", "r"))))))
    found = found.select(F.col("e").alias("e_no"), F.col("r").alias("r_no"), "confidence").join(e.select("e_no", F.col("e").alias("oge_id")), "e_no")
    return found.join(r.select("r_no", F.col("r").alias("activity_key")), "r_no").select("oge_id", "activity_key", "confidence")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with a number for their key, which the messages carry in its place; the table that is written keeps it."""
    return rows.withColumn(f"{key}_no", F.monotonically_increasing_id())


def p1_found(spark, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("oge_id", "activity_key")
