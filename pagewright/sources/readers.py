"""Readers of catalogue files, manifests, region documents, labels and logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
MANIFEST = ("id string, baslik string, dersbaslik string, klasoradi string, sayfasayisi int, aktif boolean, status int, "
            "kitapuniteList array<struct<id:string,kitapid:string,uniteid:string,baslangicsayfasi:int,bitissayfasi:int,sira:int,ilksayfabos:boolean>>, "
            "kitapogeList array<struct<id:string,kitapid:string,uniteid:string,ogeturu:int,sayfano:int,baslik:string,data:string,posx:double,posy:double,width:double,height:double,sayfaustuoge:boolean,ogekategori:int>>")
REGIONS = ("version int, bookId string, fingerprint string, profile string, pageCount int, folio struct<offset:int,byPage:map<string,int>>, "
           "pages map<string,struct<pageWidth:double,pageHeight:double,activities:array<struct<id:string,label:string,`column`:int,rect:array<double>,parts:array<array<double>>,kind:string,headline:string,anchored:boolean,ogeId:string,"
           "items:array<struct<id:string,label:string,number:int,partIndex:int,rect:array<double>,text:string>>>>>>")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(index, id, title, url, grade) of a catalogue text file; blank lines are dropped before numbering, broken ones keep their number.

    A catalogue is one short file, read whole to keep its order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    rows = lines.select(F.posexplode("l").alias("i", "line"))
    uuid = F.lower(F.regexp_extract("line", r"(?i)/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})/", 1))
    n = F.col("i") + 1
    grade = F.when(n.between(1, 10), 9).when(n.between(11, 20), 10).when(n.between(21, 31), 11).when(n.between(32, 45), 12).otherwise(0)
    return rows.where(uuid != "").select(n.alias("index"), uuid.alias("id"), F.trim(F.regexp_extract("line", r"^(.*?):\s*https?://", 1)).alias("title"), F.regexp_extract("line", r"(https?://\S+)", 1).alias("url"), grade.alias("grade"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a publisher manifest, with the file's name as ``file_id``."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("file_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of manifests in their order, typed; missing positions and page numbers are 0."""
    m = manifests(spark, path).select("file_id", F.posexplode("kitapogeList").alias("ord", "e"))
    return m.select("file_id", "ord", "e.id", "e.ogeturu", F.coalesce("e.sayfano", F.lit(0)).alias("sayfano"), F.col("e.baslik").alias("title"), "e.data",
                    F.coalesce("e.posx", F.lit(0.0)).alias("posx"), F.coalesce("e.posy", F.lit(0.0)).alias("posy"), "e.sayfaustuoge")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of region documents of version 1 or 2; kind and column have defaults, page keys become numbers."""
    b = spark.read.schema(REGIONS).option("multiLine", True).json(path).where("version in (1, 2)")
    p = b.select("bookId", F.explode("pages").alias("page", "p")).select("bookId", F.col("page").cast("int").alias("page"), "p.pageWidth", "p.pageHeight", F.posexplode("p.activities").alias("ord", "a"))

    def rect(c):
        return F.struct(*[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])

    return p.select(F.col("bookId").alias("book_id"), "page", "ord", "a.id", "a.label", F.coalesce(F.col("a.column"), F.lit(0)).alias("column"), rect(F.col("a.rect")).alias("rect"),
                    F.transform("a.parts", rect).alias("parts"), F.coalesce("a.kind", F.lit("activity")).alias("kind"), "a.headline", F.coalesce("a.anchored", F.lit(False)).alias("anchored"), F.col("a.ogeId").alias("oge_id"), "a.items",
                    F.col("pageWidth").alias("page_width"), F.col("pageHeight").alias("page_height"))


def trusted_labels(verdicts: DataFrame) -> DataFrame:
    """Of (file_ord, line_ord, book, page, verdict, hint_count) the first trusted, unhinted line of each page; the filter comes before first-wins."""
    ok = verdicts.where("verdict = 'trusted' and coalesce(hint_count, 0) = 0")
    first = W.partitionBy("book", "page").orderBy("file_ord", "line_ord")
    return ok.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def coco_pages(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row a page with its boxes [x0, y0, x1, y1]; pages without annotation survive with none."""
    b = F.col("bbox")
    boxes = annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]).alias("box")))).alias("g"))
    return images.join(boxes, images["id"] == boxes["image_id"], "left").select(images["id"], "book", "page", F.transform(F.coalesce("g", F.array().cast("array<struct<id:int,box:array<double>>>")), lambda x: x["box"]).alias("boxes"))


def best_epoch(spark: SparkSession, path: str) -> DataFrame:
    """The first epoch of greatest score of a metrics CSV, the averaged column preferred; empty cells are skipped."""
    t = spark.read.csv(path, header=True)
    ema = F.nullif("ema_map", F.lit("")) if "ema_map" in t.columns else F.lit(None).cast("string")
    t = t.select(F.col("epoch").cast("int").alias("epoch"), F.coalesce(ema, F.nullif("map", F.lit(""))).cast("double").alias("score")).where("score is not null")
    return t.orderBy(F.desc("score"), "epoch").limit(1)


def catalogue_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, grade_text, subject, page_count) of an index document whose ``books`` maps ids to records; an unreadable or absent one is an empty table."""
    schema = "books map<string,struct<title:string,grade:string,subject:string,pageCount:int>>"
    fields = "id string, title string, grade_text string, subject string, page_count int"
    if not _exists(spark, path):
        return spark.createDataFrame([], fields)
    b = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return b.select(F.explode("books").alias("id", "r")).select(F.lower("id").alias("id"), "r.title", F.col("r.grade").alias("grade_text"), "r.subject", F.col("r.pageCount").alias("page_count"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def catalogue_books(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Catalogue lines (of ``catalogue``) with what the index knows: its title and grade go before the line's own; a grade is the first number of its text."""
    i = index.select("id", F.col("title").alias("_t"), F.nullif(F.regexp_extract("grade_text", r"(\d+)", 1), F.lit("")).cast("int").alias("_g"), "subject", "page_count")
    return lines.join(i, "id", "left").withColumns({"title": F.coalesce("_t", "title"), "grade": F.coalesce("_g", "grade")}).drop("_t", "_g")


def library_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, title, grade, grade_label, subject, page_count, interactive_count, url) of a packaged library's array of books, defaults put in; records without an id go."""
    record = "struct<id:string,title:string,grade:int,gradeLabel:string,subject:string,pageCount:int,interactiveCount:int,url:string>"
    b = spark.read.schema(f"books array<{record}>").option("multiLine", True).json(path).select(F.posexplode("books").alias("ord", "r")).where("r.id is not null")
    text = {c: F.coalesce(F.col(f"r.{c}"), F.lit("")) for c in ("title", "gradeLabel", "subject", "url")}
    return b.select("ord", "r.id", text["title"].alias("title"), F.coalesce("r.grade", F.lit(0)).alias("grade"), text["gradeLabel"].alias("grade_label"), text["subject"].alias("subject"),
                    F.coalesce("r.pageCount", F.lit(0)).alias("page_count"), F.coalesce("r.interactiveCount", F.lit(0)).alias("interactive_count"), text["url"].alias("url"))


def region_items(regions: DataFrame) -> DataFrame:
    """One row an item of ``regions``: its region's place, its own fields and box; a part index that is absent is 0."""
    i = regions.select("book_id", "page", "ord", F.posexplode("items").alias("item_ord", "i"))
    r = F.col("i.rect")
    return i.select("book_id", "page", "ord", "item_ord", "i.id", "i.label", "i.number", F.coalesce("i.partIndex", F.lit(0)).alias("part_index"),
                    F.struct(*[F.get(r, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).alias("rect"), "i.text")


DIAGNOSTICS = ("version int, bookId string, fingerprint string, pages map<string,struct<pageWidth:double,pageHeight:double,contentTop:double,contentBottom:double,"
               "panels:array<array<double>>,solutions:array<array<double>>,markers:array<array<double>>>>")


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, fingerprint, page, kind, ord, rect) of plain or gzip diagnostics documents: panels, solutions and markers of each sheet."""
    d = spark.read.schema(DIAGNOSTICS).option("multiLine", True).json(path)
    p = d.select(F.col("bookId").alias("book_id"), "fingerprint", F.explode("pages").alias("page", "p"))
    def of(kind: str):
        return F.transform(F.coalesce(F.col(f"p.{kind}s"), F.array().cast("array<array<double>>")), lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), r.alias("r")))

    kinds = F.flatten(F.array(of("panel"), of("solution"), of("marker")))
    b = p.select("book_id", "fingerprint", F.col("page").cast("int").alias("page"), F.explode(kinds).alias("b"))
    r = F.col("b.r")
    return b.select("book_id", "fingerprint", "page", "b.kind", F.format_string("%s%d", F.col("b.kind"), F.col("b.ord")).alias("ord"), F.struct(*[F.get(r, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).alias("rect"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, stage, rule, n) of trace documents' histograms."""
    t = spark.read.schema("book_id string, histogram array<struct<stage:string,rule:string,n:long>>").json(path)
    return t.select("book_id", F.explode("histogram").alias("h")).select("book_id", "h.*")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, size): one row a book found below ``folder``: the GUID in a file's name, else the name; the first path of an id counts. No content is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder).select("path", F.col("length").alias("size"))
    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    own = F.regexp_extract(name, r"(?i)([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1)
    return f.select(F.when(own != "", F.lower(own)).otherwise(name).alias("id"), "path", "size").groupBy("id").agg(F.min("path").alias("path"), F.min_by("size", "path").alias("size"))


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """(at, route, key, status) of an append-only log of JSON lines; broken lines are dropped."""
    return spark.read.schema("at string, route string, key string, status int").option("mode", "DROPMALFORMED").json(path)


def requests_by_key(log: DataFrame, day: str, route: str = "api") -> DataFrame:
    """Requests of one day (the timestamp's first characters) and route per key."""
    return log.where(F.startswith("at", F.lit(day)) & (F.col("route") == route)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """(book, page, width_pt, height_pt, width_px, height_px) of the index lines of rendered pages; a page rendered again keeps its last line's sizes."""
    i = spark.read.schema("book string, page int, width_pt double, height_pt double, width_px int, height_px int").json(path)
    return i.groupBy("book", "page").agg(*[F.max(c).alias(c) for c in ("width_pt", "height_pt", "width_px", "height_px")])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(book, page, ord, px, score) of a detector's documents: pages map numbers to lists of boxes."""
    d = spark.read.schema("book string, pages map<string,array<struct<px:array<double>,score:double>>>").option("multiLine", True).json(path)
    p = d.select("book", F.explode("pages").alias("page", "boxes"))
    return p.select("book", F.col("page").cast("int").alias("page"), F.posexplode("boxes").alias("ord", "b")).select("book", "page", "ord", "b.px", "b.score")


def label_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(labels, failed) of a folder of one folder a book: files with numbers for names, and the marks that stand for a failed request.

    Labels have (book, page, boxes, path); other files and the batches' folder are passed over. A mark holds the failure's text; empty files are not seen.
    """
    path = F.col("_metadata.file_path")

    def at(kind: str):
        return F.regexp_extract("path", rf"/([^/]+)/(\d+)\.{kind}$", 1), F.regexp_extract("path", rf"/([^/]+)/(\d+)\.{kind}$", 2)

    raw = spark.read.schema("boxes array<struct<px:array<double>,label:string>>, hint string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9]*.json").json(folder)
    book, page = at("json")
    labels = raw.select("boxes", "hint", path.alias("path")).select(book.alias("book"), page.cast("int").alias("page"), "boxes", "hint", "path").where("page is not null and book <> 'batches'")
    book, page = at("failed")
    failed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9]*.failed").load(folder).select("path").select(book.alias("book"), page.cast("int").alias("page")).where("page is not null")
    return labels, failed


STROKE = "struct<id:string,page:int,kind:string,color:array<double>,width:double,points:array<double>,created_ms:bigint>"


def strokes(spark: SparkSession, path: str) -> DataFrame:
    """One row a valid stroke of ink documents (book, strokes); a bad record goes alone, a bad document gives none."""
    from pagewright.operators.ink import valid

    d = spark.read.schema(f"book string, strokes array<{STROKE}>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return valid(d.select("book", F.explode("strokes").alias("s")).select("book", "s.*"))


#: Reader settings with their defaults.
SETTINGS = {"theme": "system", "zoom": 1.0, "spread": False, "volume": 1.0}


def settings(spark: SparkSession, path: str) -> DataFrame:
    """The reader's state, absent or wrongly typed values by their defaults; an absent document is all defaults."""
    kinds = {str: "string", float: "double", bool: "boolean"}
    fields = ", ".join(f"{k} {kinds[type(v)]}" for k, v in SETTINGS.items())
    own = spark.read.schema(fields).option("multiLine", True).json(path) if _exists(spark, path) else spark.createDataFrame([], fields)
    one = spark.range(1).select(F.lit(1).alias("_one"))
    return one.join(own.withColumn("_one", F.lit(1)), "_one", "left").select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in SETTINGS.items()])


def contents_tree(rows: DataFrame) -> DataFrame:
    """(book_id, ord, level, title, page, parent) of contents lists, to which a document's pages are matched by order."""
    from pagewright.operators.sequence import toc_parents

    return toc_parents(rows.select("book_id", "ord", "level", "title", "page"), "book_id", "ord", "level")
