"""Turkish-aware text functions and label parsers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters between the 26 come half a step after the one they derive from.
BETWEEN = {"ç": 3.5, "ğ": 7.5, "ı": 8.5, "ö": 15.5, "ş": 19.5, "ü": 21.5}


def fold(c: Column) -> Column:
    """Lower case without diacritics or dotted forms, for searching."""
    return F.lower(F.translate(c, "İIıŞşĞğÇçÖöÜüÂâÎîÛû", "iiissggccoouuaaiiuu"))


def lower_tr(c: Column) -> Column:
    """Lower case by Turkish rules."""
    return F.lower(F.translate(c, "İI", "iı"))


def matches(query: Column, *fields: Column) -> Column:
    """Whether the folded query is part of any folded field; an empty or null query matches all."""
    q = fold(F.trim(F.coalesce(query, F.lit(""))))
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(fold(f), q), F.lit(False))
    return (q == "") | hit


def letter_value(c: Column) -> Column:
    """Order of a letter: a = 1 to z = 26, Turkish letters between; null for anything else."""
    low = lower_tr(c)
    out = F.when(low.rlike("^[a-z]$"), (F.ascii(low) - 96).cast("double"))
    for k, v in BETWEEN.items():
        out = out.when(low == k, F.lit(v))
    return out


def marker_label(c: Column) -> Column:
    """(kind, value, text) of a printed marker such as 'a)', '3.', '2. Adım'; null where it is none."""
    t = F.trim(c)
    step = F.regexp_extract(t, r"(?iu)^(\d{1,2})\. ?(?:adım|step)\b", 1)
    digit = F.regexp_extract(t, r"^\(?(\d{1,3})[.)\-]?$", 1)
    letter = F.regexp_extract(t, r"(?iu)^\(?([a-zçğıöşü])[.)]$", 1)

    def made(kind: str, value: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"), text.alias("text"))

    return (F.when(step != "", made("step", step.cast("double"), step)).when(digit != "", made("digit", digit.cast("double"), digit))
            .when(letter != "", made("letter", letter_value(letter), lower_tr(letter))))


def tidy_label(c: Column) -> Column:
    """A region's label as entry labels are written: lower case, without blanks, stops, colons and brackets around it."""
    return F.regexp_replace(F.lower(c), r"^[\s.:()]+|[\s.:()]+$", "")


def label_value(c: Column) -> Column:
    """(kind, value) of a region's label, bare or written as a marker; null where it is none."""
    bare = F.regexp_replace(lower_tr(c), r"^[\s.:()]+|[\s.:()]+$", "")
    marker = marker_label(c)

    def made(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"))

    return (F.when(bare.rlike(r"^0*[1-9][0-9]{0,2}$"), made("digit", bare)).when(letter_value(bare).isNotNull(), made("letter", letter_value(bare)))
            .when(marker.isNotNull() & (marker["value"] >= 1), F.struct(marker["kind"].alias("kind"), marker["value"].alias("value"))))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def entry_label(title: Column, page: Column) -> Column:
    """The exercise label that a publisher's title carries, null where it carries none.

    In turn go the entry's own printed page at the head, the page before it, any number with a separator, and the edition
    marks ('ed' with or without a number, repeated) at the end. What is left is a label if it is 'N. soru', a single letter,
    at most two digits, or digits glued to a letter. A number before a hyphen is taken for a page ('12/3-ed2' has no label). Without a page (null, 0 or less) no page goes.
    """
    def paged(t: Column, n: Column, marks: str) -> Column:
        own = F.when(page > 0, F.concat(F.lit("^0*"), n.cast("string"), F.lit(rf"\s*[{marks}]?\s*"))).otherwise(F.lit("^"))
        return _strip(F.regexp_replace(t, own, F.lit("")))

    t = paged(paged(_strip(F.lower(title)), page, r"\-/\\.:"), page - 1, r"\-/\\.:_")
    t = _strip(F.regexp_replace(t, r"^\d{1,4}\s*[\-/:]\s*", ""))
    t = F.regexp_replace(t, r"(^|[^\p{L}\p{N}_])ed\s*\d*(?:[\s._\-]*[\s.\-]ed\s*\d*)*[\s._\-]*$", "$1")
    t = F.regexp_replace(t, r"[\s._\-]+$", "")
    t = F.regexp_replace(t, r"^(?:(\d{1,2})\s*\.?\s*soru[\s\S]*|([a-zçğıöşü]|\d{1,2})|\d{1,4}\s*[/\-.:]?\s*([a-zçğıöşü]))$", "$1$2$3")
    return F.nullif(F.regexp_extract(t, r"^([a-zçğıöşü]|\d{1,2})$", 1), F.lit(""))


# English verbs that open an instruction, and what exercises are titled.
ENGLISH_VERBS = ("read", "write", "match", "complete", "fill", "choose", "answer", "listen", "look", "circle", "underline", "tick", "number", "put", "order", "rewrite", "discuss", "talk", "work",
                 "ask", "tell", "find", "label", "draw", "colour", "color", "say", "repeat", "practise", "practice", "decide", "guess", "compare", "describe", "explain", "make", "use", "watch",
                 "study", "check", "correct", "replace", "translate", "sort", "classify")
TITLES = (r"etkinlik", "uygulama", "alıştırma", "alistirma", "çalışma\\s+kağıdı", "konuya\\s+başlarken", "hazırlık\\s+çalışmaları", "hazırlanalım", "sıra\\s+sizde", "sıra\\s+sende",
          "kendimizi\\s+değerlendirelim", "ölçme\\s+ve\\s+değerlendirme", "değerlendirme\\s+soruları", "neler\\s+öğrendik", "ne\\s+öğrendik", "araştıralım", "düşünelim", "tartışalım", "yanıtlayalım",
          "cevaplayalım", "uygulayalım", "inceleyelim", "bunları\\s+yapalım", "birlikte\\s+yapalım", "\\d{0,2}\\s*\\.?\\s*soru", "problem", "proje\\s+ödevi", "performans\\s+görevi", "activity", "exercise",
          "task", "practice", "warm[\\s-]?up", "let'?s\\s+\\w+", "your\\s+turn", "check\\s+yourself", "self[\\s-]?assessment", "study\\s+skills")
#: A question has this many characters at least; one with a mark amid it this many at most; a title this many, unless set larger.
LEAST, MOST, TITLE = 12, 140, 48
_INLINE = r"(?U)^\(?\s*([a-zçğıöşü]|\d{1,2})\s*[.)\]]\s+(?=\S)"


def inline_label(c: Column) -> Column:
    """The label that opens a paragraph's own text, such as 'a) ' or '3. '; null where there is none."""
    return F.nullif(F.regexp_extract(F.trim(c), _INLINE, 1), F.lit(""))


def reads_as_question(c: Column) -> Column:
    """Whether a paragraph asks its reader to do something; null is no question.

    It must be long enough, open on a word or number, not in lower case unless labelled, and not introduce a range of questions.
    Then it closes with a question mark, has one in a short text, a Turkish imperative or exhortation that closes a
    sentence (none before it an s, which other persons carry), or opens on an English verb.
    """
    t = F.trim(c)
    opens = t.rlike(r"^[(\[\"'«‘“]?\s*[0-9A-Za-zÇĞİÖŞÜÂÎÛçğıöşüâîû]") & ~(t.rlike("^[a-zçğıöşü]") & ~t.rlike(_INLINE)) & ~t.rlike(r"(?iu)^\s*\d+\s*[-–—]\s*\d+\.\s*sorular")
    asks = t.endswith("?") | (F.contains(t, F.lit("?")) & (F.length(t) <= MOST))
    formal = t.rlike(r"(?iuU)\w{2,}(?<!s)(?:ınız|iniz|unuz|ünüz)\s*(?:[.!?:;]|$)")
    exhorts = t.rlike(r"(?iuU)\w{3,}(?:alım|elim)\s*(?:[.!?:]|$)")
    short = t.rlike(r"(?iuU)\w{2,}(?:ayın|eyin|yın|yin|yun|yün)\s*[.!?]")
    english = t.rlike(rf"(?iuU)^\s*(?:now\s+)?(?:{'|'.join(ENGLISH_VERBS)})\b")
    return F.coalesce((F.length(t) >= LEAST) & opens & (asks | formal | exhorts | short | english), F.lit(False))


def reads_as_title(c: Column, size: Column, body: Column) -> Column:
    """Whether a paragraph is the title of an exercise: it opens on one and is short, or set 1.12 times the body's size."""
    t = F.trim(c)
    return F.coalesce(t.rlike(rf"(?iuU)^\s*(?:{'|'.join(TITLES)})\b") & ((F.length(t) <= TITLE) | (size >= 1.12 * body)), F.lit(False))


def is_bold(flags: Column, font: Column) -> Column:
    return F.coalesce((flags.bitwiseAND(16) != 0), F.lit(False)) | F.coalesce(font.rlike(r"(?i)bold|black|heavy|demi"), F.lit(False))


def is_prose(text: Column) -> Column:
    """A span with a word character that is no marker."""
    return F.coalesce(text.rlike(r"(?U)\w") & marker_label(text).isNull(), F.lit(False))


def template_of(title: Column) -> Column:
    """The kind of book that a title names."""
    return F.when(fold(title).rlike("ingilizce|english"), "elt").when(fold(title).rlike("soru|test|alistirma"), "questions").otherwise("subject")


def band_of(rate: Column) -> Column:
    """Violation band by rate: low under .02, mid under .07, else high; none where unknown."""
    return F.when(rate.isNull(), "none").when(rate < 0.02, "low").when(rate < 0.07, "mid").otherwise("high")


def human_size(n: Column) -> Column:
    out = F.concat(F.format_number(n / (1 << 30), 1), F.lit(" GB"))
    for limit, unit in ((1 << 30, "MB"), (1 << 20, "KB"), (1 << 10, "B")):
        small = n.cast("string") if unit == "B" else F.format_number(n / (limit >> 10), 1)
        out = F.when(n < limit, F.concat(small, F.lit(f" {unit}"))).otherwise(out)
    return out


def page_spec(spec: Column, total: Column) -> Column:
    """'16,23,10-20' as an array of pages in the given order, repeats kept, within 1..total; broken parts are dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(-\d+)?$"))

    def pages(p: Column) -> Column:
        a, b = F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")
        return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.filter(F.flatten(F.transform(parts, pages)), lambda x: x.between(F.lit(1), total))


def html_assets(html: Column) -> Column:
    """Relative asset paths of a page (src, href, data-src, poster, css url()), distinct, without query and leading slash."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)(?:src|href|data-src|poster)\s*=\s*["']([^"']+)["']"""), 1)
    css = F.regexp_extract_all(html, F.lit(r"""(?i)url\(\s*["']?([^"')]+)["']?\s*\)"""), 1)
    kept = F.filter(F.array_union(tags, css), lambda u: ~u.rlike(r"(?i)^(?:data:|javascript:|#|[a-z][a-z0-9+.\-]*:|//)"))
    clean = F.transform(kept, lambda u: F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^/+", ""))
    return F.array_distinct(F.filter(clean, lambda u: u != ""))
