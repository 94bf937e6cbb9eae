"""Texts that look the same but hold different characters, brought to one consistent form.

Each token's resolved script set is the intersection of its characters' script extensions, after removing what cannot be
seen. A token whose set is empty is mixed: if its foreign letters all look like Latin ones, the Latin
spelling is the consistent one. A token of foreign script whose letters all look Latin is a whole-script confusable. Words
of another script that hold letters of their own, and formula symbols, stay. The remaining forms (wide letters,
ligatures, separate marks, other blanks, invisible signs) are normalised.

Which letters look alike is the public Unicode confusables data, as the ICU library in Spark's own JVM has it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import spread, table

# Signs that cannot be told from an ordinary one, and a letter that the public data lack.
SIGNS = {"\u037e": ";", "‐": "-", "‑": "-", "ʼ": "'", "ʹ": "'", "․": ".", "։": ":", "\u212a": "K", "Ɪ": "I"}
#: Of the forms that NFKC would change, signs with a meaning of their own stay: only these kinds are folded.
FOLDED = ("<wide>", "<narrow>", "<font>", "<small>")
#: Letters that ordinary texts are written with; what looks like one of them is a confusable.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzçğıöşüÇĞİÖŞÜ"
#: Characters of ordinary Turkish and English texts; a value of these only needs no look.
ORDINARY = r"\n\r\t -~çÇğĞıİöÖşŞüÜâÂîÎûÛ“”‘’„«»–—…•°²³½©№≤≥"
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
# Scripts told apart, with those that are read together; all others are one.
_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Syriac", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao",
            "Tibetan", "Myanmar", "Georgian", "Hangul", "Ethiopic", "Cherokee", "Khmer", "Mongolian", "Hiragana", "Katakana", "Bopomofo", "Han", "Coptic", "Lisu", "Glagolitic", "Gothic", "Runic")
_TOGETHER = {"Han": ("Japanese", "Korean", "Chinese"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Chinese",)}
_IS = {s: regex.compile(rf"\p{{scx={s}}}") for s in _SCRIPTS}
_ANY = frozenset({*_SCRIPTS, "Other"}.union(*_TOGETHER.values()))
_COMMON = regex.compile(r"[\p{scx=Common}\p{scx=Inherited}]")
_QUOTES = "“”‘’\"'«»„"
#: Greek letters that no font tells from Latin ones: all capitals and these; other Greek letters alone are formula symbols.
_SAME_GREEK = "οϲϳ"
#: A formula term has at most this many Latin letters beside a Greek symbol; a word has more.
TERM = 2


@lru_cache(maxsize=4096)
def scripts(ch: str) -> frozenset[str]:
    """The scripts that a character can belong to (its script extensions); shared signs belong to all."""
    if _COMMON.match(ch):
        return _ANY
    own = {s for s in _SCRIPTS if _IS[s].match(ch)}
    return frozenset(own.union(*(_TOGETHER[s] for s in own if s in _TOGETHER))) if own else frozenset({"Other"})


_TABLES: dict[str, dict[str, str]] = {}


def prototypes(spark: SparkSession) -> dict[str, str]:
    """The ordinary letter that each other letter looks like, by equal skeletons; a capital looks like a capital where there is one.

    One call for all letters up to U+1FFFF; a few thousand are left, the same for any data.
    """
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        every = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and c not in LETTERS]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        own: dict[str, list[str]] = {}
        for c, skeleton in zip(LETTERS, checker.getSkeleton("\n".join(LETTERS)).split("\n"), strict=True):
            own.setdefault(skeleton, []).append(c)
        out = {}
        for c, skeleton in zip(every, checker.getSkeleton("\n".join(every)).split("\n"), strict=True):
            like = own.get(skeleton, [])
            if like:
                out[c] = next((x for x in like if x.isupper() == c.isupper()), like[0])
        _TABLES.clear()
        _TABLES[app] = out
    return _TABLES[app]


def folded(ch: str, known: dict[str, str], memo: dict[str, tuple[str, str]] = {}) -> tuple[str, str]:  # noqa: B006 - one memo a worker
    """A character's ordinary form and the kind of difference ('' where it is ordinary)."""
    if ch not in memo:
        memo[ch] = _folded(ch, known)
    return memo[ch]


def _folded(ch: str, known: dict[str, str]) -> tuple[str, str]:
    if "\x20" <= ch < "\x7f" or ch in "\n\r\t":
        return ch, ""
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Cc") or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "͏ᅟᅠㅤ":
        return "", "invisible"
    if kind in ("Zs", "Zl", "Zp"):
        return " ", "blank"
    if ch in SIGNS:
        return SIGNS[ch], "sign"
    way = unicodedata.decomposition(ch)
    if not way.startswith("<") and ch in known and "Latin" in scripts(ch):
        return known[ch], "letter"
    if way.startswith(FOLDED) or (way.startswith("<compat>") and kind in ("Lu", "Ll", "Lt", "Nl")):
        plain = unicodedata.normalize("NFKC", ch)
        if plain.isascii() or all(scripts(x) == {"Latin"} for x in plain):
            return plain, "form"
    return ch, ""


def consistent(token: str, before: str, after: str, known: dict[str, str]) -> tuple[str, str]:
    """A token's consistent spelling and the kind of confusion ('' where it stays)."""
    resolved = _ANY
    for ch in token:
        resolved = resolved & scripts(ch)
    if "Latin" in resolved:
        return token, ""
    letters = [ch for ch in token if scripts(ch) != _ANY]
    foreign = [ch for ch in letters if "Latin" not in scripts(ch)]
    symbols = [ch for ch in foreign if "Greek" in scripts(ch) and not ch.isupper() and ch not in _SAME_GREEK]
    if not all(ch in known for ch in foreign):
        return token, ""
    plain = "".join(known.get(ch, ch) if "Latin" not in scripts(ch) else ch for ch in token)
    if not resolved:
        others = len(letters) - len(symbols)
        return (token, "") if symbols and others <= TERM and symbols != ["ν"] else (plain, "mixed script")
    quoted = len(letters) > 2 and before in _QUOTES and after in _QUOTES and before and after
    return (token, "") if symbols or quoted else (plain, "whole script")


def plain_form(text: str, known: dict[str, str]) -> tuple[str, list[str]]:
    """The consistent form of a text and the kinds of differences found, sorted; equal to the text where there are none."""
    kinds: set[str] = set()
    out = []
    for ch in text:
        plain, kind = folded(ch, known)
        out.append(plain)
        if kind:
            kinds.add(kind)
    seen = "".join(out)
    if any(unicodedata.combining(ch) for ch in seen):
        seen = _with_marks(seen, kinds, known)
    done, at = [], 0
    for m in _TOKEN.finditer(seen):
        token = m.group()
        if not token.isascii():
            form, kind = consistent(token, seen[m.start() - 1: m.start()] if m.start() else "", seen[m.end(): m.end() + 1], known)
            if kind:
                kinds.add(kind)
                done += [seen[at: m.start()], form]
                at = m.end()
    return "".join(done) + seen[at:], sorted(kinds)


def _with_marks(text: str, kinds: set[str], known: dict[str, str]) -> str:
    """Letters with separate marks as single characters; a second dot over an i is none."""
    out = []
    for m in regex.finditer(r"\P{M}\p{M}*|\p{M}+", text):
        c = m.group()
        if len(c) > 1:
            base = known.get(c[0], c[0])
            if "Latin" in scripts(base) or not base.isalpha():
                marks = c[1:].replace("̇", "") if base in "ij" else c[1:]
                one = unicodedata.normalize("NFC", base + marks)
                one = "".join(known.get(x, x) for x in one)
                kinds.add("separate mark")
                c = one
            else:
                c = unicodedata.normalize("NFC", c)
        out.append(c)
    return "".join(out)


def unusual(col: str) -> Column:
    """Whether a value holds any character beyond those of ordinary texts (a JVM-side prefilter without exceptions)."""
    return F.col(col).rlike(f"[^{ORDINARY}]")


def forms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text, form, kinds) of the rows whose text is not written with ordinary single characters.

    Null, empty and ordinary texts give no row; repeated rows give as many. Texts are read whole. No shuffle: only rows
    with an unusual character reach Python.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).where(unusual("_text"))
    known = df.sparkSession.sparkContext.broadcast(prototypes(df.sparkSession))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string, form string, kinds array<string>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [plain_form(s, known.value) for s in pdf["_text"]]
            out = pdf.rename(columns={"_text": "text"}).assign(form=[f for f, _ in made], kinds=[k for _, k in made])
            yield out[[bool(k) for _, k in made]]

    return rows.mapInPandas(run, schema)


def consistent_text(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` with ``out``: the consistent form of ``text``; ordinary values skip Python's rules, null stays null."""
    known = df.sparkSession.sparkContext.broadcast(prototypes(df.sparkSession))

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(lambda x: plain_form(x, known.value)[0], na_action="ignore")

    return df.withColumn(out, F.when(unusual(text), fix(F.when(unusual(text), F.col(text)))).otherwise(F.col(text)))


FIELDS = (("spans", "span_id", "text"), ("publisher_oge", "id", "title"), ("item", "item_key", "label"))


def p5_forms(spark, sf_dir: str) -> DataFrame:
    out = None
    for name, key, field in FIELDS:
        df = table(spark, sf_dir, name).where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(field).alias("value"))
        df = forms(spread(df), ["row_key"], "value").select(F.lit(name).alias("table_name"), "row_key", F.lit(field).alias("field"), "text", "form", "kinds")
        out = df if out is None else out.unionByName(df)
    return out.distinct()


def p5_found(spark, sf_dir: str) -> DataFrame:
    return p5_forms(spark, sf_dir).select("table_name", "row_key", "field").distinct()
