"""Replies of labelling services: boxes out of prose, checks of boxes, kinds of errors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<struct<box:array<double>,label:string>>"


def balanced_list(text: str) -> str | None:
    """The first JSON list in a text that closes its brackets and can be read, brackets in strings not counted; fences and prose around it do not matter."""
    for start in (i for i, c in enumerate(text) if c == "["):
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if not depth:
                    try:
                        json.loads(text[start:i + 1])
                        return text[start:i + 1]
                    except ValueError:
                        break
    return None


def list_in(reply: Column) -> Column:
    """``balanced_list`` of a column; null where there is none."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(balanced_list, na_action="ignore")

    return run(reply)


def boxes_in(reply: Column) -> Column:
    """The boxes of a reply (arrays of ymin, xmin, ymax, xmax or objects with a box); null where the reply holds no list."""
    return F.from_json(list_in(reply), BOXES)


def box_fault(box: Column, top: float = 1000.0) -> Column:
    """What is wrong with a box of four numbers 0..``top``: its form, range or order; null if nothing is."""
    return (F.when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda x: x.isNull() | F.isnan(x)), "not four numbers").when(F.exists(box, lambda x: (x < 0) | (x > top)), "out of range")
            .when((F.get(box, F.lit(2)) <= F.get(box, F.lit(0))) | (F.get(box, F.lit(3)) <= F.get(box, F.lit(1))), "inverted"))


def scaled_box(box: Column, w_px: Column, h_px: Column, top: float = 1000.0) -> Column:
    """A box in thousandths of the page (x0, y0, x1, y1) in pixels, one decimal."""
    return F.array(*[F.bround(F.get(box, F.lit(i)) * (w_px if i % 2 == 0 else h_px) / top, 1) for i in range(4)])


def error_class(code: Column, message: Column) -> tuple[Column, Column]:
    """(kind, seconds to wait) of a failed request: 'quota' (the day is used up), 'rate' (the wait the message names, else 30), 'server', 'key', or 'other'."""
    m = F.lower(F.coalesce(message, F.lit("")))
    named = F.nullif(F.regexp_extract(m, r"retry (?:in|after) (\d+(?:\.\d+)?) ?s", 1), F.lit("")).cast("double")
    kind = (F.when((code == 429) & m.rlike(r"per ?day|daily|quota exceeded"), "quota").when(code == 429, "rate").when(code.isin(401, 403), "key").when(code >= 500, "server").otherwise("other"))
    return kind, F.when(kind == "rate", F.coalesce(named, F.lit(30.0))).when(kind == "server", F.lit(5.0)).otherwise(F.lit(0.0))


# Extensions by the class of what they hold.
MEDIA = {"audio": ("mp3", "wav", "ogg", "m4a"), "video": ("mp4", "webm", "mov", "avi"), "image": ("png", "jpg", "jpeg", "gif", "svg", "webp"), "page": ("html", "htm", "js", "css", "json")}


def media_class(path: Column) -> Column:
    """The class of an asset by its extension, 'other' where unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for name, exts in MEDIA.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out
