"""Titles, slugs, file names and display formats as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import strip

SLUG_LEN = 80

# Symbols that are spelled out in slugs, in this order.
SLUG_WORDS = (("c++", "c-plus-plus"), ("C++", "c-plus-plus"), ("c#", "c-sharp"), ("C#", "c-sharp"), ("&", "-and-"), ("™", "-tm"), ("®", "-r"), ("©", "-c"), ("@", "-at-"))

# Device names that cannot be file names (com1-com9 and lpt1-lpt9 follow a rule).
DEVICES = ("con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)))

INVISIBLE = r"[​-‍﻿‪-‮؜]"
FILE_INVALID = r'[<>:"/\\|?*\x00-\x1f]'


@F.pandas_udf(T.StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII; Spark has no normalize()."""
    return s.map(lambda v: None if v is None else v if v.isascii() else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def slug(value: Column, max_len: int = SLUG_LEN) -> Column:
    v = F.regexp_replace(value, INVISIBLE, "")
    for a, b in SLUG_WORDS:
        v = F.replace(v, F.lit(a), F.lit(b))
    t = F.lower(F.trim(F.regexp_replace(nfkd_ascii(v), r"\s+", " ")))
    t = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("/"), F.lit("-")), FILE_INVALID, ""), r"[^a-z0-9\- _]", "")
    t = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit(" "), F.lit("-")), "-+", "-"), "^-+|-+$", "")
    t = F.when(t.isin(*DEVICES), F.concat(t, F.lit("-page"))).otherwise(t)
    cut = F.when(F.length(t) > max_len, F.concat(F.substring(t, 1, max_len - 9), F.lit("-"), F.substring(F.md5(t), 1, 8))).otherwise(t)
    return F.when(t == "", F.concat(F.lit("pagina-"), F.substring(F.md5(v), 1, 8))).otherwise(cut)


def file_base(index: Column, title_slug: Column) -> Column:
    return F.concat(F.format_string("%04d", index), F.lit("-"), title_slug)


def file_name(base: Column, nth: Column, index: Column, title: Column, ext: str = ".pdf") -> Column:
    """Name of the nth (from 1) entry that has this base: -2 to -99, then a hash."""
    tag = F.when(nth == 1, "").when(nth <= 99, F.concat(F.lit("-"), nth.cast("string"))).otherwise(F.concat(F.lit("-"), F.substring(F.md5(F.concat(index.cast("string"), F.lit("-"), title)), 1, 8)))
    return F.concat(base, tag, F.lit(ext))


def bookmark_title(title: Column, stem: Column) -> Column:
    t = strip(F.coalesce(title, F.lit("")))
    t = F.when(t == "", stem).otherwise(t)
    for a, b in (("™", "TM"), ("®", "(R)"), ("©", "(C)")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.substring(F.regexp_replace(t, r"[​-‍﻿]", ""), 1, 120)


def one_decimal(x: Column) -> Column:
    """One decimal, rounded half to even on the exact binary value; format_string rounds its decimal form up."""
    return F.replace(F.format_number(x.cast("double"), 1), F.lit(","), F.lit(""))


def format_bytes(n: Column) -> Column:
    n = n.cast("double")
    out = F.concat(one_decimal(n / 1024.0**4), F.lit(" TB"))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n / 1024.0**k < 1024, F.concat(one_decimal(n / 1024.0**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    m = F.floor(s / 60)
    hours = F.format_string("%dh %dmin %ds", F.floor(m / 60), F.pmod(m, F.lit(60)), F.pmod(s, F.lit(60)))
    return F.when(seconds < 60, F.concat(one_decimal(seconds), F.lit("s"))).when(m < 60, F.format_string("%dmin %ds", m, F.pmod(s, F.lit(60)))).otherwise(hours)


PATH_LEN = 240


def path_problem(path: Column) -> Column:
    """Why a relative output path is refused: it leaves its folder, or is too long; null if it is fine."""
    away = F.startswith(path, F.lit("/")) | F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")
    return F.when(away, "traversal").when(F.length(path) > PATH_LEN, "too long")
