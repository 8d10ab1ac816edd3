"""Text functions on columns. Unicode white space counts as space everywhere."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that stand for "no value", compared after trimming and lower-casing.
DISGUISED_NULLS = ["", "-", "--", "n/a", "na", "n.a.", "null", "none", "unknown", "tbd", "pendiente", "pending", "por determinar", "?", "sin datos"]
# Spellings of currencies.
CURRENCIES = {"eur": "EUR", "euro": "EUR", "euros": "EUR", "€": "EUR", "eur.": "EUR", "usd": "USD", "$": "USD", "dolares": "USD", "dólares": "USD", "gbp": "GBP", "£": "GBP"}
# Legal forms that a client's key leaves out.
LEGAL_FORMS = r"\b(?:s ?l|s ?a|inc|ltd|llc|plc|corp|corporation|company|gmbh|srl|bv|ag)\b"
# Fixed value: shortest text unit that is kept.
SHORTEST_UNIT = 25


# Fixed value: Unicode white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACES))


def is_placeholder(text: Column) -> Column:
    return F.lower(strip(text)).isin(DISGUISED_NULLS)


def unmask_null(text: Column) -> Column:
    """The trimmed text, or null where it only stands for no value."""
    return F.when(~is_placeholder(text), strip(text))


def normalise_currency(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(strip(text))), F.upper(strip(text)))


def client_key(name: Column) -> Column:
    """A name without punctuation, case and legal forms; null if nothing is left."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")
    bare = strip(F.regexp_replace(F.regexp_replace(F.trim(spaced), LEGAL_FORMS, ""), r"(?U)\s+", " "))
    return F.when(bare != "", bare)


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC, for which Spark has no function; ASCII texts don't leave the JVM's value."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.pandas_udf(_nfkc, "string")(text)).otherwise(text)


def tidy(text: Column) -> Column:
    """Without control characters, runs of blanks, blanks at line ends, and more than one empty line."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?m) +$", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normalise_text(text: Column) -> Column:
    return tidy(nfkc(text))


def is_page_artefact(text: Column) -> Column:
    return text.rlike(r"(?iu)^\s*(p[áa]gina\s+\d+\s*(de\s+\d+)?|\d+\s*/\s*\d+)\s*$")


def drop_reason(text: Column) -> Column:
    """Why a tidied text unit is dropped, the first rule first; null if it is kept."""
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(is_page_artefact(text), "page_artefact").when(F.length(text) < SHORTEST_UNIT, "too_short")


def cache_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def word_count(text: Column) -> Column:
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"(?U)\s+")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def document_id(source: Column, document: Column, unit: Column) -> Column:
    return F.concat_ws(":", source, document, F.when(unit != "", unit))


def estimated_tokens(text: Column) -> Column:
    """About four characters a token; an estimate."""
    return F.ceil(F.length(text) / 4).cast("long")


def whole(pattern: str) -> str:
    r"""A pattern of whole words, in any case."""
    return rf"(?iu)\b(?:{pattern})\b"
