"""Text cleaning and counting as Column expressions; Unicode classes and white space as in a Unicode-aware regex engine."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(x: Column) -> Column:
    """Composed form. Texts of characters below U+0300 are composed as they are; only the others pass through Arrow."""

    @F.pandas_udf("string")
    def composed(t: pd.Series) -> pd.Series:
        return t.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

    other = x.rlike("[^\\x{0}-\\x{2FF}]")
    return F.when(other, composed(F.when(other, x))).otherwise(x)


# What UTF-8 looks like where it was read as a single-byte encoding.
MOJIBAKE = ("Ã§", "Ã£", "Ã©", "Ã¡", "Ã³", "nÂº")


def has_mojibake(x: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(m)) for m in MOJIBAKE))


def repair_mojibake(x: Column, target: str = "cp1252") -> Column:
    """Texts that show it, read anew: written as ISO 8859-1 and decoded by target; unchanged where either fails.

    cp1252 turns the controls U+0080 to U+009F into the signs that they stand for; utf-8 also joins pairs such as the
    listed ones.
    """

    @F.pandas_udf("string")
    def repaired(t: pd.Series) -> pd.Series:
        def one(s: str) -> str:
            try:
                return s.encode("latin-1").decode(target)
            except UnicodeError:
                return s

        return t.map(one, na_action="ignore")

    found = has_mojibake(x)
    return F.when(found, repaired(F.when(found, x))).otherwise(x)


def strip(x: Column) -> Column:
    # Only a run's first place is tried, and once: else a long run within a text costs its square.
    return F.regexp_replace(x, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def join_hyphenated(x: Column) -> Column:
    """A word cut at a line's end: joined if it goes on in lower case, else the hyphen stays and the break goes."""
    x = F.regexp_replace(x, r"(?U)(\w)-\s*\n\s*(?=\p{Ll})", "$1")
    return F.regexp_replace(x, r"(?U)(\w-)\s*\n\s*(?=\w)", "$1")


def remove_urls(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)https?://\S+|www\.\S+", "")


def clean_whitespace(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(x, " +", " "), "\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(x, "\n", -1), strip), "\n")


def clean(x: Column, normalize: bool = True, hyphens: bool = True, urls: bool = False, whitespace: bool = True, lower: bool = False) -> Column:
    x = F.coalesce(x, F.lit(""))
    for on, step in ((normalize, nfc), (hyphens, join_hyphenated), (urls, remove_urls), (whitespace, clean_whitespace), (lower, F.lower)):
        x = step(x) if on else x
    return strip(x)


def remove_repeated_lines(x: Column, least: int = 3) -> Column:
    """Without the lines under 100 characters that occur least times; blank lines stay."""
    lines = F.transform(F.split(x, "\n", -1), lambda line, i: F.struct(strip(line).alias("t"), i.alias("i"), line.alias("line")))

    # Each step takes the array before it as the variable of a lambda: an expression of the column would be computed anew for each element.
    def marked(s: Column) -> Column:
        # In sorted order a line that occurs often enough stands in a run of least equal ones: one of the windows of that width around it ends as it begins.
        def often(i: Column) -> Column:
            same = lambda a: (i >= -a) & F.coalesce(F.get(s, F.greatest(i + a, F.lit(0)))["t"] == F.get(s, F.greatest(i + (a + least - 1), F.lit(0)))["t"], F.lit(False))
            return reduce(lambda a, b: a | b, (same(a) for a in range(1 - least, 1)))

        return F.filter(s, lambda v, i: (v["t"] == "") | (F.length(v["t"]) >= 100) | ~often(i))

    kept = F.transform(F.array(F.array_sort(lines)), marked)
    kept = F.transform(kept, lambda s: F.array_sort(F.transform(s, lambda v: F.struct(v["i"].alias("i"), v["line"].alias("line")))))
    return F.transform(kept, lambda s: F.array_join(F.transform(s, lambda v: v["line"]), "\n"))[0]


def normalize_legal(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?iU)\bart\.?\s+(\d+)", "Art. $1")
    return F.regexp_replace(x, r"(?iU)\bpar[áa]grafo\s+(\d+)", "§ $1º")


def sentences(x: Column) -> Column:
    """Ends of sentences are consumed, but for the text's own; abbreviations don't end one."""
    x = F.regexp_replace(x, r"(?U)\b(Art|Dr|Sr|Sra|Inc)\.\s", "$1\u0001 ")
    return F.filter(F.transform(F.split(x, r"(?U)[.!?]\s+", -1), lambda s: strip(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x)).cast("long")


def estimated_tokens(x: Column) -> Column:
    return F.floor(F.length(x) / 4).cast("long")


# Stop words of the lexical tokenizer.
STOPWORDS = (
    "o", "a", "os", "as", "um", "uma", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "por", "para", "com", "sem",
    "e", "ou", "que", "se", "é", "são", "foi", "ser", "ter",
)
SIMPLE = r"[\p{L}\p{N}_]+"
LEGAL = r"art\.?\s*\d+|§\s*\d+|inciso\s+[ivxlcdm]+|[\p{L}\p{N}_]+"


def tokens(x: Column, legal: bool = False) -> Column:
    """Lower-case words of more than two characters that aren't stop words; legal: references count as one token."""
    found = F.regexp_extract_all(F.lower(x), F.lit(LEGAL if legal else SIMPLE), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))
