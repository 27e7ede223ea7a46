"""Text normalisation and comparison: Column expressions, and Arrow UDFs where no expression exists."""

from __future__ import annotations

import difflib
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

#: The ASCII marks and the CJK marks that answer normalisation deletes.
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_MARKS = "，。！？；：、（）【】《》“”‘’—…"


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; only text with other than ASCII needs it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)^\\s+|\\s+$", "")


def without_marks(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), ASCII_MARKS + CJK_MARKS, "")


def plain_numbers(c: Column) -> Column:
    """Digit groups without their commas: 1,000,000 becomes 1000000."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?<=\\d),(?=\\d{3}\\b)", "")


def normalize_answer(c: Column, compose: bool = False) -> Column:
    """Lower case, plain numbers, no marks, single spaces; ``compose`` adds NFKC through an Arrow UDF."""
    c = F.coalesce(c, F.lit(""))
    return collapse(without_marks(plain_numbers(F.lower(nfkc(c) if compose else c))))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def contains_answer(text: Column, answer: Column) -> Column:
    """Both already normalised; an empty answer is in no text."""
    return (answer != "") & F.contains(text, answer)


def occurrences(text: Column, answer: Column) -> Column:
    gone = F.length(text) - F.length(F.replace(text, answer, F.lit("")))
    return F.when(answer == "", F.lit(0)).otherwise(F.coalesce(F.try_divide(gone, F.length(answer)), F.lit(0.0)).cast("int"))


def token_f1(p: Column, g: Column) -> Column:
    """Bag-of-tokens F1 of two token arrays."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    same = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, t: n + F.least(count(p, t), count(g, t)))
    score = F.coalesce(F.try_divide(2.0 * same, (F.size(p) + F.size(g)).cast("double")), F.lit(0.0))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(score)


def token_overlap(a: Column, b: Column) -> Column:
    share = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a)).cast("double"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance over the reference's length, case-folded and stripped; 0 for an empty reference, may exceed 1."""
    r, h = F.lower(strip(reference)), F.lower(strip(hypothesis))
    return F.when(r == "", F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.levenshtein(r, h).cast("double"), F.length(r).cast("double")), F.lit(0.0)))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows over an integer as long as ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=100_000)
def similarity(a: str, b: str) -> float:
    """Common subsequence over the longer length, stripped and case-folded; 0 if either is empty."""
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return 0.0
    return 1.0 if a == b else lcs_length(a, b) / max(len(a), len(b))


@pandas_udf(DoubleType())
def text_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    return text_similarity_udf(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def block_matches(a: str, b: str, most: int = 2000) -> int:
    """Sum of the matching blocks' sizes of two texts cut to ``most`` characters."""
    return sum(m.size for m in difflib.SequenceMatcher(None, a[:most], b[:most], autojunk=False).get_matching_blocks())


def character_loss_of(truth: str, found: str) -> float:
    """1 minus matched characters over the (cut) truth, both stripped; 0 for a blank truth, 1 for nothing found."""
    truth, found = truth.strip(), found.strip()
    return 0.0 if not truth else 1.0 if not found else 1.0 - block_matches(truth, found) / len(truth[:2000])


@pandas_udf(DoubleType())
def character_loss(truth: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([character_loss_of(t or "", f or "") for t, f in zip(truth, found, strict=True)], dtype="float64")


def bad_char_ratio(c: Column) -> Column:
    """Share of replacement and control characters (line breaks and tabs aside); 1 for empty text."""
    c = F.coalesce(c, F.lit(""))
    bad = F.length(F.regexp_replace(c, "[^\\uFFFD\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    return F.when(c == "", F.lit(1.0)).otherwise(F.coalesce(F.try_divide(bad.cast("double"), F.length(c).cast("double")), F.lit(1.0)))


def split_lines(c: Column, least: int = 8, most: int = 220) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), "[\\n\\r]+|(?<=[.!?])\\s+")
    return F.filter(F.transform(parts, collapse), lambda s: (F.length(s) >= least) & (F.length(s) <= most))


def windows(c: Column, most: int, overlap: int) -> Column:
    """Character windows of a text, stepping ``most - overlap``; the last one ends with the text."""
    step = max(1, most - overlap)
    n = F.when(F.length(c) <= most, F.lit(1)).otherwise(F.ceil((F.length(c) - most) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * step + 1, F.lit(most)))


def text_related(page: Column, blocks: Column) -> Column:
    """Whether page and block texts share a fifth of the smaller token set."""
    a, b = F.array_distinct(tokens(normalize_answer(page))), F.array_distinct(tokens(normalize_answer(blocks)))
    share = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(True)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(False)).otherwise(share >= 0.2)


def to_number(c: Column) -> Column:
    """Tolerant cast of a cell; blanks and the usual words for nothing are null."""
    s = F.lower(F.trim(c.cast("string")))
    v = s.try_cast("double")
    return F.when(s.isin("", "nan", "none", "null"), None).otherwise(F.when(F.isnan(v), None).otherwise(v))
