"""Text normalisers and tokenizers as column expressions.

There are six normalisers on purpose; results depend on which one is used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote as _unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera import vocab

TURKISH, PLAIN = "İIıĞğÜüŞşÖöÇç", "iiigguussoocc"
#: The same letters with their case kept.
TURKISH_CASE, PLAIN_CASE = "İıĞğÜüŞşÖöÇç", "IiGgUuSsOoCc"
#: Latin letters whose canonical decomposition is a base letter and marks.
_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
ACCENTED, BARE = "".join(_ACCENTED), "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def falsy(x: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(default))


def unquote(x: Column) -> Column:
    """Percent-decoding that keeps '+' and malformed escapes."""
    whole = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(x, F.lit("%")), F.coalesce(F.try_url_decode(whole), x)).otherwise(x)


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_rerank(x: Column) -> Column:
    """Decode, strip accents, fold case, collapse blanks (Latin letters; see normalize_exact for all scripts)."""
    return collapse(F.translate(casefold(F.translate(unquote(or_empty(x)), ACCENTED + "İ", BARE + "I")), "ı", "i"))


@F.pandas_udf(StringType())
def normalize_exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As normalize_rerank, by Unicode's own tables for any script."""

    def one(v: str | None) -> str:
        marked = unicodedata.normalize("NFKD", _unquote(v or ""))
        return " ".join("".join(c for c in marked if not unicodedata.combining(c)).replace("ı", "i").casefold().split())

    for s in batches:
        yield s.map(one)


def normalize_eval(x: Column) -> Column:
    """Decode, fold 13 Turkish letters (I to i), fold case."""
    return casefold(F.translate(unquote(or_empty(x)), TURKISH, PLAIN))


def normalize_filter(x: Column) -> Column:
    """Decode, fold Turkish letters with their case, fold case; also the source search's form."""
    return casefold(F.translate(unquote(or_empty(x)), TURKISH_CASE, PLAIN_CASE))


def normalize_question(x: Column) -> Column:
    """Fold case first, strip accents, collapse blanks; no decoding."""
    return collapse(F.translate(F.translate(casefold(F.translate(or_empty(x), "İ", "i")), ACCENTED, BARE), "ı", "i"))


def normalize_discovery(x: Column) -> Column:
    return F.replace(F.lower(unquote(or_empty(x))), F.lit("%20"), F.lit(" "))


def tokenize(x: Column) -> Column:
    """Evaluator tokens: runs of two or more of a-z, 0-9 of the evaluator's form, repeats kept."""
    return F.regexp_extract_all(normalize_eval(x), F.lit("[a-z0-9]{2,}"), F.lit(0))


def query_tokens(x: Column, institution: Sequence[str] = ()) -> Column:
    """Distinct rerank tokens of three or more without stop words, unless they are important.

    ``institution`` holds further stop words: the institution's own name.
    """
    drop = F.array(*(F.lit(w) for w in (*institution, *vocab.STOPWORDS) if w not in vocab.IMPORTANT_TOKENS))
    return F.array_except(F.array_distinct(F.regexp_extract_all(normalize_rerank(x), F.lit("[a-z0-9]{3,}"), F.lit(0))), drop)


def contains_any(x: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))


QUOTES = "\"'“”‘’`"


def strip(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_question(x: Column) -> Column:
    """Strip quotes from both ends, bullets (followed by a blank) and numbering from the front, thrice; collapse blanks."""
    y = or_empty(x)
    for _ in range(3):
        y = F.btrim(strip(y), F.lit(QUOTES))
        y = F.regexp_replace(y, r"^\s*(?:[-*+]\s+)+", "")
        y = F.regexp_replace(y, r"^\s*[0-9]+\s*[.)]\s*", "")
    return collapse(strip(y))


def preview_cut(x: Column, limit: int = 500) -> Column:
    """Collapsed, at most ``limit`` characters with the dots."""
    y = collapse(or_empty(x))
    return F.when(F.length(y) <= limit, y).otherwise(F.concat(F.rtrim(F.left(y, F.lit(limit - 3))), F.lit("...")))


def preview_append(x: Column, limit: int = 500) -> Column:
    """Collapsed, ``limit`` characters and then the dots."""
    y = collapse(or_empty(x))
    return F.when(F.length(y) <= limit, y).otherwise(F.concat(F.left(y, F.lit(limit)), F.lit("...")))


#: Fixed value: what a cut history begins with.
CUT_MARKER = "[gecmis kisaltildi]\n"


def trim_tail(x: Column, limit: int, marker: str = CUT_MARKER) -> Column:
    """The tail of a text within a budget that includes the marker."""
    y = or_empty(x)
    room = max(0, limit - len(marker))
    return F.when(F.length(y) <= limit, y).otherwise(F.concat(F.lit(marker[:limit]), F.right(y, F.lit(room)) if room else F.lit("")))


def page_key(x: Column) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(0))


@F.pandas_udf(StringType())
def _compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compatible(x: Column) -> Column:
    """Compatibility composition (NFKC); ASCII texts, which it leaves alone, aren't sent to Python."""
    plain = x.rlike(r"^\p{ASCII}*$")
    return F.when(plain, x).otherwise(_compatible(F.when(~plain, x)))


def clean_markdown(x: Column) -> Column:
    """Compatibility forms composed, at most one blank line in a row, no rows of short cells divided by bars; stripped."""
    y = F.regexp_replace(compatible(or_empty(x)), "\n{3,}", "\n\n")
    y = F.regexp_replace(y, r"(?m)^([ \t]*[\p{L}\p{N}_ ]{1,30}[ \t]*\|)+[ \t]*[\p{L}\p{N}_ ]{1,30}[ \t]*$", "")
    return F.regexp_replace(y, r"^\s+|\s+$", "")


def is_junk(x: Column, min_chars: int = 200) -> Column:
    """Shorter than min_chars when stripped, or more than five lines of under 15 characters on average."""
    s = F.regexp_replace(or_empty(x), r"^\s+|\s+$", "")
    lines = F.size(F.filter(F.split(s, "\n"), lambda y: y.rlike(r"\S")))
    return (F.length(s) < min_chars) | ((lines > 5) & (F.length(s) / lines < 15))


def quality_gate(x: Column, minimum: int = 300) -> Column:
    """Whether a page's text is long enough; the threshold never exceeds 120."""
    return F.length(F.regexp_replace(or_empty(x), r"^\s+|\s+$", "")) >= min(minimum, 120)


def markdown_escape(x: Column) -> Column:
    return F.replace(or_empty(x), F.lit("|"), F.lit("\\|"))
