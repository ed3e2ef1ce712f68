"""Column helpers shared by the operators: words, lines and reproducible document splits."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the characters that separate words, and a run of them as a pattern
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text, '' where it is NULL."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; NULL and blank texts have none."""
    bare = F.btrim(whole(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    """Number of words, as BIGINT."""
    bare = F.btrim(whole(text), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("bigint")


def fresh(name: str, columns: list[str]) -> str:
    """The name, or one like it that is not among the columns."""
    while name in columns:
        name = f"_{name}"
    return name


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``, as BIGINT."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def crc_slot(doc_id: Column, slots: int) -> Column:
    """crc32 of the id as text, modulo ``slots``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(slots))
