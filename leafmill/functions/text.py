"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import fixed


#: All white space of Unicode, as characters and as a class for patterns.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
GAP = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(WHITE))


def split_words(text: Column) -> Column:
    """The parts between white space of any kind."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """One space for each run of spaces and tabs, two newlines for three or more, stripped; null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def parse_amount(text: Column) -> Column:
    """The number that the digits and dots of a text spell, or null."""
    return F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double")


def standardize_date(text: Column) -> Column:
    """yyyy-MM-dd if one of the known formats fits the whole text, else the text itself, stripped; null if empty."""
    bare = F.regexp_replace(strip(text), r"\s+", " ")
    tries = (F.date_format(F.try_to_timestamp(bare, F.lit(f)), "yyyy-MM-dd") for f in fixed.DATE_FORMATS)
    return F.when(text != "", F.coalesce(*tries, strip(text)))


def repair_digits(text: Column) -> Column:
    """Letters that look like digits become digits in a text that has a digit."""
    return F.when(text.rlike(r"\d"), F.translate(text, "OoIlSsB", "0011558")).otherwise(text)


def lexical_tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_distinct(split_words(plain))


def words(text: Column) -> Column:
    """Lower-case words, repeated ones too."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return split_words(plain)


def subword_tokens(text: Column) -> Column:
    """Words, their trigrams, and the 4-grams of words of five letters or more."""

    def grams(w: Column, n: int, least: int) -> Column:
        spots = F.when(F.char_length(w) >= least, F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.substring(w, i, F.lit(n)))

    return F.flatten(F.transform(words(text), lambda w: F.concat(F.array(w), grams(w, 3, 3), grams(w, 4, 5))))


def token_hash(token: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 sum as a number."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")


def token_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(split_words(F.coalesce(text, F.lit("")))).cast("bigint")


def title_key(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def field_key(key: Column) -> Column:
    """A key as the name of a field: lower case, other characters than letters, digits and _ replaced by _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(key)), "[^a-zA-Z0-9_]", "_"), "^_+|_+$", "")


def first_sentence(text: Column) -> Column:
    return strip(F.substring_index(text, ".", 1))


def masked(key: Column) -> Column:
    """The ends of a long key."""
    return F.when(F.char_length(key) > 16, F.concat(F.left(key, F.lit(12)), F.lit("..."), F.right(key, F.lit(4)))).otherwise(key)


def contains_any(text: Column, words_: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words_))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
