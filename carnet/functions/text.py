"""Column functions on text. All stay inside generated code; none needs a Python worker."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from carnet import constants as K

SPACE = r"[\s\p{Z}]"
WORD = r"\p{L}\p{N}_"
# The characters of SPACE.
SPACES = "\t\n\x0b\f\r" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c).startswith("Z"))
# Letters accepted in a dictionary word.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def _accent_table() -> tuple[str, str]:
    """Every letter that Unicode decomposes into one base character with accents, and that base."""
    source, target = [], []
    for code in range(0xC0, 0x20000):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        parts = unicodedata.normalize("NFD", char)
        base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if len(parts) > 1 and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, UNACCENTED = _accent_table()
# Ligatures and letters without a decomposition, spelled in ASCII.
ASCII_SPELLING = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ø": "o", "Ø": "O", "’": "'", "‘": "'"}


def strip_space(c: Column) -> Column:
    """Trim every kind of white space at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def lower_punct(c: Column) -> Column:
    """Lower case, every non-word character to a space, runs of spaces collapsed."""
    return squeeze(F.regexp_replace(F.lower(c), rf"[^{WORD}\s\p{{Z}}]", " "))


def drop_empty(c: Column) -> Column:
    return F.filter(c, lambda t: t != "")


def space_tokens(c: Column) -> Column:
    return drop_empty(F.split(c, " "))


def norm_tokens(c: Column) -> Column:
    """Tokens of the normalised text, ``space_tokens(lower_punct(c))`` in one pass: whatever is no word character stands between tokens."""
    return drop_empty(F.split(F.lower(c), rf"[^{WORD}]+"))


def remove_special(c: Column) -> Column:
    return F.translate(c, K.ASCII_PUNCTUATION, " " * len(K.ASCII_PUNCTUATION))


def unaccent(c: Column, mode: str = "strip") -> Column:
    """Remove diacritics; ``mode='ascii'`` also spells ligatures with ASCII letters. Text of ASCII alone is not looked through."""
    out = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), ACCENTED, UNACCENTED)
    if mode == "ascii":
        for char, spelled in ASCII_SPELLING.items():
            out = F.replace(out, F.lit(char), F.lit(spelled))
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(out)


def has_diacritics(c: Column) -> Column:
    return c != unaccent(c)


def words(c: Column) -> Column:
    """Runs of word characters and apostrophes."""
    return F.regexp_extract_all(c, F.lit(rf"[{WORD}']+"), F.lit(0))


def plain_words(c: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(c, F.lit(rf"[{WORD}]+"), F.lit(0))


def encoding_repair(c: Column) -> Column:
    """Stray Windows control characters: apostrophe, hard space, ellipsis and both oe ligatures."""
    out = F.translate(c, "\x92\xa0\x85", "' ")
    return F.regexp_replace(out, "[\x8c\x9c]", "oe")


def redecode_cp1252(c: Column) -> Column:
    """Text whose cp1252 bytes were read as Latin-1."""
    return F.decode(F.encode(c, "ISO-8859-1"), "windows-1252")


def trim_punct(c: Column) -> Column:
    """Strip leading and trailing characters that are neither letters nor digits."""
    return F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def sentences(c: Column) -> Column:
    """Sentence list: bar to full stop, split after final punctuation or at line ends."""
    parts = F.split(F.replace(c, F.lit("|"), F.lit(". ")), rf"(?<=[.!?]){SPACE}+|\n+")
    return drop_empty(F.transform(parts, strip_space))


def join_sentences(c: Column) -> Column:
    """Sentences joined by spaces; a full stop is added where final punctuation is missing."""
    kept = drop_empty(F.transform(c, lambda s: strip_space(F.coalesce(s, F.lit("")))))
    closed = F.transform(kept, lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))
    return F.array_join(closed, " ")


def strip_separators(c: Column) -> Column:
    """Drop lines made of '=' and turn remaining long '=' runs into one space."""
    out = F.regexp_replace(c, rf"(?md)^{SPACE}*={{3,}}{SPACE}*$", "")
    out = F.regexp_replace(out, r"={3,}", " ")
    return F.regexp_replace(out, r"[ \t]{2,}", " ")


def strip_leading_label(c: Column, label: str = "Après") -> Column:
    return F.regexp_replace(c, rf"(?iu)^{SPACE}*{label}{SPACE}*\r?\n(\r?\n)?", "")


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def drop_number_tokens(c: Column) -> Column:
    return F.filter(c, lambda t: ~has_digit(t))


def drop_stopwords(c: Column, stopwords: list[str] | None = None) -> Column:
    """Remove every occurrence of each stop word."""
    listed = K.FRENCH_STOPWORDS if stopwords is None else stopwords
    return F.filter(c, lambda t: ~t.isin(*listed))


def time_units(c: Column) -> Column:
    """'3/j' to '3 / jour', 'qq j' to 'quelques jours', '3 j' to '3 jours'."""
    out = F.regexp_replace(c, r"(?iU)\b(\d+)\s*/\s*j\b", "$1 / jour")
    out = F.regexp_replace(out, r"(?iU)\b(q{1,2}u?e?l?q?u?e?s?|qqs?|qques)\s*j\b", "quelques jours")
    return F.regexp_replace(out, r"(?iU)\b(\d+)\s*j\b", "$1 jours")


INTENSITY_TOKEN = r"(?i)^([a-zàâçéèêëîïôûùüÿñæœ\-]+)(\+{2,})$"
INTENSITY_TEXT = rf"(?U)(?<!\w)(?![A-Za-z]\+\+)([{LETTERS}]{{2,}})(\+{{2,4}})(?!\w)"


def intensity_token(c: Column) -> Column:
    """'douleur+++' to 'douleur (+++)'; NULL when the token is not an intensity mark."""
    return F.when(c.rlike(INTENSITY_TOKEN), F.regexp_replace(c, INTENSITY_TOKEN, "$1 ($2)"))


def intensity_text(c: Column) -> Column:
    return F.regexp_replace(c, INTENSITY_TEXT, "$1 ($2)")


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def is_word_like(c: Column) -> Column:
    """A letter, then letters, apostrophes or hyphens."""
    return c.rlike(rf"^[{LETTERS}][{LETTERS}'\-]*$")


def is_letters(c: Column) -> Column:
    return c.rlike(rf"^[{LETTERS}]+$")


def is_function_word(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return (F.length(t) <= 2) | t.isin(*K.FUNCTION_WORDS)


def consonant_ratio(c: Column) -> Column:
    """Share of consonants among letters; 0 without letters."""
    low = F.lower(c)
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    consonants = F.length(F.regexp_replace(low, rf"[^\p{{L}}]|[{K.VOWELS}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(consonants / letters)


def quote_regex(c: Column) -> Column:
    """Escape a literal for use inside a pattern column."""
    return F.regexp_replace(c, r"([\\\^\$\.\|\?\*\+\(\)\[\]\{\}])", r"\\$1")


def quote_replacement(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\$])", r"\\$1")


MAIL = rf"[{WORD}.*\-]*@[{WORD}]*[.][{WORD}]*"


def scrub_mails(c: Column) -> Column:
    """Remove mail addresses, their local part, that part without digits, and its name pieces, longest first."""
    mails = F.array_distinct(F.regexp_extract_all(c, F.lit(MAIL), F.lit(0)))
    local = F.transform(mails, lambda m: F.substring_index(m, "@", 1))
    bare = F.transform(local, lambda n: F.regexp_replace(n, r"\d", ""))
    pieces = F.flatten(F.transform(bare, lambda n: F.split(n, r"[._]")))
    found = F.filter(F.array_distinct(F.concat(mails, local, bare, pieces)), lambda n: F.length(n) >= 2)
    ordered = F.transform(
        F.array_sort(F.transform(found, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))),
        lambda s: s["n"],
    )
    return F.when(F.size(mails) == 0, c).otherwise(F.aggregate(ordered, c, lambda text, n: F.replace(text, n, F.lit(""))))
