"""Text mappers and text statistics as Column expressions. A null text counts as empty; lengths are in code points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: All special characters, those of ASCII, and those that aren't separators of words. A table lookup per character is far cheaper than a
#: character class of hundreds of entries in a regular expression.
SPECIALS = "".join(sorted(fixed.special_characters()))
ASCII_SPECIALS = "".join(c for c in SPECIALS if c < "\x80")
IN_WORDS = "".join(c for c in SPECIALS if c not in " \n\t")
#: Words that begin and end with these letters, none of which is special, need no further look.
_PLAIN = r"^[a-zA-Zà-öù-ÿÀ-ÖÙ-Þ](?:.*[a-zA-Zà-öù-ÿÀ-ÖÙ-Þ])?$"


def text_of(col: Column | str) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


# Mappers


def clean_email(text: Column) -> Column:
    return F.regexp_replace(text, fixed.EMAIL, "")


def normalize_punctuation(text: Column) -> Column:
    """Each character of the table becomes its string: single ones in one pass, then the three that become longer strings."""
    one = {a: b for a, b in fixed.PUNCTUATION.items() if len(b) == 1}
    text = F.translate(text, "".join(one), "".join(one.values()))
    for a, b in fixed.PUNCTUATION.items():
        if len(b) > 1:
            text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalize_whitespace(text: Column) -> Column:
    """Trims white space of any kind at both ends; then every kind of space, but no line break, becomes a space."""
    text = F.regexp_replace(text, f"^{fixed.TRIMMED}+|{fixed.TRIMMED}+\\z", "")
    return F.translate(text, fixed.SPACES, " " * len(fixed.SPACES))


def _words_of_lines(text: Column, keep) -> Column:
    """Cells and lines in order, each with the words that are kept; empty cells and lines go."""
    cell = lambda c: F.array_join(F.filter(F.split(c, " "), lambda w: (w != "") & keep(w)), " ")
    line = lambda x: F.array_join(F.filter(F.transform(F.split(x, "\t"), cell), lambda c: c != ""), "\t")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), line), lambda x: x != ""), "\n")


def stripped(word: Column) -> Column:
    """A word without special characters at its ends."""
    ascii_ = F.btrim(word, F.lit(ASCII_SPECIALS))
    return F.when(ascii_.rlike(_PLAIN), ascii_).otherwise(F.btrim(ascii_, F.lit(SPECIALS)))


def remove_words_with(text: Column, substrings: Sequence[str] = fixed.BAD_SUBSTRINGS) -> Column:
    def found(w: Column) -> Column:
        out = F.lit(False)
        for s in substrings:
            out = out | F.contains(w, F.lit(s))
        return out

    # Only a word that holds a substring is stripped, to see whether it still does.
    keep = lambda w: ~(found(w) & found(stripped(w)))
    return _words_of_lines(text, keep)


def remove_long_words(text: Column, min_len: int = 1, max_len: int = (1 << 31) - 1) -> Column:
    return _words_of_lines(text, lambda w: F.length(w).between(min_len, max_len) | F.length(stripped(w)).between(min_len, max_len))


def clean_copyright(text: Column) -> Column:
    """Cuts the first block comment if it speaks of copyright. Only without any block comment, leading comment and empty lines go."""
    block = F.regexp_extract(text, f"({fixed.BLOCK_COMMENT})", 1)
    cut = F.regexp_replace(text, f"(?s)^(.*?){fixed.BLOCK_COMMENT}(.*)$", "$1$2")
    head = F.regexp_replace(text, r"^(?:(?://|#|--)[^\n]*(?:\n|\z)|\n)+", "")
    return F.when(block == "", head).when(F.contains(F.lower(block), F.lit("copyright")), cut).otherwise(text)


def clean_caption(text: Column) -> Column:
    """Lower case, some punctuation as spaces, runs of two or more spaces as one, no space at the ends."""
    text = F.regexp_replace(F.lower(text), r"[.!\"()*#:;~]", " ")
    return F.regexp_replace(F.rtrim(F.regexp_replace(text, r"\s{2,}", " "), F.lit("\n")), r"^ +| +$", "")


def truncate_caption(text: Column, words: int = 30) -> Column:
    parts = F.split(text, " ")
    return F.when(F.size(parts) > words, F.array_join(F.slice(parts, 1, words), " ")).otherwise(text)


def join_nonempty(*parts: Column) -> Column:
    """The trimmed parts that aren't empty, with an empty line between them."""
    trimmed = [F.regexp_replace(text_of(p), f"^{fixed.TRIMMED}+|{fixed.TRIMMED}+$", "") for p in parts]
    return F.array_join(F.filter(F.array(*trimmed), lambda x: x != ""), "\n\n")


# Statistics


def ratio(part: Column, of: Column) -> Column:
    return F.when(of > 0, part.cast("double") / of).otherwise(F.lit(0.0))


def alnum_ratio(text: Column) -> Column:
    return ratio(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(text))


def alpha_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def special_ratio(text: Column) -> Column:
    return ratio(F.length(text) - F.length(F.translate(text, SPECIALS, "")), F.length(text))


def lines(text: Column) -> Column:
    """The lines, without an empty one after a last line end; none for an empty text."""
    return F.split(F.regexp_replace(text, f"(?:{fixed.LINE_END})\\z", ""), fixed.LINE_END)


def average_line_length(text: Column) -> Column:
    return F.when(text == "", F.lit(0.0)).otherwise(F.length(text) / F.size(lines(text)))


def maximum_line_length(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.array_max(F.transform(lines(text), F.length)))


def text_length(text: Column) -> Column:
    return F.length(text)


def words(text: Column, lower: bool = False, strip: bool = True) -> Column:
    """Words between spaces, line feeds and tabs, without special characters at their ends; empty ones go."""
    found = F.filter(F.split(F.lower(text) if lower else text, "[ \n\t]"), lambda w: w != "")
    return F.filter(F.transform(found, stripped), lambda w: w != "") if strip else found


def words_num(text: Column) -> Column:
    """How many words have a character that isn't special; that is how many words() gives."""
    return F.size(F.filter(F.split(F.translate(text, IN_WORDS, ""), "[ \n\t]"), lambda w: w != ""))


def listed_ratio(text: Column, listed: Sequence[str]) -> Column:
    """The share of lower-cased words that are in the list, 1 at most."""
    raw = F.filter(F.split(F.lower(text), "[ \n\t]"), lambda w: w != "")
    hits = F.size(F.filter(raw, lambda w: stripped(w).isin(*listed))) if listed else F.lit(0)
    return F.least(F.lit(1.0), ratio(hits, words_num(text)))


# Image text records


def chunks(text: Column, end: str = "<|__dj__eoc|>") -> Column:
    """The parts between end marks that have more than white space."""
    return F.filter(F.split(text, "\\Q" + end + "\\E"), lambda c: F.trim(c) != "")


def rooted(paths: Column, root: str) -> Column:
    """Relative paths below a root; absolute ones unchanged."""
    return F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p)))
