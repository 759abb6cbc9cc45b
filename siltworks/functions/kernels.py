"""Text operations that Spark's functions can't express well, as functions of a text: links, because the pattern backtracks without end in Java's
engine; text repair; tokenizers, because they are Python libraries."""

from __future__ import annotations

import unicodedata

import regex

from . import fixed

_LINK = regex.compile(fixed.LINK, regex.DOTALL)
_SPECIAL = "".join(fixed.special_characters())
#: Quotes and ligatures that text repair straightens.
REPAIRED = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
_REPAIR = str.maketrans(REPAIRED | {chr(c): None for c in (*range(0, 9), 11, *range(14, 32), 0x7F, 0xFEFF)})


def clean_links(text: str) -> str:
    """Links hold a colon, a slash or www."""
    return _LINK.sub("", text) if ":" in text or "/" in text or "www" in text.lower() else text


def _unmangled(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read as UTF-8 again, where the whole text allows it."""
    for encoding in ("cp1252", "latin-1"):
        try:
            again = text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        if again != text:
            return again
    return text


def fix_unicode(text: str, form: str = "NFC") -> str:
    """A subset of the usual text repair: mangled UTF-8, line ends, quotes, ligatures and control characters, then normalisation."""
    if not text.isascii():
        text = _unmangled(text)
    return unicodedata.normalize(form, text.replace("\r\n", "\n").replace("\r", "\n").translate(_REPAIR))


def refined_words(text: str, lower: bool = True) -> list[str]:
    found = text.replace("\n", " ").replace("\t", " ").split(" ")
    return [w for w in ((w.lower() if lower else w).strip(_SPECIAL) for w in found if w) if w]


_PIECES: dict = {}


def pieces_of(path: str):
    """The tokenizer of a SentencePiece model file, loaded once a worker."""
    if path not in _PIECES:
        import sentencepiece

        _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PIECES[path]


def tokens(text: str, model: str | None, lower: bool) -> list[str]:
    if model is None:
        return refined_words(text, lower)
    found = pieces_of(model).encode(text, out_type=str)
    return [w for w in ((w.lower() if lower else w).strip(_SPECIAL) for w in found) if w]
