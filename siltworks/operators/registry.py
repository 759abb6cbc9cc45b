"""The operators of text pipelines by name: what each computes and where it runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..functions import kernels, measures, scorers, text


@dataclass(frozen=True)
class Operator:
    """kind: map or filter. A filter's value is a statistic, which is kept within bounds.

    column: a function of a Column, None if Spark's functions can't express it. one: a function of one text (map) or one Doc (filter), for
    passes over Arrow batches. many: a function of a list of texts, for scorers that want them together. speed is a rough prior in
    microseconds for a thousand characters in such a pass, until a profile says more.
    """

    kind: str
    column: Callable[..., Any] | None
    one: Callable[..., Any] | None
    speed: float
    many: Callable[..., Any] | None = None

    @property
    def engine(self) -> str:
        return "native" if self.column else "kernel"

    def build(self, **args) -> Callable:
        """The function with its arguments: of a Column if there is one, else of one text or Doc, or of a list."""
        f = self.column or self.one or self.many
        return lambda x: f(x, **args)


OPERATORS: dict[str, Operator] = {
    "clean_email": Operator("map", text.clean_email, measures.clean_email, 2),
    "clean_links": Operator("map", None, kernels.clean_links, 20),
    "clean_copyright": Operator("map", text.clean_copyright, measures.clean_copyright, 1),
    "fix_unicode": Operator("map", None, kernels.fix_unicode, 8),
    "normalize_punctuation": Operator("map", text.normalize_punctuation, measures.normalize_punctuation, 4),
    "normalize_whitespace": Operator("map", text.normalize_whitespace, measures.normalize_whitespace, 5),
    "remove_words_with": Operator("map", text.remove_words_with, measures.remove_words_with, 80),
    "remove_long_words": Operator("map", text.remove_long_words, measures.remove_long_words, 25),
    "clean_caption": Operator("map", text.clean_caption, None, 20),
    "truncate_caption": Operator("map", text.truncate_caption, None, 10),
    "text_length": Operator("filter", text.text_length, measures.text_length, 0.1),
    "average_line_length": Operator("filter", text.average_line_length, measures.average_line_length, 0.5),
    "maximum_line_length": Operator("filter", text.maximum_line_length, measures.maximum_line_length, 0.5),
    "alnum_ratio": Operator("filter", text.alnum_ratio, measures.alnum_ratio, 3),
    "special_ratio": Operator("filter", text.special_ratio, measures.special_ratio, 3),
    "words_num": Operator("filter", text.words_num, measures.words_num, 15),
    "flagged_ratio": Operator("filter", text.listed_ratio, measures.listed_ratio, 18),
    "stopwords_ratio": Operator("filter", text.listed_ratio, measures.listed_ratio, 18),
    "char_repetition": Operator("filter", None, measures.char_repetition, 60),
    "word_repetition": Operator("filter", None, measures.word_repetition, 40),
    "token_count": Operator("filter", None, measures.token_count, 15),
    "alpha_per_token": Operator("filter", None, measures.alpha_per_token, 8),
    "language_score": Operator("filter", None, measures.language_score, 80),
    "perplexity": Operator("filter", None, measures.perplexity, 70),
    "score": Operator("filter", None, None, 5000, scorers.score),
}
