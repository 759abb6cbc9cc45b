"""The refinement recipes as data: fixed mappers, then filters with their published bounds."""

from __future__ import annotations

from collections.abc import Sequence

from .pipeline import Step

#: The statistic and, where it has one, the tag of each filter; bounds are (low, high), None where a recipe has none.
_MAPPERS = {"email": "clean_email", "links": "clean_links", "copyright": "clean_copyright", "unicode": "fix_unicode", "punctuation": "normalize_punctuation", "space": "normalize_whitespace", "bad_words": "remove_words_with", "long_words": "remove_long_words"}
_FILTERS = {
    "alnum": ("alnum_ratio", {}),
    "alpha_token": ("alpha_per_token", {}),
    "avg_line": ("average_line_length", {}),
    "char_rep": ("char_repetition", {"n": 10}),
    "flagged": ("flagged_ratio", {"listed": ()}),
    "stopwords": ("stopwords_ratio", {"listed": ()}),
    "lang": ("language_score", {}),
    "max_line": ("maximum_line_length", {}),
    "ppl": ("perplexity", {}),
    "special": ("special_ratio", {}),
    "length": ("text_length", {}),
    "words": ("words_num", {}),
    "tokens": ("token_count", {}),
    "word_rep": ("word_repetition", {"n": 10}),
    "word_rep_5": ("word_repetition", {"n": 5}),
}
_USUAL = ("email", "links", "unicode", "punctuation", "space")
_LINE_LOW = 10  # of average_line_length and maximum_line_length where a recipe gives only the upper bound

# The mappers and the bounds of each recipe.
RECIPES: dict[str, tuple[tuple[str, ...], dict[str, tuple[float | None, float | None]]]] = {
    "redpajama_c4": (_USUAL, {"alnum": (0.65, 0.9), "avg_line": (_LINE_LOW, 3000), "char_rep": (0, 0.3), "lang": (0.6, None), "max_line": (_LINE_LOW, 4000), "ppl": (None, 6000), "special": (0, 0.4), "tokens": (20, 10000), "word_rep": (0, 0.231)}),
    "stackexchange": (_USUAL, {"alnum": (0.35, 0.943), "avg_line": (20, 400), "char_rep": (0, 0.4), "flagged": (0, 0.01), "lang": (0.1, None), "max_line": (80, None), "ppl": (None, 10000), "special": (0.232, 0.7), "length": (200, None), "tokens": (100, None), "word_rep": (0, 0.8)}),
    "pile_europarl": (_USUAL, {"alnum": (0.75, 0.9), "avg_line": (_LINE_LOW, 588), "char_rep": (0, 0.16), "flagged": (0, 0.0007), "lang": (0.7, None), "max_line": (_LINE_LOW, 4000), "ppl": (None, 7596), "special": (0, 0.3), "length": (0, 200000), "tokens": (20, 100000), "word_rep": (0, 0.2)}),
    "pile_hackernews": (("email", "unicode", "punctuation", "space"), {"alnum": (0.2, None), "avg_line": (15, None), "char_rep": (0, 0.3), "flagged": (0, 0.05), "lang": (0.2, None), "max_line": (20, None), "ppl": (None, 10000), "special": (0, 0.7), "length": (100, None), "tokens": (30, None), "word_rep": (0, 0.8)}),
    "pile_pubmed_abstracts": (_USUAL, {"alnum": (0.7, 0.881), "avg_line": (_LINE_LOW, 2100), "char_rep": (0, 0.2), "flagged": (0, 0.00232), "lang": (0.5, None), "max_line": (_LINE_LOW, 4000), "ppl": (None, 4000), "special": (0, 0.38), "length": (0, 4000), "tokens": (20, 700), "word_rep": (0, 0.0887)}),
    "pile_freelaw": (_USUAL, {"alnum": (0.3, None), "avg_line": (_LINE_LOW, 697), "char_rep": (0, 0.4), "flagged": (0, 0.0053), "lang": (0.5, None), "max_line": (_LINE_LOW, 4229), "ppl": (None, 5322), "special": (0, 0.7), "stopwords": (0.1, None), "length": (0, 84026), "tokens": (100, 15208), "word_rep": (0, 0.155)}),
    "pile_uspto_backgrounds": (_USUAL, {"alnum": (0.7, None), "avg_line": (_LINE_LOW, 2000), "char_rep": (0, 0.2), "flagged": (0, 0.0016), "lang": (0.6, None), "max_line": (_LINE_LOW, 3061), "ppl": (None, 4000), "special": (0, 0.3), "length": (0, 21556), "tokens": (100, 6000), "word_rep": (0, 0.169)}),
    "redpajama_arxiv": (_USUAL, {"alnum": (0.516, 0.915), "avg_line": (_LINE_LOW, 682), "char_rep": (0, 0.3), "flagged": (0, 0.00076), "max_line": (_LINE_LOW, 4000), "ppl": (None, 8000), "special": (0, 0.6), "length": (0, 350000), "tokens": (20, 100000), "word_rep": (0, 0.574)}),
    "redpajama_code": (("email", "links", "unicode", "punctuation", "space", "copyright"), {"alnum": (0.4, 0.8), "alpha_token": (1.5, 3.0), "avg_line": (15, 100), "char_rep": (0.05, 0.3), "max_line": (50, 500), "length": (300, None), "words": (30, 5000), "word_rep": (0, 0.1)}),
    "bloom_oscar": (("space", "punctuation", "unicode", "bad_words", "long_words"), {"lang": (0.8, None), "words": (20, 100000), "char_rep": (0, 0.106), "word_rep_5": (0, 0.19), "special": (0, 0.4), "stopwords": (0.3, None), "flagged": (0, 0.01), "ppl": (None, 1500)}),
    "alpaca_cot": ((), {"alnum": (0.1, None), "char_rep": (0, 0.6), "flagged": (0, 0.017), "max_line": (20, None), "length": (30, None)}),
    "llava_pretrain_text": (("unicode", "punctuation"), {"alnum": (0.6, 1.0), "char_rep": (0, 0.09373663), "flagged": (0, 0.0), "ppl": (None, 14435.5806), "special": (0.16534802, 0.42023757), "word_rep": (0, 0.03085751)}),
}


def recipe(name: str) -> list[Step]:
    """The steps of a recipe in its declared order. Mappers are fixed; filters may change places."""
    mappers, filters = RECIPES[name]
    steps = [Step(tag, _MAPPERS[tag], {"max_len": 25} if tag == "long_words" else {}, fixed=True) for tag in mappers]
    for tag, (low, high) in filters.items():
        op, args = _FILTERS[tag]
        steps.append(Step(tag, op, dict(args), low, high))
    if name == "bloom_oscar":  # its language filter comes before the mappers and stays there
        lang = next(s for s in steps if s.tag == "lang")
        rest = [s for s in steps if s.tag != "lang"]
        steps = [Step("lang", lang.op, {"lang": "en"}, lang.low, lang.high, fixed=True), *rest]
    return steps


def declared(name: str) -> Sequence[str]:
    return [s.tag for s in recipe(name)]
