"""The word model holds every word, however few of them are kept in memory."""

import pytest

from siltworks.functions import scorers
from siltworks.plans.pipeline import Step, lower

TEXTS = ["the cat and the dog", "the rare zebra\nand the rarer okapi and okapi", "unseen", "", None, "the cat and the dog", "a b c d e f g h"]


def test_words_beyond_memory_count(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    seen = docs.filter("text <> 'unseen'")
    whole, few = scorers.fit_words(seen), scorers.fit_words(seen, most=2)
    assert whole.tail is None and few.tail.count() == len(whole.logs) - 2 and len(few.logs) == len(few.hashes) == 2

    def scores(model):
        step = Step("ppl", "perplexity", {"model": model})
        return {r.doc_id: r.stat_ppl for r in lower(docs, [Step("len", "text_length"), step], annotate=True).collect()}

    want = {i: whole.perplexity(t or "") for i, t in enumerate(TEXTS)}
    assert scores(whole) == pytest.approx(want) and scores(few) == pytest.approx(want, abs=0.11)
    bound = want[1] + 0.05
    kept = lower(docs, [Step("ppl", "perplexity", {"model": few}, high=bound), Step("rep", "char_repetition", {"n": 3})])
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v <= bound}
    with pytest.raises(ValueError):
        few.perplexity("a")
