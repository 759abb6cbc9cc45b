"""Numbers that fill the space of their length get longer surrogates, and the job ends."""

import re

from siltworks.llm.pii import pii_surrogates


def test_short_phones_and_addresses_without_free_values(spark):
    texts = [f"+1{n:02d}" for n in range(100)] + [f"+1-{n}" for n in range(200, 260)] + [f"0:0:0:0:0:0:{n // 10}:{n % 10}" for n in range(20)] + ["+1 (00)"]
    docs = spark.createDataFrame([(i, f"call {t} now") for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in pii_surrogates(docs, "a key").collect()}
    got = [re.fullmatch("call (.*) now", out[i].text)[1] for i in range(len(texts))]
    assert all(out[i].pii_count == 1 for i in range(len(texts)))
    bare = [re.sub("[^0-9a-f:]", "", v) for v in got]
    real = {re.sub("[^0-9a-f:]", "", t) for t in texts}
    assert len(set(bare[:-1])) == len(texts) - 1 and not set(bare) & real
    assert bare[-1] == bare[0] and re.fullmatch(r"\+\d \(\d{2,}\)", got[-1])  # one number in two forms, in the format of each
    assert all(re.fullmatch(r"\+1\d{3,6}", v) for v in got[:100]) and all(re.fullmatch(r"\+1-\d{3,6}", v) for v in got[100:160])
