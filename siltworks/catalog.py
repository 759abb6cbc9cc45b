"""The queries of the library's own operators over the driver's tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed, kernels, scorers, text
from .operators import media, records, rows
from .plans import profile
from .plans.pipeline import Step, funnel, lower, spread, with_args
from .plans.recipes import RECIPES, recipe
from .sources import readers

Query = Callable[[SparkSession, str], DataFrame]

STOPWORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "der", "die", "und", "le", "la", "de", "que", "el")
FLAGGED = ("idiot", "stupid", "moron", "trash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the operators, as expressions of a text

_CLASS = fixed.special_class()
_TRIM = fixed.TRIMMED


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(t: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({t}, {_q(pattern)}, {_q(to)}, 'g')"


def _punct_sql(t: str) -> str:
    one = {a: b for a, b in fixed.PUNCTUATION.items() if len(b) == 1}
    t = f"translate({t}, {_q(''.join(one))}, {_q(''.join(one.values()))})"
    for a, b in fixed.PUNCTUATION.items():
        if len(b) > 1:
            t = f"replace({t}, {_q(a)}, {_q(b)})"
    return t


def _space_sql(t: str) -> str:
    spaces = "".join(f"\\x{{{ord(c):x}}}" for c in fixed.SPACES)
    return _sub(_sub(t, f"^{_TRIM}+|{_TRIM}+\\z"), f"[{spaces}]", " ")


def _strip_sql(w: str) -> str:
    return _sub(w, f"^[{_CLASS}]+|[{_CLASS}]+\\z")


def _lines_sql(t: str) -> str:
    return f"string_split_regex({_sub(t, '(?:' + fixed.LINE_END + ')\\z')}, {_q(fixed.LINE_END)})"


def _words_sql(t: str, lower_case: bool) -> str:
    t = f"lower({t})" if lower_case else t
    return f"[w for w in [{_strip_sql('v')} for v in string_split_regex({t}, '[ \\n\\t]') if v <> ''] if w <> '']"


def _merge_sql(t: str, keep: str) -> str:
    cell = f"array_to_string([w for w in string_split(c, ' ') if w <> '' and ({keep})], ' ')"
    line = f"array_to_string([y for y in [{cell} for c in string_split(x, chr(9))] if y <> ''], chr(9))"
    return f"array_to_string([z for z in [{line} for x in string_split({t}, chr(10))] if z <> ''], chr(10))"


def _ratio_sql(part: str, of: str) -> str:
    return f"case when ({of}) > 0 then ({part})::double / ({of}) else 0.0 end"


def _listed_sql(t: str, listed: tuple[str, ...]) -> str:
    words = _words_sql(t, True)
    hits = f"len([w for w in {words} if list_contains([{', '.join(map(_q, listed))}], w)])"
    return f"least(1.0, {_ratio_sql(hits, f'len({words})')})"


_BAD = " and ".join(f"not contains({_strip_sql('w')}, {_q(s)})" for s in fixed.BAD_SUBSTRINGS)
_BLOCK = f"regexp_extract(t, {_q('(' + fixed.BLOCK_COMMENT + ')')}, 1)"
_SQL: dict[str, Callable[..., str]] = {
    "clean_email": lambda t: _sub(t, fixed.EMAIL),
    "normalize_punctuation": _punct_sql,
    "normalize_whitespace": _space_sql,
    "remove_words_with": lambda t: _merge_sql(t, _BAD),
    "remove_long_words": lambda t, max_len=25: _merge_sql(t, f"length(w) between 1 and {max_len} or length({_strip_sql('w')}) between 1 and {max_len}"),
    "clean_copyright": lambda t: f"case when {_BLOCK.replace('(t,', f'({t},', 1)} = '' then {_sub(t, '^(?:(?://|#|--)[^' + chr(92) + 'n]*(?:' + chr(92) + 'n|' + chr(92) + 'z)|' + chr(92) + 'n)+')} when contains(lower({_BLOCK.replace('(t,', f'({t},', 1)}), 'copyright') then regexp_replace({t}, {_q('(?s)^(.*?)' + fixed.BLOCK_COMMENT + '(.*)$')}, {_q(chr(92) + '1' + chr(92) + '2')}) else {t} end",
    "clean_caption": lambda t: _sub(_sub(_sub(f"lower({t})", r"[.!\"()*#:;~]", " "), r"[ \t\n\v\f\r]{2,}", " "), r"\n+\z|^ +| +\z"),
    "truncate_caption": lambda t, words=30: f"array_to_string(string_split({t}, ' ')[1:{words}], ' ')",
    "text_length": lambda t: f"length({t})",
    "average_line_length": lambda t: f"case when {t} = '' then 0.0 else length({t})::double / len({_lines_sql(t)}) end",
    "maximum_line_length": lambda t: f"case when {t} = '' then 0 else list_max([length(x) for x in {_lines_sql(t)}]) end",
    "alnum_ratio": lambda t: _ratio_sql(f"length({_sub(t, r'[^\p{L}\p{N}]')})", f"length({t})"),
    "special_ratio": lambda t: _ratio_sql(f"length({t}) - length({_sub(t, f'[{_CLASS}]')})", f"length({t})"),
    "words_num": lambda t: f"len({_words_sql(t, False)})",
    "flagged_ratio": _listed_sql,
    "stopwords_ratio": _listed_sql,
    "clean_links": lambda t: _sub(t, fixed.LINK),
    "fix_unicode": lambda t: _unicode_sql(t),
    "char_repetition": lambda t, n=10: _grams_sql(f"[substr({t}, i::int, {n}) for i in generate_series(1, length({t}) - {n - 1})]", "list_sum(v[1:least(floor(sqrt(len(v)))::int, len([x for x in v if x > 1]))])"),
    "word_repetition": lambda t, n=10: "coalesce([" + _grams_sql(f"[array_to_string(w[i:i + {n - 1}], ' ') for i in generate_series(1, len(w) - {n - 1})]", "list_sum([x for x in v if x > 1])") + f" for w in [{_words_sql(t, True)}]][1], 0.0)",
    "token_count": lambda t: f"len({_words_sql(t, False)})",
    "alpha_per_token": lambda t: _ratio_sql(f"length({_sub(t, r'[^\p{L}]')})", f"len({_split_sql(t)})"),
}


def _unicode_sql(t: str) -> str:
    """Without the repair of mangled UTF-8, which tests compare on literals."""
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for a, b in kernels.REPAIRED.items():
        t = f"replace({t}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize({_sub(t, r'[\x{1}-\x{8}\x{b}\x{e}-\x{1f}\x{7f}\x{feff}]')})"


def _grams_sql(grams: str, part: str) -> str:
    """The share that a part of the counts of all n-grams, largest first, has of them."""
    return f"coalesce([{part}::double / list_sum(v) for v in [list_reverse_sort(map_values(list_aggregate({grams}, 'histogram')))]][1], 0.0)"


def _split_sql(t: str) -> str:
    return f"[x for x in string_split_regex({t}, {_q(_TRIM + '+')}) if x <> '']"


# The stand-in models, fitted as functions/scorers.py does.

_MODELS = r"""
ls as materialized (select text as t, lang as l from documents where length(text) between 20 and 5000 and lang is not null order by md5(text), lang limit 2000),
lg as materialized (select l, substr(p, i::int, 3) as g, count(*) as c from (select l, p, unnest(generate_series(1, length(p) - 2)) as i from (select l, ' ' || replace(lower(t), chr(10), ' ') || ' ' as p from ls)) group by all),
lt as materialized (select l, sum(c) as n from lg group by 1),
lk as materialized (select l, g, ln(c::double / n) as log from (select *, row_number() over (partition by l order by c desc, g) as k from lg) join lt using (l) where k <= 3000),
wc as materialized (select w, count(*) as c from (select unnest(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]+')) as w from documents) where w <> '' group by 1),
wt as materialized (select sum(c) as n from wc),
wl as materialized (select w, round(log10(c::double / n) * 1000000000)::bigint as log from wc, wt)"""


def _language_sql(source: str, k: int, lang: str | None) -> tuple[str, str]:
    """CTEs that end in x<k> (rid, stat), and the value of documents that aren't in it."""
    share = "1 / sum(exp(greatest(-700.0, v - top)))"
    stat = share if lang is None else f"case when any_value(best) = {_q(lang)} then {share} else 0.0 end"
    ctes = f"""
g{k} as materialized (select rid, substr(p, i::int, 3) as g, count(*) as c from (select rid, p, unnest(generate_series(1, length(p) - 2)) as i from (select rid, ' ' || replace(lower(text), chr(10), ' ') || ' ' as p from {source})) group by all),
n{k} as (select rid, greatest(1.0, sum(c) / 50.0) as n from g{k} group by 1),
v{k} as materialized (select g.rid, lt.l, sum(g.c * coalesce(lk.log, ln(0.5 / lt.n))) / any_value(m.n) as v from g{k} g cross join lt join n{k} m using (rid) left join lk on lk.l = lt.l and lk.g = g.g group by 1, 2),
x{k} as materialized (select rid, {stat} as stat from (select *, max(v) over (partition by rid) as top, first(l) over (partition by rid order by v desc, l) as best from v{k}) group by rid)"""
    alone = "(select 1.0 / count(*) from lt)"
    return ctes, alone if lang is None else f"(select case when min(l) = {_q(lang)} then 1.0 / count(*) else 0.0 end from lt)"


def _perplexity_sql(source: str, k: int) -> tuple[str, str]:
    ctes = f"""
w{k} as (select rid, len(ws) + lines as n, lines, ws from (select rid, {_split_sql('lower(text)')} as ws, case when text = '' then 0 else len({_lines_sql('text')}) end as lines from {source})),
u{k} as (select rid, sum(coalesce(log, round(log10(0.1 / (select n from wt)) * 1000000000)::bigint)) as s from (select rid, unnest(ws) as w from w{k}) left join wl using (w) group by 1),
x{k} as materialized (select rid, case when n > 0 then round(pow(10.0, -(coalesce(s, 0) - 2000000000::bigint * lines) / 1000000000.0 / n), 1) else 0.0 end as stat from w{k} left join u{k} using (rid))"""
    return ctes, "0.0"


def _annotated_sql(steps: list[Step]) -> tuple[str, str]:
    """WITH of a chain, and the table at its end: doc_id, text and the statistic s_<tag> of each filter."""
    ctes, at = [], "d0"
    if any(s.op in ("language_score", "perplexity") for s in steps):
        ctes.append(_MODELS)
    ctes.append("\nd0 as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents)")
    for k, s in enumerate(steps, 1):
        if s.op in ("language_score", "perplexity"):
            more, alone = _language_sql(at, k, s.args.get("lang")) if s.op == "language_score" else _perplexity_sql(at, k)
            ctes += [more, f"\nd{k} as materialized (select d.*, coalesce(x.stat, {alone}) as s_{s.tag} from {at} d left join x{k} x using (rid))"]
        else:
            args = {a: v for a, v in s.args.items() if a in ("n", "listed", "max_len", "words")}
            value = _SQL[s.op]("text", **args)
            ctes.append(f"\nd{k} as materialized (select * replace ({value} as text) from {at})" if s.operator.kind == "map" else f"\nd{k} as materialized (select *, ({value})::double as s_{s.tag} from {at})")
        at = f"d{k}"
    return "with " + ",".join(ctes), at


def _within_sql(s: Step) -> str:
    tests = [f"s_{s.tag} >= {s.low}"] * (s.low is not None) + [f"s_{s.tag} <= {s.high}"] * (s.high is not None)
    return " and ".join(tests) or "true"


def _doc_sql(expressions: str) -> str:
    return f"with d as (select doc_id, coalesce(text, '') as t from documents) select doc_id, {expressions} from d"


# Single operators


def _mapped(op: str, **args) -> tuple[Query, str]:
    step = Step("x", op, args)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lower(table(spark, sf_dir, "documents").select("doc_id", "text"), [step])

    return run, _doc_sql(f"{_SQL[op]('t', **args)} as text")


def _stat(op: str, **args) -> tuple[Query, str]:
    step = Step("x", op, args)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return lower(docs, [step], annotate=True).select("doc_id", F.round("stat_x", 9).alias("stat"))

    return run, _doc_sql(f"round(({_SQL[op]('t', **args)})::double, 9) as stat")


def char_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lower(docs, [Step("x", "char_repetition", {"n": 10})], annotate=True).select("doc_id", F.round("stat_x", 9).alias("stat"))


_CHAR_REPETITION = """
with g as (select doc_id, substr(text, i, 10) as g from (select doc_id, text, unnest(generate_series(1, length(text) - 9)) as i from documents where length(text) >= 10)),
c as (select doc_id, g, count(*) as n from g group by all),
r as (select doc_id, n, row_number() over (partition by doc_id order by n desc) as k, count(*) over (partition by doc_id) as kinds, sum(case when n = 1 then 1 else 0 end) over (partition by doc_id) as single, sum(n) over (partition by doc_id) as total from c),
s as (select doc_id, sum(case when k <= least(floor(sqrt(kinds)), kinds - single) then n else 0 end)::double / max(total) as stat from r group by doc_id)
select d.doc_id as doc_id, round(coalesce(s.stat, 0.0), 9) as stat from documents d left join s using (doc_id)
"""


def word_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lower(docs, [Step("x", "word_repetition", {"n": 5})], annotate=True).select("doc_id", F.round("stat_x", 9).alias("stat"))


_WORD_REPETITION = f"""
with w as (select doc_id, {_words_sql("coalesce(text, '')", True)} as ws from documents),
g as (select doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) as i from w where len(ws) >= 5)),
c as (select doc_id, g, count(*) as n from g group by all),
s as (select doc_id, sum(case when n > 1 then n else 0 end)::double / sum(n) as stat from c group by doc_id)
select d.doc_id as doc_id, round(coalesce(s.stat, 0.0), 9) as stat from documents d left join s using (doc_id)
"""


# Recipes


def _steps(name: str, docs: DataFrame | None = None) -> list[Step]:
    """A recipe with word lists, and with the stand-in models fitted on docs."""
    steps = with_args(recipe(name), flagged_ratio={"listed": FLAGGED}, stopwords_ratio={"listed": STOPWORDS})
    if docs is None:
        return steps
    ops = {s.op for s in steps}
    models = {"language_score": scorers.fit_language, "perplexity": scorers.fit_words}
    texts = {"language_score": docs, "perplexity": spread(docs.select("text"))}  # all words are counted, but few texts tell languages
    return with_args(steps, **{op: {"model": fit(texts[op])} for op, fit in models.items() if op in ops})


def _recipe(name: str) -> tuple[Query, str]:
    """What is left of the documents, in the order that a profile of a sample makes cheapest."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        steps, rows = _steps(name, docs), docs.select("doc_id", "text")
        return lower(spread(rows), profile.planned(rows, steps))

    steps = _steps(name)
    ctes, at = _annotated_sql(steps)
    return run, f"{ctes}\nselect doc_id, text from {at} where {' and '.join(_within_sql(s) for s in steps if s.operator.kind == 'filter')}"


def _funnel(name: str) -> tuple[Query, str]:
    """How many documents each filter of a recipe sees and keeps, in the declared order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        return funnel(spread(docs.select("doc_id", "text")), _steps(name, docs))

    steps = _steps(name)
    ctes, at = _annotated_sql(steps)
    filters = [s for s in steps if s.operator.kind == "filter"]
    parts = []
    for i, s in enumerate(filters):
        seen = " and ".join(_within_sql(o) for o in filters[:i]) or "true"
        parts.append(f"select {i} as step, {_q(s.tag)} as tag, count(*) filter (where {seen}) as rows_in, count(*) filter (where {seen} and {_within_sql(s)}) as rows_out from {at}")
    return run, f"{ctes}\n" + " union all ".join(parts)


def _model_stat(op: str, **args) -> tuple[Query, str]:
    """The statistic of a stand-in model that is fitted on the documents."""
    fit = {"language_score": scorers.fit_language, "perplexity": scorers.fit_words}[op]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        rows = lower(spread(docs.select("doc_id", "text")), [Step("x", op, {"model": fit(spread(docs.select("text", "lang"))), **args})], annotate=True)
        return rows.select("doc_id", F.round("stat_x", 6).alias("stat"))

    ctes, at = _annotated_sql([Step("x", op, args)])
    return run, f"{ctes}\nselect doc_id, round(s_x, 6) as stat from {at}"


def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stat = lower(docs, [Step("x", "special_ratio")], annotate=True)
    return profile.thresholds(stat, "stat_x", (0.5, 0.8, 0.9, 0.95), True).select("retention", F.round("threshold", 9).alias("threshold"))


_THRESHOLDS = f"with s as (select ({_SQL['special_ratio']("coalesce(text, '')")})::double as x from documents) select r as retention, round((select quantile_cont(x, [0.5, 0.8, 0.9, 0.95]) from s)[i], 9) as threshold from (values (0.5::double, 1), (0.8::double, 2), (0.9::double, 3), (0.95::double, 4)) v(r, i)"


# Rows


def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.prefix(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, ["doc_id"])


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.shard(table(spark, sf_dir, "documents").select("doc_id", "source"), 3, 1, ["doc_id"])


def batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rows.batch(table(spark, sf_dir, "orders").select("o_orderkey"), 32, ["o_orderkey"])
    return got.select("batch", F.size("items").cast("long").alias("n"), F.transform("items", lambda x: x["o_orderkey"]).cast("string").alias("x")).select("batch", "n", F.array_join(F.split(F.regexp_replace("x", r"[\[\] ]", ""), ","), ",").alias("keys"))


def byte_capped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.byte_prefix(docs, 200_000, F.octet_length(text.text_of("text")) + 1, ["doc_id"]).select("doc_id")


def line_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.lines_of(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def json_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("text", F.col("lang").alias("meta"))).alias("value"))
    return readers.parse_json(docs, "value").select("doc_id", "raw_content", "meta")


def web_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some urls were read twice, with different pages: each row has the page that was read for it.
    return readers.web(table(spark, sf_dir, "pages"), stored="html").select("page_id", "url", F.octet_length("content").cast("long").alias("n_bytes"))


def detection_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images and their lines as annotations: the same left join of combined rows."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    images = orders.select(F.col("o_orderkey").alias("id"), F.lit("x").alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    box = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_linenumber", "l_linenumber", "l_quantity")])
    notes = items.select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("image_id"), box.alias("bbox"), F.col("l_partkey").alias("category_id"))
    out = readers.detection(images, notes)
    return out.select("image_id", F.size("boxes").cast("long").alias("n"), F.aggregate("boxes", F.lit(0.0), lambda a, b: a + F.get(b, F.lit(2))).alias("right"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"))


_DETECTION = """
with a as (select l_orderkey as id, count(*) as n, sum(l_quantity::double + l_linenumber) as r, sum(l_partkey) as s from lineitem group by 1)
select o_orderkey as image_id, coalesce(n, 0) as n, coalesce(r, 0.0)::double as "right", coalesce(s, 0)::bigint as labels from orders left join a on id = o_orderkey
"""


def conversation_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.captions(table(spark, sf_dir, "conversations"))


def instruction_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("instruction"), F.lit("  ").alias("input"), F.col("lang").alias("output"))
    return records.instructions(docs).select("doc_id", "raw_content")


def caption_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rounds(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"]).select("conv_id", "turn", F.col("round").cast("long").alias("round"))


def ordered_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.splits(table(spark, sf_dir, "documents").select("doc_id"), {"calibration": 50, "pilot": 30, "formal": 40}, ["doc_id"])


def matched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return records.matched(table(spark, sf_dir, "labels"), docs, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a list as a semi-join: documents that have a label."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def _vector(value: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", value(F.col("embedding")).alias("x"))
        return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v.cast("double"))), 6).alias("total"))

    return run


def token_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In single precision, as SQL has it: an integer factor would make it double, which floors 0.066 * 1000 to 65.
    ids = F.transform(F.col("embedding"), lambda v: F.floor(F.abs(v) * F.lit(1000).cast("float")).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", records.padded(records.token_ids(ids, most=254), 256).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.get("x", F.lit(0)).cast("long").alias("bos"))


def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.array(*[F.array(*[F.get("embedding", F.lit(4 * k + i)).cast("double") + (2.0 if i > 1 else 0.0) for i in range(4)]) for k in range(2)])
    ref = F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(records.boxes_overlap(boxes, ref)).alias("k", "share")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("share", 6).alias("share"))


_BOXES = """
with b as (select vec_id, k, embedding[4 * k + 1]::double as y0, embedding[4 * k + 2]::double as x0, embedding[4 * k + 3]::double + 2 as y1, embedding[4 * k + 4]::double + 2 as x1 from embeddings, (values (0::bigint), (1::bigint)) v(k))
select vec_id, k, round(case when (y1 - y0) * (x1 - x0) > 0 then greatest(0, least(y1, 1) - greatest(y0, 0)) * greatest(0, least(x1, 1) - greatest(x0, 0)) / ((y1 - y0) * (x1 - x0)) else 0 end, 6) as share from b
"""


# Rows and records that other operators are made of


def detection_file_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only orders with lines, and boxes relative to the frame."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    images = orders.select(F.col("o_orderkey").alias("id"), F.lit("x").alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    box = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_linenumber", "l_linenumber", "l_quantity")])
    notes = items.filter("l_linenumber > 2").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("image_id"), box.alias("bbox"), F.col("l_partkey").alias("category_id"))
    out = readers.detection(images, notes, empty=False, relative=True)
    return out.select("image_id", F.size("boxes").cast("long").alias("n"), F.round(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + F.aggregate(b, F.lit(0.0), lambda c, v: c + v)) * 1920, 3).alias("total"))


def noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.noop(table(spark, sf_dir, "benchmark"))


def fused_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plus = lambda d: d.withColumn("x", F.col("x") + 1)
    return rows.fused(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x")), [plus, lambda d: d.filter("x % 2 = 0"), plus])


def cached_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over rows that are kept after the first."""
    kept = rows.cached(table(spark, sf_dir, "documents").select("lang", F.length(text.text_of("text")).alias("n")))
    return kept.groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("n").alias("chars")).crossJoin(F.broadcast(kept.agg(F.max("n").alias("longest"))))


def text_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's caption, repaired and with plain punctuation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("caption"))
    return lower(docs, [Step("u", "fix_unicode"), Step("p", "normalize_punctuation")], text="caption")


def image_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image or a list of them, below a root unless a path is absolute."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.lit(None)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("p/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("/abs/"), F.col("page_id").cast("string"))).alias("image"))
    return media.rooted_records(media.image_records(pages), "/data/").select("page_id", F.array_join("images", ",").alias("images"))


def video_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("sentence_id"), F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("v"), F.col("conv_id").cast("string")))).alias("videos"), "text", "role")
    out = media.video_output(media.rooted_records(turns, "/videos", "videos"))
    return out.select("video_id", "sentence_id", F.array_join("videos", ",").alias("videos"), "text")


def output_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("text"), F.col("url").alias("raw_content"))
    return pages.select("page_id", records.output_text(pages).alias("out"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field changed, and views of a record collected into one array."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    changed = records.on_field(parts, "p_size", lambda c: c * 2)
    fanned = changed.withColumns({f"view{k}": F.col("p_size") + k for k in range(3)})
    return records.collected_views(fanned, 3).select("p_partkey", F.aggregate("views", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size("views").cast("long").alias("n"))


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.col("doc_id") % 40, (F.col("doc_id") * 7) % 90, F.col("doc_id") % 40)
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    got = records.embedded(docs, "ids", table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "doc_id")
    return got.select("doc_id", F.size("vectors").cast("long").alias("n"), F.round(F.aggregate("vectors", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0)).cast("double") + 2 * F.get(v, F.lit(1)).cast("double")), 6).alias("total"))


def _box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes a vector: (top, left, bottom, right) of its first eight values, moved by half of a unit."""
    boxes = F.array(*[F.array(*[F.get("embedding", F.lit(4 * k + i)).cast("double") + (0.9 if i > 1 else 0.1) for i in range(4)]) for k in range(2)])
    return table(spark, sf_dir, "embeddings").select("vec_id", boxes.alias("boxes"))


def boxes_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75, 2.5)])
    out = _box_rows(spark, sf_dir).select("vec_id", records.boxes_resized(F.col("boxes"), ref).alias("b"))
    return out.select("vec_id", F.round(F.aggregate(F.flatten("b"), F.lit(0.0), lambda a, v: a * 0.5 + v), 6).alias("mix"))


def boxes_that_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _box_rows(spark, sf_dir).select("vec_id", records.boxes_kept(F.col("boxes"), F.array(F.lit(1), F.lit(2))).alias("kept"))
    return out.select("vec_id", F.array_join(F.transform("kept", lambda x: x["label"].cast("string")), ",").alias("labels"))


def boxes_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored in a frame, and those of them that are sane there, counted."""
    out = _box_rows(spark, sf_dir).select("vec_id", records.boxes_flipped(F.col("boxes"), F.lit(1.2)).alias("b"))
    return out.select("vec_id", F.round(F.aggregate(F.flatten("b"), F.lit(0.0), lambda a, v: a * 0.5 + v), 6).alias("mix"), F.size(records.boxes_sane(F.col("b"), F.lit(1.2), F.lit(1.1), 0.2)).cast("long").alias("sane"))


def counted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.byte_prefix(docs, 100_000, F.octet_length(text.text_of("text")) + 1, [F.desc("doc_id")], least_rows=5).select("doc_id")


def resumed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.exact_prefix(docs, 150, F.octet_length(text.text_of("text")) + 1, 1 << 40, ["doc_id"], done=40).select("doc_id")


_B = "select vec_id, embedding, [embedding[1]::double + 0.1, embedding[2]::double + 0.1, embedding[3]::double + 0.9, embedding[4]::double + 0.9] as p, [embedding[5]::double + 0.1, embedding[6]::double + 0.1, embedding[7]::double + 0.9, embedding[8]::double + 0.9] as q from embeddings"


def _mix(values: list[str]) -> str:
    out = "0.0"
    for v in values:
        out = f"({out} * 0.5 + {v})"
    return f"round({out}, 6)"


def _in_frame(box: str) -> list[str]:
    return [f"({box}[{i + 1}] - {(0.25, 0.5)[i % 2]}) / {(0.5, 2.0)[i % 2]}" for i in range(4)]


def _flip(box: str) -> list[str]:
    return [f"(1.2 - {box}[3])", f"{box}[2]", f"(1.2 - {box}[1])", f"{box}[4]"]


def _kept(box: str, label: int) -> str:
    area = f"(({box}[3] - {box}[1]) * ({box}[4] - {box}[2]))"
    inside = f"greatest(0.0, least({box}[3], 1) - greatest({box}[1], 0)) * greatest(0.0, least({box}[4], 1) - greatest({box}[2], 0))"
    return f"case when {area} > 0 and {inside} / {area} > 0.5 then '{label}' end"


def _sane(box: str) -> str:
    a, b, c, d = _flip(box)
    return f"case when {c} - {a} >= 0.2 and {d} - {b} >= 0.2 and {a} >= 0 and {b} >= 0 and {c} <= 1.2 and {d} <= 1.1 then 1 else 0 end"


_RECORDS: dict[str, tuple[Query, str]] = {
    "source_detection_file": (detection_file_source, "select l_orderkey as image_id, count(*) as n, round(sum(l_quantity::double / 640 + l_linenumber::double / 480 + (l_quantity::double + l_linenumber) / 640 + (l_linenumber::double + l_quantity) / 480) * 1920, 3) as total from lineitem where l_linenumber > 2 and l_orderkey in (select o_orderkey from orders) group by 1"),
    "source_counted_prefix": (counted_prefix, "select doc_id from (select doc_id, row_number() over (order by doc_id desc) as n, sum(strlen(coalesce(text, '')) + 1) over (order by doc_id desc) as s from documents) where s <= 100000 or n = 1"),
    "source_resumed_prefix": (resumed_prefix, "select doc_id from (select doc_id, row_number() over (order by doc_id) as n from documents) where n > 40 and n <= 150"),
    "op_noop": (noop, "select * from benchmark"),
    "op_fused": (fused_chain, "select o_orderkey + 2 as x from orders where (o_orderkey + 1) % 2 = 0"),
    "op_cached": (cached_rows, "select lang, count(*) as n_rows, sum(length(coalesce(text, '')))::bigint as chars, (select max(length(coalesce(text, ''))) from documents) as longest from documents group by 1"),
    "map_text_normalizer": (text_normalizer, f"select doc_id, {_punct_sql(_SQL['fix_unicode']("coalesce(text, '')"))} as caption from documents"),
    "record_images": (image_lists, "select page_id, case page_id % 3 when 0 then '' when 1 then '/data/p/' || page_id else '/abs/' || page_id end as images from pages"),
    "record_videos": (video_records, "select conv_id as video_id, turn as sentence_id, case when turn % 2 = 0 then '/videos/v' || conv_id else '' end as videos, coalesce(text, '') as text from conversations"),
    "record_output_text": (output_texts, "select page_id, coalesce(url, '') as out from pages"),
    "record_views": (views, "select p_partkey, (p_size * 6 + 3)::bigint as total, 3::bigint as n from part"),
    "array_embedded": (embedding_lookup, "with d as (select doc_id, unnest([doc_id % 40, (doc_id * 7) % 90, doc_id % 40]) as vec_id from documents) select doc_id, count(*) as n, round(sum(embedding[1]::double + 2 * embedding[2]::double), 6) as total from d join embeddings using (vec_id) group by 1"),
    "array_boxes_resized": (boxes_in_frame, f"with b as ({_B}) select vec_id, {_mix(_in_frame('p') + _in_frame('q'))} as mix from b"),
    "array_boxes_kept": (boxes_that_stay, f"with b as ({_B}) select vec_id, array_to_string([x for x in [{_kept('p', 1)}, {_kept('q', 2)}] if x is not null], ',') as labels from b"),
    "array_boxes_flipped": (boxes_mirrored, f"with b as ({_B}) select vec_id, {_mix(_flip('p') + _flip('q'))} as mix, ({_sane('p')} + {_sane('q')})::bigint as sane from b"),
}


# Images and videos: the tables have none, so records get paths, headers and stand-in scores that SQL can compute too.


def _stand_in(kind: str):
    def load():
        import hashlib

        return lambda text, paths: [int(hashlib.md5(f"{kind}|{text}|{p}".encode()).hexdigest()[:4], 16) / 65536 * _SCALE.get(kind, 1.0) for p in paths]

    return load


_SCALE = {"video_motion": 30.0, "video_duration": 10.0, "video_nsfw": 0.4}
_SCORERS = ("image_text_similarity", "image_text_matching", "image_safety", "image_aesthetic", "video_aesthetics", "video_text_similarity", "video_motion", "video_nsfw", "video_watermark", "video_duration")


def _media_rows(docs: DataFrame) -> DataFrame:
    """Texts of two parts, of which the first names one image and the second two; every seventh document has no paths."""
    body = text.text_of("text")
    path = lambda k: F.concat(F.lit(f"m{k}/"), F.col("doc_id").cast("string"))
    none = F.col("doc_id") % 7 == 3
    rows = docs.select("doc_id", F.concat(F.lit("<image>\n"), body, F.lit(" <|__dj__eoc|><image> <image>\nsecond part <|__dj__eoc|>")).alias("text"), F.when(none, F.array().cast("array<string>")).otherwise(F.array(path(0), path(1), path(2))).alias("paths"))
    shape = lambda k: F.struct((F.col("doc_id") * (3 + k) % 1200 + 1).alias("width"), (F.col("doc_id") * (5 + k) % 900 + 1).alias("height"))
    size = lambda k: F.col("doc_id") * 977 * (k + 1) % 400_000
    return rows.withColumns({"shapes": F.when(none, F.array().cast("array<struct<width:bigint,height:bigint>>")).otherwise(F.array(*map(shape, range(3)))), "sizes": F.when(none, F.array().cast("array<bigint>")).otherwise(F.array(*map(size, range(3))))})


def _media(name: str) -> tuple[Query, str]:
    """How many filters each record passes, in declared order, before the first that it fails."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        steps = with_args(media.media_recipe(name), flagged_ratio={"listed": FLAGGED}, **{op: {"model": fit(docs)} for op, fit in (("language_score", scorers.fit_language), ("perplexity", scorers.fit_words)) if any(s.op == op for s in media.media_recipe(name))})
        rows = media.lower_media(spread(_media_rows(docs)), steps, {k: _stand_in(k) for k in _SCORERS}, "paths", annotate=True)
        passed, alive = F.lit(0).cast("long"), F.lit(True)
        for s in steps:
            if f"ok_{s.tag}" in rows.columns:
                alive = alive & F.col(f"ok_{s.tag}")
                passed = passed + F.when(alive, 1).otherwise(0)
        return rows.select("doc_id", passed.alias("passed"))

    steps = with_args(media.media_recipe(name), flagged_ratio={"listed": FLAGGED})
    text_steps = [s for s in steps if s.op not in ("media", "header")]
    ctes, at = _annotated_sql(text_steps)
    body = "'<image>' || chr(10) || coalesce(text, '') || ' <|__dj__eoc|><image> <image>' || chr(10) || 'second part <|__dj__eoc|>'"
    ctes = ctes.replace("coalesce(text, '') as text from documents)", f"{body} as text from documents)")
    score = lambda kind, t, k: f"(('0x' || substr(md5({_q(kind + '|')} || {t} || '|m{k}/' || doc_id), 1, 4))::int / 65536.0 * {_SCALE.get(kind, 1.0)})"
    within = lambda v, low, high: " and ".join([f"{v} >= {low}"] * (low is not None) + [f"{v} <= {high}"] * (high is not None))
    trimmed = lambda part: _sub(f"replace({part}, '<image>', '')", r"^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+\z")
    tests = []
    for s in steps:
        if s.op == "media":
            kind = s.args["scorer"]
            if kind.startswith("image_text"):
                parts = [trimmed("string_split(text, '<|__dj__eoc|>')[1]"), trimmed("string_split(text, '<|__dj__eoc|>')[2]")]
                test = f"{within(score(kind, parts[0], 0), s.low, s.high)} or ({within(f'(({score(kind, parts[1], 1)} + {score(kind, parts[1], 2)}) / 2)', s.low, s.high)})"
            elif kind == "video_text_similarity":
                test = within("((" + " + ".join(score(kind, "text", k) for k in range(3)) + ") / 3)", s.low, s.high)
            else:
                test = " or ".join(f"({within(score(kind, 'text', k), s.low, s.high)})" for k in range(3))
            tests.append(f"(doc_id % 7 = 3 or {test})")
        elif s.op == "header":
            w, h, b = ([f"(doc_id * {c + k} % {m} + 1)" for k in range(3)] for c, m in ((3, 1200), (5, 900), (0, 1)))
            each = {"image_aspect": [f"{x}::double / {y} between 0.333 and 3.0" for x, y in zip(w, h)], "image_shape": [f"{x} between 1 and 727 and {y} between 1 and 606" for x, y in zip(w, h)], "image_bytes": [f"doc_id * 977 * {k + 1} % 400000 <= {124 * 1024}" for k in range(3)]}[s.tag]
            tests.append("(doc_id % 7 = 3 or " + " or ".join(f"({x})" for x in each) + ")")
        elif s.operator.kind == "filter":
            tests.append(f"({_within_sql(s)})")
    flags = ", ".join(f"{t} as k{i}" for i, t in enumerate(tests))
    passed = " + ".join("case when " + " and ".join(f"k{j}" for j in range(i + 1)) + " then 1 else 0 end" for i in range(len(tests)))
    return run, f"{ctes},\nz as (select doc_id, {flags} from {at})\nselect doc_id, ({passed})::bigint as passed from z"


MEDIA_RECIPES = ("llava_pretrain", "general_video_refine", "video_self_evolution", "running_example")

_SINGLE: dict[str, tuple[Query, str]] = {
    **_RECORDS,
    **{f"media_{name}": _media(name) for name in MEDIA_RECIPES},
    **{f"map_{op}": _mapped(op) for op in ("clean_email", "normalize_punctuation", "normalize_whitespace", "remove_words_with", "clean_copyright", "clean_caption", "truncate_caption")},
    "map_remove_long_words": _mapped("remove_long_words", max_len=25),
    **{f"stat_{op}": _stat(op) for op in ("text_length", "average_line_length", "maximum_line_length", "alnum_ratio", "special_ratio", "words_num")},
    "stat_flagged_ratio": _stat("flagged_ratio", listed=FLAGGED),
    "stat_stopwords_ratio": _stat("stopwords_ratio", listed=STOPWORDS),
    "stat_char_repetition": (char_repetition, _CHAR_REPETITION),
    "stat_word_repetition": (word_repetition, _WORD_REPETITION),
    "map_clean_links": _mapped("clean_links"),
    "map_fix_unicode": _mapped("fix_unicode"),
    "stat_token_count": _stat("token_count"),
    "stat_alpha_per_token": _stat("alpha_per_token"),
    "stat_language_score": _model_stat("language_score"),
    "stat_language_score_en": _model_stat("language_score", lang="en"),
    "stat_perplexity": _model_stat("perplexity"),
    **{f"recipe_{name}": _recipe(name) for name in RECIPES},
    **{f"funnel_{name}": _funnel(name) for name in RECIPES},
    "threshold_calibration": (threshold_calibration, _THRESHOLDS),
    "source_prefix": (prefix, "select doc_id, source from documents order by doc_id limit 100"),
    "source_shard": (sharding, "select doc_id, source from (select doc_id, source, row_number() over (order by doc_id) - 1 as n from documents) where (n - 1) % 3 = 0 and n >= 1"),
    "source_byte_prefix": (byte_capped_prefix, "select doc_id from (select doc_id, row_number() over (order by doc_id) as n, sum(strlen(coalesce(text, '')) + 1) over (order by doc_id) as s from documents) where s <= 200000 or n = 1"),
    "source_lines": (line_reader, r"select doc_id, i - 1 as line_no, trim(ls[i], chr(10) || chr(13)) as line from (select doc_id, ls, unnest(generate_series(1, len(ls))) as i from (select doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) as ls from documents where text <> ''))"),
    "source_json": (json_parser, "select doc_id, coalesce(text, '') as raw_content, lang as meta from documents"),
    "source_web": (web_reader, "select page_id, url, strlen(html) as n_bytes from pages"),
    "source_detection": (detection_source, _DETECTION),
    "op_batch": (batching, "select n // 32 as batch, count(*) as n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as keys from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as n from orders) group by 1"),
    "record_captions": (conversation_captions, r"with c as (select conv_id, regexp_replace(list(coalesce(text, '') order by turn)[2], '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+\z', '', 'g') as c from conversations group by 1) select conv_id, '<image>' || chr(10) || c || ' <|__dj__eoc|>' as text from c where c is not null and c <> ''"),
    "record_instructions": (instruction_format, "select doc_id, array_to_string([x for x in [trim(source), trim(lang)] if x <> ''], chr(10) || chr(10)) as raw_content from documents"),
    "record_rounds": (caption_rounds, "select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as round from conversations"),
    "record_splits": (ordered_splits, "select doc_id, case when n < 50 then 'calibration' when n < 80 then 'pilot' else 'formal' end as split from (select doc_id, row_number() over (order by doc_id) - 1 as n from documents) where n < 120"),
    "record_matched": (matched_labels, "select lang, quality, count(*) as n, sum(toxic)::bigint as toxic from labels join documents using (doc_id) group by all"),
    "record_semi_join": (listed_documents, "select doc_id from documents where doc_id in (select doc_id from labels)"),
    "record_anti_join": (unlabelled_documents, "select doc_id from documents where doc_id not in (select doc_id from labels)"),
    "array_unit_length": (_vector(records.unit_length), "with e as (select vec_id, embedding, sqrt(list_sum([x::double * x::double for x in embedding])) as n from embeddings) select vec_id, len(embedding) as n, round(case when e.n > 0 then list_sum([abs(x::double) for x in embedding]) / e.n else 0 end, 6) as total from e"),
    "array_normalize": (_vector(lambda x: records.normalized(F.transform(x, lambda v: v.cast("double")), 0.1307, 0.3081)), "select vec_id, len(embedding) as n, round(list_sum([abs((x::double - 0.1307) / 0.3081) for x in embedding]), 6) as total from embeddings"),
    "array_tokens": (token_sequence, "with e as (select vec_id, [floor(abs(x) * 1000)::int for x in embedding] as t from embeddings) select vec_id, 256::bigint as n, (1 + list_sum([x + 1 for x in t]) + 2)::bigint as total, 1::bigint as bos from e"),
    "array_boxes": (box_algebra, _BOXES),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _SINGLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _SINGLE.items()}
