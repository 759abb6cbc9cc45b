"""The queries in DuckDB's SQL, where SQL can say them: 1, 3, 5, 7, 9 and 10.

Not in SQL: 4 draws with Spark's 64-bit hash, 6 needs a parser and trained weights, 8 a trained machine, and the pipeline holds 4 and 8.
Tests compare those with brute force, exact texts or held-out labels.
"""

from __future__ import annotations

from .chat_format import CONTROL

WORDS = r"[x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']"

OP1 = rf"""
with c as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, length(regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g')) + length(role) + 5 + 8 as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from t group by conv_id
"""

OP3 = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents),
g as (select h, min(doc_id) as keep_id, count(*) as n from t group by h)
select t.doc_id as doc_id, g.keep_id as keep_id, g.n as group_size, t.doc_id is not distinct from g.keep_id and row_number() over (partition by t.h, t.doc_id) = 1 as kept, t.h as text_sha256 from t join g using (h)
"""

OP5 = """
with d as (select doc_id, encode(coalesce(text, '')) as b, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, md5(hex(b[i + 1:i + 200])) as h from (select doc_id, b, unnest(generate_series(0, n - 200)) as i from d where n >= 200)),
r as (select h from w group by h having count(*) > 1),
s as (select doc_id, i from w where h in (select h from r)),
f as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 200 or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as new from s),
k as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from f),
g as (select doc_id, min(i) as a, max(i) + 200 as z from k group by doc_id, k.k),
o as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as start from g),
p as (
  select o.doc_id, o.start, hex(d.b[o.start + 1:o.a]) as part from o join d using (doc_id)
  union all select d.doc_id, m.z, hex(d.b[m.z + 1:]) from d join (select doc_id, max(z) as z from g group by 1) m using (doc_id)
  union all select doc_id, 0, hex(b) from d where doc_id not in (select doc_id from g)),
q as (select doc_id, sha256(unhex(string_agg(part, '' order by start))) as kept_sha256 from p group by 1)
select d.doc_id as doc_id, d.n::bigint as n_bytes, coalesce((select sum(z - a) from g where g.doc_id = d.doc_id), 0)::bigint as n_removed,
  (select count(*) from g where g.doc_id = d.doc_id) as n_spans, q.kept_sha256 as kept_sha256 from d join q using (doc_id)
"""

OP7 = f"""
with d as (select doc_id, {WORDS} as ws from documents),
p as (select doc_id, i, ws[i] as word, case when i + 49 <= len(ws) then md5(array_to_string(ws[i:i + 49], ' ')) end as h from (select doc_id, ws, unnest(generate_series(1, len(ws))) as i from d)),
m as (select h, min(doc_id) as first from p where h is not null group by h),
r as (select p.doc_id, p.i, p.word, case when m.first < p.doc_id then 1 else 0 end as rep from p left join m using (h)),
c as (select *, max(rep) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from r),
k as (select doc_id, sum(gone)::bigint as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '')) as s from c group by 1)
select d.doc_id as doc_id, len(d.ws)::bigint as n_words, coalesce(k.n_removed, 0) as n_removed, coalesce(k.s, sha256('')) as kept_sha256 from d left join k using (doc_id)
"""

OP9 = f"""
with recursive d as (select doc_id, coalesce(text, '') as t, {WORDS} as ws from documents),
x as (select t, min(doc_id) as id, count(*) as copies, any_value(ws) as ws from d group by t),
s as (select distinct id, g from (select id, array_to_string(ws[i:i + 4], ' ') as g from (select id, ws, unnest(generate_series(1, len(ws) - 4)) as i from x where len(ws) >= 5))),
n as (select id, count(*) as n from s group by 1),
j as (select a.id as a, b.id as b, count(*) as c from s a join s b on a.g = b.g and a.id < b.id group by all),
l as (select j.a, j.b from j join n na on na.id = j.a join n nb on nb.id = j.b where c >= 0.8 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select id, id as seen from x union select r.id, e.b from r join e on e.a = r.seen),
k as (select id, min(seen) as class_id from r group by 1),
c as (select e.a as id, sum(x.copies) as links from e join x on x.id = e.b group by 1)
select d.doc_id as doc_id, k.class_id as class_id, (coalesce(c.links, 0) + x.copies - 1)::bigint as n_links
from d join x on x.t = d.t join k on k.id = x.id left join c on c.id = x.id
"""


_TOKENS = r"[x for x in string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if x <> '']"
#: No seeds here, but every alignment of an item with a document in which tokens are equal.
OP10 = f"""
with d as (select doc_id, {_TOKENS} as w from documents), b as (select item_id, {_TOKENS} as w from benchmark),
dt as (select doc_id, i, hash(w[i]) as t from (select doc_id, w, unnest(generate_series(1, len(w))) as i from d)),
bt as (select item_id, len(w) as n, j, hash(w[j]) as t from (select item_id, w, unnest(generate_series(1, len(w))) as j from b)),
m as (select dt.doc_id, bt.item_id, bt.n, bt.j, dt.i - bt.j as shift from dt join bt using (t)),
k as (select doc_id, item_id, shift from m group by all having count(*) >= least(10, ceil(0.8 * any_value(n)))),
c as (select doc_id, item_id, n, count(*) over (partition by doc_id, item_id, shift order by j range between current row and 11 following) as c from m join k using (doc_id, item_id, shift)),
v as (select doc_id, item_id, max(c::double / least(n, 12)) as agreement from c group by all),
f as (select doc_id, string_agg(item_id::varchar, ',' order by item_id) as items, max(agreement) as agreement from v where agreement >= 0.8 group by 1)
select d.doc_id as doc_id, coalesce(f.items, '') as items, coalesce(f.agreement, 0.0) as agreement, f.doc_id is not null as contaminated from d left join f using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op3_exact_dedup": OP3, "op5_suffix_array_dedup": OP5, "op7_substring_dedup": OP7, "op9_ngram_jaccard_join": OP9, "op10_decontamination": OP10}
