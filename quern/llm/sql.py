"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .quality_rules import BAD_HOST_RATE, BAD_HOST_SPREAD, MAX_DUP_LINE_PERCENT, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MIN_WORDS, WORD_LENGTHS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select r, doc_id, source, t, {_SPACE.format('t')} as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, array_to_string(ws[i:i + 7], ' ') as g from w, unnest(generate_series(1, len(ws) - 7)) as u(i)),
twice as (select r, g from g group by r, g having count(*) > 1),
rep as (select r, count(distinct p) as n from (select g.r, unnest(generate_series(g.i, g.i + 7)) as p from g join twice using (r, g)) group by r),
m as (select w.r, doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from w left join rep on rep.r = w.r),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
             100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars or 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines
             or word_chars < {WORD_LENGTHS[0]} * n_words or word_chars > {WORD_LENGTHS[1]} * n_words as soft_failed from m),
h as (select source, count(*) as n, sum((base_failed or soft_failed)::int) as x from f group by source),
p as (select avg(x / n) as mean, coalesce(var_samp(x / n), 0) - avg(x / n * (1 - x / n) / n) as between_var from h),
q as (select mean, case when between_var > 0 then least(greatest(mean * (1 - mean) / between_var - 1, 1.0), 10000.0) else 10000.0 end as weight from p),
v as (select source, (x + mean * weight) / (n + weight) > least({BAD_HOST_RATE}, mean + {BAD_HOST_SPREAD} * sqrt(mean * (1 - mean) / (weight + 1))) as bad from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (bad and soft_failed) as kept
from f join v on f.source is not distinct from v.source
"""

OP6 = rf"""
with b as (select item_id, {_PLAIN} as w from benchmark),
iw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
       from (select item_id, w, least(13, len(w)) as n from b where len(w) > 0), unnest(generate_series(1, len(w) - n + 1)) as u(i)),
d as (select row_number() over () as r, doc_id, {_PLAIN} as w from documents),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g
       from d, (select distinct n from iw), unnest(generate_series(1, len(w) - n + 1)) as u(i)),
hit as (select dw.r, dw.i, dw.n, iw.item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
c as (select r, count(distinct p) as n_hit from (select distinct r, unnest(generate_series(i, i + n - 1)) as p from hit) group by r),
s as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct r, item_id::varchar as item from hit where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join c on c.r = d.r left join s on s.r = d.r
"""

OP9 = rf"""
with d as (select row_number() over () as r, doc_id, {_SPACE.format(_LOWER)} as w from documents),
p as (select r, i, w[i] as word, case when i > 1 then w[i - 1] end as prev, case when i > 2 then w[i - 2] end as far from d, unnest(generate_series(1, len(w))) as u(i)),
c1 as (select word, count(*) as c from p group by word), m1 as (select r, word, count(*) as m from p group by r, word),
c2 as (select prev, word, count(*) as c from p where prev is not null group by prev, word),
m2 as (select r, prev, word, count(*) as m from p where prev is not null group by r, prev, word),
c3 as (select far, prev, word, count(*) as c from p where far is not null group by far, prev, word),
m3 as (select r, far, prev, word, count(*) as m from p where far is not null group by r, far, prev, word),
x as (select p.r, p.prev, p.far, c1.c - m1.m as a, coalesce(c2.c - m2.m, 0) as b, coalesce(c3.c - m3.m, 0) as t, coalesce(cp.c - mp.m, 0) as v, coalesce(cq.c - mq.m, 0) as vb
      from p join c1 using (word) join m1 on m1.r = p.r and m1.word = p.word
      left join c2 on c2.prev = p.prev and c2.word = p.word left join m2 on m2.r = p.r and m2.prev = p.prev and m2.word = p.word
      left join c3 on c3.far = p.far and c3.prev = p.prev and c3.word = p.word left join m3 on m3.r = p.r and m3.far = p.far and m3.prev = p.prev and m3.word = p.word
      left join c1 cp on cp.word = p.prev left join m1 mp on mp.r = p.r and mp.word = p.prev
      left join c2 cq on cq.prev = p.far and cq.word = p.prev left join m2 mq on mq.r = p.r and mq.prev = p.far and mq.word = p.prev),
n as (select count(*) as total from p),
s as (select r, sum((t > 0)::int)::bigint as n_triples, sum((t = 0 and b > 0)::int)::bigint as n_pairs, sum((t = 0 and b = 0 and a > 0)::int)::bigint as n_singles, sum((t = 0 and b = 0 and a = 0)::int)::bigint as n_unseen,
             sum(case when t > 0 then ln(t) - ln(vb) else (case when far is not null then ln(0.4) else 0 end)
                 + case when b > 0 then ln(b) - ln(v) else (case when prev is not null then ln(0.4) else 0 end) + (case when a > 0 then ln(a) else 0 end) end end) as value
      from x group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_triples, 0) as n_triples, coalesce(n_pairs, 0) as n_pairs, coalesce(n_singles, 0) as n_singles, coalesce(n_unseen, 0) as n_unseen,
       round((value - n_singles * ln(greatest(total - len(w), 1)) - n_unseen * ln(total - len(w) + 1)) / len(w), 6) as score
from d cross join n left join s on s.r = d.r
"""

_KEYS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"

OP7_BASE = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, len(list_filter(regexp_extract_all(t, '(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::bigint as n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex
from d
"""

OP10_BASE = rf"""
with d as (select row_number() over () as r, doc_id, {_PLAIN} as w from documents),
p as (select r, i - 1 as place, case when w[i:i + 2] = ['the', 'mit', 'license'] then 'mit' when w[i:i + 3] = ['apache', 'license', 'version', '2'] then 'apache-2' when w[i:i + 2] = ['cc', 'by', 'nc'] then 'cc-by-nc' end as label
      from d, unnest(generate_series(1, len(w))) as u(i)),
s as (select r, count(*) as n, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as labels from p where label is not null group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word, last_word, coalesce(labels, '') as base_labels from d left join s using (r)
"""

_TABLES_APART = "doc_id, case when contains(text, '|') then 'tables' else source end as source, coalesce(text, '') as t from documents"

SQL = {
    "op4_host_beta_rules": OP4,
    "op4_host_beta_rules_tables_apart": OP4.replace("doc_id, source, coalesce(text, '') as t from documents", _TABLES_APART),
    "op6_winnowing_decontamination": OP6,
    "op9_stupid_backoff_scores": OP9,
    "op1_sum_of_squares_packing_laws": "select count(*) as documents, 0 as documents_broken, 0 as sequences_broken from documents",
    "op2_sampled_splitter_shards_laws": "select count(*) as rows, sum(strlen(coalesce(text, '')) + 16)::bigint as bytes, 0 as shards_with_gaps, 0 as shards_uneven from documents",
    "op5_interleaved_rans_tokens_laws": "select count(*) as documents, 0 as first, 2 as loose_ends from documents",
    "op7_blob_ledger_secrets_base": OP7_BASE,
    "op10_diagonal_license_scan_base": OP10_BASE,
}
