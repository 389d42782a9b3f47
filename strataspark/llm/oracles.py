"""DuckDB SQL for the corpus queries that SQL can express. Views: documents, embeddings, conversations."""

op2_rule_ledger = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
tri as (
  select doc_id, p, ws[p] || chr(10) || ws[p + 1] || chr(10) || ws[p + 2] as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as p from w) x),
often as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as c from tri) x where c > 1),
rep as (
  select doc_id, count(distinct p) as n
  from (select doc_id, p from often union all select doc_id, p + 1 from often union all select doc_id, p + 2 from often) x group by doc_id),
m as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
         cast(len(ls) as bigint) as n_lines, cast(length(text) - length(regexp_replace(text, '[!?]', '', 'g')) as bigint) as n_marks,
         cast(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as bigint) as n_upper,
         cast(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) as bigint) as n_letters
  from w left join rep on w.doc_id = rep.doc_id),
b as (
  select *, cast(case when n_words < 50 then 1 else 0 end
    + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 10 * word_chars < 20 * n_words or word_chars > 14 * n_words then 4 else 0 end
    + case when 10 * n_symbols > n_words then 8 else 0 end
    + case when n_dup_lines >= 3 and 100 * n_dup_lines > 60 * n_lines then 16 else 0 end
    + case when 10 * n_marks > 3 * n_words then 32 else 0 end
    + case when n_letters > 0 and 100 * n_upper > 60 * n_letters then 64 else 0 end as bigint) as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits, (fail_bits & 15) = 0 as kept_v1,
       case fail_bits when 1 then 'few_words' when 2 then 'repeated_windows' when 4 then 'short_or_long_words' when 8 then 'symbols' when 16 then 'repeated_lines' when 32 then 'marks' when 64 then 'capitals' end as blocking_rule,
       case when bit_count(fail_bits) = 1 then count(*) over (partition by fail_bits) end as let_back
from b
"""

op6_hyperminhash = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, ws[p] || chr(10) || ws[p + 1] || chr(10) || ws[p + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as p from w) x
    union all select doc_id, array_to_string(ws, chr(10)) from w where len(ws) between 1 and 2) y),
n as (select doc_id, count(*) as n from s group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, b as other from edges union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
comp as (select doc_id, min(other) as low from reach group by doc_id)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(w.doc_id, coalesce(comp.low, w.doc_id)) as component_id,
       w.doc_id = least(w.doc_id, coalesce(comp.low, w.doc_id)) as kept
from w left join n on n.doc_id = w.doc_id left join comp on comp.doc_id = w.doc_id
"""

op3_segment_topk = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

op7_preference = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
n as (select conv_id, count(*) as n, max(case when role = 'assistant' then i end) as last from t group by conv_id),
l as (select t.conv_id, t.text from t join n on n.conv_id = t.conv_id and n.last = t.i),
p as (
  select n.conv_id, n.n, n.last, o.text as other, n.last is not null and o.text is not null as paired, a.text as own
  from n left join l o on o.conv_id = n.conv_id + 1 left join l a on a.conv_id = n.conv_id),
d as (select *, case when not paired then 0 when own = other then n else last - 1 end as k from p),
x as (
  select t.conv_id, t.i, t.role, d.k, 0 as side, t.text from t join d on d.conv_id = t.conv_id
  union all select t.conv_id, t.i, t.role, d.k, 1, case when t.i = d.last then d.other else t.text end from t join d on d.conv_id = t.conv_id where d.paired),
y as (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown from x),
z as (
  select *, coalesce(sum(case when i > k then length(shown) end) over (partition by conv_id, side order by i rows between unbounded preceding and 1 preceding), 0) as pos
  from y)
select d.conv_id as pair_id, d.conv_id as chosen_id, d.conv_id + 1 as rejected_id, d.paired, coalesce(bool_or(d.paired and d.own = d.other), false) as equal, cast(d.k as bigint) as prompt_turns,
  coalesce(string_agg(case when side = 0 and i <= z.k then shown end, '' order by i), '') as prompt,
  coalesce(string_agg(case when side = 0 and i > z.k then shown end, '' order by i), '') as chosen,
  coalesce(string_agg(case when side = 0 and i > z.k and role = 'assistant' then cast(cast(pos + length(role) + 5 as bigint) as varchar) || '+' || cast(length(text) + 8 as varchar) end, ',' order by i), '') as chosen_mask,
  coalesce(string_agg(case when side = 1 and i > z.k then shown end, '' order by i), '') as rejected,
  coalesce(string_agg(case when side = 1 and i > z.k and role = 'assistant' then cast(cast(pos + length(role) + 5 as bigint) as varchar) || '+' || cast(length(text) + 8 as varchar) end, ',' order by i), '') as rejected_mask
from d join z on z.conv_id = d.conv_id
group by d.conv_id, d.paired, d.k
"""

op4_fuzzy_lines = r"""
with recursive t as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
l as (
  select doc_id, p - 1 as pos, ls[p] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as p from t) x where regexp_matches(ls[p], '[^\x20\x09-\x0D]')),
d as (select line, row_number() over (order by line) as k from (select distinct line from l) x),
s as (select distinct k, substr(line, i, 8) as g from (select k, line, unnest(range(1, greatest(length(line) - 7, 1) + 1)) as i from d) x),
n as (select k, count(*) as n from s group by k),
f as (select g, count(*) as c from s group by g),
o as (select s.k, s.g, n.n, row_number() over (partition by s.k order by f.c, s.g) as r from s join f on f.g = s.g join n on n.k = s.k),
p as (select k, g, n from o where r <= n - (4 * n + 4) // 5 + 1),
c as (select distinct a.k as a, b.k as b, a.n as na, b.n as nb from p a join p b on a.g = b.g and a.k < b.k where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
j as (select a, b, na, nb, count(*) as i from c join s x on x.k = a join s y on y.k = b and y.g = x.g group by a, b, na, nb),
links as (select a, b from j where 180 * i >= 80 * (na + nb)),
edges as (select a, b from links union all select b, a from links),
reach as (select a as k, b as other from edges union select r.k, e.b from reach r join edges e on e.a = r.other),
comp as (select k, least(k, min(other)) as root from reach group by k),
w as (select l.doc_id, l.pos, coalesce(comp.root, d.k) as root from l join d on d.line = l.line left join comp on comp.k = d.k),
first as (select root, min(row(doc_id, pos)) as best from w group by root),
z as (select w.doc_id, w.pos, best from w join first on first.root = w.root)
select doc_id, cast(pos as integer) as pos, best[1] as first_doc_id, cast(best[2] as integer) as first_pos, doc_id = best[1] and pos = best[2] as kept from z
"""

op10_repeats = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, md5(substr(h, 2 * p + 1, 400)) as m from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) as p from b) x),
often as (select m from w group by m having count(*) > 1),
r as (select doc_id, p from w where m in (select m from often)),
g as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 200 then 0 else 1 end as opens from r),
i as (select doc_id, p, sum(opens) over (partition by doc_id order by p) as run from g),
runs as (select doc_id, run, min(p) as lo, max(p) + 200 as hi from i group by doc_id, run),
total as (select doc_id, sum(hi - lo) as removed, count(*) as spans, max(hi) as hi from runs group by doc_id),
gaps as (
  select doc_id, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as s, lo as e from runs
  union all select b.doc_id, coalesce(total.hi, 0), length(h) // 2 from b left join total on total.doc_id = b.doc_id),
k as (select gaps.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' order by s) as kept from gaps join b on b.doc_id = gaps.doc_id group by gaps.doc_id)
select b.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(kept, ''))) as kept_sha256
from b join k on k.doc_id = b.doc_id left join total on total.doc_id = b.doc_id
"""

op8_source_schedule = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5('7|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as k from d group by source),
a as (select *, (k - 1) % 3 + 1 as w, 3 * source_size as cap, sum(source_size) over () as total, count(*) over () as n from s),
b as (
  select *, sum(w) over () as ws, coalesce(sum(cap) over (order by cap / cast(w as double), k rows between unbounded preceding and 1 preceding), 0) as cap0,
         coalesce(sum(w) over (order by cap / cast(w as double), k rows between unbounded preceding and 1 preceding), 0) as w0
  from a),
c as (select *, (total - cap0) * w >= cap * (ws - w0) as held from b),
e as (select *, coalesce(sum(case when held then cap end) over (), 0) as held_cap, ws - coalesce(sum(case when held then w end) over (), 0) as free_w from c),
t as (select source, k, source_size, total, n, case when held then cast(cap as double) else cast(w * (total - held_cap) as double) / free_w end as target from e),
q as (select *, cast(ceil(source_size / greatest(1, least(2048, total // greatest(1, n * 1000)))) as bigint) as blocks from t where source_size > 0),
r as (select *, target * blocks / source_size as share, sum(target * blocks / source_size) over (order by k rows between unbounded preceding and current row) as hi from q),
x as (select *, max(hi) over () as ends from r),
y as (select *, (hi - share) / ends as lo, case when hi >= ends then 1.0e0 else hi / ends end as top from x),
slots as (select i as slot, (i * 2654435769) % 4294967296 / 4294967296.0e0 as u from range(cast((select round(max(ends)) from x) as bigint)) g(i)),
ranked as (select y.k, blocks, row_number() over (partition by y.k order by slot) - 1 as rank from slots join y on u >= lo and u < top),
uses as (select k, rank % blocks as block, count(*) as uses from ranked where rank < 3 * blocks group by 1, 2),
laid as (
  select doc_id, size, source, h, coalesce(sum(size) over (partition by source order by h % greatest(1, (select count(*) from d) // 4096), h rows between unbounded preceding and 1 preceding), 0) as before
  from d where size > 0),
m as (select laid.*, q.k, source_size // blocks as len, source_size % blocks as more, before + size - 1 as last from laid join q on laid.source is not distinct from q.source),
p as (
  select *, unnest(range(cast(case when before < more * (len + 1) then before // (len + 1) else more + (before - more * (len + 1)) // len end as bigint),
                         cast(case when last < more * (len + 1) then last // (len + 1) else more + (last - more * (len + 1)) // len end as bigint) + 1)) as block
  from m),
got as (
  select p.doc_id, sum((least(before + size, (p.block + 1) * len + least(p.block + 1, more)) - greatest(before, p.block * len + least(p.block, more))) * uses) as taken
  from p join uses on uses.k = p.k and uses.block = p.block group by p.doc_id)
select d.doc_id, d.size, t.source_size, t.target, cast(coalesce(got.taken, 0) as bigint) as taken
from d join t on d.source is not distinct from t.source left join got on got.doc_id = d.doc_id
"""

op13_spelling = r"""
with recursive tbl as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as crc),
runs as (
  select doc_id, r, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as r
    from documents) x where length(r) >= 6 group by 1, 2),
hashed as (
  select r, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || r, ''), lambda c: case when ord(c) < 128 then [cast(ord(c) as bigint)] else [195, cast(ord(c) - 64 as bigint)] end))),
    lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) as h
  from runs, tbl),
slipped as (
  select case when h % 199 = 0 then substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) else r end as word, k from hashed),
words as (select word, cast(sum(k) as bigint) as n from slipped where length(word) >= 6 group by 1 having sum(k) >= 5),
cut as (select word, n, p, substring(word, 1, p - 1) || substring(word, p + 1) as v from (select word, n, unnest(range(1, length(word) + 1)) as p from words) x),
pairs as (
  select x.word as a, x.n as na, y.word as b, y.n as nb from cut x join cut y on x.v = y.v and x.p = y.p and x.word <> y.word
  union select c.word, c.n, w.word, w.n from cut c join words w on c.v = w.word
  union select w.word, w.n, c.word, c.n from cut c join words w on c.v = w.word),
best as (select a, count(*) as n_near, max(nb) as m from pairs group by a),
forms as (
  select p.a as word, min(p.b) as form, p.nb as form_n from pairs p join best on best.a = p.a and p.nb = best.m and p.nb >= 5 * p.na group by p.a, p.nb),
chain as (select word, form as here, 1 as step from forms union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.here),
roots as (select word, arg_max(here, step) as root from chain group by word)
select w.word, w.n, cast(coalesce(best.n_near, 0) as bigint) as n_near, f.form, f.form_n, coalesce(r.root, w.word) as root
from words w left join best on best.a = w.word left join forms f on f.word = w.word left join roots r on r.word = w.word
"""
