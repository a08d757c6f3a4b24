"""The parts of the contracts that SQL can state: base columns of licenses,
personal data and quality, the targets of the mix, and exact vector links."""

from __future__ import annotations

LICENSES = r"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
p(label, ws) as (values ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
h as (select doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(ws)] = ws)) place from d, p)
select doc_id, any_value(len(w)) n_words, count(place) n_base, min(place) first_word, max(place) last_word, coalesce(string_agg(distinct label, ',' order by label), '') base_labels from d left join h using (doc_id) group by doc_id"""

QUALITY = r"""with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)), r as (select doc_id, i, count(*) over (partition by doc_id, g) c from g),
m as (select doc_id, count(distinct i + j) n from r, (values (0), (1), (2)) k(j) where c > 1 group by 1)
select doc_id, len(w) n_words, len(array_to_string(w, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) base_failed from d join l using (doc_id) left join m using (doc_id)"""

PERSONAL = r"""with p(k, kind, re) as (values (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
a as (select doc_id, k, kind, regexp_extract_all(coalesce(text, ''), re) al, regexp_split_to_array(coalesce(text, ''), re) pc from documents, p),
s as (select doc_id, k, kind, unnest(al) m, al, pc, generate_subscripts(al, 1) j from a where len(al) > 0), t as (select doc_id, k, kind, m, len(array_to_string(pc[1:j], '')) + len(array_to_string(al[1:j - 1], '')) b, regexp_replace(m, '[^0-9]', '', 'g') dg from s),
u as (select *, case kind when 'email' then true when 'ip' then len(list_filter(string_split(m, '.'), lambda x: x::hugeint > 255)) = 0 when 'phone' then len(dg) between 9 and 15
else len(dg) between 13 and 19 and list_sum(list_transform(range(len(dg)), lambda i: case when i % 2 = 0 then dg[len(dg) - i]::int else dg[len(dg) - i]::int * 2 - case when dg[len(dg) - i]::int > 4 then 9 else 0 end end)) % 10 = 0 end ok from t),
v as (select doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone, sha256(string_agg(kind || ':' || b || ':' || (b + len(m)), ',' order by k, b)) h from u where ok group by 1)
select doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone, coalesce(h, sha256('')) base_sha256 from documents left join v using (doc_id)"""

TARGETS = r"""with recursive z as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents), o as (select source, sum(size)::bigint s, row_number() over (order by source is null, source) - 1 i from z group by 1),
w as (select *, ([3.0, 1.0, 2.0]::double[])[i % 3 + 1] w from o), r(n, l) as (select 0, list({i: i, w: w, s: s, free: true} order by i) from w
union all select n + 1, list_transform(l, lambda x: {i: x.i, w: x.w, s: x.s, free: x.free and (1.5::double * list_sum(list_transform(l, lambda y: y.s)) - coalesce(list_sum(list_transform(list_filter(l, lambda y: not y.free), lambda y: 2 * y.s)), 0)) / list_sum(list_transform(list_filter(l, lambda y: y.free), lambda y: y.w)) * x.w <= 2 * x.s}) from r where n < 12 and len(list_filter(l, lambda y: y.free)) > 0),
e as (select l from r order by n desc limit 1), f as (select unnest(l) x, (1.5::double * list_sum(list_transform(l, lambda y: y.s)) - coalesce(list_sum(list_transform(list_filter(l, lambda y: not y.free), lambda y: 2 * y.s)), 0)) / nullif(list_sum(list_transform(list_filter(l, lambda y: y.free), lambda y: y.w)), 0) u from e)
select doc_id, size::bigint size, w.s source_size, round(case when f.x.free then u * w.w else 2.0::double * w.s end, 6)::double target from z join w on z.source is not distinct from w.source join f on f.x.i = w.i"""

#: Links of all pairs; components by passing the least id along the links.
VECTORS = r"""with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93), n as (select a, count(*) n from l group by 1),
c(vec_id, root) as (select vec_id, vec_id from embeddings union select l.b, c.root from c join l on l.a = c.vec_id), m as (select vec_id, min(root) root from c group by 1)
select vec_id, coalesce(n, 0) n_links, root component_id, vec_id = root kept from m left join n on a = vec_id"""

#: Exact deviations of each row; SQL has no eigenvectors.
DEVIATIONS = r"""with v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
x as (select vec_id, list_transform(e, lambda c: floor(64 * c)::bigint + 1000000) x, row_number() over () r from v), f as (select r, vec_id, unnest(x) x, generate_subscripts(x, 1) i from x),
s as (select i, count(*) n, sum(x)::bigint s from f group by 1) select any_value(vec_id) vec_id, any_value(n) n, sum((n * x - s) * (n * x - s))::bigint deviation from f join s using (i) group by r"""

#: The checksum by a table made bit by bit; near words share what is left without one letter.
SPELLING = r"""with recursive t(i, k, v) as (select i, 0, i from range(256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from t where k < 8),
tab as (select list(v order by i) l from t where k = 8),
runs as (select doc_id, run, count(*) c from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) run from documents) group by all),
h as (select run, c, xor(list_reduce(flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)),
lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) h from runs, tab),
w as (select word, sum(c)::bigint n from (select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end word, c from h) where length(word) >= 5 group by 1 having sum(c) >= 3),
g as (select word, n, p, word[:p - 1] || word[p + 1:] rest from (select word, n, unnest(range(1, length(word) + 1)) p from w)),
pairs as (select a.word, b.word near, b.n m from g a join g b on a.rest = b.rest and a.p = b.p and a.word <> b.word union select g.word, w.word, w.n from g join w on g.rest = w.word union select w.word, g.word, g.n from g join w on g.rest = w.word),
b as (select word, count(*) n_near, first(near order by m desc, near) near, max(m) m from pairs group by 1),
f as (select word, n, coalesce(n_near, 0) n_near, case when m >= 2 * n then near end form, case when m >= 2 * n then m end form_n from w left join b using (word)),
r(word, via, form) as (select word, word, form from f union all select r.word, f.word, f.form from r join f on f.word = r.form)
select word, f.form, r.via root, n, n_near, form_n from f join r using (word) where r.form is null"""
