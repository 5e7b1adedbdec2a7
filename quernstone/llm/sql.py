"""DuckDB SQL for the numbered queries that SQL can express."""

from quernstone.llm.url_reputation import TWO_LABELS

OP10 = """
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), parts as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from p
), known as (
  select doc_id as page_id, max(greatest(case when quality = 0 then 1 when quality is not null then 0 end, case when toxic = 1 then 1 when toxic is not null then 0 end)) as bad
  from labels where doc_id is not null group by 1
), named as (
  select host, case when regexp_matches(h, '^[0-9]+(\\.[0-9]+){3}$|^\\[') then '' when two in (TWO) then two else list_extract(l, -1) end as suffix,
    case when regexp_matches(h, '^[0-9]+(\\.[0-9]+){3}$|^\\[') then h when two in (TWO) then array_to_string(list_slice(l, -3, -1), '.') else two end as domain
  from (select *, string_split(h, '.') as l, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') as two
    from (select distinct host, regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g') as h from parts))
), hosts as (
  select host, min(suffix) as suffix, min(domain) as domain, count(*)::double as n, sum(bad)::double as k
  from parts join known using (page_id) join named using (host) where bad is not null group by 1
), domains as (select domain, min(suffix) as suffix, sum(n) as n, sum(k) as k from hosts group by 1),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by 1),
levels as (
  select 's' as level, sum(n) as tn, sum(k) as tk, sum(n * n) as nn, sum(k * k / n) as kk, count(*) as g from suffixes
  union all select 'd', sum(n), sum(k), sum(n * n), sum(k * k / n), count(*) from domains
  union all select 'h', sum(n), sum(k), sum(n * n), sum(k * k / n), count(*) from hosts
), spread as (
  select level, tk / tn as m, g, (kk - tk * (tk / tn) - (g - 1) * (tk / tn) * (1 - tk / tn)) / nullif(tn - nn / tn, 0) as between_groups from levels
), strength as (
  select level, m, greatest(2.0, least(1000.0, case when g > 1 and between_groups > 0 then m * (1 - m) / between_groups - 1 else 1000.0 end)) as s from spread
), x as (
  select host, coalesce(s.n, 0) as sn, coalesce(s.k, 0) as sk, coalesce(d.n, 0) as dn, coalesce(d.k, 0) as dk, coalesce(h.n, 0) as hn, coalesce(h.k, 0) as hk,
    a.m, a.s as s0, b.s as s1, c.s as s2
  from named left join suffixes s using (suffix) left join domains d using (domain) left join hosts h using (host)
  cross join (select * from strength where level = 's') a cross join (select * from strength where level = 'd') b cross join (select * from strength where level = 'h') c
), y as (select *, (dk + s1 * (sk + s0 * m) / (sn + s0)) / (dn + s1) as md from x),
z as (select *, (hk + s2 * md) / (hn + s2) as mean, hn + s2 as weight from y),
bound as (select host, mean - 1.6449 * sqrt(mean * (1 - mean) / (weight + 1)) as low from z),
ruled as (
  select page_id, host, path, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule
  from parts
)
select page_id, host, path, rule, case
  when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
  when low > 0.5 then 'block' else 'allow' end as verdict, round(low, 6) as bound
from ruled left join bound using (host)
""".replace("TWO", ", ".join(f"'{x}'" for x in TWO_LABELS))

OP2 = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') as t from documents where text is not null
), s as (
  select distinct doc_id, array_to_string(t[i : i + 4], ' ') as g from (select doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) as i from w where len(t) > 0)
), n as (select doc_id, count(*) as n from s group by 1),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as both_have from s x join s y using (g) where x.doc_id <> y.doc_id group by all)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * both_have >= 75 * (p.n + q.n - both_have)
), reach as (
  select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on links.a = reach.b
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join (select a as doc_id, min(b) as component_id from reach group by 1) c using (doc_id) left join n using (doc_id)
"""

OP8 = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e)) / sqrt(list_inner_product(y.e, y.e)) >= 0.93
), reach as (
  select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on links.a = reach.b
)
select e.vec_id, coalesce(l.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select a as vec_id, min(b) as component_id from reach group by 1) c using (vec_id)
left join (select a as vec_id, count(*) as n from links group by 1) l using (vec_id)
"""

#: The terms of a text: what its other characters, once they are all spaces, leave apart.
TERMS = r"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

OP11 = f"""
with d as (select row_number() over () as r, doc_id, {TERMS} as t from documents),
c as (select count(*)::bigint as n, sum(len(t))::bigint as l from d where len(t) > 0),
items as (select item_id, term, count(*)::bigint as times from (select item_id, unnest({TERMS}) as term from (select distinct item_id, text from benchmark)) group by all),
p as (select r, doc_id, len(t)::bigint as length, term, count(*)::bigint as tf from (select r, doc_id, t, unnest(t) as term from d) where term in (select term from items) group by all),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by term, n),
s as (
  select item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * length * n) // l))))::bigint as score
  from items join p using (term) join w using (term), c group by all
), o as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from o where rank <= 20
"""

ORACLES = {"op11_threshold_search": OP11, "op10_url_reputation": OP10, "op2_near_dup": OP2, "op8_cover_tree": OP8}
