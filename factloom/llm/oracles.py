"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from factloom.llm.license_scan import BLOCK, CONTAINMENT, PHRASES, STEP, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components by labels that fall to the smallest reachable id. {links} has a and b in both directions, {nodes} has id.
_COMPONENTS = """
reach(id, r) as (select id, id from {nodes} union select l.a, reach.r from reach join {links} l on l.b = reach.id where reach.r < l.a)
"""

JACCARD = f"""
with recursive w as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as t from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.t = y.t and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
nodes as (select doc_id as id from documents),
{_COMPONENTS.format(nodes="nodes", links="links")}
select doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from documents left join n using (doc_id) join (select id as doc_id, min(r) as component_id from reach group by 1) c using (doc_id)
"""

EMBEDDINGS = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9),
nodes as (select vec_id as id from embeddings),
{_COMPONENTS.format(nodes="nodes", links="links")},
c as (select id as vec_id, min(r) as component_id from reach group by 1), k as (select a as vec_id, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c using (vec_id) left join k using (vec_id)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TEMPLATE_ROWS = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, t in TEMPLATES.items())
_PHRASE_ROWS = ", ".join(f"('{label}', {p.split()!r})" for p, label in PHRASES.items())

LICENSES = f"""
with w as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
t as (select * from (values {_TEMPLATE_ROWS}) t(label, tokens)), p as (select * from (values {_PHRASE_ROWS}) p(label, words)),
base as (select doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(words)] = words)) as place from w, p),
b as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word from base group by 1),
block as (select doc_id, w[i * {STEP} + 1:i * {STEP} + {BLOCK}] as w from (select doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - {STEP}) / {STEP}.0)::bigint))) as i from w)),
own as (select distinct doc_id, label, max(len(list_intersect(list_distinct(block.w), tokens)) / len(tokens)) over (partition by doc_id) as share from block, t where len(list_intersect(list_distinct(block.w), tokens)) >= ceil({CONTAINMENT} * len(tokens) - 1e-9)),
labels as (select doc_id, label from own union select doc_id, label from base)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce((select string_agg(distinct label, ',' order by label) from base where base.doc_id = w.doc_id), '') as base_labels,
  coalesce((select string_agg(distinct label, ',' order by label) from labels where labels.doc_id = w.doc_id), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce((select max(share) from own where own.doc_id = w.doc_id), 0)::double end as score
from w left join b using (doc_id)
"""
