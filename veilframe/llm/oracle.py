"""DuckDB SQL of the operators that SQL expresses: pairwise comparison, reachability in a recursive CTE, counts of phrases."""

_REACH = """edges as (select a, b from links union all select b, a from links),
 reach(node, seen) as (select a, a from edges union select r.node, e.b from reach r join edges e on r.seen = e.a),
 comp as (select node, min(seen) as component_id from reach group by node)"""

OP3 = f"""with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
 ok as (select *, sqrt(list_dot_product(e, e)) as n from v where label is not null and e is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 links as (select x.vec_id as a, y.vec_id as b from ok x join ok y on x.label = y.label and x.vec_id < y.vec_id and len(x.e) = len(y.e)
  where list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98), {_REACH},
 n as (select a, count(*) as n_links from edges group by a)
 select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
 from embeddings left join comp on vec_id = node left join n on vec_id = n.a"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP7 = f"""with recursive w as materialized (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
 class as materialized (select min(doc_id) as rep, len(any_value(s)) as n, any_value(s) as s, list(doc_id) as members from s where len(s) > 0 group by md5(array_to_string(list_sort(s), chr(10)))),
 x as materialized (select rep, n, unnest(s) as h from class),
 pairs as (select p.rep as a, q.rep as b, count(*) as k, any_value(p.n) as na, any_value(q.n) as nb from x p join x q on p.h = q.h and p.rep < q.rep group by 1, 2),
 links as (select a, b from pairs where 100 * k >= 75 * (na + nb - k) union all select rep, unnest(members) from class where len(members) > 1), {_REACH}
 select doc_id, len(s) as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept from s left join comp on doc_id = node"""

OP12 = f"""with p as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents)),
 w as materialized (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
 total as (select lang, sum(len(w))::bigint as n from w group by lang),
 f as materialized (select lang, k, phrase, count(*) as f from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, range(1, 6) as t(k) where len(w) >= k) group by all having count(*) >= 100),
 cuts as (select c.lang, c.phrase, c.f as a, j, l.f as l, r.f as r, n, 1000::hugeint * c.f * n // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as j from f where k > 1) as c join total using (lang)
  join f as l on l.lang = c.lang and l.phrase = array_to_string(string_split(c.phrase, ' ')[1:j], ' ') join f as r on r.lang = c.lang and r.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')),
 best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
 kept as (select * from best where not exists (select 1 from f where f.lang = best.lang and f.k > len(string_split(best.phrase, ' ')) and f.f >= best.a and contains(concat(' ', f.phrase, ' '), concat(' ', best.phrase, ' '))))
 select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from kept qualify rank <= 2000"""

ORACLE = {"op3_embedding_dedup": OP3, "op7_near_dedup": OP7, "op12_collocations": OP12}
