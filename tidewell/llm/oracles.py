"""DuckDB SQL for the queries that SQL can express, by plain definition: every window, every pair."""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REACH = """reach(id, c) as (select id, id from ids union select l.b, r.c from reach r join links l on l.a = r.id),
 least as (select id, min(c) as component_id from reach group by id)"""

NORM = "sqrt(list_dot_product(embedding::double[], embedding::double[]))"

OP1 = f"""with recursive fine as (select vec_id, label, embedding::double[] as e, {NORM} as n from embeddings
   where embedding is not null and label is not null and isfinite({NORM}) and {NORM} > 0),
 ids as (select vec_id as id from embeddings),
 links as (select x.vec_id as a, y.vec_id as b from fine x join fine y on x.label = y.label and x.vec_id <> y.vec_id and list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98),
 {REACH}
 select id as vec_id, coalesce(k.n, 0) as n_links, component_id, id = component_id as kept from least left join (select a, count(*) as n from links group by a) k on k.a = least.id"""

OP2 = rf"""with d as (select doc_id, source, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as ws from documents),
 t as (select doc_id, unnest(range(1, len(ws) - 1)) as k, ws from d where len(ws) >= 3),
 g as (select doc_id, k, count(*) over (partition by doc_id, ws[k], ws[k + 1], ws[k + 2]) as n from t),
 r as (select doc_id, count(distinct k + o) as n from g, (select unnest([0, 1, 2]) as o) where n > 1 group by doc_id),
 l as (select doc_id, source, line, {WORDS.format("translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as lw from (select doc_id, source, unnest(string_split(text, chr(10))) as line from d)),
 f as (select doc_id, source, line, array_to_string(lw, ' ') as h, len(lw) as n from l where len(lw) > 0),
 u as (select doc_id, count(*) - count(distinct line) as n from f group by doc_id),
 hd as (select source, count(distinct doc_id) as docs from d group by source),
 q as (select f.source, f.h from f join hd on hd.source is not distinct from f.source group by f.source, f.h having count(distinct doc_id) > 20 and count(distinct doc_id) > 0.01 * max(hd.docs)),
 z as (select f.doc_id, count(distinct f.h) as lines, sum(f.n) as gone from f join q on q.h = f.h and q.source is not distinct from f.source group by f.doc_id),
 b as (select d.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(u.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
   coalesce(z.lines, 0) as n_frequent_lines, (len(ws) - coalesce(z.gone, 0))::bigint as words_left
   from d left join u using (doc_id) left join r using (doc_id) left join z using (doc_id)),
 c as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
 select *, not base_failed and not words_left < 0.3 * n_words as kept from c"""

OP4 = rf"""with recursive d as (select doc_id, source, coalesce(len({WORDS.format("text")}), 0)::bigint as size, md5('mix' || coalesce(doc_id::varchar, '')) as h from documents),
 s as (select source, coalesce('=' || source, '') as key, sum(size)::bigint as source_size, [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source is null, source) - 1) % 3] as w from d group by source),
 o as (select *, row_number() over (order by 2 * source_size / w, key) as k, sum(w) over (order by 2 * source_size / w, key rows between current row and unbounded following) as free,
   1.5::double * (select sum(source_size) from s)::double - 2.0::double * coalesce(sum(source_size) over (order by 2 * source_size / w, key rows between unbounded preceding and 1 preceding), 0)::double as rest from s),
 f as (select k, rest, free from o where rest * w / free <= 2.0::double * source_size order by k limit 1),
 t as (select o.source, o.key, o.source_size, case when f.k is null or o.k < f.k then 2.0::double * o.source_size else f.rest * o.w / f.free end as target,
   ('0x' || substr(md5('mix' || o.key), 1, 8))::bigint / 4294967296.0::double as offs from o left join f on true),
 c as (select key, size, n, row_number() over (partition by key order by size desc) as i from (select coalesce('=' || source, '') as key, size, count(*) as n from d group by 1, 2)),
 w as (select t.key, 0::bigint as i, 0::bigint as size, 0.0::double as rate, 0.0::double as start, t.target as wanted, t.source_size::double as remain, t.offs as pos from t
  union all select key, i, size, rate, pos, wanted - (floor(pos + rate * n) - floor(pos)) * size, remain - size * n, (pos + rate * n) - floor(pos + rate * n)
   from (select w.key, c.i, c.size, c.n, w.pos, w.wanted, w.remain, case when c.size > 0 and w.remain > 0 then least(greatest(w.wanted / w.remain, 0.0::double), 2.0::double)
     when t.source_size > 0 then least(t.target / t.source_size, 2.0::double) else 0.0::double end as rate from w join c on c.key = w.key and c.i = w.i + 1 join t on t.key = w.key)),
 p as (select doc_id, source, size, row_number() over (partition by source, size order by h, doc_id) as j from d)
 select p.doc_id, p.size, t.source_size, t.target, (floor(w.start + w.rate * p.j) - floor(w.start + w.rate * (p.j - 1)))::bigint * p.size as taken,
  (floor(w.start + w.rate * p.j) - floor(w.start + w.rate * (p.j - 1)))::bigint as copies
 from p join t on t.source is not distinct from p.source join w on w.key = t.key and w.size = p.size and w.i > 0"""

OP5 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
 p as (select doc_id, unnest(range(1, length(x) // 2 + 1)) as k, x from d where length(x) > 0),
 s as (select doc_id, k, substr(x, 2 * k - 1, 2) as b, case when k + 49 <= length(x) // 2 then substr(x, 2 * k - 1, 100) end as w from p),
 m as (select w, min(doc_id) as least from s where w is not null group by w),
 h as (select s.doc_id, s.k, s.b, m.least < s.doc_id as hit from s left join m on m.w = s.w),
 c as (select doc_id, k, b, coalesce(max(case when hit then k end) over (partition by doc_id order by k rows unbounded preceding) >= k - 49, false) as gone from h),
 e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by k), false) as begins from c),
 a as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where begins) as n_spans, string_agg(case when not gone then b end, '' order by k) as rest from e group by doc_id)
 select d.doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, ''))) as kept_sha256 from d left join a using (doc_id)"""

OP6 = f"""with recursive d as (select doc_id, {WORDS.format(LOWER)} as ws from documents),
 g as (select distinct doc_id, array_to_string(ws[k : k + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as k from d where len(ws) > 0)),
 n as (select doc_id, count(*) as n from g group by doc_id),
 ids as (select doc_id as id from d),
 links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2) join n na on na.doc_id = a join n nb on nb.doc_id = b
   where 100 * c >= 80 * (na.n + nb.n - c)),
 {REACH}
 select id as doc_id, coalesce(n.n, 0) as n_shingles, component_id from least left join n on n.doc_id = least.id"""

OP8 = f"""with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as ws from documents),
 p as (select doc_id, unnest(range(1, len(ws) + 1)) as k, ws from d where len(ws) > 0),
 s as (select doc_id, k, ws[k] as word, case when k + 12 <= len(ws) then array_to_string(ws[k : k + 12], ' ') end as w from p),
 m as (select w, min(doc_id) as least from s where w is not null group by w),
 h as (select s.doc_id, s.k, s.word, m.least < s.doc_id as hit from s left join m on m.w = s.w),
 c as (select doc_id, k, word, coalesce(max(case when hit then k end) over (partition by doc_id order by k rows unbounded preceding) >= k - 12, false) as gone from h),
 a as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(case when not gone then word end, ' ' order by k) as rest from c group by doc_id)
 select d.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(rest, '')) as kept_sha256 from d left join a using (doc_id)"""

FINE = "len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))"
INTS = "list_transform(embedding, lambda x: floor(256 * x::double))"
GAP = "list_dot_product({0}, {0}) - 2 * list_dot_product({0}, {1}) + list_dot_product({1}, {1})"


def _op11(rounds: int = 5) -> str:
    """Every vector against every centroid, round by round; numbers are whole and small enough for doubles."""
    steps = ["v as (select row_number() over () as r, vec_id, " + INTS + " as e from embeddings where len(embedding) = 64 and " + FINE + ")"]
    steps.append("c0 as (select row_number() over (order by sha256('2:' || vec_id::varchar) nulls last, e) - 1 as k, e from v order by k limit 40)")
    for t in range(rounds + 1):
        steps.append(f"a{t} as (select r, min((d * 64 + k)::bigint) as m from (select v.r, c.k, {GAP.format('v.e', 'c.e')} as d from v cross join c{t} c) group by r)")
        if t < rounds:
            steps.append(f"s{t} as (select k, i, floor(sum(x) / count(*)) as x from (select (m % 64)::bigint as k, unnest(v.e) as x, generate_subscripts(v.e, 1) as i from v join a{t} using (r)) group by k, i)")
            steps.append(f"c{t + 1} as (select c.k, coalesce(n.e, c.e) as e from c{t} c left join (select k, list(x order by i) as e from s{t} group by k) n using (k))")
    return "with " + ",\n ".join(steps) + f""",
 f as (select vec_id, (m % 64)::int as cluster, (m // 64)::bigint as distance from v join a{rounds} using (r)),
 h as (select k, sha256(array_to_string(e::bigint[], ',')) as centroid_sha256 from c{rounds})
 select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256 from f join h on h.k = f.cluster"""


def _op13(rounds: int = 2) -> str:
    """Every part against every entry of its codebook, round by round."""
    steps = ["v as (select row_number() over (order by vec_id nulls last, e) as r, vec_id, label, e from (select vec_id, label, " + INTS + " as e from embeddings where len(embedding) = 64 and " + FINE + "))"]
    steps.append("x as (select r, p, e[4 * p + 1 : 4 * p + 4] as e from (select r, e, unnest(range(16)) as p from v))")
    steps.append("b0 as (select p, r - 1 as k, e from x where r <= 64)")
    for t in range(rounds + 1):
        steps.append(f"a{t} as (select r, p, min((d * 64 + k)::bigint) as m from (select x.r, x.p, b.k, {GAP.format('x.e', 'b.e')} as d from x join b{t} b on b.p = x.p) group by r, p)")
        if t < rounds:
            steps.append(f"s{t} as (select p, k, i, floor(sum(c) / count(*)) as c from (select p, (m % 64)::bigint as k, unnest(x.e) as c, generate_subscripts(x.e, 1) as i from x join a{t} using (r, p)) group by p, k, i)")
            steps.append(f"b{t + 1} as (select b.p, b.k, coalesce(n.e, b.e) as e from b{t} b left join (select p, k, list(c order by i) as e from s{t} group by p, k) n using (p, k))")
    return "with " + ",\n ".join(steps) + f""",
 f as (select r, string_agg(lower(format('{{:02x}}', (m % 64)::int)), '' order by p) as code, sum(m // 64)::bigint as error from a{rounds} group by r),
 g as (select sha256(string_agg(array_to_string(e::bigint[], ','), ',' order by p, k)) as codebooks_sha256 from b{rounds})
 select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join f using (r) cross join g"""


SQL = {"op1_vector_dedup": OP1, "op2_line_rules": OP2, "op4_systematic_mix": OP4, "op5_suffix_merge": OP5, "op6_jaccard_join": OP6, "op8_window_dedup": OP8,
       "op11_hamerly_clusters": _op11(), "op13_vector_codes": _op13()}
