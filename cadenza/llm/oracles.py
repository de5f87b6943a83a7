"""DuckDB SQL of the queries that SQL can express on whole tables: all pairs and recursion where the operators hash and contract."""

from __future__ import annotations

from . import op2_dartminhash as D
from . import op4_rabitq as R
from . import op9_secrets as S
from . import op10_suffix as X

REACHED = "reached as (select id, id as m from nodes union select e.b, r.m from reached r join e on e.a = r.id)"

NEAR_TEXTS = rf"""with recursive
w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {D.WORDS} then list_transform(range(1, len(w) - {D.WORDS - 2}), lambda i: array_to_string(w[i:i + {D.WORDS - 1}], ' ')) else [array_to_string(w, ' ')] end) as g from w where len(w) > 0),
n as (select doc_id, count(*) as c from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where k >= {D.SIMILARITY}::double * (x.c + y.c - k)),
e as (select a, b from l union all select b, a from l),
nodes as (select distinct doc_id as id from documents),
{REACHED}
select id as doc_id, min(m) as class_id, min(m) = id as kept from reached group by id"""

NEAR_VECTORS = f"""with recursive
v as (select vec_id, embedding::double[] as x from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0),
e as (select p.vec_id as a, q.vec_id as b from v p join v q on p.vec_id <> q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= {R.THRESHOLD}),
nodes as (select vec_id as id from embeddings),
{REACHED}
select id as vec_id, (select count(*) from e where a = id) as n_links, min(m) as component_id, min(m) = id as kept from reached group by id"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def located(no: int, pattern: str, inner: int) -> str:
    p = quoted(pattern)
    hits = f"list_append(regexp_extract_all(t, {p}), null)"
    return f"select rid, {no} as no, unnest(string_split_regex(t, {p})) as gap, unnest({hits}) as hit, unnest(list_append(regexp_extract_all(t, {p}, {inner}), null)) as inside, generate_subscripts({hits}, 1) as i from docs"


def tail(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.2316419 * abs({z})))"
    return f"(exp(-{z} * {z} / 2) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))) / sqrt(2 * pi()))"


ALPHABET = "case " + " ".join(f"when regexp_matches(body, {quoted(p)}) then {quoted(a)}" for p, a in S.ALPHABETS[:-1]) + f" else {quoted(S.ALPHABETS[-1][1])} end"
STRATUM = "case " + " ".join(f"when e - s >= {least} then {i}" for i, least in reversed(list(enumerate(S.STRATA)))) + " else 0 end"
KIND = "case no " + " ".join(f"when {i} then {quoted(k)}" for i, k in enumerate(S.KINDS)) + " end"
WRITTEN = lambda when: f"coalesce(string_agg({KIND} || ':' || s || ':' || e, ',' order by s, no) filter ({when}), '')"

SECRETS = f"""with docs as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
found as ({" union all ".join(located(i, p, g) for i, (p, g) in enumerate(((S.ASSIGN, 2), (S.ACCESS, 0), (S.HEX, 0), (S.OUTSIDE, 3))))}),
ended as (select rid, no, hit, inside, sum(length(gap) + coalesce(length(hit), 0)) over (partition by rid, no order by i) as e from found),
spans as (select rid, no, cast(e - length(hit) as bigint) as s, cast(e as bigint) as e, hit from ended where hit is not null and length(inside) >= case no when 0 then 12 else 1 end),
free as (select *, regexp_replace(hit, '=+$', '') as body from spans x where no = 3 and not exists (select 1 from spans b where b.rid = x.rid and b.no in (1, 2) and b.s = x.s and x.e = b.e)),
coded as (select *, {ALPHABET} as symbols, greatest(length(body), 2)::double as n from free),
valued as (select *, length(symbols)::double as k, list_transform(string_split(body, ''), lambda c: instr(symbols, c) - 1) as v from coded),
tested as (select *,
  (k * list_sum(list_transform(list_distinct(v), lambda y: pow(len(list_filter(v, lambda z: z = y)), 2))) / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) as chi,
  (len(list_filter(range(1, len(v)), lambda j: (2 * v[j] >= k) <> (2 * v[j + 1] >= k))) - (n - 1) / 2) / sqrt((n - 1) / 4) as runs,
  coalesce(list_sum(list_transform(range(1, len(v)), lambda j: (v[j] - (k - 1) / 2) * (v[j + 1] - (k - 1) / 2))), 0) / (sqrt(n - 1) * (k * k - 1) / 12) as serial from valued),
binned as (select *, {STRATUM} as stratum, least({S.TOP}, floor(-log10(greatest(least(1.0, 3 * least(case when chi > 0 then {tail('chi')} else 0.5 end, 2 * {tail('runs')}, 2 * {tail('serial')})), 1e-200)) * {S.BINS})) as bin from tested),
ranked as (select stratum, bin, sum(c) over (partition by stratum order by bin desc) as above, sum(c) over (partition by stratum) as whole from (select stratum, bin, count(*) as c from binned group by all)),
limits as (select stratum, min(bin) as cut from ranked where pow(10.0, -bin / {S.BINS}.0) <= {S.Q} * above / whole group by stratum),
kept as (select rid, no, s, e from spans where no < 3 union all select rid, no, s, e from binned left join limits using (stratum) where cut is null or bin < cut),
told as (select rid, cast(count(*) filter (no = 0) as bigint) as n_assign, cast(count(*) filter (no = 1) as bigint) as n_access, cast(count(*) filter (no = 2) as bigint) as n_hex, {WRITTEN('no < 3')} as base, {WRITTEN('true')} as spans from kept group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join told using (rid)"""

REPEATS = f"""with docs as (select doc_id, encode(coalesce(text, '')) as b, row_number() over () as rid from documents),
places as (select doc_id, rid, b, unnest(range(1, octet_length(b) - {X.LENGTH} + 2)) as i from docs),
strings as (select doc_id, rid, i, b[i:i + {X.LENGTH - 1}] as s from places),
gone as (select rid, i, i > 1 + lag(i, 1, -1000) over w + {X.LENGTH - 1} as fresh from (select *, min(doc_id) over (partition by s) as least from strings) where least < doc_id window w as (partition by rid order by i)),
numbered as (select rid, i, sum(fresh::int) over (partition by rid order by i) as span from gone),
spans as (select rid, span, min(i) as a, max(i) + {X.LENGTH} as z from numbered group by all),
kept as (select rid, lag(z, 1, 1) over w as a, a as z, span from spans window w as (partition by rid order by span) union all select rid, max(z), null, null from spans group by rid),
told as (select rid, cast(sum(z - a) as bigint) as n_removed, count(*) as n_spans from spans group by rid),
rest as (select rid, unhex(string_agg(hex(case when z is null then b[a:] when z > a then b[a:z - 1] else ''::blob end), '' order by a)) as kept from kept join docs using (rid) group by rid)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(kept, b)) as kept_sha256 from docs left join told using (rid) left join rest using (rid)"""

ORACLES = {"op2_dartminhash": NEAR_TEXTS, "op4_rabitq": NEAR_VECTORS, "op9_secrets": SECRETS, "op10_suffix": REPEATS}
