"""DuckDB SQL of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 or words is null then [] when len(words) < 4 then [words] else list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
k as (select doc_id, hash(shingle) as h, shingle from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from k a join k b on a.h = b.h and a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, reached) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.reached)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id from (select doc_id, min(reached) as component_id from r group by doc_id) c left join n using (doc_id)"""

OP1_LINKS = f"""{OP1.partition("select doc_id, cast(coalesce(n.n, 0)")[0]}, g as (select doc_id, list_sort(list(shingle)) as shingles from k group by doc_id),
d as (select a as doc_id, count(distinct y.shingles) as n_links from l join g x on x.doc_id = a join g y on y.doc_id = b where x.shingles <> y.shingles group by a)
select c.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, cast(coalesce(n_links, 0) as bigint) as n_links
from (select doc_id, min(reached) as component_id from r group by doc_id) c left join n on n.doc_id = c.doc_id left join d on d.doc_id = c.doc_id"""

#: sha1 as base32: each 5 of its 40 hexadecimal digits make 4 of 32 characters.
_PART = "(('0x' || substr(h, {0} * 5 + 1, 5))::bigint)"
_CHARACTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((" + _PART + " >> {1}) & 31)::int + 1, 1)"
OP3 = f"""
with h as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, {" || ".join(_CHARACTER.format(i, s) for i in range(8) for s in (15, 10, 5, 0))} as payload_digest from h),
m as (select *, max(page_id) over (partition by payload_digest) as kept from d)
select page_id, payload_bytes, payload_digest, case when page_id = kept then 'response' else 'revisit' end as record_type, case when page_id <> kept then kept end as refers_to from m"""


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its rule."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ 0xEDB88320 * (value & 1)
        out.append(value)
    return out


_TABLE = f"{_crc_table()}::bigint[]"
#: The unsigned CRC-32 of a list of bytes, and the bytes of a text.
CRC = f"xor(list_reduce({{0}}, lambda acc, b: xor(acc >> 8, ({_TABLE})[(xor(acc, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"
BYTES = "list_transform(range(1, octet_length(encode({0})) * 2, 2), lambda i: ('0x' || substr(hex(encode({0})), i, 2))::bigint)"

_FEATURES = """
{p}w as (select {id} as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') as words from {table}),
{p}f as (select id, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) as feature from {p}w, unnest([1, 2, 3]) g(k) where len(words) >= k)"""
OP13 = f"""
with {_FEATURES.format(p="d", id="doc_id", table="documents", word=ASCII_WORD).strip()}, {_FEATURES.format(p="b", id="item_id", table="benchmark", word=ASCII_WORD).strip()},
u as (select distinct word, {BYTES.format("word")} as b from (select unnest(words) as word from dw union all select unnest(words) from bw)),
df2 as (select id, feature, count(*) as n from df group by all), bf2 as (select feature, count(*) as n from bf group by all),
k as (select feature, {CRC.format("case len(feature) when 1 then x.b when 2 then list_concat(x.b, [32::bigint], y.b) else list_concat(x.b, [32::bigint], y.b, [32::bigint], z.b) end")} % 10000 as bucket
  from (select distinct feature from (select feature from df2 union all select feature from bf2)) f join u x on x.word = feature[1] left join u y on y.word = feature[2] left join u z on z.word = feature[3]),
s as (select bucket, sum(n)::double as s from df2 join k using (feature) group by all), t as (select bucket, sum(n)::double as t from bf2 join k using (feature) group by all),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((select coalesce(sum(s), 0) from s) + 10000) / ((s + 1) * ((select coalesce(sum(t), 0) from t) + 10000))))::bigint as gain from s left join t using (bucket)),
m as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from df2 join k using (feature) join g using (bucket) group by all),
r as (select id as doc_id, len(words) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from dw left join m using (id)),
p as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as able from r)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= floor(5 * able / 100) then place end as rank from p"""

OP12 = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as place from conversations where conv_id is not null),
c as (select conv_id, list(struct_pack(role := role, text := text) order by place) as own from t group by conv_id),
h as (select conv_id, own, conv_id - conv_id % 20 as base, ({CRC.format(BYTES.format("conv_id::varchar"))} % 4)::int as h from c),
r as (select h.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) as turns from h left join c b on b.conv_id = h.base),
p as (select conv_id, turns, d, list_slice(turns, 1, d) as prefix from r, unnest(range(0, len(turns) + 1)) g(d)),
n as (select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = d) as ended,
  case when d = 0 then 0 else len(regexp_extract_all(prefix[d].text, '{WORD}')) end as words from p group by d, prefix),
k as (select a.d, a.prefix, count(*) as n_children from n a join n b on b.d = a.d + 1 and list_slice(b.prefix, 1, a.d) = a.prefix group by a.d, a.prefix),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (d, prefix)),
s as (select u as d, list_slice(prefix, 1, u) as prefix, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens from m, unnest(range(0, d + 1)) g(u) group by all)
select m.conv_id, m.d::bigint as depth, q.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(m.ended, '')) as ends_sha256
from m join s on s.d = m.d and s.prefix = m.prefix left join m q on q.d = m.d - 1 and q.prefix = list_slice(m.prefix, 1, m.d - 1)"""
