"""Queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, collocations, covertree, decontaminate, html, hyperminhash, jaccard, langid, packing, quality, sharding, suffixes, toxicity

QUERIES = {
    "op1_leaks": decontaminate.op1_leaks,
    "op2_language_id": langid.op2_language_id,
    "op3_pack": packing.op3_pack,
    "op4_repeats": suffixes.op4_repeats,
    "op5_shard": sharding.op5_shard,
    "op6_main_text": html.op6_main_text,
    "op7_quality": quality.op7_quality,
    "op8_chat": chat.op8_chat,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_codes": covertree.op11_codes,
    "op12_near_duplicates": hyperminhash.op12_near_duplicates,
    "op13_collocations": collocations.op13_collocations,
}

#: CRC-32 of a text's bytes: a table of 256 by the rule of its polynomial, then folded over the bytes.
_CRC = """(with t as materialized (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n)) as t),
    b as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint)) as b from documents)
    select doc_id, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), cast(4294967295 as bigint)), 4294967295) as crc from b, t)"""

#: Jump consistent hashing with md5 draws; slots by md5 of what the rows are ordered by.
_SHARDS = f"""with recursive j as (select doc_id, cast(n as bigint) as n, cast(0 as bigint) as here, cast(0 as bigint) as nxt from documents, (values (8), (9)) as s(n)
    union all select doc_id, n, nxt, cast(floor((nxt + 1) * (cast(2147483648 as double) / ((cast('0x' || substr(md5(concat(doc_id, ':', nxt)), 1, 8) as bigint) >> 1) + 1))) as bigint) from j where nxt < n),
    s as (select doc_id, cast(max(here) filter (n = 8) as int) as shard, cast(max(here) filter (n = 9) as int) as grown_shard from j group by doc_id),
    r as (select d.doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, crc as text_crc32, 'key' as law, shard, grown_shard from documents d join s on s.doc_id = d.doc_id join {_CRC} c on c.doc_id = d.doc_id)
    select doc_id, size, text_crc32, law, shard, row_number() over (partition by shard order by substr(md5(concat(doc_id, ':', text_crc32, ':', size, ':')), 1, 8), doc_id, text_crc32, size) - 1 as slot, grown_shard from r"""

#: Turns as they are formatted: each backslash doubled and a backslash put into each control string.
_EXTRA = r"len(regexp_extract_all({c}, '\\\\|<\|im_start\|>|<\|im_end\|>|<\|startoftext\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))"
_CHAT = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    c as (select conv_id, count(*) as n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' order by turn) as whole, coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '') as loss,
    cast(sum(length(role) + {_EXTRA.format(c="role")} + length(text) + {_EXTRA.format(c="text")} + 24) as bigint) as formatted_chars from t group by conv_id)
    select conv_id, n_turns, sha256(whole) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from c"""

#: Word sets by their shingles, links by counts of common ones, components by reachability.
_LINKED = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    s as materialized (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < SIZE then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - SIZE + 2), lambda i: array_to_string(w[i:i + SIZE - 1], ' ')) end)) as s from w),
    k as materialized (select min(doc_id) as k, s, len(s) as n from s where len(s) > 0 group by s),
    e as (select k, n, unnest(s) as x from k), p as (select a.k as a, b.k as b, a.n as na, b.n as nb, count(*) as common from e a join e b on a.x = b.x and a.k < b.k and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
    l as (select a, b from p where 100 * common >= 80 * (na + nb - common)), both_ways as materialized (select a, b from l union all select b, a from l),
    r as (select k, k as c from k union select both_ways.b, r.c from r join both_ways on both_ways.a = r.k)
    select s.doc_id, len(s.s) as n_shingles, coalesce(c, s.doc_id) as component_id, coalesce(k.k, s.doc_id) as class_id MORE from s left join k on k.s = s.s left join (select k, min(c) as c from r group by k) m on m.k = k.k"""
_LINKS = _LINKED.replace("SIZE", "5").replace("MORE", "")
_NEAR = _LINKED.replace("SIZE", "2").replace("MORE", ", s.doc_id = coalesce(c, s.doc_id) as kept")

#: Codebooks by whole numbers: a vector's parts, then each round's nearest entries and floored means, one after the other.
_LAST = 6
_PARTS = """q as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as materialized (select vec_id, label, j, v[j * len(v) // 8 + 1:(j + 1) * len(v) // 8] as x from q, (select unnest(range(8)) as j)),
    b0 as materialized (select j, row_number() over (partition by j order by vec_id) - 1 as e, x as c from p qualify e < 16)"""
_ROUND = """d{n} as materialized (select vec_id, label, p.j, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from p join b{n} on b{n}.j = p.j qualify row_number() over (partition by vec_id, p.j order by d, e) = 1)"""
_MEANS = """m{n} as (select j, e, place, cast(floor_div(sum(x), count(*)) as bigint) as c from (select j, e, unnest(x) as x, unnest(range(len(x))) as place from d{n}) group by all),
    n{n} as (select j, e, list(c order by place) as c from m{n} group by all), b{m} as materialized (select b{n}.j, b{n}.e, coalesce(n{n}.c, b{n}.c) as c from b{n} left join n{n} on n{n}.j = b{n}.j and n{n}.e = b{n}.e)"""
_CODES = "with " + ", ".join(
    [_PARTS, *(x for n in range(_LAST) for x in (_ROUND.format(n=n), _MEANS.replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)").format(n=n, m=n + 1))), _ROUND.format(n=_LAST)]
) + f"""
    , s as (select sha256(string_agg(cast(x as varchar), ',' order by j, e, place)) as codebooks_sha256 from (select j, e, unnest(c) as x, unnest(range(len(c))) as place from b{_LAST})),
    v as (select vec_id, label, string_agg(printf('%02x', e), '' order by j) as code, cast(sum(d) as bigint) as error from d{_LAST} group by vec_id, label)
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v, s"""

#: All phrases of one to five words by their counts; cuts, scores in whole numbers of any size, extensions by one word.
_PHRASES = r"""with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t), n as (select lang, sum(len(w)) as n from w group by lang),
    g as (select lang, w, unnest(range(1, len(w) + 1)) as i from w), h as (select lang, w[i:i + z] as p from g, (select unnest(range(5)) as z) where i + z <= len(w)),
    f as materialized (select lang, p, count(*) as f from h group by all having count(*) >= 100),
    c as (select lang, p, f as a, unnest(range(1, len(p))) as k from f where len(p) > 1),
    s as (select c.lang, c.p, a, k, l.f as l, r.f as r, n.n, (1000 * a::hugeint * n.n::hugeint) // (l.f::hugeint * r.f::hugeint) as score from c
        join f l on l.lang = c.lang and l.p = c.p[1:k] join f r on r.lang = c.lang and r.p = c.p[k + 1:] join n on n.lang = c.lang),
    o as (select lang, p[:len(p) - 1] as p, max(f) as f from f where len(p) > 2 group by all union all select lang, p[2:], max(f) from f where len(p) > 2 group by all),
    b as (select lang, p, max(f) as longer from o group by all),
    d as (select s.lang, array_to_string(s.p, ' ') as phrase, a, l, r, n, score from s left join b on b.lang = s.lang and b.p = s.p where coalesce(longer, 0) < a qualify row_number() over (partition by s.lang, s.p order by score, k) = 1)
    select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from d qualify rank <= 2000"""

#: Strings of 400 bytes as pieces of hexadecimal text; starts of those that come twice, runs that they cover, what is left.
_REPEATS = """with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    w as materialized (select doc_id, i, md5(h[2 * i + 1:2 * (i + 400)]) as m from (select doc_id, h, unnest(range(0, len(h) // 2 - 399)) as i from d)),
    a as (select doc_id, i from w join (select m from w group by m having count(*) > 1) as c on c.m = w.m),
    b as (select *, sum(fresh) over (partition by doc_id order by i) as run from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 400 then 0 else 1 end as fresh from a)),
    r as materialized (select doc_id, run, min(i) as lo, max(i) + 400 as hi from b group by doc_id, run),
    t as (select doc_id, cast(sum(hi - lo) as bigint) as n_removed, count(*) as n_spans from r group by doc_id),
    g as (select doc_id, lag(hi, 1, 0) over (partition by doc_id order by lo) as f, lo as z from r union all select d.doc_id, coalesce(max(hi), 0), max(len(h)) // 2 from d left join r on r.doc_id = d.doc_id group by d.doc_id),
    x as (select g.doc_id, string_agg(h[2 * f + 1:2 * z], '' order by f) as h from g join d on d.doc_id = g.doc_id group by g.doc_id)
    select d.doc_id, len(d.h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(x.h)) as kept_sha256 from d join x on x.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""

#: The others need a trained model, a tokenizer, an index or a parser; tests hold brute-force versions.
ORACLE_SQL: dict[str, str] = {"op4_repeats": _REPEATS, "op5_shard": _SHARDS, "op8_chat": _CHAT, "op9_jaccard": _LINKS, "op11_codes": _CODES, "op12_near_duplicates": _NEAR, "op13_collocations": _PHRASES}
