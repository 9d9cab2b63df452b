"""SQL for DuckDB that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from . import secrets, url_filters

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUOTES = "\"'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def chat(tricky: str) -> str:
    order = "order by turn nulls first, role, t"
    times = lambda s, part: f"(length({s}) - length(replace({s}, {quoted(part)}, ''))) // {len(part)}"
    size = " + ".join(["16 + length(role) + length(t)", *(times("t", p) for p in ("\\", "<turn", "</turn")), *(times("role", p) for p in ("\\", "<", ">")), "length(role) - length(replace(role, chr(10), ''))"])
    return f"""with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
        union all select -7, 0, 'user', {quoted(tricky)} union all select -7, 1, 'assistant', {quoted(tricky)})
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' {order})) as turns_sha256,
        cast(coalesce(sum(length(t)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(t, '' {order}) filter (where role = 'assistant'), '')) as loss_sha256,
        cast(sum({size}) as bigint) as formatted_chars from said group by conv_id"""


def warc() -> str:
    digit = "cast(floor(cast('0x' || substr(h, cast(i // 4 * 5 + 1 as int), 5) as int) / pow(32, 3 - i % 4)) as int) % 32 + 1"
    return f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
    heads as (select html, max(page_id) as head from p group by html)
    select page_id, cast(strlen(html) as bigint) as payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {digit}, 1)), '') as payload_digest,
        case when page_id < head then 'revisit' else 'response' end as record_type, case when page_id < head then head end as refers_to
    from p join heads using (html)"""


def mixing() -> str:
    return r"""with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
    s as (select source, sum(size) as source_size from d group by source),
    r as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, row_number() over (order by source nulls last) as place from s),
    f as (select *, 3 * source_size as most, sum(source_size) over () as total, sum(w) over () as ws,
        coalesce(sum(3 * source_size) over (order by 3 * source_size / w::double, place rows between unbounded preceding and 1 preceding), 0) as fw,
        coalesce(sum(w) over (order by 3 * source_size / w::double, place rows between unbounded preceding and 1 preceding), 0) as fweight from r),
    l as (select *, (total - fw)::double / (ws - fweight) as level from f),
    m as (select *, max(case when w * level < most then level end) over () as pour from l),
    t as (select source, cast(source_size as bigint) as source_size, least(most::double, coalesce(w * pour, most::double)) as target from m),
    n as (select d.*, t.source_size, t.target, row_number() over (partition by d.source
        order by size, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint), doc_id nulls first) as rank,
        (cast('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 4) as int) + 0.5::double) / 65536 as u,
        case when t.source_size > 0 then target / t.source_size else 0::double end as e from d join t on d.source is not distinct from t.source)
    select doc_id, size, source_size, target, cast(floor(rank * e + u) - floor((rank - 1) * e + u) as bigint) * size as taken from n"""


def scan() -> str:
    rules = secrets.BASE + secrets.MORE
    parts = []
    for place, rule in enumerate(rules):
        flags = ", 'i'" if rule.pattern.startswith("(?i)") else ""
        pattern = quoted(rule.pattern.removeprefix("(?i)"))
        tested = f"regexp_extract_all(t, {pattern}, {rule.group}{flags})" if flags else f"regexp_extract_all(t, {pattern}, {rule.group})"
        found = f"regexp_extract_all(t, {pattern}, 0{flags})"
        between = f"regexp_split_to_array(t, {pattern}{flags})"
        parts.append(f"select row_id, {place} as place, '{rule.kind}' as kind, {rule.shortest} as least, {found} as m, {tested} as g, {between} as b from texts")
    base = len(secrets.BASE)
    counts = ", ".join(f"cast(count(*) filter (where place = {i}) as bigint) as n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""with texts as (select row_number() over () as row_id, doc_id, coalesce(text, '') as t from documents),
    found as ({' union all '.join(parts)}),
    each as (select row_id, place, kind, least, m, g, b, unnest(range(1, len(m) + 1)) as i from found where len(m) > 0),
    spans as (select row_id, place, kind, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start,
        length(m[i]) as n from each where length(g[i]) >= least),
    named as (select *, kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint) as s from spans),
    sums as (select row_id, {counts}, string_agg(s, ',' order by start, place) filter (where place < {base}) as base, string_agg(s, ',' order by start, place) as spans from named group by row_id)
    select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from texts left join sums using (row_id)"""


def exact_dedup() -> str:
    return f"""with d as (select doc_id, {lowered("coalesce(text, '')")} as t from documents), g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
    select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id is null) as kept, sha256(t) as text_sha256 from d join g using (t)"""


def url_filter() -> str:
    """Its patterns are its own, so that they and the operator's check each other."""
    rest = lambda u: f"case when contains({u}, '://') then substr({u}, instr({u}, '://') + 3) else '' end"
    host = lambda u: lowered(f"regexp_extract({rest(u)}, '^[^/?#]*')")
    path = lambda u: f"regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1)"
    tracked = "starts_with(x, 'utm_') or split_part(x, '=', 1) in ('gclid', 'fbclid')"

    def form(u: str) -> str:
        query = f"string_split(regexp_extract({rest(u)}, '^[^?#]*\\?([^#]*)', 1), '&')"
        kept = f"array_to_string(list_filter({query}, lambda x: x <> '' and not ({tracked})), '&')"
        steps = "lambda done, x: case x when '.' then done when '..' then regexp_replace(done, '/[^/]*$', '') else done || '/' || x end"
        plain = f"case when {path(u)} = '' then '' else list_reduce(string_split({path(u)}, '/'), {steps}) end"
        return f"case when {host(u)} <> '' then {host(u)} || regexp_replace({plain}, '/$', '') || case when {kept} <> '' then '?' || {kept} else '' end end"

    def absolute(target: str, url: str) -> str:
        scheme, folder = f"split_part({url}, '://', 1)", f"regexp_extract({path(url)}, '(?s)^(.*)/', 1)"
        root = f"{scheme} || '://' || {host(url)}"
        return f"""case when {target} = '' or {target}[1] = '#' then null when regexp_matches({target}, '^[a-zA-Z][-+.a-zA-Z0-9]*://') then {target}
            when regexp_matches({target}, '^[a-zA-Z][-+.a-zA-Z0-9]*:') then null when {target}[1:2] = '//' then {scheme} || ':' || {target} when {target}[1] = '/' then {root} || {target}
            when {target}[1] = '?' then {root} || {path(url)} || {target} else {root} || {folder} || '/' || {target} end"""

    def attribute(tag: str, name: str) -> str:
        pattern = rf"""(?i)(?:\s|"|'|/){name}\s*=\s*("[^">]*"|'[^'>]*'|[^\s"'>]+)"""
        bare = f"trim(regexp_extract({tag}, {quoted(pattern)}, 1), {quoted(QUOTES)})"
        return f"trim(regexp_replace({bare}, '(?i)&(?:amp|#38|#x26);', '&', 'g'))"

    canonical = quoted(r"""(?i)<link\b[^>]*(?:\s|"|'|/)rel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>""")
    refresh = quoted(r"""(?i)<meta\b[^>]*(?:\s|"|'|/)http-equiv\s*=\s*["']?\s*refresh\b[^>]*>""")
    after = quoted(r"""(?i)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?["']?([^"']*)""")
    links = f"list_transform(regexp_extract_all(h, {canonical}), lambda x: {attribute('x', 'href')})"
    refreshes = f"list_transform(regexp_extract_all(h, {refresh}), lambda x: trim(regexp_extract({attribute('x', 'content')}, {after}, 1)))"
    base = attribute(r"regexp_extract(h, '(?i)<base\b[^>]*>')", "href")
    rules = sorted(url_filters.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in rules]
    rule = "case " + " ".join(f"{f} then '{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " end"
    action = "case " + " ".join(f"{f} then '{a}'" for f, (*_, a) in zip(fits, rules, strict=True)) + " end"
    return rf"""with recursive u as (select row_number() over () as row_id, page_id, coalesce(url, '') as url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|\z)', '', 'g') as h from pages),
    bases as (select url, h, {base} as b from u),
    targets as (select url, coalesce({absolute('b', 'url')}, url) as base, unnest(list_concat({links}, {refreshes})) as t from bases),
    whole as (select url, {absolute('t', 'base')} as t from targets),
    edges as (select {form('url')} as a, {form('t')} as b from whole), both_ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
    reach(f, root) as (select a, a from both_ways union select e.b, r.root from reach r join both_ways e on e.a = r.f),
    classes as (select f, min(root) as class from reach group by f),
    p as (select row_id, page_id, {host('url')} as host, {path('url')} as path, {form('url')} as form from u),
    judged as (select *, {rule} as rule, {action} as action from p), named as (select j.*, coalesce(class, form) as class from judged j left join classes on f = form),
    bad as (select distinct class from named where action = 'block')
    select page_id, host, path, rule, coalesce(action, case when bad.class is not null then 'block' else 'allow' end) as verdict from named left join bad using (class)"""
