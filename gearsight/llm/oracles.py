"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gearsight.llm import url_filter as U

_UPPER, _LOWER = U.UPPER, U.LOWER
# The ASCII white space that line keys lose at both ends.
_SPACE = r"[\x20\x09-\x0D]"

LINE_DEDUP = rf"""
with split as (
  select doc_id, rowid as r, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from (select doc_id, text, row_number() over () as rowid from documents)),
keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''),
                      '{_UPPER}', '{_LOWER}') as key from split),
common as (select key from keyed where key <> '' group by key having count(distinct r) >= 10)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (c.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (c.key is null), '')) as kept_sha256
from keyed k left join common c on c.key = k.key group by r
"""


def _propagated(name: str, seeds: str, src: str, dst: str) -> str:
    ctes = [f"{name}0 as materialized (select host, {seeds} as mass from counts where {seeds} > 0)",
            f"{name}_out as materialized (select {src} as host, sum(n) as total from links group by 1)"]
    for i in range(U.ITERATIONS):
        ctes.append(f"""{name}{i + 1} as materialized (select host, sum(mass) as mass from (
          select l.{dst} as host, r.mass * (l.n / o.total) * {U.DAMPING}e0 as mass
          from {name}{i} r join links l on l.{src} = r.host join {name}_out o on o.host = r.host
          union all select host, mass * {U.DAMPING}e0 from {name}{i} where host not in (select host from {name}_out)
          union all select host, mass * (1 - {U.DAMPING}e0) from {name}0) group by host)""")
    return ",\n".join(ctes)


def _rule_cases() -> str:
    ordered = sorted(U.RULES, key=lambda r: -len(r[1] + r[2]))
    return " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'"
                    for _, h, p in ordered)


_VERDICTS = " ".join(f"when '{h}{p}' then '{v}'" for v, h, p in U.RULES)
_LINK = U.LINK.replace("'", "''")

URL_FILTER = rf"""
with rest as (
  select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
named as (
  select page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') as path from rest),
ruled as (select *, case {_rule_cases()} end as rule from named),
counts as materialized (
  select host, count(*) filter (case rule {_VERDICTS} end = 'allow') * 1e0 as allowed,
         count(*) filter (case rule {_VERDICTS} end = 'block') * 1e0 as blocked,
         count(*) filter (rule is null) * 1e0 as undecided from ruled where host <> '' group by host),
links as materialized (
  select src, dst, count(*) * 1e0 as n from (
    select host as src, translate(regexp_replace(link, '^.*@|:[0-9]*$', ''), '{_UPPER}', '{_LOWER}') as dst
    from (select host, unnest(regexp_extract_all(coalesce(html, ''), '{_LINK}', 1)) as link
          from ruled where host <> ''))
  where src <> dst and dst <> '' group by 1, 2),
{_propagated('trust', 'allowed', 'src', 'dst')},
{_propagated('doubt', 'blocked', 'dst', 'src')},
hosts as (
  select c.host, coalesce(d.mass, 0) > 0
         and coalesce(d.mass, 0) >= {U.THRESHOLD}e0 * (coalesce(d.mass, 0) + coalesce(t.mass, 0) + c.undecided) as bad
  from counts c left join trust{U.ITERATIONS} t using (host) left join doubt{U.ITERATIONS} d using (host))
select page_id, r.host, path, rule,
       coalesce(case rule {_VERDICTS} end, case when bad then 'block' else 'allow' end) as verdict
from ruled r left join hosts h on h.host = r.host
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars")


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in (*_FIELDS, text)]
    return f"sha256({' || '.join(parts)})"


# CRC-32 of a string of ASCII characters, bit by bit (reflected polynomial 0xEDB88320).
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1),
  lambda i: ascii({0}[i])::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
  lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


def _merkle_levels(name: str, leaves: str) -> str:
    return f"""
{name}(g, level, pos, h) as (
  select g, 0, pos, h from {leaves}
  union all
  select g, level + 1, pos // 8, sha256(string_agg(h, '' order by pos))
  from (select *, count(*) over (partition by g) as n from {name}) where n > 1 group by g, level, pos // 8),
{name}_runs as (
  select g, level, pos // 8 as up, list(h order by pos) as hs
  from (select *, count(*) over (partition by g, level) as n from {name}) where n > 1 group by 1, 2, 3)"""


def _merkle_climb(name: str, tree: str, start: str) -> str:
    """From each start (k, g, pos, folded, proof) to the root of its tree."""
    return f"""
{name}(k, g, level, pos, folded, proof) as (
  select k, g, 0, pos, folded, proof from {start}
  union all
  select k, c.g, c.level + 1, pos // 8,
         sha256(array_to_string(hs[:pos % 8], '') || folded || array_to_string(hs[pos % 8 + 2:], '')),
         proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
  from {name} c join {tree}_runs r on r.g = c.g and r.level = c.level and r.up = c.pos // 8),
{name}_end as (select k, g, arg_max(folded, level) as folded, arg_max(proof, level) as proof from {name} group by k, g)"""


MERKLE = f"""
with recursive lowered as (select *, translate(text, '{_UPPER}', '{_LOWER}') as low, cast(doc_id as varchar) as s from documents),
hashed as (
  select doc_id, coalesce('=' || lang, '') as g, {_leaf("text")} as h,
         case when {_CRC.format("s")} % 3 = 0 then {_leaf("low")} else {_leaf("text")} end as shown
  from lowered),
placed as (select *, row_number() over () as k, row_number() over (partition by g order by doc_id nulls first, h) - 1 as pos
           from hashed),{_merkle_levels("node", "placed")},
subroots as (select g as lang, arg_max(h, level) as h from node group by g),
tops as (select '' as g, lang, h, row_number() over (order by lang) - 1 as pos from subroots),{_merkle_levels("high", "tops")},
top as (select arg_max(h, level) as root from high),
started as (select k, g, pos, shown as folded, '' as proof from placed),{_merkle_climb("climb", "node", "started")},
higher as (select k, '' as g, t.pos, folded, proof from climb_end c join tops t on t.lang = c.g),
{_merkle_climb("rise", "high", "higher")}
select doc_id, p.h as leaf, s.h as subroot, root, sha256(proof) as proof_sha256, folded as folded_root,
       folded = root as verified
from placed p join subroots s on s.lang = p.g join rise_end r on r.k = p.k, top
"""

ORACLES = {"op4_url_filter": URL_FILTER, "op8_line_dedup": LINE_DEDUP, "op12_merkle": MERKLE}
