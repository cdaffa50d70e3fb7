"""DuckDB SQL for the damage and the repair of conversations: the search as a recursion over rows."""

from __future__ import annotations


def _add(state: str, cost: str, letters: str) -> str:
    """A state (nine digits of cost, then the audit) after one more edit; null if the state cannot be reached."""
    return f"(lpad((left({state}, 9)::bigint + {cost})::varchar, 9, '0') || {state}[10:] || '{letters}')"


def _role(states: str, then: str, initial: str) -> list[str]:
    kept = [f"case when fault not in (1, 2) and r = '{initial}' then {_add(s, 'more', 'K')} end" for s in states.split()]
    return kept + [f"case when fault not in (1, 2) then {_add(s, '3 + more', 'R')} end" for s in states.split() if then]


_D = [_add(f"v{i}", "4", "D") for i in range(4)]

#: The checksum is taken bit by bit, eight steps a character (the keys are ASCII).
REPAIR_SQL = f"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
    from conversations),
fated as (
    select *, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(k, ''),
            lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 as fate
    from keyed),
numbered as (
    select conv_id, row_number() over (order by conv_id nulls first) as c from (select distinct conv_id from conversations)),
damaged as (
    select conv_id, turn, case when fate = 4 then 'user' else role end as role,
        case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when fate = 3 then [1, 2] when fate = 0 then []::integer[] else [1] end) as copy
    from fated),
placed as (
    select n.c, d.turn, d.role, d.text, left(d.role, 1) as r,
        row_number() over (partition by n.c order by d.turn nulls first, d.role, md5(d.text)) as i
    from damaged d join numbered n on n.conv_id is not distinct from d.conv_id),
faulty as (
    select *, case
            when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1
            when row_number() over (partition by c, role, text order by i) > 1 then 2
            when regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*\\z') then 3 else 0 end as fault,
        lag(r) over (partition by c order by i) as before
    from placed),
counted as (
    select c, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
        count(*) filter (where fault = 3) as truncated,
        count(*) filter (where i > 1 and before || r not in ('su', 'ua', 'au')) as illegal
    from faulty group by c),
states as (
    select c, 1::bigint as i, '000000000' as v0, null::varchar as v1, '000000003I' as v2, '000000006II' as v3 from numbered
    union all
    select c, i + 1, n0, n1,
        least(n2, {_add('n0', '3', 'I')}, {_add('n1', '3', 'I')}, {_add('n3', '3', 'I')}),
        least(n3, {_add('n2', '3', 'I')}, {_add('n0', '6', 'II')}, {_add('n1', '6', 'II')})
    from (
        select c, i, {_D[0]} as n0,
            least({_D[1]}, {_role('v0', '', 's')[0]}) as n1,
            least({_D[2]}, {', '.join(_role('v0 v1 v3', 'R', 'u'))}) as n2,
            least({_D[3]}, {', '.join(_role('v2', 'R', 'a'))}) as n3
        from (
            select s.*, f.fault, f.r, case when f.fault = 3 then 3 else 0 end as more
            from states s join faulty f on f.c = s.c and f.i = s.i))),
best as (
    select m.c, m.conv_id, least(s.v0, s.v3) as found
    from numbered m left join counted n on n.c = m.c join states s on s.c = m.c and s.i = coalesce(n.n, 0) + 1),
letters as (
    select c, j, found[9 + j] as letter from (select c, found, unnest(range(1, len(found) - 8)) as j from best)),
edits as (
    select l.*, count(*) filter (where letter != 'I') over upto as i, count(*) filter (where letter != 'D') over upto as o
    from letters l window upto as (partition by c order by j)),
applied as (
    select e.c, e.letter, e.o, f.role, f.text,
        max(case when e.o = 1 and e.letter = 'K' and f.r = 's' then 1 else 0 end) over (partition by e.c) as led
    from edits e left join faulty f on f.c = e.c and f.i = e.i and e.letter != 'I'),
repaired as (
    select c, string_agg(case when letter = 'K' then role when (o - led) % 2 = 1 then 'user' else 'assistant' end
        || ':' || case when letter = 'I' then '' else text end, chr(10) order by o) as text
    from applied where letter != 'D' group by c)
select b.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0)::bigint as blank,
    coalesce(n.duplicate, 0)::bigint as duplicate, coalesce(n.truncated, 0)::bigint as truncated,
    coalesce(n.illegal, 0)::bigint as illegal, left(b.found, 9)::bigint as cost, b.found[10:] as audit,
    sha256(coalesce(t.text, '')) as repaired_sha256
from best b left join counted n on n.c = b.c left join repaired t on t.c = b.c
"""
