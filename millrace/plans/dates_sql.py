"""SQL for dates and times as the feeds write them: parts, zones and instants, for the queries of problem 5 and of dates."""

from __future__ import annotations

from millrace.operators.timestamps import ABBREVIATIONS, MONTHS

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_TIME = r"(?:(?:[T,]| +at)? *(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
_ZONE = r" *(AM|PM|am|pm)? *(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5})?(?:\[([^\]]+)\])?"
_TAIL = ["h", "mi", "s", "f", "ap", "z", "zn"]
_FORMS = [  # pattern, names of its groups, condition
    (rf"^(\d{{4}})([-/])(\d{{1,2}})([-/])(\d{{1,2}}){_TIME}{_ZONE}$", ["y", "a", "mo", "b", "d", *_TAIL], "a = b"),
    (r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?)?$", ["y", "mo", "d", "h", "mi", "s", "z"], "true"),
    (rf"^(\d{{1,2}})([/.])(\d{{1,2}})([/.])(\d{{4}}){_TIME}{_ZONE}$", ["p", "a", "q", "b", "y", *_TAIL], "a = b"),
    (rf"^(?:\p{{L}}+,? +)?(\d{{1,2}})\.? +(\p{{L}}{{3,12}})\.?,? +(\d{{4}}){_TIME}{_ZONE}$", ["d", "mo", "y", *_TAIL], "true"),
    (rf"^(?:\p{{L}}+, +)?(\p{{L}}{{3,12}})\.? +(\d{{1,2}}),? +(\d{{4}}){_TIME}{_ZONE}$", ["mo", "d", "y", *_TAIL], "true"),
]


def _month(x: str) -> str:
    cases = " ".join(f"when {' or '.join(f'''starts_with(lower({x}), '{s}')''' for s in starts)} then {n}" for n, starts in MONTHS.items())
    return f"coalesce(try_cast({x} as int), case {cases} end)"


def parts_sql(source: str) -> str:
    """Columns of ``source`` (with value, zone, day_first) and t, ts (local time), off (minutes, null without), named (zone), epoch (microseconds)."""
    picks = []
    for i, (pattern, names, condition) in enumerate(_FORMS):
        got = f"m{i}"
        order = "case when day_first or contains(t, '.') then {0}.{1} else {0}.{2} end"
        fields = {n: f"{got}.{n}" if n in names else "''" for n in ("y", "mo", "d", *_TAIL)}
        if "p" in names:
            fields["mo"], fields["d"] = order.format(got, "q", "p"), order.format(got, "p", "q")
        test = condition.replace("a = b", f"{got}.a = {got}.b")
        picks.append(f"when regexp_matches(t, '{pattern}') and {test} then {{{', '.join(f'{n}: {e}' for n, e in fields.items())}}}")
    none = ", ".join(f"{n}: ''" for n in _TAIL)
    jan4 = "make_date(try_cast(substr(t, 1, 4) as int), 1, 4)"
    week = r"^(\d{4})-?W(\d{2})-?([1-7])$"
    monday = f"({jan4} - (isodow({jan4}) - 1)::int + (try_cast(regexp_extract(t, '{week}', 2) as int) - 1) * 7)"
    nth = "(make_date(try_cast(substr(t, 1, 4) as int), 1, 1) + (try_cast(substr(t, 6, 3) as int) - 1))"
    of = lambda d, ok: f"case when {ok} then {{y: strftime({d}, '%Y'), mo: strftime({d}, '%m'), d: strftime({d}, '%d'), {none}}} end"
    day = f"({monday} + (try_cast(regexp_extract(t, '{week}', 3) as int) - 1))"
    picks.append(f"when regexp_matches(t, '{week}') then {of(day, f'''try_cast(regexp_extract(t, '{week}', 2) as int) > 0 and year({monday} + 3) = year({jan4})''')}")
    picks.append(rf"when regexp_matches(t, '^(\d{{4}})-(\d{{3}})$') then {of(nth, 'year(' + nth + ') = try_cast(substr(t, 1, 4) as int)')}")
    groups = ", ".join(f"regexp_extract(t, '{p}', [{', '.join(repr(n) for n in names)}]) as m{i}" for i, (p, names, _) in enumerate(_FORMS))
    hour = "case when p.ap = '' then coalesce(try_cast(p.h as int), 0) when try_cast(p.h as int) between 1 and 12 then try_cast(p.h as int) % 12 + case when upper(p.ap) = 'PM' then 12 else 0 end end"
    text = f"lpad(p.y, 4, '0') || '-' || lpad(({_month('p.mo')})::varchar, 2, '0') || '-' || lpad(p.d, 2, '0') || ' ' || lpad(({hour})::varchar, 2, '0') || ':' || lpad(coalesce(nullif(p.mi, ''), '0'), 2, '0') || ':' || lpad(coalesce(nullif(p.s, ''), '0'), 2, '0') || '.' || substr(p.f || '000000', 1, 6)"
    short = " ".join(f"when '{k}' then {(1 if v[0] == '+' else -1) * (int(v[1:3]) * 60 + int(v[4:]))}" for k, v in ABBREVIATIONS.items())
    offset = f"case when regexp_matches(p.z, '^[+-]') then case when try_cast(substr(p.z, 2, 2) as int) < 18 then (case when p.z[1] = '-' then -1 else 1 end) * (try_cast(substr(p.z, 2, 2) as int) * 60 + try_cast(right(p.z, 2) as int)) end else case p.z {short} end end"
    epoch = r"case when regexp_matches(t, '^\d{10}(?:\.\d+)?$') then try_cast(substr(t, 1, 10) as bigint) * 1000000 + substr(regexp_extract(t, '^\d{10}\.(\d{1,6})', 1) || '000000', 1, 6)::bigint when regexp_matches(t, '^\d{13}$') then try_cast(t as bigint) * 1000 when regexp_matches(t, '^\d{16}$') then try_cast(t as bigint) end"
    trimmed = f"regexp_replace(value, '^{SPACE}+|{SPACE}+$', '', 'g')"
    return f"""select *, try_cast({text} as timestamp) as ts, case when p.z <> '' then {offset} end as off, p.z = '' and p.zn <> '' as is_named, {epoch} as epoch
        from (select *, case {' '.join(picks)} end as p from (select *, {groups} from (select *, {trimmed} as t from ({source}))))"""


def instants_sql(source: str) -> str:
    """As parts_sql, with utc_micros: null where a value states no instant."""
    zone = "case when is_named then p.zn else zone end"
    # of a local time that occurs twice the first; ICU takes the last
    local = f"epoch_us(timezone({zone}, ts))"
    first = f"case when timezone({zone}, make_timestamptz({local} - 3600000000)) = ts then {local} - 3600000000 else {local} end"
    known = f"{zone} in (select name from pg_timezone_names())"
    return f"select *, coalesce(epoch, case when p.z <> '' then epoch_us(ts) - off::bigint * 60000000 when {known} then {first} end) as utc_micros from ({parts_sql(source)})"
