"""SQL of the scoring and matching queries: ratios by bit vectors in 128-bit integers, so strings may have 120 letters on their shorter side."""

from __future__ import annotations

from collections.abc import Callable

from waypost.functions import text as T


def trim(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def clean(x: str) -> str:
    return rf"trim(lower(regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}]', ' ', 'g')))"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort({words(clean(x))}), ' ')"


def ratio(a: str, b: str) -> str:
    """The ratio of two cleaned string columns."""
    short, long = f"(case when length({a}) <= length({b}) then {a} else {b} end)", f"(case when length({a}) <= length({b}) then {b} else {a} end)"
    full = f"((1::hugeint << length({short})) - 1)"
    masks = f"list_transform(string_split({long}, ''), lambda ch_: coalesce(list_sum(list_transform(range(length({short})), lambda ix_: case when {short}[ix_ + 1] = ch_ then 1::hugeint << ix_::integer else 0::hugeint end)), 0)::hugeint)"
    row = f"list_reduce(list_prepend({full}::hugeint, {masks}), lambda row_, bit_: ((row_ + (row_ & bit_)) | (row_ - (row_ & bit_))) & {full})"
    return f"(case when {a} = '' or {b} = '' then 0 else cast(floor(200.0 * (length({short}) - bit_count({row})) / (length({a}) + length({b})) + 0.5) as integer) end)"


def first_last(x: str, part: int) -> str:
    s = f"regexp_replace({trim(x)}, '{T.TITLE}', '')"
    s = rf"regexp_replace(regexp_replace({s}, '{T.CREDENTIAL}', ''), ',\s*$', '')"
    return f"(case when len({words(s)}) >= 2 then {words(s)}[{part}] end)"


def person(x: str) -> str:
    return f"coalesce({first_last(x, 1)} || ' ' || {first_last(x, -1)}, '')"


def department(x: str) -> str:
    n = f"lower({trim(x)})"
    c = trim(rf"regexp_replace(regexp_replace({n}, '\b(dept|dept\.|department)\b', '', 'g'), '\b(records?|record)\b', '', 'g')")
    exact = "".join(f" when {c} = '{k}' then '{v}'" for k, v in T.DEPARTMENTS.items())
    held = "".join(f" when contains({c}, '{k}') or contains({n}, '{k}') then '{v}'" for k, v in T.DEPARTMENTS.items())
    return f"(case when {n} = '' then ''{exact}{held} else {n} end)"


def names_of(x: str) -> str:
    n = f"list_filter(list_transform(string_split({trim(x)}, ';'), lambda t: {trim('t')}), lambda t: t <> '')"
    return f"(case when len({n}) > 1 then {n} else [coalesce({x}, '')] end)"


def doctor_record(x: str) -> str:
    return f"(case when regexp_matches(lower({trim(x)}), '{T.DOCTOR}') then {person(f'regexp_replace(lower({trim(x)}), {chr(39)}{T.DOCTOR}{chr(39)}, {chr(39)}{chr(39)})')} end)"


def set_ratios(pairs: str) -> str:
    """select a, b, token_set from the distinct pairs (a, b) of strings that pairs selects."""
    sets = f"select a, b, list_sort(list_distinct({words(clean('a'))})) p, list_sort(list_distinct({words(clean('b'))})) q from ({pairs})"
    both = f"select *, array_to_string(list_filter(p, lambda w: list_contains(q, w)), ' ') c, array_to_string(list_filter(p, lambda w: not list_contains(q, w)), ' ') x, array_to_string(list_filter(q, lambda w: not list_contains(p, w)), ' ') y from ({sets})"
    sides = f"select a, b, p, q, c, trim(c || ' ' || x) l, trim(c || ' ' || y) r from ({both})"
    return f"select a, b, case when len(p) = 0 or len(q) = 0 then 0 else greatest({ratio('c', 'l')}, {ratio('c', 'r')}, {ratio('l', 'r')}) end token_set from ({sides})"


def matching(full: Callable[[str], str], one_name: bool = False) -> str:
    """The common tables d, r, tier (candidate pairs by postal code, else town and state) and scored."""
    z = lambda x: trim(f"substr(coalesce({x}, ''), 1, 5)")
    keys = f"{z('postal_code')} z, lower({trim('city')}) t, upper({trim('state')}) s, {department('department')} dept"
    blocks = "select block_id || ':' || (generate_subscripts(n, 1) - 1) doc_id, unnest(n) as name, * exclude (name, n) from (select *, case when len(n0) > 1 then n0 else [name] end n from (select *, " + f"list_filter(list_transform(string_split({trim('name')}, ';'), lambda t: {trim('t')}), lambda t: t <> '')" + " n0 from parsed_blocks))"
    source = f"({blocks})" if one_name else "(select block_id doc_id, * from parsed_blocks)"
    return f"""d as materialized (select doc_id, lower({trim('name')}) low, {names_of('name')} names, list_transform({names_of('name')}, lambda n: lower({person('n')})) people, {full('')} addr, {keys} from {source}),
r as materialized (select ref_ord, id, coalesce(name, '') as name, lower({trim('name')}) low, {doctor_record('name')} person, not regexp_matches(lower({trim('name')}), '{T.DOCTOR}') facility, {full('')} addr, {keys} from locations),
tier as materialized (select doc_id, ref_ord from d join r on d.z = r.z where d.z <> '' union all select doc_id, ref_ord from d join r on d.t = r.t and d.s = r.s where d.z not in (select z from r where z <> '')),
pairs as (select doc_id, ref_ord, d.names, d.people, d.addr da, r.addr ra, d.low dl, r.low rl, d.dept dd, r.dept rd, r.name rn, r.person, r.facility from tier join d using (doc_id) join r using (ref_ord)),
each as (select doc_id, ref_ord, unnest(names) n, unnest(people) p, rn, person from pairs),
sorts as materialized (select x, y, {ratio('x', 'y')} s from (select distinct x, y from (select {sorted_words('n')} x, {sorted_words('rn')} y from (select distinct n, rn from each) union select {sorted_words('dd')}, {sorted_words('rd')} from (select distinct dd, rd from pairs)))),
named as (select doc_id, ref_ord, max(case when p <> '' and p = person then 98 else s end) sn, bool_or(coalesce(p <> '' and p = person, false)) doctor from each join sorts on x = {sorted_words('n')} and y = {sorted_words('rn')} group by doc_id, ref_ord),
addressed as materialized ({set_ratios('select distinct da a, ra b from pairs')}),
scored as materialized (select pairs.*, sn, doctor, token_set sa, case when dd = rd then 100 when dd = '' or rd = '' then 0 else s end sd from pairs join named using (doc_id, ref_ord) join addressed on a = da and b = ra join sorts on x = {sorted_words('dd')} and y = {sorted_words('rd')})"""


def best(full: Callable[[str], str], one_name: bool = False) -> str:
    """The common tables of matching() and hit: the deciding record of each document, with its scores and status."""
    exact = "da <> '' and da = ra and ((dl <> '' and rl <> '' and (dl = rl or list_contains(list_transform(names, lambda n: lower(n)), rl))) or doctor)"
    top = lambda what: f"(select doc_id, arg_max({{ref_ord: ref_ord, sn: sn, sa: sa, sd: sd}}, (sn + sa + sd) * 1000000000000 - ref_ord) h from scored where {what} group by doc_id)"
    return f"""with {matching(full, one_name)},
hit as (select d.doc_id, coalesce(case when f.h is not null and (p.h is null or f.h.sn >= 94) then f.h else coalesce(p.h, f.h) end, c.h) h, f.h is not null or p.h is not null exact
 from d left join {top(exact + ' and facility')} f using (doc_id) left join {top(exact + ' and not facility')} p using (doc_id) left join {top("dd = '' or (rd <> '' and sd >= 85)")} c using (doc_id)),
decided as (select *, case when h is null then 'NEW' when exact or (h.sa >= 95 and h.sn >= 94) then 'EXACT' when h.sa >= 92 and h.sn >= 90 then 'CLOSE' else 'NEW' end status from hit)"""


LINES = rf"list_filter(list_transform(string_split_regex(coalesce({{}}, ''), '\r?\n'), lambda t: {trim('t')}), lambda t: t <> '')"
KEY = r"[A-Z0-9]+(?:-[A-Z0-9]+)*"


def sql_map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


def unit_line(x: str) -> tuple[str, str]:
    """The line without its unit, and the unit."""
    p = r"(?i)^(.*?)(?:\b(?:suite|ste|unit)\b\s*([a-z0-9-]+)|#\s*([a-z0-9-]+))(.*)$"
    ends = trim(f"(regexp_extract({x}, '{p}', 1) || regexp_extract({x}, '{p}', 4))")
    rest = trim(rf"regexp_replace(regexp_replace({ends}, ',$', ''), '\s+', ' ', 'g')")
    return f"(case when regexp_matches({x}, '{p}') then {rest} else {x} end)", f"(case when regexp_matches({x}, '{p}') then regexp_extract({x}, '{p}', 2) || regexp_extract({x}, '{p}', 3) end)"


def department_of(x: str) -> str:
    """The department that a line names, or null."""
    held = " or ".join(f"contains(lower({x}), '{w}')" for w in T.DEPARTMENT_WORDS)
    item = rf"{trim(x)} = '' or regexp_matches({trim(x)}, '^\d+\.\s+[A-Z]')"
    dated = trim(f"regexp_extract({x}, '{T.DATE_RANGE}', 1)")
    return f"(case when {item} then null when regexp_matches({x}, '{T.DATE_RANGE}') then {dated} when ({held}) and not regexp_matches({x}, '{T.STREET_LINE}') then {trim(x)} end)"


def normalized_blocks() -> str:
    short, long = r"^(.+?),\s*([A-Za-z]{2})\s+(\d{5})(?:-\d{4})?$", r"^(.+?),\s*([A-Za-z]+(?:\s+[A-Za-z]+)*)\s+(\d{5})(?:-\d{4})?$"
    states = sql_map(T.STATES)
    town = lambda x: f"(regexp_matches({x}, '{short}') or (regexp_matches({x}, '{long}') and {states}[lower(regexp_extract({x}, '{long}', 2))] is not null))"
    bare = lambda x: trim(rf"regexp_replace({x}, '^\d+\.\s*', '')")
    plain = lambda x: rf"({x} <> '' and not regexp_matches({x}, '\d'))"
    at = lambda k: f"(case when i > {k} then coalesce(v[i - {k}], '') else '' end)"
    u, un = unit_line("street"), unit_line("numbered")
    line = f"(case when i is not null and {u[0]} <> '' then {u[0]} else {un[0]} end)"
    unit = f"(case when i is not null and {u[0]} <> '' then {u[1]} else {un[1]} end)"
    token = f"coalesce({sql_map(T.STREETS)}[regexp_replace(lower(w), '[^a-z]', '', 'g')], w)"
    address = f"array_to_string(list_transform({words(f'regexp_replace(lower({line}), {chr(39)}[.,]{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, lambda w: {token}), ' ')"
    return rf"""with l as (select block_id, {LINES.format('block_text')} v from parsed_blocks),
p as (select *, list_max(list_filter(range(1, len(v) + 1), lambda k: {town('v[k]')})) i from l),
q as (select *, {bare(at(2))} near, {bare(at(3))} far, {at(1)} street, coalesce(v[i], '') town, coalesce(list_filter(v, lambda x: regexp_matches(x, '\d'))[1], '') numbered from p)
select block_id, coalesce(case when regexp_matches(near, '(?i),\s*(M\.?D\.?|D\.?O\.?|D\.?C\.?|P\.?A\.?|N\.?P\.?)') and {plain('far')} and {plain('near')} then far || '; ' || near when {plain('far')} then far when {plain('near')} then near end,
 list_filter(list_transform(v, lambda x: {bare('x')}), lambda x: {plain('x')})[1]) as name,
 regexp_replace({address}, '\bp\s*o\s+box\b', 'po box', 'g') address1, lower('suite ' || {unit}) address2, case when i is null then '' else {trim(f"regexp_extract(town, '{long}', 1)")} end city,
 case when i is null then '' when regexp_matches(town, '{short}') then upper(regexp_extract(town, '{short}', 2)) else {states}[lower(regexp_extract(town, '{long}', 2))] end state,
 case when i is null then '' else regexp_extract(town, '{long}', 3) end postal_code, 'US' country, list_filter(list_transform(v, lambda x: {department_of('x')}), lambda x: x is not null)[1] department from q"""


def warning_keys() -> str:
    like = "case when k = base then 1.0 when contains(k, base) or contains(base, k) then 0.8 else len(list_intersect(list_distinct(string_split(base, '')), list_distinct(string_split(k, '')))) / len(list_distinct(list_concat(string_split(base, ''), string_split(k, '')))) end"
    ranked = "select ref_ord, arg_max(x, (score, -i)) nearest from (select ref_ord, i, x, " + like + " score from (select ref_ord, base, i, every[i] x, upper(every[i]) k from (select *, unnest(range(1, len(every) + 1)) i from w))) group by ref_ord"
    return rf"""with w as (select ref_ord, s, regexp_extract(s, '(?i:issue|send)\s+(?i:to):?\s*({KEY})\b', 1) sent, list_filter(regexp_extract_all(s, '\b({KEY})\b', 1), lambda x: length(x) >= 3 and not regexp_matches(x, '^(THE|AND|OR|TO|FOR|WITH|FROM)$')) every,
 upper(regexp_replace(coalesce(search_key, ''), '-non$', '')) base from (select *, {trim('warning')} s from locations where warning is not null))
select w.ref_ord, case when s = '' then null when length(sent) >= 3 then sent else every[1] end as key, case when s = '' then null when length(sent) >= 3 then sent when base = '' then every[1] else nearest end nearest from w left join ({ranked}) using (ref_ord)"""


def document_pages() -> str:
    return r"""with d as (select doc_id, greatest(coalesce(page_count, 1), 1) n, regexp_replace(text, '\r\n', chr(10), 'g') body from documents where length(text) > 0),
e as (select *, string_split_regex(body, '\f+') parts, len(string_split(body, chr(10))) lines from d)
select doc_id, page, n_lines from (select doc_id, cast(p as integer) page, case when len(parts) = n then len(string_split(parts[p + 1], chr(10))) else least(per, lines - p * per) end n_lines
 from (select *, greatest(1, cast(ceil(lines / n) as bigint)) per, unnest(range(n)) p from e)) where n_lines > 0"""


def candidate_blocks() -> str:
    states = ", ".join(f"'{c}'" for c in sorted(set(T.STATES.values())))
    short, long = r"(?i),\s*([A-Z]{2})\s+(\d{5})(?:-\d{4})?$", r"(?i),\s*([A-Za-z]+(?:\s+[A-Za-z]+)*)\s+(\d{5})(?:-\d{4})?$"
    csz = lambda x: f"(upper(regexp_extract({x}, '{short}', 1)) in ({states}) or {sql_map(T.STATES)}[lower(regexp_extract({x}, '{long}', 1))] is not null)"
    held = " or ".join(f"contains(lower({{0}}), '{w}')" for w in T.DEPARTMENT_WORDS)
    dept = lambda x: rf"({x} <> '' and not regexp_matches({x}, '^\d+\.\s+[A-Z]') and (regexp_matches({x}, '{T.DATE_RANGE}') or (({held.format(x)}) and not regexp_matches({x}, '{T.STREET_LINE}'))))"
    at = lambda k: f"coalesce(lag(x, {k}) over w, '')" if k > 0 else f"coalesce(lead(x, {-k}) over w, '')"
    flag = lambda c, k: f"coalesce(lead({c}, {k}) over w, false)"
    digit = lambda x: rf"regexp_matches({x}, '\d')"
    joined = lambda *xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda y: y <> ''), chr(10))"
    return rf"""with l as (select doc_id, unnest({LINES.format('text')}) x, generate_subscripts({LINES.format('text')}, 1) i from documents),
f as (select *, {csz('x')} town, {dept('x')} dept, regexp_matches(x, '(?i)\b(suite|ste|unit|#)\b\s*\w+') unit from l),
g as (select *, {at(1)} p1, {at(2)} p2, {at(3)} p3, {at(-1)} n1, {at(-2)} n2, {at(-3)} n3, {flag('town', 1)} town1, {flag('dept', 1)} d1, {flag('dept', 2)} d2, {flag('dept', 3)} d3 from f window w as (partition by doc_id order by i)),
h as (select *, case when p2 <> '' and not {digit('p2')} then p2 when p1 <> '' and not {digit('p1')} then p1 else '' end plain, case when p2 <> '' and {digit('p2')} then p2 when p1 <> '' and {digit('p1')} then p1 else '' end addr from g where town or (unit and town1)),
k as (select doc_id, i, town, case when plain <> '' then plain when addr <> '' then p3 else '' end as name, * exclude (doc_id, i, town) from h),
b as (select doc_id, i, case when town then {joined('name', 'addr', 'x', "case when d1 then n1 else '' end", "case when d1 and d2 then n2 else '' end")} else {joined('p1', 'x', 'n1', "case when d2 then n2 else '' end", "case when d2 and d3 then n3 else '' end")} end block,
 case when town then case when name <> '' then name when addr <> '' then addr else x end else case when p1 <> '' then p1 else x end end facility_name_line from k)
select doc_id, cast(i - 1 as integer) block_ord, block, facility_name_line from b qualify row_number() over (partition by doc_id, lower(block) order by i) = 1"""
