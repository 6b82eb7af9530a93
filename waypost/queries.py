"""The queries of the core, and the SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost import oracle
from waypost.functions import fuzzy, geo
from waypost.functions import text as T
from waypost import sinks
from waypost.operators import answers, blocks, layout, match, nearby, views
from waypost.sources.locations import from_rows
from waypost.session import ship_package, table

Query = Callable[[SparkSession, str], DataFrame]
NEAR_M = 200.0
FULL = ("address1", "address2", "city", "state", "postal_code")


def _locations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "locations")


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "parsed_blocks").withColumn("doc_id", F.col("block_id"))


def _same_street(s: SparkSession, d: str) -> DataFrame:
    """Blocks and locations whose first address line and town are written alike; a pair of names to compare."""
    b = _blocks(s, d).select("block_id", F.col("name").alias("a"), "address1", "city")
    r = _locations(s, d).select("ref_ord", F.col("name").alias("b"), "address1", "city")
    return b.filter("length(address1) > 9 and length(city) > 1").join(r, ["address1", "city"]).select("block_id", "ref_ord", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))


def p4_found(s, d):
    return nearby.points_within(_locations(s, d), NEAR_M)


SHIFT = 3.7e-7  # keeps borders off the stored coordinates, so that rounding can't decide
L_SHAPE, HOLE, ISLAND = ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)), ((0.1, 0.1), (0.3, 0.1), (0.3, 0.3), (0.1, 0.3)), ((0.6, 0.6), (0.9, 0.6), (0.9, 0.9), (0.6, 0.9))


def p4_regions(s, d):
    """The regions of each located row: in each degree that has rows, an L with a hole and an island; over them, squares of five degrees."""
    at = _locations(s, d).filter(nearby.usable(F.col("latitude"), F.col("longitude")))

    def made(size: float, sign: int, *parts: tuple) -> DataFrame:
        cells = at.select(*[F.floor((F.col(c) - SHIFT) / size).alias(n) for c, n in (("longitude", "cx"), ("latitude", "cy"))]).distinct()
        corner = lambda x, y: F.struct(((F.col("cx") + x) * size + SHIFT).alias("lon"), ((F.col("cy") + y) * size + SHIFT).alias("lat"))
        rings = F.array(*[F.array(*[F.array(*[corner(x, y) for x, y in ring]) for ring in part]) for part in parts])
        return cells.select((sign * ((F.col("cy") + 1000) * 10000 + F.col("cx") + 1000)).alias("region_id"), rings.alias("rings"))

    regions = made(1.0, 1, (L_SHAPE, HOLE), (ISLAND,)).unionByName(made(5.0, -1, (((0, 0), (1, 0), (1, 1), (0, 1)),)))
    return nearby.regions_of(at, regions)


def token_orders(s, d):
    return _locations(s, d).select("ref_ord", T.token_sort(F.col("name")).alias("sorted_name"), T.token_set(F.col("name")).alias("set_name"))


def expanded_addresses(s, d):
    return _locations(s, d).select("ref_ord", T.expand_abbreviations(T.full_address(*[F.col(c) for c in FULL])).alias("expanded"))


def canonical_keys(s, d):
    return _locations(s, d).select("ref_ord", T.canonical_key(*[F.col(c) for c in ("name", "address1", "city", "state", "postal_code")]).alias("key"))


def states(s, d):
    return _locations(s, d).select("ref_ord", T.normalize_state(F.col("state")).alias("state"))


def redacted_addresses(s, d):
    return _locations(s, d).select("ref_ord", T.redact_summary(F.col("address1"), F.col("postal_code")).alias("summary"))


def departments(s, d):
    return _locations(s, d).select("ref_ord", T.normalize_department(F.col("department")).alias("canonical"))


def department_lines(s, d):
    return _locations(s, d).select("ref_ord", T.is_department(F.col("department")).alias("is_department"), T.has_unit(F.col("address2")).alias("has_unit"))


def units(s, d):
    u = T.split_unit(F.coalesce("address1", F.lit("")))
    return _locations(s, d).select("ref_ord", u["line"].alias("line"), u["unit"].alias("unit"))


def town_lines(s, d):
    last = F.coalesce(F.get(F.filter(F.transform(T.lines(F.col("block_text")), lambda x: x), lambda x: T.city_state_zip(x).isNotNull()), F.lit(0)), F.lit(""))
    z = T.city_state_zip(last)
    return _blocks(s, d).select("block_id", z["city"].alias("city"), z["state"].alias("state"), z["postal_code"].alias("postal_code"))


def single_names(s, d):
    n = T.split_names(F.col("name"))
    return _locations(s, d).select("ref_ord", F.posexplode(n).alias("name_ord", "one"))


def stats_by_state(s, d):
    return views.by_state(_locations(s, d)).select("state", "n")


def stats_by_state_located(s, d):
    return views.by_state(_locations(s, d), located_only=True).select("state", "n")


def stats_top_cities(s, d):
    return views.by_city(_locations(s, d)).select("city_state", "n")


def stats_coverage(s, d):
    return views.coverage(_locations(s, d))


def state_and_city(s, d):
    return views.in_place(_locations(s, d), "nh", "draindhaven").select("ref_ord", "name")


def first_rows(s, d):
    return views.sample(_locations(s, d).filter(views.has_coordinates()), 10).select("ref_ord", "name", "latitude", "longitude")


def distances(s, d):
    m = geo.metres_between(F.col("latitude"), F.col("longitude"), F.lit(43.7), F.lit(-71.3))
    return _locations(s, d).filter(nearby.usable(F.col("latitude"), F.col("longitude"))).select("ref_ord", m.alias("metres"))


def _blocking(mode: str) -> Query:
    def q(s, d):
        return match.blocked(_blocks(s, d), _locations(s, d), mode).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("ref_ord").alias("first_ref"), F.max("ref_ord").alias("last_ref"))

    q.__name__ = f"blocking_{mode}"
    return q


def exact_addresses(s, d):
    """Exact addresses are an equi-join on the expanded address, so no candidate is scored."""
    key = lambda c: T.trim_all(T.expand_abbreviations(T.full_address(*[F.col(x) for x in FULL]))).alias(c)
    b = _blocks(s, d).select("block_id", key("k"))
    return b.filter("k <> ''").join(_locations(s, d).select("ref_ord", key("k")), "k").select("block_id", "ref_ord")


def line_similarities(s, d):
    return _same_street(s, d).select("block_id", "ref_ord", F.round(T.line_similarity(F.col("a"), F.col("b")), 6).alias("score"), F.round(T.key_similarity(F.upper("a"), F.upper("b")), 6).alias("chars"))


def name_ratios(s, d):
    a, b = F.col("a"), F.col("b")
    return _same_street(s, d).select("block_id", "ref_ord", fuzzy.ratio_col(a, b).alias("ratio"), fuzzy.token_sort_ratio_col(a, b).alias("token_sort"), fuzzy.token_set_ratio_col(a, b).alias("token_set"))


def exact_names(s, d):
    p = _same_street(s, d)
    return p.select("block_id", "ref_ord", T.is_name_exact(F.col("a"), F.col("b")).alias("name_exact"))


def doctor_matches(s, d):
    return _same_street(s, d).select("block_id", "ref_ord", T.matches_doctor(F.col("a"), F.col("b")).alias("doctor"))


def normalized_blocks(s, d):
    return _blocks(s, d).select("block_id", T.normalize_block(F.col("block_text")).alias("p")).select("block_id", "p.*")


def reconciled(s, d):
    r = match.reconciled(_blocks(s, d), _locations(s, d))
    return r.select("doc_id", "status", "mr8_id", "scores.name", "scores.address", "scores.department", F.size("diffs").alias("n_diffs"), "explanation")


def reconciled_names(s, d):
    docs = match.by_name(_blocks(s, d))
    r = match.reconciled(docs, _locations(s, d))
    return r.select("doc_id", "status", "mr8_id", match.search_key(F.col("record"), F.col("status"), "file").alias("search_key"))


def top_candidates(s, d):
    return match.top_candidates(_blocks(s, d), _locations(s, d))


def exact_flags(s, d):
    r = answers.exactness(match.reconciled(_blocks(s, d), _locations(s, d)))
    return r.select("doc_id", "name_exact", "address_exact", match.found(F.col("status"), "lookup").alias("found"))


def document_answers(s, d):
    return answers.reconciled_documents(table(s, d, "documents"), from_rows(table(s, d, "locations"), "ref_ord"), "file")


def agreeing_departments(s, d):
    b = _blocks(s, d).select("block_id", T.normalize_department(F.col("department")).alias("x"), "address1", "city").filter("length(address1) > 9 and length(city) > 1")
    r = _locations(s, d).select("ref_ord", T.normalize_department(F.col("department")).alias("y"), "address1", "city")
    return b.join(r, ["address1", "city"]).select("block_id", "ref_ord", match.departments_match(F.col("x"), F.col("y")).alias("agree"))


def facilities(s, d):
    return _locations(s, d).select("ref_ord", T.is_facility(F.col("name")).alias("facility"), views.has_name().alias("has_name"))


def address_lines(s, d):
    whole = F.concat_ws(", ", "address1", "address2")
    plain, compat = T.split_address_line(whole), T.split_address_line(F.coalesce("address1", F.lit("")), compat=True)
    return _locations(s, d).select("ref_ord", plain["address1"].alias("line"), plain["address2"].alias("unit"), compat["address1"].alias("compat_line"), compat["address2"].alias("compat_unit"))


def projected_locations(s, d):
    """Rows under other column names, brought to the location schema."""
    df = _locations(s, d).select("ref_ord", F.col("id").alias("Loc No."), F.col("name").alias("Location Name"), F.col("address1").alias("Street"), F.col("city").alias("City/Town"), F.col("state").alias("State/Province"), F.col("postal_code").alias("Zip"), F.col("department").alias("Department"))
    return from_rows(df, "ref_ord").select("ref_ord", "id", "name", "address1", "city", "state", "postal_code", "country", "department", "search_key")


def new_items(s, d):
    docs = _blocks(s, d).select(F.lit("NEW").alias("status"), F.col("block_id").alias("ord"), F.struct("name", "address1", "address2", "city", "state", "postal_code").alias("doc"))
    return sinks.new_items(docs)


def formatted_dates(s, d):
    return table(s, d, "emails").filter("sent_at is not null").select("email_id", T.format_mail_date(F.col("sent_at")).alias("shown"))


def block_heads(s, d):
    return _blocks(s, d).select("block_id", F.array_join(F.slice(T.lines(F.col("block_text")), 1, 3), " ").alias("head"))


def first_names(s, d):
    n = T.first_last(F.col("name"))
    return _locations(s, d).select("ref_ord", n["first"].alias("first"), n["last"].alias("last"))


def fetched_ids(s, d):
    ids = _blocks(s, d).select(F.col("block_id").alias("ord"), (F.lit(100000) + F.col("block_id")).cast("string").alias("id"))
    return match.fetch_ids(ids, _locations(s, d)).select("ord", "id", "rec.name")


def warning_keys(s, d):
    return _locations(s, d).filter("warning is not null").select("ref_ord", T.warning_key(F.col("warning")).alias("key"), T.warning_key(F.col("warning"), F.col("search_key")).alias("nearest"))


def medical_blocks(s, d):
    return _blocks(s, d).filter(blocks.is_medical(F.col("block_text"))).select("block_id")


def distinct_blocks(s, d):
    b = _blocks(s, d).select(F.col("file_name").alias("doc_id"), F.col("block_id").alias("block_ord"), F.col("block_text").alias("block"))
    return blocks.deduplicated(b.filter("block is not null")).select(F.col("block_ord").alias("block_id"))


def first_blocks(s, d):
    b = _blocks(s, d).select(F.col("file_name").alias("doc_id"), F.col("block_id").alias("block_ord"))
    return blocks.limited(b, 2).select(F.col("block_ord").alias("block_id"))


def candidate_blocks(s, d):
    return blocks.candidate_blocks(table(s, d, "documents"))


def structured_blocks(s, d):
    return blocks.structured_blocks(table(s, d, "documents"))


def numbered_blocks(s, d):
    return blocks.structured_blocks(table(s, d, "documents"), numbered_only=True)


def document_pages(s, d):
    return layout.page_lines(table(s, d, "documents")).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


def note_placements(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "page_count")
    found = blocks.structured_blocks(docs).withColumn("note", F.lit("RESEARCH REQUIRED"))
    return layout.placements(found, docs, layout.page_lines(docs))


def mail_texts(s, d):
    return table(s, d, "emails").filter("html is not null").select("email_id", T.html_to_text(F.col("html")).alias("text"))


ALL: tuple[Query, ...] = (
    p4_found, p4_regions, exact_flags, document_answers, agreeing_departments, facilities, address_lines, projected_locations, new_items, formatted_dates, block_heads, first_names, token_orders, expanded_addresses, canonical_keys, states, redacted_addresses, departments, department_lines, units, town_lines, single_names, stats_by_state,
    stats_by_state_located, stats_top_cities, stats_coverage, state_and_city, first_rows, distances, *map(_blocking, ("zip", "citystate", "fallback", "sql")), exact_addresses,
    line_similarities, name_ratios, exact_names, doctor_matches, normalized_blocks, reconciled, reconciled_names, top_candidates, fetched_ids, warning_keys, medical_blocks,
    distinct_blocks, first_blocks, candidate_blocks, structured_blocks, numbered_blocks, document_pages, note_placements, mail_texts,
)


def queries() -> dict[str, Query]:
    def run(f: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        call.__name__ = f.__name__
        return call

    return {f.__name__: run(f) for f in ALL}


# The same in SQL ------------------------------------------------------------------------------------------------------------------


def _trim(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def _sql_map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


def _full(p: str = "") -> str:
    parts = ", ".join(_trim(f"{p}{c}") for c in FULL[:4]) + ", " + _trim(f"substr(coalesce({p}postal_code, ''), 1, 5)")
    return f"array_to_string(list_filter([{parts}], lambda x: x <> ''), ' ')"


def _expand(x: str) -> str:
    s = rf"regexp_replace(lower({x}), '[.,]', ' ', 'g')"
    s = rf"regexp_replace({s}, '\b(suite|ste|unit)\s+(\d+)[- ]?[a-z]\b', 'suite \2', 'g')"
    s = rf"regexp_replace({s}, '\b(suite|ste|unit)\s+(\d+)\b', 'suite \2', 'g')"
    return rf"array_to_string(list_transform(string_split_regex({s}, '\s+'), lambda t: coalesce({_sql_map(T.ABBREVIATIONS)}[t], t)), ' ')"


def _key(x: str) -> str:
    return _trim(rf"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')")


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _match_norm(x: str) -> str:
    return _trim(rf"regexp_replace(regexp_replace(lower({x}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')")


_OK = "latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude) and latitude <> 0 and longitude <> 0"
_USABLE = _OK + " and abs(latitude) <= 90 and abs(longitude) <= 180"
_HAV = "2 * 6378137.0 * asin(least(1, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
_PAIRS = "select b.block_id, l.ref_ord, coalesce(b.name, '') a, coalesce(l.name, '') b from parsed_blocks b join locations l on b.address1 = l.address1 and b.city = l.city where length(b.address1) > 9 and length(b.city) > 1"
_COUNTS = "doc_id, count(*) n, min(ref_ord) first_ref, max(ref_ord) last_ref"


_TIER2 = " union all select doc_id, ref_ord from d join r on d.t = r.t and d.s = r.s where d.z not in (select z from r where z <> '')"


def co(c: str) -> str:
    return f"coalesce({c}, '')"


def _department() -> str:
    n = f"lower({_trim('department')})"
    c = _trim(rf"regexp_replace(regexp_replace({n}, '\b(dept|dept\.|department)\b', '', 'g'), '\b(records?|record)\b', '', 'g')")
    cases = "".join(f" when c like '%{k}%' or n like '%{k}%' then '{v}'" for k, v in T.DEPARTMENTS.items())
    exact = "".join(f" when c = '{k}' then '{v}'" for k, v in T.DEPARTMENTS.items())
    return f"select ref_ord, case when n = '' then ''{exact}{cases} else n end canonical from (select ref_ord, {n} n, {c} c from locations)"


def _html() -> str:
    s = "regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis')"
    for k, v in {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''"}.items():
        s = f"replace({s}, '{k}', '{v}')"
    s = rf"regexp_replace(regexp_replace({s}, '<br\s*/?>', chr(10), 'gi'), '</(p|div|h[1-6]|li|tr)>', chr(10), 'gi')"
    s = f"regexp_replace({s}, '<[^>]+>', '', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')"
    return f"select email_id, {_trim(s)} as text from emails where html is not null"


def oracle_sql() -> dict[str, str]:
    zb, zl = _trim("substr(coalesce(b.postal_code, ''), 1, 5)"), _trim("substr(coalesce(l.postal_code, ''), 1, 5)")
    town = lambda p: f"lower({_trim(f'{p}.city')})"
    state = lambda p: f"upper({_trim(f'{p}.state')})"
    by_zip = f"select b.block_id doc_id, l.ref_ord from parsed_blocks b join locations l on {zb} = {zl} where {zb} <> ''"
    by_town = f"select b.block_id doc_id, l.ref_ord from parsed_blocks b join locations l on {town('b')} = {town('l')} and {state('b')} = {state('l')}"
    grouped = lambda q: f"select {_COUNTS} from ({q}) group by doc_id"
    st = _sql_map(T.STATES)
    long_, short = r"^(.+?),\s*([A-Za-z]+(?:\s+[A-Za-z]+)*)\s+(\d{5})(?:-\d{4})?$", r"^(.+?),\s*([A-Za-z]{2})\s+(\d{5})(?:-\d{4})?$"
    unit = r"(?i)^(.*?)(?:\b(?:suite|ste|unit)\b\s*([a-z0-9-]+)|#\s*([a-z0-9-]+))(.*)$"
    a1 = "coalesce(address1, '')"
    exact = lambda p: _trim(_expand(_full(p)))
    norm_a, norm_b = _match_norm("a"), _match_norm("b")
    med = "|".join(w.replace(".", r"\.") for w in blocks.MEDICAL)
    same = lambda cols, more="": f"select block_id, ref_ord, {cols} from ({_PAIRS}){more}"
    an, bn = oracle.clean("a"), oracle.clean("b")
    full = lambda p: exact(p)
    seven = " + ".join(f"cast(coalesce(b.{c}, '') <> coalesce(l.{c}, '') as integer)" for c in match.DIFFED)
    low = lambda c: f"lower(coalesce({c}, ''))"
    both = lambda p: f"array_to_string(list_filter([coalesce({p}.address1, ''), coalesce({p}.address2, '')], lambda x: x <> ''), ', ')"
    quoted = lambda label, x, y: f"'{label} differs: \"' || {x} || '\" vs \"' || {y} || '\"'"
    five = lambda p: f"substr(coalesce({p}.postal_code, ''), 1, 5)"
    differences = (
        f"list_filter([case when {low('b.name')} <> {low('l.name')} then {quoted('name', co('b.name'), co('l.name'))} end, case when lower({both('b')}) <> lower({both('l')}) then {quoted('address', both('b'), both('l'))} end,"
        f" case when {low('b.city')} <> {low('l.city')} or {co('b.state')} <> {co('l.state')} then 'city/state: ' || {co('b.city')} || ', ' || {co('b.state')} || ' vs ' || {co('l.city')} || ', ' || {co('l.state')} end,"
        f" case when {five('b')} <> {five('l')} then 'zip: ' || {co('b.postal_code')} || ' vs ' || {co('l.postal_code')} end], lambda x: x is not null)"
    )
    said = (
        f"case when h is null then 'No candidates in blocking set; new location.' when status = 'EXACT' then 'Exact match found.' when status = 'CLOSE' and (h.sn between 85 and 92 or h.sa between 85 and 92)"
        f" then case when len({differences}) = 0 then 'Close match.' else 'Close match with minor differences: ' || array_to_string({differences}, '; ') end when status = 'CLOSE' then 'Close match based on thresholds.' else 'No close candidate; new location.' end"
    )
    key = _key
    base = f"coalesce(nullif(l.search_key, ''), concat_ws('|', {', '.join(key(f'l.{c}') for c in ('name', 'address1', 'city', 'state'))}, {key('substr(coalesce(l.postal_code, ' + chr(39) * 2 + '), 1, 5)')}))"
    fx, fy = f"(longitude - {SHIFT} - floor(longitude - {SHIFT}))", f"(latitude - {SHIFT} - floor(latitude - {SHIFT}))"
    cell = lambda n: f"cast((floor((latitude - {SHIFT}) / {n}) + 1000) * 10000 + floor((longitude - {SHIFT}) / {n}) + 1000 as bigint)"
    inner = lambda lo, hi: f"({fx} between {lo} and {hi} and {fy} between {lo} and {hi})"
    whole = "concat_ws(', ', address1, address2)"
    comma, inline, loose = r"^([^,]*),\s*(.*(?i:suite|ste|unit|#).*)$", r"(?i)^(.*?)\s*(?:\b(suite|ste|unit)\b|#)\s*(.+)$", r"(?i)^(.*?)\s*(?:(suite|ste|unit)|#)\s*(.+)$"

    def split_line(x: str, p: str) -> tuple[str, str]:
        t = _trim(x)
        unit = f"case when regexp_extract({t}, '{p}', 2) = '' then '#' else regexp_extract({t}, '{p}', 2) || ' ' end || regexp_extract({t}, '{p}', 3)"
        one = f"case when regexp_matches({t}, '{comma}') then trim(regexp_extract({t}, '{comma}', 1)) when regexp_matches({t}, '{p}') then trim(regexp_extract({t}, '{p}', 1)) else {t} end"
        return one, f"case when regexp_matches({t}, '{comma}') then trim(regexp_extract({t}, '{comma}', 2)) when regexp_matches({t}, '{p}') then trim({unit}) end"

    plain, compat = split_line(whole, inline), split_line("address1", loose)
    st_of = f"case when length({_trim('state')}) = 2 then upper({_trim('state')}) else coalesce({st}[lower({_trim('state')})], upper({_trim('state')})) end"
    new_key = "concat_ws('|', " + ", ".join(_key(c) for c in ("name", "address1", "city", "state", "substr(coalesce(postal_code, ''), 1, 5)")) + ")"
    depts = f"select block_id, ref_ord, {oracle.department('x')} dx, {oracle.department('y')} dy from (select b.block_id, l.ref_ord, b.department x, l.department y from parsed_blocks b join locations l on b.address1 = l.address1 and b.city = l.city where length(b.address1) > 9 and length(b.city) > 1)"
    heads = oracle.LINES.format("block_text")
    fuzz = {
        "p4_regions": f"select ref_ord, {cell('1.0')} region_id from locations where {_USABLE} and ((({fx} < 0.5 or {fy} < 0.5) and not {inner(0.1, 0.3)}) or {inner(0.6, 0.9)}) union all select ref_ord, -{cell('5.0')} from locations where {_USABLE}",
        "exact_flags": f"{oracle.best(full)} select doc_id, coalesce(l.ref_ord is not null and {low('b.name')} <> '' and lower({_trim('b.name')}) <> '' and lower({_trim('l.name')}) <> '' and case when len({oracle.names_of('b.name')}) > 1 then list_contains(list_transform({oracle.names_of('b.name')}, lambda n: lower(n)), lower({_trim('l.name')})) else lower({_trim('b.name')}) = lower({_trim('l.name')}) end, false) name_exact,"
        f" coalesce(l.ref_ord is not null and {exact('b.')} <> '' and {exact('b.')} = {exact('l.')}, false) address_exact, status = 'EXACT' as found from decided join parsed_blocks b on b.block_id = doc_id left join locations l on l.ref_ord = h.ref_ord",
        "agreeing_departments": f"select block_id, ref_ord, case when dx = '' and dy = '' then true when dx = '' or dy = '' then false else dx = dy or {oracle.ratio('sx', 'sy')} >= 85 end agree from (select *, {oracle.sorted_words('dx')} sx, {oracle.sorted_words('dy')} sy from ({depts}))",
        "facilities": f"select ref_ord, not regexp_matches(lower({_trim('name')}), '{T.DOCTOR}') facility, {_trim('name')} <> '' has_name from locations",
        "address_lines": f"select ref_ord, {plain[0]} line, {plain[1]} unit, {compat[0]} compat_line, {compat[1]} compat_unit from locations",
        "projected_locations": f"select ref_ord, id, coalesce(name, '') as name, coalesce(address1, '') address1, coalesce(city, '') city, {st_of} state, coalesce(postal_code, '') postal_code, 'US' country, nullif({_trim('department')}, '') department, cast(null as varchar) search_key from locations",
        "new_items": f"select coalesce(name, '') as name, coalesce(address1, '') address1, coalesce(address2, '') address2, coalesce(city, '') city, coalesce(state, '') state, coalesce(postal_code, '') postal_code, 'US' country, k search_key from (select *, {new_key} k from parsed_blocks) qualify row_number() over (partition by k order by block_id) = 1",
        "formatted_dates": "select email_id, strftime(sent_at, '%a, %b %-d, %Y, %I:%M %p') shown from emails where sent_at is not null",
        "block_heads": f"select block_id, array_to_string({heads}[1:3], ' ') head from parsed_blocks",
        "first_names": f"select ref_ord, {oracle.first_last('name', 1)} as first, {oracle.first_last('name', -1)} as last from locations",
        "normalized_blocks": oracle.normalized_blocks(),
        "warning_keys": oracle.warning_keys(),
        "document_pages": oracle.document_pages(),
        "candidate_blocks": oracle.candidate_blocks(),
        "name_ratios": f"select block_id, ref_ord, ratio, token_sort, token_set from (select *, {oracle.ratio('x', 'y')} ratio, {oracle.ratio('xs', 'ys')} token_sort from (select *, {an} x, {bn} y, {oracle.sorted_words('a')} xs, {oracle.sorted_words('b')} ys from ({_PAIRS}))) join ({oracle.set_ratios(f'select distinct a, b from ({_PAIRS})')}) using (a, b)",
        "doctor_matches": same(f"coalesce({oracle.doctor_record('b')} <> '' and list_contains(list_transform(list_filter(list_transform(string_split({_trim('a')}, ';'), lambda t: {_trim('t')}), lambda t: t <> ''), lambda n: lower({oracle.person('n')})), {oracle.doctor_record('b')}), false) doctor"),
        "reconciled": f"{oracle.best(full)} select doc_id, status, l.id mr8_id, coalesce(h.sn, 0) as name, coalesce(h.sa, 0) address, h.sd department, case when h is null then 0 else {seven} end n_diffs, {said} explanation from decided join parsed_blocks b on b.block_id = doc_id left join locations l on l.ref_ord = h.ref_ord",
        "reconciled_names": f"{oracle.best(full, one_name=True)} select doc_id, status, l.id mr8_id, case when l.ref_ord is not null and status in ('EXACT', 'CLOSE') then {base} else 'RESEARCH REQUIRED' end search_key from decided left join locations l on l.ref_ord = h.ref_ord",
        "top_candidates": f"with {oracle.matching(full).replace(_TIER2, '')} select * from (select doc_id, cast(row_number() over (partition by doc_id order by sn + sa desc, ref_ord) as integer) as rank, ref_ord, sn name_score, sa address_score, sn + sa combined from scored) where rank <= 5",
    }
    return fuzz | {
        "p4_found": f"with l as (select ref_ord r, latitude y, longitude x, floor(latitude / 0.002) cy from locations where {_USABLE}), n as (select r, y, x, cy + d as cy from l, (select unnest([-1, 0, 1]) d))"
        f" select a.r ref_ord_a, b.r ref_ord_b from l a join n b on a.cy = b.cy and a.r < b.r where abs(a.y - b.y) < 0.0019 and {_HAV.format(y1='a.y', x1='a.x', y2='b.y', x2='b.x')} <= 200",
        "token_orders": f"select ref_ord, array_to_string(list_sort({_words(_lname := 'lower(coalesce(name, ' + chr(39) * 2 + '))')}), ' ') sorted_name, array_to_string(list_sort(list_distinct({_words(_lname)})), ' ') set_name from locations",
        "expanded_addresses": f"select ref_ord, {_expand(_full())} expanded from locations",
        "canonical_keys": "select ref_ord, concat_ws('|', " + ", ".join(_key(c) for c in ("name", "address1", "city", "state", "substr(coalesce(postal_code, ''), 1, 5)")) + ") as key from locations",
        "states": f"select ref_ord, case when length({_trim('state')}) = 2 then upper({_trim('state')}) else coalesce({st}[lower({_trim('state')})], upper({_trim('state')})) end state from locations",
        "redacted_addresses": rf"select ref_ord, 'hash:' || substr(sha256(lower({_trim('address1')})), 1, 12) || '|zip:' || regexp_extract(coalesce(postal_code, ''), '^(\d{{5}})', 1) summary from locations",
        "departments": _department(),
        "department_lines": f"select ref_ord, {oracle.department_of(co('department'))} is not null is_department,"
        r" regexp_matches(coalesce(address2, ''), '(?i)\b(suite|ste|unit|#)\b\s*\w+') has_unit from locations",
        "units": f"select ref_ord, case when regexp_matches({a1}, '{unit}') then "
        + _trim(rf"regexp_replace(regexp_replace({_trim(f'regexp_extract({a1}, {chr(39)}{unit}{chr(39)}, 1) || regexp_extract({a1}, {chr(39)}{unit}{chr(39)}, 4)')}, ',$', ''), '\s+', ' ', 'g')")
        + f" else {a1} end as line, case when regexp_matches({a1}, '{unit}') then regexp_extract({a1}, '{unit}', 2) || regexp_extract({a1}, '{unit}', 3) end unit from locations",
        "town_lines": f"select block_id, case when x is null then null else {_trim(f'regexp_extract(x, {chr(39)}{long_}{chr(39)}, 1)')} end city,"
        f" case when regexp_matches(x, '{short}') then upper(regexp_extract(x, '{short}', 2)) else {st}[lower(regexp_extract(x, '{long_}', 2))] end state, case when x is not null then regexp_extract(x, '{long_}', 3) end postal_code"
        rf" from (select block_id, list_filter(list_transform(string_split_regex(coalesce(block_text, ''), '\r?\n'), lambda t: {_trim('t')}), lambda t: regexp_matches(t, '{short}') or (regexp_matches(t, '{long_}') and {st}[lower(regexp_extract(t, '{long_}', 2))] is not null))[1] x from parsed_blocks)",
        "single_names": f"select ref_ord, cast(generate_subscripts(n, 1) - 1 as integer) name_ord, unnest(n) one from (select ref_ord, list_filter(list_transform(string_split({_trim('name')}, ';'), lambda t: {_trim('t')}), lambda t: t <> '') n from locations)",
        "stats_by_state": "select state, count(*) n from locations group by state",
        "stats_by_state_located": f"select state, count(*) n from locations where {_OK} group by state",
        "stats_top_cities": "select city_state, n from (select coalesce(city, '') || ', ' || coalesce(state, '') city_state, count(*) n, min(ref_ord) o from locations group by 1 order by n desc, o limit 10)",
        "stats_coverage": f"select *, round(100.0 * with_names / total, 1) pct_names, round(100.0 * with_coordinates / total, 1) pct_coordinates from (select count(*) total, count(*) filter ({_trim('name')} <> '') with_names, count(*) filter ({_OK}) with_coordinates from locations)",
        "state_and_city": "select ref_ord, name from locations where lower(state) = 'nh' and lower(city) = 'draindhaven'",
        "first_rows": f"select ref_ord, name, latitude, longitude from locations where {_OK} order by ref_ord limit 10",
        "distances": f"select ref_ord, cast(round({_HAV.format(y1='latitude', x1='longitude', y2='43.7', x2='(-71.3)')}) as bigint) metres from locations where {_USABLE}",
        "blocking_zip": grouped(by_zip),
        "blocking_citystate": grouped(f"{by_town} where {town('l')} <> '' and {state('l')} <> ''"),
        "blocking_fallback": grouped(f"{by_zip} union all {by_town} where {zb} not in (select {zl} from locations l where {zl} <> '')"),
        "blocking_sql": grouped(
            "select b.block_id doc_id, l.ref_ord from parsed_blocks b join locations l on substr(coalesce(b.postal_code, ''), 1, 5) = substr(coalesce(l.postal_code, ''), 1, 5) where coalesce(b.postal_code, '') <> ''"
            " union all select b.block_id, l.ref_ord from parsed_blocks b join locations l on b.city = l.city and b.state = l.state where coalesce(b.postal_code, '') = ''"
        ),
        "exact_addresses": f"select b.block_id, l.ref_ord from (select block_id, {exact('')} k from parsed_blocks) b join (select ref_ord, {exact('')} k from locations) l on b.k = l.k where b.k <> ''",
        "line_similarities": "select block_id, ref_ord, round(case when x = y then 1.0 when contains(x, y) or contains(y, x) then least(length(x), length(y)) / greatest(length(x), length(y), 1) when len(p) = 0 or len(q) = 0 then 0.0"
        " else len(list_intersect(p, q)) / greatest(len(p), len(q)) end, 6) score, round(case when a = b then 1.0 when contains(a, b) or contains(b, a) then 0.8 else len(list_intersect(c, e)) / len(list_distinct(list_concat(c, e))) end, 6) chars"
        f" from (select block_id, ref_ord, x, y, upper(a) a, upper(b) b, list_distinct({_words('x')}) p, list_distinct({_words('y')}) q, list_distinct(string_split(upper(a), '')) c, list_distinct(string_split(upper(b), '')) e from (select *, {norm_a} x, {norm_b} y from ({_PAIRS})))",
        "exact_names": f"select block_id, ref_ord, x <> '' and y <> '' and case when len(n) > 1 then list_contains(n, y) else x = y end name_exact from (select *, list_filter(list_transform(string_split(x, ';'), lambda t: {_trim('t')}), lambda t: t <> '') n from (select *, lower({_trim('a')}) x, lower({_trim('b')}) y from ({_PAIRS})))",
        "fetched_ids": "select b.block_id ord, cast(100000 + b.block_id as varchar) id, l.name from parsed_blocks b left join (select id, arg_min(struct_pack(name := name), ref_ord).name as name from locations group by id) l on l.id = cast(100000 + b.block_id as varchar)",
        "medical_blocks": f"select block_id from parsed_blocks where regexp_matches(lower(coalesce(block_text, '')), '{med}')",
        "distinct_blocks": "select min(block_id) block_id from parsed_blocks where block_text is not null group by file_name, lower(block_text)",
        "first_blocks": "select block_id from (select block_id, row_number() over (partition by file_name order by block_id) r from parsed_blocks) where r <= 2",
        "mail_texts": _html(),
    }
