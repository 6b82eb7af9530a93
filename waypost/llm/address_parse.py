"""Parsing of one typed postal address into comparable components.

Pure Python over single values; ``addresses.py`` runs it over Arrow batches.
Dictionaries are the usual US postal abbreviations.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Street types, short forms after the full form.
STREET_TYPES = {
    "street": "st str stre", "avenue": "av ave aven avn", "road": "rd", "drive": "dr drv driv", "boulevard": "blvd bvd boul blv",
    "lane": "ln", "parkway": "pkwy pky pkw parkwy", "court": "ct crt", "place": "pl plc", "trail": "tr trl", "way": "wy",
    "circle": "cir circ crcl", "terrace": "ter terr", "plaza": "plz plza", "square": "sq", "highway": "hwy hiway hway",
    "loop": "lp", "alley": "aly", "crescent": "cres", "turnpike": "tpke", "expressway": "expy", "point": "pt", "run": "", "row": "",
}
DIRECTIONS = {
    "n": "n north no", "s": "s south so", "e": "e east", "w": "w west", "ne": "ne northeast", "nw": "nw northwest",
    "se": "se southeast", "sw": "sw southwest",
}
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "dc": "district of columbia", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois",
    "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland",
    "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana",
    "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york",
    "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah",
    "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
TOWN_WORDS = {
    "st": "saint", "ste": "saint", "ft": "fort", "mt": "mount", "lk": "lake", "pt": "port", "prt": "port", "n": "north", "no": "north",
    "s": "south", "so": "south", "e": "east", "w": "west", "hts": "heights", "spgs": "springs", "vlg": "village", "nw": "new",
    "jct": "junction", "hbr": "harbor", "bch": "beach", "twp": "township",
}
PLACEHOLDERS = {
    "", "-", "--", "n/a", "na", "none", "null", "unknown", "tbd", "see line 2", "see line 1", "see notes", "see above", "see below",
    "same", "x", "xx", ".", "?", "not available", "not given",
}

_TYPE = {s: full for full, short in STREET_TYPES.items() for s in (full, *short.split())}
_DIR = {s: d for d, forms in DIRECTIONS.items() for s in forms.split()}
_STATE = {**{k: k for k in STATES}, **{v: k for k, v in STATES.items()}, **{v.replace(" ", ""): k for k, v in STATES.items()}}
_UNITS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
_TENS = {"twent": 20, "thirt": 30, "fort": 40, "fift": 50, "sixt": 60, "sevent": 70, "eight": 80, "ninet": 90}
_NUMBER = {w: str(i + 1) for i, w in enumerate(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
)}
_ORDINAL = {w: i + 1 for i, w in enumerate(_UNITS)} | {f"{t}ieth": n for t, n in _TENS.items()} | {
    f"{t}y{sep}{u}": n + i + 1 for t, n in _TENS.items() for i, u in enumerate(_UNITS[:9]) for sep in ("", "-", " ")
}

_ATTN = re.compile(
    r"^\s*(?:attn|attention|c/o|care of)\b[\s:.]*(?:(?:the|of|medical|records?|billing|release|information|custodian|department|dept|legal|radiology|office"
    r"|manager|him|patient|accounts?|human|resources|pharmacy|correspondence|roi)\b[.\s]*)*[\s,:-]*"
)
_FLOOR = re.compile(
    r"\b(?:\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|ground|top)\s+(?:floor|flr|fl)\b\.?|\b(?:floor|flr|fl)\.?\s*\d+\b"
    r"|\b(?:lower|upper|ground|main|plaza)\s+level\b|\b(?:main|front|rear)\s+lobby\b|\b(?:rear|front|side|main|north|south|east|west)\s+entrance\b"
    r"|\b(?:building|bldg)\b\.?\s*#?\s*\w+|\bbasement\b|\blobby\b"
)
_BOX = re.compile(r"(?:\bp\.?\s*o\.?\s*b(?:ox)?\b|\bpost\s+office\s+box\b|\bpob\b|^\s*box\b)\.?\s*(?:no\b\.?|number\b)?\s*#?\s*(\d+)")
_UNIT = re.compile(
    r"(?:\b(?:suite|ste|suit|unit|un|room|rm|apt|apartment)\b\.?\s*(?:no\b\.?\s*)?#?\s*|#\s*)([a-z]?-?\d+(?:\s*-?\s*[a-z](?![a-z]))?|[a-z])(?![\w])"
)
_ROUTE = re.compile(
    r"^(?:(?P<sr>state\s+(?:route|rte|rt|road|rd|hwy|highway)|st\s+(?:route|rte|rt)|s\.?r\.?)|(?P<cr>(?:county|cnty|cty|co)\s+(?:road|rd|route|rte|rt|hwy|highway)|c\.?r\.?)"
    r"|(?P<us>u\.?s\.?\s*(?:highway|hwy|hiway|route|rte)?)|(?P<hw>highway|hwy|hiway|hway|route|rte|rt))\s*[-#]?\s*(?P<n>\d+[a-z]?)\b\s*(?P<rest>.*)$"
)
_PLAIN = re.compile(
    r"(\d+) (?:(north|south|east|west|north ?east|north ?west|south ?east|south ?west|[ns][ew]|[nsew])\.? )?"
    r"((?!(?:state|county|st|co|cty|sr|cr|us|highway|hwy|route|north|south|east|west)\b)[a-z]{3,}(?: [a-z]{3,})?|\d{1,3}(?:st|nd|rd|th)) "
    rf"({'|'.join(sorted((s for s in _TYPE if s != 'highway'), key=len, reverse=True))})\.?"
)
_PLAIN_UNIT = re.compile(r"(?:suite|ste|unit|un|room|rm|apt)\.? #?(\d+[a-z]?)|# ?(\d+[a-z]?)")


def _edit1(a: str, b: str) -> bool:
    """Equal up to one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) != len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


@lru_cache(20_000)
def _type_of(word: str) -> str:
    if word in _TYPE:
        return _TYPE[word]
    if len(word) >= 5:
        return next((t for t in STREET_TYPES if len(t) >= 5 and _edit1(word, t)), "")
    return ""


@lru_cache(50_000)
def state_code(value: str | None) -> str:
    """Two lower-case letters, or '' where the state can't be read."""
    v = re.sub(r"[^a-z ]", "", (value or "").lower()).strip()
    return _STATE.get(v) or _STATE.get(v.replace(" ", "")) or next((c for c, s in STATES.items() if len(v) > 4 and _edit1(v, s)), "")


@lru_cache(100_000)
def town_key(value: str | None) -> str:
    """Town in lower case without blanks, prefixes written out; '' for blanks and placeholders."""
    v = (value or "").lower().strip()
    if v in PLACEHOLDERS:
        return ""
    words = re.findall(r"[a-z]+", v.split(",")[0].replace("'", ""))
    if len(words) > 1 and words[-1] in STATES:
        words = words[:-1]
    if len(words) > 1:
        words = [TOWN_WORDS.get(words[0], words[0]), *words[1:]]
    return "".join(words)


@lru_cache(100_000)
def zip_code(value: str | None) -> str:
    """Five digits, a lost leading zero restored; '' where the code is missing or can't be one."""
    d = re.sub(r"\D", "", value or "")
    if len(d) in (4, 8):
        d = "0" + d
    d = d[:5]
    return d if len(d) == 5 and d != "00000" else ""


def _street(text: str) -> tuple[str, str, str, str] | None:
    """(number, direction, core, type) of one segment, or None."""
    t = text.replace(".", " ").replace("'", "")
    t = re.sub(r"\s+", " ", t).strip(" -,;:")
    m = re.match(r"^(?:no |num |number )?#?(\d+(?:-?[a-z](?= ))?)(?: 1/2)? (?=\S)(.+)$", t)
    rest = ""
    if m:
        number, rest = m[1].replace("-", ""), m[2]
    elif (words := t.split(" ", 1))[0] in _NUMBER and len(words) == 2 and not _type_of(words[1]):
        number, rest = _NUMBER[words[0]], words[1]
    else:
        m = re.match(r"^(.*[a-z].*?),? (?:no )?#?(\d+)$", t)
        if not m or _ROUTE.match(t) and not re.search(r"\d", m[1]):
            return None
        number, rest = m[2], m[1]
    rest = re.sub(r"\b(north|south)[ -](east|west)\b", r"\1\2", rest.replace(" - ", " "))
    words = [w for w in re.split(r"[ ,/]+", rest) if w and w != "-"]
    direction = ""
    if len(words) > 1 and words[0] in _DIR and not (len(words) == 2 and _type_of(words[1])):
        direction, words = _DIR[words[0]], words[1:]
    if len(words) > 1 and words[-1] in _DIR and words[-1] not in ("no", "so"):
        direction, words = direction or _DIR[words[-1]], words[:-1]
    joined = " ".join(words).replace("-", " ")
    if m := _ROUTE.match(joined):
        tail = [w for w in m["rest"].split() if w in _DIR]
        kind = "sr" if m["sr"] else "cr" if m["cr"] else "us" if m["us"] else "hw"
        return number, direction or (_DIR[tail[0]] if tail else ""), f"{kind} {m['n']}", ""
    kind = ""
    if len(words) > 1 and (kind := _type_of(words[-1])):
        words = words[:-1]
    core = " ".join(words).replace("-", " ")
    if core in _ORDINAL:
        core = f"{_ORDINAL[core]}th"
    core = re.sub(r"\b(\d+) ?(?:st|nd|rd|th)\b", r"\1th", core)
    core = re.sub(r"[^a-z0-9]", "", core)
    if not re.search(r"[a-z]", core):
        return None
    return number.lstrip("0") or "0", direction, core, kind


def parse(a1: str | None, a2: str | None, city: str | None, state: str | None, postal: str | None) -> tuple:
    """(kind, number, direction, core, type, unit, town, state, zip).

    kind is 'street', 'box' or ''; the other parts are '' where missing. Parts in the wrong column are found: units, boxes and
    streets in either line, town, state and postal code behind the street. Attention, floor, building and entrance remarks go.
    """
    town, st, code = town_key(city), state_code(state), zip_code(postal)
    one, two = (a1 or "").lower(), (a2 or "").lower()
    if town and st and (m := _PLAIN.fullmatch(one)) and ((u := two in ("", "n/a", "-")) or (u := _PLAIN_UNIT.fullmatch(two))):
        core = m[3].replace(" ", "")
        if core[0].isdigit():
            core = core[:-2] + "th"
        elif core in _ORDINAL:
            core = f"{_ORDINAL[core]}th"
        return "street", m[1].lstrip("0") or "0", _DIR[m[2].replace(" ", "")] if m[2] else "", core, _TYPE[m[4]], "" if u is True else u[1] or u[2], town, st, code
    unit = box = ""
    street = None
    for field in (a1, a2):
        if not field:
            continue
        text = re.sub(r"\s+", " ", field.lower()).strip()
        if text.strip(" ,-") in PLACEHOLDERS:
            continue
        if text.startswith(("att", "c/o", "care")):
            text = _ATTN.sub("", text)
        text = _FLOOR.sub(" ", text) if re.search(r"fl|level|lobby|entr|b(?:ui)?ldg|building|basem", text) else text
        if not box and (m := _BOX.search(text)):
            box = m[1].lstrip("0")
            text = text[: m.start()] + "," + text[m.end() :]
        if m := _UNIT.search(text):
            unit = unit or re.sub(r"[^a-z0-9]", "", m[1])
            text = text[: m.start()] + "," + text[m.end() :]
        tail = []
        for part in re.split(r",| - |;", text):
            part = part.strip(" .-")
            if not part or part in PLACEHOLDERS:
                continue
            if (street or box) and not re.match(r"^\d+ \w", part):
                tail.append(part)
            elif not street and (found := _street(part)):
                street = found
            elif not street and re.fullmatch(r"\d+[a-z]?", part) is None and re.search(r"[a-z]{3}", part):
                tail.append(part) if street or box else None
        for part in tail:
            if m := re.match(r"^([a-z ]*?)\s*\b(\d{5})(?:[- ]?\d{4})?$", part):
                code, part = code or zip_code(m[2]), m[1].strip()
            if s := _STATE.get(part):
                st = st or s
            elif part and (m := re.match(r"^(.*?)\s+([a-z]{2})$", part)) and m[2] in STATES:
                town, st = town or town_key(m[1]), st or m[2]
            elif part and not re.search(r"\d", part) and (town == ""):
                town = town_key(part)
    if street:
        return ("street", *street, unit, town, st, code)
    if box:
        return ("box", box, "", "", "", "", town, st, code)
    return ("", "", "", "", "", unit, town, st, code)
