"""Problem 3: personal information inside free text.

Method: offset-preserving deobfuscation. Two transducers rewrite the text and remember for every output character which source
character it came from: the first maps look-alike and full-width characters, odd dashes and blanks to ASCII and drops invisible ones;
the second undoes disguises ("[at]", "(dot)", " at x dot y", spelled digits). Detectors run over the normalised text, and their
spans are mapped back to source positions. Texts without anything to normalise skip both.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.address_parse import _DIR, _TYPE, STATES
from waypost.llm.name_parse import FORMS, SITES, SPECIALTIES
from waypost.llm.people import CREDENTIALS, GIVEN, TITLES

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")

# Letters of other scripts that look like Latin ones, and spelled digits.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТУХІЈЅавеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνι", "ABEKMHOPCTYXIJSabeopcyxijsdhqwABEZHIKMNOPTYXaopvi"))
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


@lru_cache(4096)
def _char(c: str) -> str:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Pd" or c == "−":
        return "-"
    if kind == "Zs":
        return " "
    if c in "‘’`´":
        return "'"
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


class Source:
    """Where each character of a rewritten text came from: the start and the end of its range in the source."""

    def __init__(self, n: int):
        self.start, self.end = list(range(n)), list(range(1, n + 1))


def _rewrite(text: str, at: Source | None, edits: list[tuple[int, int, str]]) -> tuple[str, Source]:
    """text with the ranges of edits replaced; at is that of text (None: the text is the source)."""
    at = at or Source(len(text))
    new = Source(0)
    out, i = [], 0
    for a, b, s in edits:
        if a < i:
            continue
        out += (text[i:a], s)
        new.start += at.start[i:a] + [at.start[a]] * len(s)
        new.end += at.end[i:a] + [at.end[b - 1]] * len(s)
        i = b
    out.append(text[i:])
    new.start += at.start[i:]
    new.end += at.end[i:]
    return "".join(out), new


_MARKED_AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", re.I)
_MARKED_DOT = re.compile(r"\s*[\[({]\s*(?:dot|punto|\.)\s*[\])}]\s*", re.I)
_AT_MARK = re.compile(r"[\[({<]\s*(?:at|@)\s*[\])}>]")
_DOT_MARK = re.compile(r"[\[({]\s*(?:dot|punto|\.)\s*[\])}]")
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
_AT = re.compile(r" at | ?@ | @|(?<=\w) arroba ", re.I)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+", re.I)
_BEFORE = re.compile(r"[A-Za-z0-9_%+-]\Z")
_ENDING = re.compile(r"\.(?:com|org|net|edu|gov|test|example|invalid|info|us)\b", re.I)
_SAID_DOT = re.compile(r"(?<=@)[A-Za-z0-9.-]+(?: dot [A-Za-z0-9-]+)+", re.I)
_SPELLED = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})(?:[ -](?:{'|'.join(DIGIT_WORDS)})\b){{2,}}", re.I)


_INNER = [f" {w} " for w in DIGIT_WORDS]


def normalise(text: str) -> tuple[str, Source | None]:
    """The text as the detectors read it, and each character's source range (None where nothing changed)."""
    at = None
    if not text.isascii():
        edits = [(i, i + 1, n) for i, c in enumerate(text) if c > "\x7f" and (n := _char(c)) != c]
        if edits:
            text, at = _rewrite(text, at, edits)
    low = text.lower()
    if " at " in low or "@ " in low or " @" in low or "arroba" in low or _AT_MARK.search(low) or "@" in low and (" dot " in low or _DOT_MARK.search(low)):
        edits = [(m.start(), m.end(), "@") for m in _MARKED_AT.finditer(text) if m.start() and text[m.start() - 1].isalnum()]
        if edits:
            text, at = _rewrite(text, at, edits)
        edits = [(m.start(), m.end(), ".") for m in _MARKED_DOT.finditer(text)]
        if edits:
            text, at = _rewrite(text, at, edits)
        edits = []
        for m in _AT.finditer(text):
            if (x := _DOMAIN.match(text, m.end())) and _BEFORE.search(text, max(0, m.start() - 64), m.start()):
                if "@" in m[0] or " dot " in x[0].lower() or _ENDING.search(x[0]):
                    edits.append((m.start(), m.end(), "@"))
        if edits:
            text, at = _rewrite(text, at, edits)
        edits = [(m.start() + d.start(), m.start() + d.end(), ".") for m in _SAID_DOT.finditer(text) for d in re.finditer(r" dot ", m[0], re.I)]
        if edits:
            text, at = _rewrite(text, at, edits)
    spaced = low.replace("-", " ")
    if any(w in spaced for w in _INNER):
        edits = []
        for m in _SPELLED.finditer(text):
            for w in re.finditer(r"([ -]?)(\w+)", m[0]):
                if w[1]:
                    edits.append((m.start() + w.start(1), m.start() + w.end(1), ""))
                edits.append((m.start() + w.start(2), m.start() + w.end(2), DIGIT_WORDS[w[2].lower()]))
        if edits:
            text, at = _rewrite(text, at, edits)
    return text, at


_EMAIL = re.compile(rf"(?<![\w.+%-]){_LOCAL}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(
    r"(?<![\w+(.-])(?:\+\d{1,3}[ .-]?(?:\(?\d{1,5}\)?[ .-]?){2,4}\d{2,4}|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}(?: - |[ .-]?)\d{4})(?![\w-]|\.\d)(?:,? ?(?:x|ext\.?|extension) ?\d{1,6}\b)?"
)
_SSN = re.compile(r"(?<![\w-])\d{3}([-. ])\d{2}\1\d{4}(?![\w-])")
_ID = re.compile(r"(?<![\w-])(?:[A-Z]{1,4}-?\d{2,4}(?:-\d{2,4}){1,2}|[A-Z]{1,4}\d{6,12}|\d{6,12}|\d{3}-\d{3}-\d{3})(?![\w-])")
_ID_LABEL = re.compile(
    r"(?:\bchart|\bmember(?:ship)?|\blicen[sc]e|\bdl|\bssn|social security|\bmrn|\bpatient|\bpolicy|\bsubscriber|\bbeneficiary|\bpassport|\btax|\bmedical record)"
    r"(?:\s+(?:id|no|number|num|nr|#|card|account|key|on the form|reads|is|was|record))*[\s.:#]*(?:the form reads|reads|is)?\s*$", re.I
)
_ID_AFTER = re.compile(r"\s*(?:as|is|was)\s+(?:the|her|his|their)\s+(?:social|member|chart|driver|licen|patient)", re.I)
_TYPES = "|".join(sorted((t for t in _TYPE if t not in ("highway", "hwy", "hiway", "hway", "run", "row", "point", "pt", "st", "dr", "ct", "way", "square")), key=len, reverse=True))
_DIRS = "|".join(sorted((d for d in _DIR if d not in ("no", "so")), key=len, reverse=True))
_UNIT = r"(?:,? *(?:- *)?(?:(?:suite|ste|unit|un|room|rm|apt)\b\.? *#?|#) *[A-Za-z]?\d+ ?-?[A-Za-z]?\b)?"
_STREET = re.compile(
    rf"(?<![\w.,/$-])(?<!\d )\d{{1,6}}[A-Za-z]? +(?:(?:{_DIRS})\.? +)?"
    rf"(?:(?:state +(?:route|rte|road|rd)|county +(?:road|rd)|cty +rd|co +rd|s\.?r\.?|c\.?r\.?|us|u\.s\.|highway|hwy|hiway)\.?[ -]*\d+[A-Za-z]?\b"
    rf"|(?:\d{{1,3}}(?:st|nd|rd|th)|[A-Za-z][A-Za-z']+)(?: [A-Za-z][A-Za-z']+){{0,2}}? +(?:{_TYPES}|st|dr|ct|way|square)\b\.?)(?: +(?:{_DIRS})\b(?= *(?:[,.\n#]|$|suite|ste|unit)))?{_UNIT}",
    re.I,
)
_BOX = re.compile(r"(?<!\w)(?:p\.? ?o\.? ?b(?:ox)?|post office box|pob)\b\.? *(?:no\.? *)?#? *\d+", re.I)
_TOWN = re.compile(r"(?:\s*[,|]\s*|\s*\n[>| ]*|  ?)((?:[A-Z][A-Za-z.']+ ){0,2}[A-Z][A-Za-z']+)(,? +[A-Z]{2}\b\.?(?: +\d{5}(?:-\d{4})?)?| +\d{5}(?:-\d{4})?)")
_MONTHS = {"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"}
_DAYS = {"monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}
_NOT_STREET = {"and", "of", "the", "pages", "page", "records", "copies", "case", "invoice", "ticket", "on", "in", "at", "for", "to", "am", "pm", *(_MONTHS - {"may"}), *(m[:3] for m in _MONTHS)}

# Given names and short forms that are ordinary words; alone or in lower case they are no evidence of a name.
AMBIGUOUS = {
    "will", "mark", "bill", "art", "pat", "may", "rich", "bob", "drew", "sue", "gene", "rob", "jack", "dot", "hank", "gail", "rick", "dick", "ray", "frank", "nick", "don", "ken", "dan", "al", "ed",
    "hal", "les", "lou", "meg", "nan", "peg", "kit", "kim", "lee", "lia", "di", "win", "sally", "sandy", "terry", "tom", "jean", "ron", "sam", "ben", "max", "carol", "joe", "kay", "bert", "barb", "deb", "vic", "vin",
    "christy", "marty", "missy", "patty", "fred", "jon", "jake", "josh", "dave", "liv", "leo", "len", "lars", "kat", "gerry", "jerry", "iggy", "nacho", "ollie", "uly", "reba", "lindy", "quin", "phil", "kev", "freda", "molly",
}
# Capitalised words after a given name or initial that are no surname.
PLAIN = (
    "the a an and or of for to in on at by with from is was are were be been has have had will would can could should may might must do does did not no yes please she he they it we you i "
    "this that these those who which what when where signed records record case cases order orders chart license ssn invoice ticket page pages both either all any some if but so as than then there here "
    "department departments legal billing medical patient human resources accounts office clinic hospital re fw fwd subject sent date cc bcc phone direct fax tel cell email e-mail mail regards best thanks thank "
    "sincerely cheers kind many hello hi dear good morning afternoon evening wrote says said called paralegal clerk manager specialist coordinator custodian desk retrieval group never our your her his their my"
).split()
WORDLIKE = {"will", "mark", "bill", "may", "art", "dot", "win", "rich", "drew", "sue", "hank", "gene", "pat", "les", "kit", "peg", "nan", "lee", "di", "don", "rob", "jack", "ray", "max", "ed", "al"}
_PLAIN = set(PLAIN) | set(FORMS) | set(SITES) | set(SPECIALTIES) | _MONTHS | _DAYS | {w for w in CREDENTIALS} | set(TITLES)
_ORG = (set(FORMS) | set(SPECIALTIES) | {"health", "medicine", "care", "imaging", "therapy", "retrieval", "management", "disorders"}) - {"home", "family", "women", "pain", "wound", "sleep", "spec", "group", "services", "service", "card", "int", "physical", "internal", "vision"}
_WORD = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'-]*")
_GREET = re.compile(r"^[>| \t]*(?:(?:hi|hello|dear|hey|good (?:morning|afternoon|evening|day)|hola|estimad[oa]|buenos d[ií]as|to)\b[ ,:]*)?$", re.I)


def _is_surname(w: str) -> bool:
    return len(w) >= 3 and w.lower() not in _PLAIN and not w.endswith("'s") or len(w) == 2 and w[0].isupper() and w[1].islower() and w.lower() not in _PLAIN and w.lower() in ("li", "ng", "wu", "xu", "le", "ho", "yu")


def _names(t: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(t)]
    spans = sorted((a, b) for a, b, _ in taken)
    k, free = 0, []
    for w in words:
        while k < len(spans) and spans[k][1] <= w[0]:
            k += 1
        if k == len(spans) or w[1] <= spans[k][0]:
            free.append(w)
    n, i = len(free), 0
    blank = re.compile(r"[ \t]+").fullmatch

    def joined(x: int, y: int, sep: str = r"[ \t]+") -> bool:
        if y >= n:
            return False
        gap = t[free[x][1] : free[y][0]]
        return gap == " " or (blank(gap) if sep == r"[ \t]+" else re.fullmatch(sep, gap)) is not None if "," not in sep else re.fullmatch(sep, gap) is not None

    while i < n:
        a, b, w = free[i]
        low, cap = w.lower(), w[0].isupper()
        g = low in GIVEN
        if not (cap or g or b - a == 1 or low in TITLES):
            i += 1
            continue
        if g and (cap or low not in WORDLIKE):
            j = i + 1
            if joined(i, j, r"\.?[ \t]+") and len(free[j][2]) == 1 and free[j][2].isalpha() and joined(j, j + 1, r"\.?[ \t]+"):
                j += 1  # middle initial
            if joined(j - 1, j, r"\.?[ \t]+" if j > i + 1 else r"[ \t]+"):
                s = free[j][2]
                fits = _is_surname(s) and (s[0].isupper() == cap or s[0].isupper()) and not (s.lower() in GIVEN and s[0].islower())
                if fits and not cap:
                    fits = len(s) >= (8 if low in AMBIGUOUS else 5) and not (s.endswith(("ing", "ed", "ly")) and s.islower())
                if fits and low in AMBIGUOUS and j + 1 < n and joined(j, j + 1) and free[j + 1][2].lower() in _ORG:
                    fits = False
                if fits:
                    yield a, free[j][1], "NAME"
                    i = j + 1
                    continue
            alone = cap
            if alone and low in AMBIGUOUS:
                start = t.rfind("\n", 0, a) + 1
                rest = t[b : t.find("\n", b) if t.find("\n", b) >= 0 else len(t)]
                alone = bool(_GREET.match(t[start:a])) and re.fullmatch(r"[ \t\r]*[,.:;!-]*[ \t\r]*", rest) is not None
            if alone and not (i + 1 < n and joined(i, i + 1) and free[i + 1][2].lower() in _ORG):
                yield a, b, "NAME"
                i += 1
                continue
        elif cap and not g and _is_surname(w) and i + 1 < n and t[b : b + 1] == "," and joined(i, i + 1, r",[ \t]+") and not (i and joined(i - 1, i) and (free[i - 1][2].lower() in GIVEN or free[i - 1][2][0].isupper() and free[i - 1][2].lower() not in _PLAIN)):
            s = free[i + 1][2]
            initial = len(s) == 1 and s.isupper() and t[free[i + 1][1] : free[i + 1][1] + 1] == "."
            if (s.lower() in GIVEN and s[0].isupper() or initial) and s.lower() not in STATES:
                end = free[i + 1][1]
                if joined(i + 1, i + 2) and len(free[i + 2][2]) == 1 and free[i + 2][2].isupper() and t[free[i + 2][1] : free[i + 2][1] + 1] == ".":
                    end = free[i + 2][1]
                    i += 1
                yield a, end, "NAME"
                i += 2
                continue
        if len(w) == 1 and i + 1 < n and t[b : b + 1] == "." and joined(i, i + 1, r"\.[ \t]+") and (not a or t[a - 1] not in ".&'"):
            j = i + 1
            if len(free[j][2]) == 1 and joined(j, j + 1, r"\.?[ \t]+"):
                j += 1
            s = free[j][2]
            if _is_surname(s) and s.lower() not in _ORG and (cap and s[0].isupper() or not cap and s.islower() and len(s) >= 5):
                follows = free[j + 1][2].lower() if joined(j, j + 1) else ""
                if follows not in _ORG and follows not in SITES:
                    yield a, free[j][1], "NAME"
                    i = j + 1
                    continue
        if low in TITLES and i + 1 < n and joined(i, i + 1, r"\.?[ \t]+"):
            s = free[i + 1][2]
            if s.lower() not in GIVEN and _is_surname(s) and (s[0].isupper() or len(s) >= 5 and t[b : b + 1] == "."):
                j = i + 1
                if joined(j, j + 1) and free[j + 1][2][0].isupper() and _is_surname(free[j + 1][2]):
                    j += 1  # a given name that isn't known, and the surname
                yield free[i + 1][0], free[j][1], "NAME"
                i = j + 1
                continue
        i += 1


def find_pii(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each occurrence in source positions, in order, without overlaps. Null and empty texts have none."""
    if not text:
        return []
    t, at = normalise(text)
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> bool:
        if any(a < y and x < b for x, y, _ in found):
            return False
        found.append((a, b, kind))
        return True

    if "@" in t:
        for m in _EMAIL.finditer(t):
            add(m.start(), m.end(), "EMAIL")
    for m in _SSN.finditer(t):
        add(m.start(), m.end(), "ID")
    for m in _ID.finditer(t):
        before = t[max(0, m.start() - 48) : m.start()]
        if _ID_LABEL.search(before) or _ID_AFTER.match(t[m.end() : m.end() + 40]):
            add(m.start(), m.end(), "ID")
    for m in _BOX.finditer(t):
        e = m.end()
        if x := _TOWN.match(t, e):
            e = x.end()
        add(m.start(), e, "ADDRESS")
    for m in _STREET.finditer(t):
        words = re.findall(r"[A-Za-z]+", m[0])
        if any(w.lower() in _NOT_STREET for w in words[:-1]):
            continue
        if m[0].islower() and len(words) < 2:
            continue
        e = m.end()
        if t[e - 1] == "." and (e == len(t) or t[e] in " \n\r") and not re.match(r" *(?:[,#]|suite|ste|unit)", t[e:], re.I):
            pass
        if x := _TOWN.match(t, e):
            e = x.end()
        add(m.start(), e, "ADDRESS")
    for m in _PHONE.finditer(t):
        digits = re.sub(r"\D", "", re.split(r"(?i)x|ext", m[0])[0])
        if not 9 <= len(digits) <= 15 or re.search(r"\b(?:ticket|tracking number is|invoice|docket|case|key|order|claim)\s*(?:no\.?|number|#)?\s*$", t[max(0, m.start() - 26) : m.start()], re.I):
            continue
        if re.match(r" ?\d{3,4}\b", t[m.end() : m.end() + 6]) or re.search(r"\d[ -]?$", t[max(0, m.start() - 2) : m.start()]):
            continue
        add(m.start(), m.end(), "PHONE")
    for a, b, kind in list(_names(t, found)):
        add(a, b, kind)
    found.sort()
    if at is None:
        return found
    return [(at.start[a], at.end[b - 1], kind) for a, b, kind in found]


def redact(text: str | None) -> str | None:
    """The text with each occurrence replaced by its kind in brackets; null stays null."""
    if not text:
        return text
    out, i = [], 0
    for a, b, kind in find_pii(text):
        out += (text[i:a], f"[{kind}]")
        i = b
    return "".join(out) + text[i:]


def _found_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, kinds, starts, ends = [], [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for a, e, kind in find_pii(text):
                keys.append(key)
                kinds.append(kind)
                starts.append(a)
                ends.append(e)
        cols = [pa.array(keys, b.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "pii_type", "start_pos", "end_pos"])


def pii_spans(df: DataFrame, key: str = "email_id", text: str = "text") -> DataFrame:
    """(key, pii_type, start_pos, end_pos): one row for each occurrence; positions count code points from 0. No shuffle."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(_found_batches, f"key {kind}, pii_type string, start_pos bigint, end_pos bigint").withColumnRenamed("key", key)


def redacted(df: DataFrame, columns: list[str], key: str = "email_id") -> DataFrame:
    """key and the columns, their texts with typed placeholders in place of personal information. Nulls stay null. No shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([redact(x) for x in b.column(i).to_pylist()], pa.string()) for i in range(1, b.num_columns)], names=b.schema.names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[F.col(c).cast("string") for c in columns]).mapInArrow(batches, f"`{key}` {kind}, " + ", ".join(f"`{c}` string" for c in columns))
