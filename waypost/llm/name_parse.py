"""Parsing of one typed organisation's or person's name into comparable parts."""

from __future__ import annotations

import re
from functools import lru_cache

from waypost.llm.address_parse import PLACEHOLDERS, _edit1
from waypost.llm.people import CREDENTIALS, GIVEN, TITLES

# Words of organisations' names with the customary (postal and clinical) short forms; clippings that people make up
# are learned from the corpus (names.short_forms).
SITES = {
    "bayfront": "", "canyon": "cyn", "central": "cntrl ctrl", "community": "comm", "county": "cnty", "creek": "crk", "crossing": "xing",
    "eastfield": "", "estates": "ests est", "forest": "frst", "gardens": "gdns gdn", "grove": "grv", "harbor": "hbr harbour", "heights": "hts", "island": "isl",
    "junction": "jct", "lake": "lk", "lighthouse": "", "meadow": "mdw meadows", "memorial": "mem", "metropolitan": "metro", "mountain": "mtn",
    "northside": "", "park": "pk", "parkside": "", "plains": "plns", "point": "pt", "prairie": "prr", "regional": "reg", "ridge": "rdg", "river": "rvr riv",
    "shores": "shrs", "southgate": "", "springs": "spgs spg", "summit": "smt", "terrace": "ter", "university": "univ", "valley": "vly", "village": "vlg vill",
    "westbrook": "", "hill": "hills", "bay": "", "coastal": "", "general": "", "saint": "st", "downtown": "", "riverside": "", "lakeside": "",
}
SPECIALTIES = {
    "allergy": "", "ambulance": "amb", "audiology": "aud", "cardiology": "cardio card", "chiropractic": "chiro", "dental": "", "dermatology": "derm",
    "diagnostic": "diag", "endocrinology": "endo", "family": "fam", "gastroenterology": "gastro", "home": "", "hospice": "", "infusion": "", "internal": "int",
    "laboratory": "lab labs", "nephrology": "neph", "neurology": "neuro", "occupational": "occ", "oncology": "onc", "orthopedic": "ortho orthopaedic orthopedics", "pain": "",
    "pediatric": "peds pediatrics ped", "physical": "phys", "podiatry": "pod", "psychiatry": "psych", "rehabilitation": "rehab", "rheumatology": "rheum", "sleep": "", "surgical": "surg surgery",
    "urgent": "uc", "urology": "uro", "veterans": "vets vet", "vision": "", "women": "womens womans", "wound": "", "radiology": "rad", "imaging only": "",
}
FORMS = "center ctr centre group grp clinic clin clinics institute inst associates assoc assocs hospital hosp partners ptnrs prtnrs services svcs service specialists spec specialist".split()
FILLERS = "health hlth medicine med medical care imaging img management mgmt mgt therapy thpy ther disorders disorder dis of the and at for in inc llc pllc pc ltd corp co lp main campus office".split()

_WORD = {s: ("site", full) for full, short in SITES.items() for s in (full, *short.split())}
_WORD |= {s: ("spec", full) for full, short in SPECIALTIES.items() for s in (full, *short.split())}
_WORD |= {w: ("form", w) for w in FORMS} | {w: ("filler", w) for w in FILLERS}
_LONG = [w for w in (*SITES, *SPECIALTIES, *FORMS) if len(w) >= 5 and " " not in w]
_SIDES = {"n": "north", "s": "south", "e": "east", "w": "west"}
NOT_NAMES = PLACEHOLDERS | {"unknown facility", "unknown provider", "records custodian", "custodian of records", "medical records", "to be determined", "pending", "test"}


@lru_cache(20_000)
def _fuzzy(word: str) -> str:
    return next((w for w in _LONG if len(word) >= 5 and _edit1(word, w)), "")


@lru_cache(20_000)
def given_of(word: str) -> str:
    """The full given name that word is, or is short for, or misspells by one edit; '' otherwise."""
    return GIVEN.get(word) or next((GIVEN[g] for g in GIVEN if len(g) >= 5 and len(word) >= 4 and _edit1(word, g)), "")


def _person(words: list[str], comma: int) -> tuple[str, ...] | None:
    """words without titles and credentials; comma: how many words stood before the first comma, or 0."""
    words = [w for w in words if w]
    if not 2 <= len(words) <= 4:
        return None
    if comma and comma < len(words):
        family, own = words[:comma], words[comma:]
    elif len(words[0]) > 1 and (g := given_of(words[0])) and not (words[0] not in GIVEN and words[-1] in GIVEN):
        family, own = words[-1:], words[:-1]
    elif given_of(words[1]) and not given_of(words[0]) and len(words[0]) > 1:
        family, own = words[:1], words[1:]
    else:
        long = max(range(len(words)), key=lambda i: (len(words[i]) > 1, i))
        family, own = [words[long]], words[:long] + words[long + 1 :]
    if len("".join(family)) < 2:
        return None
    first = own[0]
    return "".join(family), given_of(first) if len(first) > 1 and given_of(first) else first, next((w for w in own[1:] if len(w) == 1), "")


@lru_cache(100_000)
def parse_name(name: str | None) -> tuple[str, str, str, str, str, str, str]:
    """(kind, word, site or given name, specialty, credential, middle initial, pieces).

    kind is 'org', 'person' or '' (blank, placeholder, several names with ';'). word is the organisation's own word, joined where it
    was typed in pieces, or the surname; pieces has them apart, one of which may be a clipped site or specialty. Missing parts are ''.
    """
    none = ("",) * 7
    if name is None or ";" in name:
        return none
    text = re.sub(r"\s+", " ", name.lower().replace("’", "'")).strip()
    if text.strip(" .,-") in NOT_NAMES or text in NOT_NAMES:
        return none
    text = re.sub(r"\(.*?\)", " ", text).replace("'s", "s").replace("'", "")
    text = re.sub(r"\b(?:(n)orth|(s)outh|(e)ast|(w)est|([nsew]))\.? ?(side|gate|field|brook)\b", lambda m: _SIDES["".join(x or "" for x in m.groups()[:5])] + m[6], text)
    text = re.sub(r"\b([a-z])\.([a-z])\.(?:([a-z])\.?)?", r"\1\2\3", text)
    head = re.findall(r"[a-z]+", text.split(",")[0]) if "," in text else []
    words = re.findall(r"[a-z]+", text)
    if not words:
        return none
    kinds = [_WORD.get(w, ("", ""))[0] for w in words]
    cred = next((w for w in reversed(words) if w in CREDENTIALS), "")
    titled = words[0] in TITLES
    if titled or not any(k in ("site", "spec", "form") for k in kinds) and 2 <= len(words) <= 5:
        plain = [w for w in words if w not in TITLES and w not in CREDENTIALS]
        before = [w for w in head if w not in TITLES and w not in CREDENTIALS]
        if found := _person(plain, len(before) if "," in text and len(before) < len(plain) else 0):
            family, given, middle = found
            return "person", family, given, "", cred, middle, family
    site, spec, own = [], [], []
    points = []
    for i, (w, k) in enumerate(zip(words, kinds)):
        if w == "pt":
            points.append(i)
        elif k == "site":
            site.append(_WORD[w][1])
        elif k == "spec":
            spec.append(_WORD[w][1])
        elif not k:
            own.append(w)
    if len(own) > 1:
        for w in own[:]:
            k, full = _WORD.get(_fuzzy(w), ("", ""))
            if len(own) > 1 and (k == "form" or k == "site" and not site or k == "spec" and not spec):
                own.remove(w)
                if k != "form":
                    (site if k == "site" else spec).append(full)
    pieces = own
    if len(points) == 1 and len(own) > 1 and not (site and spec):
        points, pieces = [], [*own, "pt"]  # point or physical therapy, as the other pieces turn out
    for _ in points:
        if not spec and (site or len(points) > 1):
            spec.append("physical")
        elif not site:
            site.append("point")
        elif not spec:
            spec.append("physical")
    if not own and site:
        pieces = own = [site.pop(0)]
    word = "".join(own)
    return ("org", word, "+".join(sorted(set(site))), "+".join(sorted(set(spec))), "", "", " ".join(pieces)) if word else none
