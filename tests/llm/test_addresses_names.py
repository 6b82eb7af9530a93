import random

import pytest
from pyspark.sql import functions as F

from waypost.llm import spelling
from waypost.llm.address_parse import parse, town_key, zip_code
from waypost.llm.addresses import same_address_pairs
from waypost.llm.name_parse import parse_name
from waypost.llm.names import entities, same_name_pairs

ROW = "ref_ord long, address1 string, address2 string, city string, state string, postal_code string"


@pytest.mark.parametrize(
    "fields,want",
    [
        (("12345 N. Oak St., Ste 5-B", None, "Ft. Reed", "Texas", "750011234"), ("street", "12345", "n", "oak", "street", "5b", "fortreed", "tx", "75001")),
        (("see line 2", "Oak Street 12345 #5B", "Fort Reed", "tx", "75001"), ("street", "12345", "", "oak", "street", "5b", "fortreed", "tx", "75001")),
        (("ATTN BILLING Tenth Ave 77, RM 8, PT REED, IA 52064", None, None, "IA", None), ("street", "77", "", "10th", "avenue", "8", "portreed", "ia", "52064")),
        (("P.O. Box #012", "2nd Floor", "Reed", "IA", "00000"), ("box", "12", "", "", "", "", "reed", "ia", "")),
        (("12 County Rd-65", "", "Reed", "NH", "3135"), ("street", "12", "", "cr 65", "", "", "reed", "nh", "03135")),
        ((None, "n/a", None, None, None), ("", "", "", "", "", "", "", "", "")),
        (("x" * 5000, "", "", "", ""), ("", "", "", "", "", "", "", "", "")),
    ],
)
def test_parse(fields, want):
    assert parse(*fields) == want


def test_keys():
    assert town_key("St. Loskbury") == "saintloskbury" and town_key("-") == "" and zip_code(" 3135 ") == "03135" and zip_code(None) == ""


def test_pairs_follow_the_rules(spark):
    rows = [
        (1, "12345 Beskstone Street", "Suite 5", "Reedville", "TX", "75001"), (2, "12345 beskstone st", "# 5", "Reedville", "TX", "75001"),
        (3, "12345 Beskstnoe St", None, "Reedvlile", "TX", "75010"), (4, "12345 Beskstone Street", "Suite 6", "Reedville", "TX", "75001"),
        (5, "12345 Beskstone Avenue", None, "Reedville", "TX", "75001"), (6, "12345 Beskstone", None, None, "TX", None), (7, "12345 Beskstone Street", None, "Elsewhere", "TX", "79901"),
        (8, "PO Box 9", None, "Reedville", "TX", "75001"), (9, "p.o. box 9", None, "Reedville", "TX", None), (10, "unknown", None, "Reedville", "TX", "75001"), (11, None, None, None, None, None),
        (12, "55 Lone Way", None, None, "NV", "89999"), (13, "55 Lone Wy", "", "-", "nv", "89999"), (14, "55 Lone Way", None, None, "NV", "89111"),
    ]
    rows += [(100 + i, f"{i} Elm Street", None, "Reedville", "TX", "75001") for i in range(1, 30)]
    df = spark.createDataFrame(rows, ROW).withColumn("num", F.lit(1)).withColumn("town", F.lit("x"))
    got = {tuple(r) for r in same_address_pairs(df).collect()}
    assert {(1, 2), (1, 3), (2, 3), (3, 4), (8, 9)} <= got
    assert (12, 13) in got and not {(12, 14), (13, 14)} & got  # no town can be told: compared within the postal code
    assert not {(1, 4), (2, 4), (1, 5), (1, 7)} & got and not any(10 in p or 11 in p for p in got)
    assert same_address_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "name,want",
    [
        ("The Bavzindmeack Prairie Derm Spec", ("org", "bavzindmeack", "prairie", "dermatology")),
        ("Dermatology Specialists - Bavzind meack Prr, PLLC (main)", ("org", "bavzindmeack", "prairie", "dermatology")),
        ("tearn park pt inst", ("org", "tearn", "park", "physical")), ("tearn pt fam med inst", ("org", "tearn", "point", "family")),
        ("Quell, Bob A. M.D.", ("person", "quell", "robert", "")), ("DR. S. QUELL", ("person", "quell", "s", "")), ("QUELL ROBERT, DO", ("person", "quell", "robert", "")),
        ("A; B", ("", "", "", "")), (None, ("", "", "", "")), ("  ", ("", "", "", "")), ("see notes", ("", "", "", "")),
    ],
)
def test_parse_name(name, want):
    assert parse_name(name)[:4] == want


def test_clippings_are_learned(spark):
    own = ["bavzindmeack", "tearnmerrshath", "criskwanddao", "flomkainvoos"]
    names = [f"{w} Bayfront Infusion Clinic" for w in own] + [f"{w} Bayfr Infusion Clinic" for w in own[:3]] + [f"{w} Bayfront Infsn Clinic" for w in own[:3]]
    names += [f"{own[3]} bayfr infsn clinic", "flomkianvoos bayfr infsn grp", "Bavzindmeack Bay Infusion Clinic", "Quellor Stone Dental"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    e = {r["name"]: r["entity"] for r in entities(df).collect()}
    for w in own:
        assert len({v for n, v in e.items() if n.lower().startswith(w) and " Bay " not in n}) == 1
    assert e["flomkianvoos bayfr infsn grp"] == e[f"{own[3]} bayfr infsn clinic"]  # two clippings and a misspelling: it re-enters three times
    assert e["Bavzindmeack Bay Infusion Clinic"] != e[names[0]] and e["Quellor Stone Dental"].startswith("o|quellorstone||dental|")


def test_the_links_of_a_corpus_and_of_ten_copies_are_the_same(spark):
    names = ["Bavzindmeack Prairie Dermatology"] * 4 + ["Bavzindmaeck Prairie Dermatology", "Bavzindmaeck Prr Derm", "Milton Creek Dental Clinic", "Hilton Creek Vision Clinic"]
    rows = [(f"{n}{' ' * i}",) for i, n in enumerate(names)]
    of = lambda df: {(r["name"].split("  #")[0], r["entity"]) for r in entities(df).collect()}
    once, ten = spark.createDataFrame(rows, "name string"), spark.createDataFrame([(f"{n}  #{'-' * i}",) for (n,) in rows for i in range(10)], "name string")
    assert len({x for _, x in of(once)}) == len({x for _, x in of(ten)}) == 3


def test_merging_has_no_bound_of_rounds(spark):
    """Each spelling is within the allowed edits of the next one only, so the chain takes many merges."""
    chain = ["abcdefghijklmnop"]
    for i in range(0, 16, 2):
        chain.append(chain[-1][:i] + "zz" + chain[-1][i + 2 :])
    df = spark.createDataFrame([(f"{w.title()} Creek Dental Clinic",) for w in chain], "name string")
    assert len({r["entity"] for r in entities(df).collect()}) == 1

def test_names_merge_and_rematch(spark):
    names = ["Bavzindmeack Prairie Derm Spec"] * 3 + ["Bavzindmaeck Prairie Dermatology", "bavzindmeack prairie dermatology specialists", "Bavzindmeack Ridge Dermatology Clinic", "Bavzindmeack Prairie Dental Clinic"]
    names += ["Robert Quellstone, MD", "Quellstone, Bob", "R. Quellstone MD", "Rita Quellstone DO", "Quellstone, R.", None, "", "TBD", "A;B"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("entity", F.lit(1)).withColumn("kind", F.lit(2))
    e = {r["name"]: r["entity"] for r in entities(df).collect()}
    assert len({e[n] for n in names[:5]}) == 1 and len({e[names[0]], e[names[5]], e[names[6]]}) == 3
    assert e["Robert Quellstone, MD"] == e["Quellstone, Bob"] == e["R. Quellstone MD"] != e["Rita Quellstone DO"]
    assert e["Quellstone, R."] not in (e["Quellstone, Bob"], e["Rita Quellstone DO"])  # two persons fit
    assert not {"", "TBD", "A;B", None} & set(e)
    pairs = {tuple(r) for r in same_name_pairs(df).collect()}
    assert all(a < b for a, b in pairs) and len(pairs) == 3 + 3
    assert same_name_pairs(df.limit(0)).count() == 0


def test_every_pair_within_the_allowed_edits_shares_a_key(spark):
    r = random.Random(7)

    def edited(w, n):
        for _ in range(n):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + r.choice("aeklr") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("aeklr") + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]]) or "a"
        return w

    pairs = [("firtwoomrut", "flirtwoomrunt"), ("keerngreanmeacck", "keerngreenmeack"), ("abcdefg", "bacdegf"), ("aaaaa", "aaaaaa")]
    pairs += [(edited(w, r.randint(0, 3)), w) for _ in range(4000) for w in ["".join(r.choice("aeklrst") for _ in range(r.randint(4, 16)))]]
    df = spark.createDataFrame(pairs, "a string, b string").filter(spelling.close(F.col("a"), F.col("b")))
    shared = F.arrays_overlap(spelling.seeking_keys(F.col("a")), spelling.sought_keys(F.col("b"))) & F.arrays_overlap(spelling.seeking_keys(F.col("b")), spelling.sought_keys(F.col("a")))
    assert df.count() > 2000 and df.filter(~shared & ((F.length("a") > 3) & (F.length("b") > 3))).collect() == []


def test_corrections_of_edits_in_both_halves(spark):
    words = spark.createDataFrame([("flirtwoomrunt", 186), ("firtwoomrut", 1), ("keerngreenmeack", 90), ("keerngreanmeacck", 1)], "word string, n long")
    assert {r["word"]: r["correct"] for r in spelling.corrections(words, []).collect()} == {"firtwoomrut": "flirtwoomrunt", "keerngreanmeacck": "keerngreenmeack"}
