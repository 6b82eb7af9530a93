"""Problem 2: variant spellings of names typed by people.

Method: merge-and-rematch. Each distinct name is parsed to a profile (organisation: own word, site word, specialty; person:
surname, given name, credential, middle initial). Profiles that agree merge, and a merged profile holds the union of its members'
spellings, initials and credentials. Richer profiles re-enter blocking until no profile merges any more:

* spellings: an own word or surname merges into the much more frequent one it misspells, over the whole corpus (spelling.corrections);
* clippings: "Quellor Bayfr Cardiology" merges into "Quellor Bayfront Cardiology", as the odd piece abbreviates the site or specialty
  that another name with the same own word has in its place. What is learned so holds for the other names with that clipping, whose
  remaining pieces then re-enter (short_forms);
* within one site and specialty (or one given name), a word near any spelling of a richer profile merges into it;
* a profile that lacks a part (site, specialty, given name known by its initial only) merges if exactly one richer profile agrees
  with all it has; credentials and middle initials that differ are conflicts there.

Specialties, site words and given names that are different words never merge. Every merge takes a profile away and every clipping a
piece, so both loops end; neither has a bound of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm.name_parse import parse_name
from waypost.llm.spelling import close, corrections, seeking_keys, sought_keys, typo_distance
from waypost.session import staged

PARTS = ("kind", "word", "own", "spec", "cred", "mid", "pieces")
EVIDENCE = 3  # words beside which a clipping must have been seen to be read so beside a word that is not known


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = list(zip(*map(parse_name, b.column(0).to_pylist()))) or [()] * len(PARTS)
        yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(p, pa.string()) for p in parts], names=[b.schema.names[0], *PARTS])


def _abbreviates(short: Column, full: Column) -> Column:
    """Whether short has some letters of the longer word full in their order, the first one included."""
    return (F.length(short) >= 2) & (F.length(short) < F.length(full)) & (F.substring(short, 1, 1) == F.substring(full, 1, 1)) & F.rlike(full, F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*")))


def short_forms(orgs: DataFrame) -> DataFrame:
    """(raw, own, spec, pieces, word, to_own, to_spec): what becomes of organisations of several pieces one of which is a clipping.

    orgs: distinct (raw, own, spec, pieces). A piece is a clipping if its site or specialty is missing and it abbreviates the full form
    that most words have in that place beside the same other part; full forms of equal weight leave it alone. What is left without it
    must be a word that is also typed in one piece, or else EVIDENCE words must have shown the clipping. Loops until no name changes.
    """
    known = staged(orgs.filter("pieces not like '% %'").select(F.col("raw").alias("rest"), F.lit(True).alias("known")).distinct(), "known")
    full = orgs.filter("own <> '' or spec <> ''").select(F.col("raw").alias("rest"), F.col("own").alias("f_own"), F.col("spec").alias("f_spec"))
    many = orgs.filter("pieces like '% %'").select("raw", "own", "spec", "pieces", F.col("raw").alias("word"), F.col("own").alias("to_own"), F.col("spec").alias("to_spec"), F.split("pieces", " ").alias("left"))
    now, evidence = staged(many.withColumn("changed", F.lit(True)), "clipped"), None
    while True:
        open_ = now.filter("changed and size(left) > 1 and (to_own = '' or to_spec = '')").withColumn("i", F.explode(F.sequence(F.lit(1), F.size("left"))))
        rest = F.concat(F.slice("left", F.lit(1), F.col("i") - 1), F.slice("left", F.col("i") + 1, F.size("left")))
        open_ = open_.withColumn("piece", F.element_at("left", F.col("i"))).withColumn("less", rest).withColumn("rest", F.array_join("less", "")).drop("i")
        open_ = staged(open_.join(known, "rest", "left").select("raw", "own", "spec", "pieces", "to_own", "to_spec", "less", "piece", "rest", "known"), "open")
        beside = open_.filter("known").join(full, "rest")
        site = (F.col("to_own") == "") & (F.col("f_own") != "") & (F.col("to_spec") == F.col("f_spec")) & _abbreviates(F.col("piece"), F.col("f_own"))
        spec = (F.col("to_spec") == "") & (F.col("f_spec") != "") & (F.col("to_own") == F.col("f_own")) & (_abbreviates(F.col("piece"), F.col("f_spec")) | ((F.col("piece") == "pt") & (F.col("f_spec") == "physical")))
        seen = beside.select("piece", "rest", F.when(site, F.struct(F.lit("own").alias("part"), F.col("f_own").alias("full"))).when(spec, F.struct(F.lit("spec").alias("part"), F.col("f_spec").alias("full"))).alias("f"))
        seen = seen.filter("f is not null").distinct()
        evidence = staged(seen if evidence is None else evidence.unionByName(seen).distinct(), "evidence")
        seen = evidence.groupBy("piece", "f").agg(F.count("*").alias("n"))
        learned = seen.groupBy("piece", "f.part").agg(F.max_by("f", F.struct("n", "f")).alias("f"), F.max("n").alias("n"), F.sort_array(F.collect_list("n"), False).alias("ns"))  # as many as there are full forms
        learned = learned.filter("size(ns) = 1 or ns[0] > ns[1]").select("piece", "part", "f.full", "n")
        hits = open_.join(learned, "piece").filter(f"((part = 'own' and to_own = '') or (part = 'spec' and to_spec = '')) and (known or n >= {EVIDENCE})")
        key = ["raw", "own", "spec", "pieces"]
        hits = staged(hits.groupBy(*key).agg(F.max_by(F.struct("rest", "part", "full", "less"), F.struct(F.coalesce("known", F.lit(False)).alias("known"), "n", "piece", "full")).alias("hit")), "hits")
        if hits.isEmpty():
            left = F.array_contains("left", "pt")
            own, spec = F.when(left & (F.col("to_own") == ""), "point").otherwise(F.col("to_own")), F.when(left & (F.col("to_own") != "") & (F.col("to_spec") == ""), "physical").otherwise(F.col("to_spec"))
            return now.select(*key, F.when(left, F.array_join(F.array_remove("left", "pt"), "")).otherwise(F.col("word")).alias("word"), own.alias("to_own"), spec.alias("to_spec"))
        now = now.join(hits, key, "left")
        took = lambda p: F.when(F.col("hit.part") == p, F.col("hit.full")).otherwise(F.col(f"to_{p}")).alias(f"to_{p}")
        now = staged(now.select(*key, F.coalesce("hit.rest", "word").alias("word"), took("own"), took("spec"), F.coalesce("hit.less", "left").alias("left"), F.col("hit").isNotNull().alias("changed")), "clipped")


def normalised(rows: DataFrame, p: str = "") -> DataFrame:
    """rows with their name's parts (p + PARTS, as parsed; kind not '') corrected, and p + raw, p + whole.

    raw is the word as typed; word, own and spec are without misspellings and clippings. whole: nothing is missing from the name. Other
    columns are kept.
    """
    c = lambda x: f"{p}{x}"
    distinct = staged(rows.select(*[F.col(c(x)).alias(x) for x in PARTS]).distinct(), "parts")
    clips = short_forms(distinct.filter("kind = 'org'").select(F.col("word").alias("raw"), "own", "spec", "pieces")).filter("own <> to_own or spec <> to_spec").withColumn("kind", F.lit("org"))
    clips = staged(clips, "clips")
    key = ["kind", "raw", "own", "spec", "pieces"]
    typed = distinct.withColumnRenamed("word", "raw").join(clips, key, "left").select(*key, F.coalesce("word", "raw").alias("word"), F.coalesce("to_own", "own").alias("to_own"), F.coalesce("to_spec", "spec").alias("to_spec"))
    typed = staged(typed, "typed")
    words = corrections(typed.groupBy("kind", "word").agg(F.count("*").alias("n")), ["kind"])
    to = typed.distinct().join(words, ["kind", "word"], "left").withColumn("to_word", F.coalesce("correct", "word")).filter("to_word <> raw or to_own <> own or to_spec <> spec")
    to = to.select(F.xxhash64(*key).alias("_key"), *[F.col(f"to_{x}").alias(f"_{x}") for x in ("word", "own", "spec")])
    rows = rows.withColumnRenamed(c("word"), c("raw"))
    rows = rows.withColumn("_key", F.xxhash64(*[c(x) for x in key])).join(to, "_key", "left").drop("_key")  # the only shuffle of all rows
    rows = rows.withColumns({c("word"): F.coalesce("_word", c("raw")), c("own"): F.coalesce("_own", c("own")), c("spec"): F.coalesce("_spec", c("spec"))}).drop("_word", "_own", "_spec", c("pieces"))
    own, spec = F.col(c("own")), F.col(c("spec"))
    return rows.withColumn(c("whole"), (own != "") & F.when(F.col(c("kind")) == "org", spec != "").otherwise(F.length(own) > 1))


def entities(names: DataFrame) -> DataFrame:
    """(name, kind, entity): each distinct value of the column ``name`` that names one organisation or person, with its entity.

    Nulls, blanks, placeholders and values with ';' have no entity and don't appear; repeated values appear once.
    """
    n = names.select(F.col("name").cast("string")).filter("name is not null and name not like '%;%'").distinct()
    schema = "name string, " + ", ".join(f"{p} string" for p in PARTS)
    rows = normalised(staged(n.mapInArrow(_parse_batches, schema).filter("kind <> ''"), "names"))
    loose = F.when(F.col("whole"), "").otherwise(F.concat_ws("|", "cred", "mid"))  # initials alone aren't joined over credentials
    rows = staged(rows.withColumn("entity", F.concat_ws("|", F.substring("kind", 1, 1), "word", "own", "spec", loose)), "profiles")

    profiles = rows.groupBy("entity", "kind", "word", "own", "spec", "whole").agg(
        F.count("*").alias("n"), F.collect_set("raw").alias("raws"), F.array_remove(F.collect_set("cred"), "").alias("creds"), F.array_remove(F.collect_set("mid"), "").alias("mids")
    )
    profiles, links, richer = staged(profiles, "merged"), None, None
    alike = staged(_alike(profiles), "alike")
    while True:
        found = staged(_merges(profiles, alike, richer), "found")
        if found.isEmpty():
            break
        richer = found.select(F.col("into").alias("entity")).distinct()
        links = found if links is None else staged(_followed(links, found), "links")
        profiles = staged(_merged(profiles, found), "merged")
    out = rows.select("name", "kind", "entity")
    if links is None:
        return out
    return out.join(links, "entity", "left").select("name", "kind", F.coalesce("into", "entity").alias("entity"))


def _alike(profiles: DataFrame) -> DataFrame:
    """(kind, a_raw, b_raw): words of whole profiles, and the spellings of other words that are near them.

    Worked out on distinct words; what is already corrected doesn't look, so the pairs don't grow with the square of a word's misspellings.
    """
    whole = profiles.filter("whole")
    words = whole.select("kind", F.col("word").alias("a_raw")).distinct()
    spelled = whole.select("kind", "word", F.explode(F.array_union("raws", F.array("word"))).alias("b_raw")).distinct()
    x = words.withColumn("k", F.explode(seeking_keys(F.col("a_raw")))).withColumn("k", F.xxhash64("kind", "k")).alias("x")
    y = spelled.withColumn("k", F.explode(sought_keys(F.col("b_raw")))).withColumn("k", F.xxhash64("kind", "k")).alias("y")
    near = x.join(y, "k").filter((F.col("x.kind") == F.col("y.kind")) & (F.col("a_raw") != F.col("word")) & close(F.col("a_raw"), F.col("b_raw")))
    return near.select("x.kind", "a_raw", "b_raw").distinct()


def _merges(profiles: DataFrame, alike: DataFrame, richer: DataFrame | None = None) -> DataFrame:
    """(entity, into): merges of this round; into is never itself merged in the same round.

    alike: see _alike; it holds for all rounds, as merging makes no new spellings. richer: the entities that merged in the round before.
    """
    part, full = profiles.filter("not whole"), profiles.filter("whole")
    ours = full.select(F.col("entity").alias("a_entity"), "kind", F.col("word").alias("a_raw"), "own", "spec", F.col("n").alias("a_n"))
    theirs = full.select(F.col("entity").alias("b_entity"), "kind", F.explode(F.array_union("raws", F.array("word"))).alias("b_raw"), "own", "spec", F.col("n").alias("b_n"))
    close_by = ours.join(theirs.join(alike, ["kind", "b_raw"]), ["kind", "a_raw", "own", "spec"]).filter("a_entity <> b_entity")
    if richer is not None:
        again = full.join(richer, "entity", "left_semi").select("kind", "word").distinct()  # only there the one that fits may be another now
        part, full = (x.join(again, ["kind", "word"], "left_semi") for x in (part, full))
    smaller = F.struct("a_n", "a_entity") < F.struct("b_n", "b_entity")
    side = lambda c: (F.when(smaller, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")), F.when(smaller, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")))
    (less, more), (_, n) = side("entity"), side("n")
    ranked = close_by.select(less.alias("entity"), more.alias("more"), F.struct((-typo_distance(F.col("a_raw"), F.col("b_raw"))).alias("d"), n.alias("n"), more.alias("e")).alias("rank"))
    near = ranked.groupBy("entity").agg(F.max_by("more", "rank").alias("into"))

    part = part.select("entity", "kind", "word", "own", "spec", "creds", "mids").alias("a")
    full = full.select("entity", "kind", "word", "own", "spec", "creds", "mids").alias("b")
    agree = lambda c: (F.size(f"a.{c}") == 0) | (F.size(f"b.{c}") == 0) | F.arrays_overlap(f"a.{c}", f"b.{c}")
    org = (F.col("a.kind") == "org") & F.col("a.own").isin("", F.col("b.own")) & F.col("a.spec").isin("", F.col("b.spec"))
    person = (F.col("a.kind") == "person") & (F.substring("b.own", 1, 1) == F.col("a.own")) & agree("creds") & agree("mids")
    fits = part.join(full, ["kind", "word"]).filter(org | person)
    only = fits.groupBy(F.col("a.entity").alias("entity")).agg(F.min("b.entity").alias("into"), F.max("b.entity").alias("last")).filter("into = last").drop("last")
    both = staged(near.unionByName(only), "both")
    return both.join(both.select(F.col("entity").alias("into")), "into", "left_anti").select("entity", "into")


def _followed(links: DataFrame, found: DataFrame) -> DataFrame:
    next_ = found.select(F.col("entity").alias("into"), F.col("into").alias("further"))
    return links.join(next_, "into", "left").select("entity", F.coalesce("further", "into").alias("into")).unionByName(found.select("entity", "into"))


def _merged(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """Profiles after the merges, with the unions of spellings, credentials and initials."""
    p = profiles.join(found, "entity", "left").withColumn("entity", F.coalesce("into", "entity")).withColumn("lead", F.col("into").isNull()).drop("into")
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    lead = lambda c: F.max_by(c, "lead").alias(c)
    return p.groupBy("entity").agg(*[lead(c) for c in ("kind", "word", "own", "spec", "whole")], F.sum("n").alias("n"), union("raws"), union("creds"), union("mids"))


def same_name_pairs(df: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code points: pairs of distinct values of ``name`` for one organisation or person.

    An empty table gives no rows; columns other than name are ignored.
    """
    e = staged(entities(df), "entities")
    a = e.select(F.col("name").alias("name_a"), "kind", "entity")
    b = e.select(F.col("name").alias("name_b"), "kind", "entity")
    return a.join(b, ["kind", "entity"]).filter("name_a < name_b").select("name_a", "name_b")
