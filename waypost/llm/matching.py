"""Problem 6: matching entities across sources without keys.

Method: candidates share state, town and building number, or, where a block has no address, the name's word. Each pair has a vector of
similarities; a mixture of two Gaussians with regularised diagonal covariances separates matched from unmatched vectors without labels
by expectation-maximisation. What is missing on either side is left out of a vector's likelihood. Transitivity holds inside every
E-step: the locations of one organisation at one place are a group that stands or falls together, and a block can belong to one group
only or to none, so its groups compete:

    P(group i | block) = s/m L_i / (1 - s + s/m (L_1 + ... + L_m))

with the likelihood ratios L of its m candidate groups and the share s of blocks that have a match. The posterior is the confidence;
names decide by nothing else. For a found pair, units, streets and departments of the single rows are checked for conflicts afterwards.

The vectors - similarity of the own word or surname, site or given name, specialty (credential, where only an initial is known),
street, direction and type, unit, department, postal code - are rounded to a grid, so the mixture is fitted on a histogram of all
candidates that has at most CELLS cells, and each step works on the distinct patterns of cells that blocks have.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm import addresses, names
from waypost.llm.address_parse import parse
from waypost.llm.name_parse import parse_name
from waypost.session import staged

log = logging.getLogger(__name__)

RIDGE = 0.01  # added to every variance
SETTLED = 0.05  # change of the log likelihood ratios under which the mixture has settled
STEPS = 500  # bound of the iterations, far above what settling takes; reaching it is an error
CONFIDENT = 0.5  # a pair is found above it, so two groups that fit alike are none

# steps of each feature from 0 to 1; one cell more stands for a missing one
TOPS = {"word": 10, "own": 2, "spec": 1, "core": 10, "way": 1, "unit": 1, "dept": 1, "zip": 1}
CELLS = int(np.prod([t + 2 for t in TOPS.values()]))

PLACE = ["st", "town", "kind", "num"]
NAME = [f"n_{p}" for p in names.PARTS]


_DEPARTMENTS = [
    (re.compile(pattern), value)
    for pattern, value in (
        (r"^(-|n/?a|none|unknown|tbd|)$", ""), (r"\bhim\b|med", "medical records"), (r"bill", "billing"), (r"radiol|film|imaging", "radiology"),
        (r"patient|\bpt\b|acc(oun)?ts", "patient accounts"), (r"human|\bh\.? ?r\b", "human resources"), (r"pharm", "pharmacy"), (r"legal", "legal"),
        (r"records?", "medical records"),
    )
]


@lru_cache(20_000)
def department_class(name: str | None) -> str:
    """What a department's name means; '' where it is missing."""
    s = (name or "").lower().strip()
    return next((value for pattern, value in _DEPARTMENTS if pattern.search(s)), None) or re.sub(r"[^a-z0-9]+|dep(artmen)?t", "", s if not _DEPARTMENTS[0][0].search(s) else "")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dept, *place, name = (c.to_pylist() for c in b.columns[2:])
        parts = [*(list(zip(*map(parse, *place))) or [()] * len(addresses.PARTS)), *(list(zip(*map(parse_name, name))) or [()] * len(NAME))]
        several = pa.array([x is not None and ";" in x for x in name], pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(list(map(department_class, dept)), pa.string()), several, *[pa.array(p, pa.string()) for p in parts]], names=[*b.schema.names[:3], "several", *addresses.PARTS, *NAME])


def _rows(locations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Both tables parsed (src, id, dept, address parts, name parts), names and towns corrected over both."""

    def side(df: DataFrame, src: str, key: str) -> DataFrame:
        return df.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("id"), F.col("department").cast("string").alias("dept"), *[F.col(f).cast("string") for f in (*addresses.FIELDS, "name")])

    schema = "src string, id bigint, dept string, several boolean, " + ", ".join(f"{c} string" for c in (*addresses.PARTS, *NAME))
    rows = side(locations, "l", "ref_ord").unionByName(side(blocks, "b", "block_id")).mapInArrow(_parse_batches, schema)
    # a location without an own name or without an address is in no pair, nor is a block with neither or with several names
    rows = staged(rows.filter("(n_kind <> '' or (src = 'b' and not several)) and (kind <> '' or (src = 'b' and n_kind <> ''))"), "rows")
    named = names.normalised(rows.filter("n_kind <> ''"), "n_").drop("n_raw", "n_whole")
    return staged(addresses.corrected(rows, named.unionByName(rows.filter("n_kind = ''").select(named.columns))), "corrected")


def _filled(loc: DataFrame, key: Column) -> DataFrame:
    """loc with g_own and g_spec: hashes of site (given name) and specialty, missing ones filled in where all names of the key agree.

    key: a hash of the name's word and of what else shall be equal. Hashes, as sums of strings can't be aggregated without sorting.
    """
    person = F.col("n_kind") == "person"
    short = F.when(person, F.length("n_own") < 2).otherwise(F.col("n_own") == "")
    lacking = short | (~person & (F.col("n_spec") == ""))
    initial = F.xxhash64(F.substring("n_own", 1, 1))
    loc = loc.withColumns({"g_own": F.xxhash64("n_own"), "g_spec": F.xxhash64("n_spec"), "g_initial": initial, "_key": key})
    full = {"own": F.when(~short, F.col("g_own")), "initial": F.when(~short, initial), "spec": F.when(F.col("n_spec") != "", F.col("g_spec"))}
    one = loc.groupBy("_key").agg(*[f(c).alias(f"{n}_{p}") for p, c in full.items() for n, f in (("lo", F.min), ("hi", F.max))])
    one = one.select("_key", *[F.when(F.col(f"lo_{p}") == F.col(f"hi_{p}"), F.col(f"lo_{p}")).alias(f"one_{p}") for p in full])
    part = loc.filter(lacking).join(one, "_key", "left")
    fits = ~person | (F.col("n_own") == "") | F.coalesce(F.col("one_initial") == F.col("g_initial"), F.lit(False))
    part = part.withColumns({"g_own": F.when(short & fits, F.coalesce("one_own", "g_own")).otherwise(F.col("g_own")), "g_spec": F.when(F.col("n_spec") == "", F.coalesce("one_spec", "g_spec")).otherwise(F.col("g_spec"))})
    part = part.withColumn("g_initial", F.when(short & fits, F.coalesce("one_initial", "g_initial")).otherwise(F.col("g_initial")))
    return loc.filter(~lacking).unionByName(part.select(loc.columns)).drop("_key")


def _similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def _agreement(a: Column, b: Column) -> Column:
    """1 or 0; null where a side is missing."""
    return F.when((a != "") & (b != ""), F.when(a == b, 1.0).otherwise(0.0))


def _features(x: str, y: str, placed: bool = True) -> dict[str, Column]:
    """The similarities (0 to 1, null where missing) of two rows, aliases x and y; placed: whether both have an address."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    alike = a("n_kind") == b("n_kind")
    known = (a("n_kind") != "") & (b("n_kind") != "")
    person = alike & (a("n_kind") == "person")
    initial = (F.length(a("n_own")) == 1) | (F.length(b("n_own")) == 1)
    given = F.when(a("n_own") == b("n_own"), 1.0).when(initial & (F.substring(a("n_own"), 1, 1) == F.substring(b("n_own"), 1, 1)), 0.5).otherwise(0.0)
    letters = [_agreement(a(c), b(c)) for c in ("n_cred", "n_mid")]
    none = F.lit(None).cast("double")
    ways = [_agreement(a(c), b(c)) for c in ("dir", "type")]
    code = F.when((a("zip") != "") & (b("zip") != ""), F.when((a("zip") == b("zip")) | addresses.zip_near(a("zip"), b("zip")), 1.0).otherwise(0.0))
    return {
        "word": F.when(known, F.when(alike, _similarity(a("n_word"), b("n_word"))).otherwise(0.0)),
        "own": F.when(alike & known & (a("n_own") != "") & (b("n_own") != ""), F.when(person, given).when(a("n_own") == b("n_own"), 1.0).otherwise(0.0)),
        "spec": F.when(alike & known, F.when(person, F.when(initial, F.least(*letters))).otherwise(_agreement(a("n_spec"), b("n_spec")))),
        "core": _similarity(a("core"), b("core")) if placed else none, "way": F.least(*ways) if placed else none, "unit": _agreement(a("unit"), b("unit")) if placed else none,
        "dept": _agreement(a("dept"), b("dept")), "zip": code,
    }


def _coded(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """df with v, the grid cell of the features as one number (_vectors reads it back), and s, by which a group's best pair is chosen."""
    df = df.withColumns({f"f_{k}": c for k, c in features.items()})
    v = F.lit(0)
    for k, top in TOPS.items():
        v = v * (top + 2) + F.coalesce(F.round(F.col(f"f_{k}") * top).cast("int"), F.lit(top + 1))
    s = sum((F.coalesce(F.col(f"f_{k}"), F.lit(0.5)) for k in TOPS), F.lit(0.0))
    return df.withColumns({"v": v, "s": s}).drop(*[f"f_{k}" for k in TOPS])


def _vectors(codes: np.ndarray) -> np.ndarray:
    """One row for each code; NaN where a feature is missing."""
    out = np.zeros((len(codes), len(TOPS)))
    for i, top in reversed(list(enumerate(TOPS.values()))):
        codes, r = np.divmod(codes, top + 2)
        out[:, i] = np.where(r > top, np.nan, r / top)
    return out


def _fit(hist: np.ndarray, counts: np.ndarray, resp: np.ndarray) -> np.ndarray:
    """Log likelihood ratio, matched to unmatched, of each cell; resp: the share of its pairs that match."""
    there = ~np.isnan(hist)
    x = np.where(there, hist, 0.0)
    logs = []
    for r in (resp, 1 - resp):
        w = (r * counts)[:, None] * there
        total = w.sum(0) + 1e-9
        mean = (w * x).sum(0) / total
        var = (w * (x - mean) ** 2).sum(0) / total + RIDGE
        logs.append(np.where(there, -0.5 * (np.log(var) + (x - mean) ** 2 / var), 0.0).sum(1))
    return np.clip(logs[0] - logs[1], -30, 30)


def _shares(offsets: np.ndarray, v: np.ndarray, n: np.ndarray, ratio: np.ndarray, share: float) -> np.ndarray:
    """The posterior of one group of each cell; v and n: the cells of a block's groups, and how many it has in each."""
    if not len(v):
        return np.zeros(0)
    e = np.exp(ratio[v]) * share
    groups = np.add.reduceat(n, offsets[:-1])
    total = np.add.reduceat(e * n, offsets[:-1])
    return e / np.repeat(groups * (1 - share) + total, np.diff(offsets))


def _mixture(groups: DataFrame) -> tuple[np.ndarray, float]:
    """The log likelihood ratio of each cell and the share of blocks that have a match, fitted on groups (block_id, g, v)."""
    cells = staged(groups.groupBy("block_id", "v").agg(F.count("*").alias("n")), "cells")
    counts, ratio, share = np.zeros(CELLS), np.full(CELLS, -30.0), 0.5
    for r in cells.groupBy("v").agg(F.sum("n").alias("n")).collect():  # at most CELLS rows
        counts[r["v"]] = r["n"]
    used = np.flatnonzero(counts)
    if not len(used):
        return ratio, share
    hist = _vectors(used)
    ratio[used] = _fit(hist, counts[used], np.clip(np.nan_to_num(hist[:, :4], nan=0.5).mean(1), 0.02, 0.98) ** 3)  # where EM starts: the mean similarity of name and street
    # blocks with groups in the same cells share their posteriors; a block's list has at most CELLS entries
    patterns = cells.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p")).groupBy("p").agg(F.count("*").alias("blocks"))
    patterns = staged(patterns.select("p.v", "p.n", "blocks"), "patterns")
    blocks = patterns.select(F.sum("blocks").alias("n")).first()["n"]
    for step in range(STEPS):
        now, prior = ratio.copy(), share

        def expectation(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, prior: float = prior) -> Iterator[pa.RecordBatch]:
            won = np.zeros(CELLS)
            for b in batches:
                v, n = (c.flatten().to_numpy(zero_copy_only=False) for c in b.columns[:2])
                o = b.column(0).offsets.to_numpy()
                if len(v):
                    won += np.bincount(v, _shares(o - o[0], v, n, now, prior) * n * np.repeat(b.column(2).to_numpy(), np.diff(o)), CELLS)
            at = np.flatnonzero(won)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(won[at], pa.float64())], names=["v", "p"])

        got = np.zeros(CELLS)
        for r in patterns.mapInArrow(expectation, "v int, p double").groupBy("v").agg(F.sum("p").alias("p")).collect():  # at most CELLS rows
            got[r["v"]] = r["p"]
        share = float(np.clip(got.sum() / blocks, 1e-4, 1 - 1e-4))
        ratio[used] = _fit(hist, counts[used], np.clip(got[used] / counts[used], 0, 1))
        if np.abs(ratio[used] - now[used]).max() < SETTLED:
            log.info("mixture settled after %d steps", step + 1)
            return ratio, share
    raise RuntimeError(f"the mixture has not settled after {STEPS} steps")


def _with_posteriors(groups: DataFrame) -> DataFrame:
    """groups (block_id, g, v) with posterior."""
    ratio, share = _mixture(groups)
    spark = groups.sparkSession
    odds = spark.createDataFrame([(int(v), float(np.exp(ratio[v]) * share)) for v in np.flatnonzero(ratio > -30)] or [(0, 0.0)], "v int, e double")  # at most CELLS rows
    each = groups.join(F.broadcast(odds), "v", "left").withColumn("e", F.coalesce("e", F.lit(float(np.exp(-30) * share))))
    total = each.groupBy("block_id").agg((F.sum("e") + F.count("*") * F.lit(1 - share)).alias("total"))
    return each.join(total, "block_id").select("block_id", "g", (F.col("e") / F.col("total")).alias("posterior"))


def matched(locations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(ref_ord, block_id, posterior, agrees): candidate pairs with the confidence that they match.

    agrees: neither street nor unit nor department of the two rows conflict. Blocks that lack a name compete for the organisations at
    their place, so only a single one can get a posterior over a half; those that lack an address are candidates where all that is
    known of them fits one organisation at one place. Location rows with ';' in the name, a blank or placeholder name or no address,
    and blocks with several names or with neither name nor address are in no pair. Empty tables give no rows.
    """
    rows = _rows(locations, blocks)
    lone = staged(rows.filter("src = 'b' and kind = ''"), "lone")
    spots = addresses.settled(rows).withColumn("at", F.xxhash64(*PLACE))
    loc = _filled(spots.filter("src = 'l'"), F.xxhash64("at", "n_kind", "n_word"))
    # initials alone aren't joined over credentials
    loose = F.when((F.col("n_kind") == "person") & (F.length("n_own") < 2) & (F.col("g_own") == F.xxhash64("n_own")), F.concat_ws("|", "n_cred", "n_mid")).otherwise("")
    loc = loc.withColumn("g", F.xxhash64("n_kind", "n_word", "g_own", "g_spec", "core", loose)).drop("src", "several", "g_own", "g_spec", "g_initial")
    same = F.lit(True)
    for c in PLACE:
        same = same & (F.col(f"b.{c}") == F.col(f"l.{c}"))
    near = spots.filter("src = 'b'").drop("src", "several").alias("b").join(loc.alias("l"), "at").filter(same)
    near = _coded(near, _features("b", "l"))
    agrees = addresses.same_place("b", "l") & _depts(F.col("b.dept"), F.col("l.dept"))
    pairs = staged(near.select(F.col("b.id").alias("block_id"), "g", "v", "s", F.col("l.id").alias("ref_ord"), agrees.alias("agrees")), "pairs")
    groups = pairs.groupBy("block_id", "g").agg(F.max_by("v", F.struct("s", "v")).alias("v"))
    alone = staged(_lone(lone, spots.filter("src = 'l'")), "alone")
    groups = staged(groups.unionByName(alone.groupBy("block_id", "g").agg(F.max_by("v", F.struct("s", "v")).alias("v"))), "groups")
    out = pairs.select("block_id", "g", "ref_ord", "agrees").unionByName(alone.select("block_id", "g", "ref_ord", "agrees"))
    return out.join(_with_posteriors(groups), ["block_id", "g"]).select("ref_ord", "block_id", "posterior", "agrees")


def _depts(x: Column, y: Column) -> Column:
    return (x == "") | (y == "") | (x == y)


def _lone(blocks: DataFrame, loc: DataFrame) -> DataFrame:
    """Pairs (block_id, g, v, s, ref_ord, agrees) of blocks without a street or box whose name and town fit one organisation at one place.

    Organisations are counted once for each set of fields that blocks leave out (24 sets at most), under a key of the fields they
    have; a key with just one place is joined, so a name at many places, however many blocks have it, makes no pairs.
    """
    own = F.when(F.col("n_own") == "", 0).when((F.col("n_kind") == "person") & (F.length("n_own") == 1), 1).otherwise(2)
    mode = F.struct(own.alias("own"), (F.col("n_spec") != "").alias("spec"), (F.col("st") != "").alias("st"), (F.col("town") != "").alias("town"))
    key = F.xxhash64("mode", "w", "x_own", "x_spec", "x_st", "x_town").alias("k")
    word = F.xxhash64("n_kind", "n_word").alias("w")
    name = ["n_kind", "n_word", "n_own", "n_spec", "n_cred", "n_mid"]
    b = blocks.select("id", "dept", "zip", *name, word, mode.alias("mode"), F.xxhash64("n_own").alias("x_own"), F.xxhash64("n_spec").alias("x_spec"), F.xxhash64("st").alias("x_st"), F.xxhash64("town").alias("x_town"))
    b = staged(b.select("*", key), "lone keys")
    modes = [r["mode"] for r in b.select("mode").distinct().collect()]  # 24 at most
    words = staged(b.select("w").distinct(), "lone words")
    loc = loc.select("id", "dept", "zip", *name, word, "at", "st", "town", "core", "dir", "type", "unit").join(words, "w", "left_semi")
    loc = staged(_filled(loc, F.col("w")).withColumn("g", F.xxhash64("g_own", "g_spec", "at", "core")), "of lone words")
    masks = F.array(*[F.struct(F.lit(m["own"]).alias("own"), *[F.lit(m[c]).alias(c) for c in ("spec", "st", "town")]) for m in modes]) if modes else F.array().cast("array<struct<own:int,spec:boolean,st:boolean,town:boolean>>")
    none = F.xxhash64(F.lit(""))
    each = loc.withColumn("mode", F.explode(masks)).withColumns({
        "x_own": F.when(F.col("mode.own") == 0, none).when(F.col("mode.own") == 1, F.col("g_initial")).otherwise(F.col("g_own")),
        "x_spec": F.when(F.col("mode.spec"), F.col("g_spec")).otherwise(none), **{f"x_{c}": F.when(F.col(f"mode.{c}"), F.xxhash64(c)).otherwise(none) for c in ("st", "town")},
    })
    parts = {c: F.when(F.col(c) != "", F.xxhash64(c)) for c in ("dir", "type", "unit")}
    single = each.groupBy(key).agg(F.min("g").alias("g"), F.max("g").alias("last"), *[f(x).alias(f"{n}_{c}") for c, x in parts.items() for n, f in (("lo", F.min), ("hi", F.max))])
    single = single.filter(" and ".join(["g = last", *[f"(lo_{c} is null or lo_{c} = hi_{c})" for c in parts]])).select("k", "g")
    ours = staged(b.join(single, "k").select("id", "g", "dept", "zip", *name), "lone singles")
    near = _coded(ours.alias("b").join(loc.select("id", "g", "dept", "zip", *name).alias("l"), F.col("b.g") == F.col("l.g")), _features("b", "l", placed=False))
    return near.select(F.col("b.id").alias("block_id"), F.col("b.g").alias("g"), "v", "s", F.col("l.id").alias("ref_ord"), _depts(F.col("b.dept"), F.col("l.dept")).alias("agrees"))


def found_pairs(locations: DataFrame, blocks: DataFrame) -> DataFrame:
    """(ref_ord, block_id): the pairs whose posterior is over a half and whose rows don't conflict."""
    m = matched(locations, blocks)
    return m.filter(f"posterior > {CONFIDENT} and agrees").select("ref_ord", "block_id").distinct()
