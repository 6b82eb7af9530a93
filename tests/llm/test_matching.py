import numpy as np
from pyspark.sql import functions as F

from waypost.llm import matching
from waypost.llm.matching import department_class, found_pairs, matched

COLS = "name string, address1 string, address2 string, city string, state string, postal_code string, department string"
LOC = [
    (1, "Bavzindmeack Prairie Dermatology Clinic", "12345 Beskstone Street", "Suite 5", "Reedville", "TX", "75001", "Billing"),
    (2, "Bavzindmeack Prairie Derm Clin", "12345 Beskstone St", "# 5", "Reedville", "TX", "75001", None),
    (3, "Tearnmerrshath Ridge Dental Group", "12345 Beskstone Street", "Suite 5", "Reedville", "TX", "75001", None),
    (4, "Criskwanddao Creek Vision Center", "77 Elmwood Avenue", None, "Reedville", "TX", "75001", "Legal"),
    (5, "Criskwanddao Creek Vision Center;Dr. Rita Quell", "77 Elmwood Avenue", None, "Reedville", "TX", "75001", None),
    (6, None, "77 Elmwood Avenue", None, "Reedville", "TX", "75001", None), (7, "Nowhere Creek Vision Center", None, None, None, None, None, None),
]
BLK = [
    (1, "bavzindmaeck prr dermatology clinic", "12345 beskstnoe st", "ste 5", "Reedville", "TX", "75001", "Bills"),
    (2, "bavzindmeack prairie dermatology", "12345 Beskstone St", None, "Reedville", "TX", None, "Radiology"),
    (3, None, "77 Elmwood Ave", None, "Reedville", "TX", "75001", None), (4, "Criskwanddao Creek Vsn Ctr", None, None, None, "TX", None, "Legal Dept"),
    (5, None, "12345 Beskstone Street", None, "Reedville", "TX", "75001", None), (6, None, None, None, None, None, None, None), (7, "Criskwanddao Creek Vision Center", "99 Elmwood Avenue", None, "Reedville", "TX", "75001", None),
]


def test_found(spark):
    loc = spark.createDataFrame(LOC, "ref_ord long, " + COLS).withColumn("id", F.lit("x")).withColumn("dept", F.lit(1)).withColumn("src", F.lit(2))
    blk = spark.createDataFrame(BLK, "block_id long, " + COLS).withColumn("st", F.lit("x"))
    got = {tuple(r) for r in found_pairs(loc, blk).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (4, 3), (4, 4)}
    m = matched(loc, blk)
    assert m.columns == ["ref_ord", "block_id", "posterior", "agrees"]
    p = {(r["ref_ord"], r["block_id"]): r["posterior"] for r in m.collect()}
    assert p[3, 1] < 0.5 < p[1, 1] and p[1, 5] < 0.5 and p[3, 5] < 0.5  # without a name, two organisations at the place are too many
    assert 0.5 < p[4, 3] < 1 and 0.5 < p[4, 4] < 1  # no posterior is given without the model
    assert found_pairs(loc.limit(0), blk).count() == 0 == found_pairs(loc, blk.limit(0)).count()


def test_departments():
    names = ["Med. Records", "HIM / Medical Records", "Pt. Accounts", "H.R.", "N/A", None, "Radiolgy", "Zoo Dept"]
    assert [department_class(x) for x in names] == ["medical records", "medical records", "patient accounts", "human resources", "", "", "radiology", "zoo"]


def _cells(r, n):
    """Grid cells of n blocks with three groups, of which the first matches two times in three; and which block has a match."""
    tops = list(matching.TOPS.values())
    grid = lambda mean: tuple(int(np.clip(round(m * t + r.normal(0, 0.08 * t)), 0, t)) if r.random() > 0.1 else t + 1 for m, t in zip(mean, tops))
    cell = lambda c: int(np.ravel_multi_index(c, [t + 2 for t in tops]))
    yes = [i % 3 > 0 for i in range(n)]
    rows = [(i, g, cell(grid((0.95, 1, 1, 0.95, 1, 1, 1, 1) if g == 0 and yes[i] else (0.3, 0.2, 0.1, r.choice([0.2, 1]), 0.7, 0.5, 0.6, 1)))) for i in range(n) for g in range(3)]
    return rows, yes


def test_the_mixture_settles_and_separates(spark):
    rows, yes = _cells(np.random.default_rng(3), 900)
    groups = spark.createDataFrame(rows, "block_id long, g long, v int")
    got = {(x["block_id"], x["g"]): x["posterior"] for x in matching._with_posteriors(groups).collect()}
    assert sum((got[i, 0] > 0.5) == y for i, y in enumerate(yes)) >= 890
    assert max(sum(got[i, g] for g in range(3)) for i in range(900)) <= 1 + 1e-9  # a block belongs to one group at most
    ratio, share = matching._mixture(groups)
    assert abs(share - 2 / 3) < 0.03
    used, n = np.unique([v for _, _, v in rows], return_counts=True)
    won = np.zeros(matching.CELLS)
    np.add.at(won, [v for _, _, v in rows], [got[i, g] for i, g, _ in rows])
    assert np.abs(matching._fit(matching._vectors(used), n, won[used] / n) - ratio[used]).max() < 2 * matching.SETTLED
    assert matching._with_posteriors(groups.limit(0)).count() == 0


def test_cells_are_read_back():
    tops = list(matching.TOPS.values())
    for c in ((0,) * 8, tuple(tops), tuple(t + 1 for t in tops)):
        v = matching._vectors(np.array([int(np.ravel_multi_index(c, [t + 2 for t in tops]))]))[0]
        assert all(np.isnan(x) if d > t else x == d / t for x, d, t in zip(v, c, tops))


def test_the_posterior_decides_and_size_does_not(spark):
    loc, blk = spark.createDataFrame(LOC, "ref_ord long, " + COLS), spark.createDataFrame(BLK, "block_id long, " + COLS)
    low = matched(loc, blk).filter("agrees and posterior <= 0.5").count()
    assert low > 0  # pairs without a conflict that only the mixture rejects
    ten = lambda df, key: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn(key, F.col(key) + 1000 * F.col("i")).drop("i")
    want = {tuple(r) for r in found_pairs(loc, blk).collect()}
    assert {(a % 1000, b % 1000) for a, b in found_pairs(ten(loc, "ref_ord"), ten(blk, "block_id")).collect()} == want
