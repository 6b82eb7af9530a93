"""Problem 8: filling fixed-capacity containers with items.

Method: Martello-Toth dominance reduction on the histogram of item sizes (at most one line for each size up to the capacity, so the
driver holds a bounded table whatever the number of items), then best fit decreasing for what remains. Copies of a size are handled
at once: fixing a set, or putting a size into a group of equal containers, is one step for all copies. The plan - how many containers
of which content - goes back to the items by their rank within their size; ranks are computed over salted groups, so a size that a
third of all items have isn't ranked in one task.

An item larger than the capacity is split into full pieces and a rest; the rest is packed like an item. Items of size 0 (null or
empty texts) go to container 0, which they leave as it is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypost.session import staged

Pattern = tuple[tuple[int, int], ...]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sets of one or two sizes that dominate every other set with the same largest item; counts keeps the rest.

    A set dominates if each alternative's items can be replaced by its own, larger or equal ones: with an item of size w, the largest
    partner p that fits dominates when it fills the container, when no two others fit beside w, or when exactly two fit at most and
    p is at least as large as any such two together. If nothing fits, w stands alone.
    """
    fixed: list[tuple[Pattern, int]] = []
    sizes = sorted(s for s, c in counts.items() if c > 0 and s > 0)

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect_left(sizes, size))

    changed = True
    while changed:
        changed = False
        for w in sizes[::-1]:
            if w not in counts:
                continue
            room = capacity - w
            least = [s for s in sizes[:4] for _ in range(min(4, counts[s] - (s == w)))][:3]
            if not least or least[0] > room:
                n = counts[w] if not least or w + w > capacity or counts[w] == 1 else 0
                if n:
                    fixed.append((((w, 1),), n))
                    take(w, n)
                    changed = True
                continue
            i = bisect_right(sizes, room) - 1
            if i >= 0 and sizes[i] == w and counts[w] == 1:
                i -= 1
            if i < 0:
                continue
            p = sizes[i]
            two = len(least) > 1 and least[0] + least[1] <= room
            three = len(least) > 2 and sum(least) <= room
            ok = w + p == capacity or not two
            if not ok and not three:
                ok = p >= _largest_pair(sizes, counts, w, room)
            if ok:
                if p == w:
                    n = counts[w] // 2
                    fixed.append((((w, 2),), n))
                    take(w, 2 * n)
                else:
                    n = min(counts[w], counts[p])
                    fixed.append((((w, 1), (p, 1)), n))
                    take(w, n)
                    take(p, n)
                changed = True
    return fixed


def _largest_pair(sizes: list[int], counts: dict[int, int], w: int, room: int) -> int:
    """The largest sum of two items other than one w that is at most room; 0 if there is none."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        a, b = sizes[i], sizes[j]
        if a + b > room or (i == j and counts[a] - (a == w) < 2):
            j -= 1
        else:
            best = max(best, a + b)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over a histogram; containers with the same content are one group."""
    by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, room: int, n: int) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append((pattern, n))

    for s in sorted((s for s, c in counts.items() if c > 0 and s > 0), reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                pattern, room, n = (), capacity, left
            else:
                room = rooms[i]
                pattern, n = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
            each = room // s
            full = min(n, left // each)
            rest = left - full * each if full < n and left - full * each < each else 0
            put((*pattern, (s, each)), room - each * s, full)
            if rest:
                put((*pattern, (s, rest)), room - rest * s, 1)
            if pattern:
                put(pattern, room, n - full - bool(rest))
            left -= full * each + rest
    return [(p, n) for groups in by_room.values() for p, n in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(content, number of containers) for the histogram counts of sizes 1..capacity."""
    rest = dict(counts)
    return reduce_by_dominance(rest, capacity) + best_fit(rest, capacity)


def _slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """By size: the first rank of each run of slots, the run's first container, and the slots in each container of the run."""
    rows: dict[int, tuple[list[int], list[int], list[int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for pattern, n in patterns:
        for size, each in pattern:
            first, bases, eaches = rows.setdefault(size, ([], [], []))
            first.append(seen.get(size, 0))
            bases.append(base)
            eaches.append(each)
            seen[size] = seen.get(size, 0) + each * n
        base += n
    return [(s, *r) for s, r in rows.items()]


def packed(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece int, n_tokens bigint, container bigint): one row for each item, or for each piece of an item that was split.

    key must be unique; null sizes count as 0. piece is 0 for whole items and 0, 1, ... for pieces. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    pieces = items.select(F.col(key), n.alias("n")).withColumn("piece", F.explode(F.sequence(F.lit(0), (F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)) - 1).cast("int"))))
    pieces = staged(pieces.select(key, "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("bigint") * capacity).alias("n")), "pieces")

    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    groups = staged(salted.filter("n > 0").groupBy("n", "salt").agg(F.count("*").alias("c")), "groups")
    counts = {r["n"]: r["c"] for r in groups.groupBy("n").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    slots = _slots(plan(counts, capacity))
    schema = "n bigint, first array<bigint>, base array<bigint>, each array<bigint>"
    table = spark.createDataFrame(slots, schema)  # one row for each size

    before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select("n", "salt", before.alias("start"))
    ranked = salted.filter("n > 0").withColumn("r", F.row_number().over(Window.partitionBy("n", "salt").orderBy(key, "piece")) - 1)
    ranked = ranked.join(starts, ["n", "salt"]).withColumn("r", F.col("r") + F.col("start"))
    placed = ranked.join(F.broadcast(table), "n").withColumn("i", F.size(F.filter("first", lambda x: x <= F.col("r"))) - 1)
    inside = ((F.col("r") - F.get("first", F.col("i"))) / F.get("each", F.col("i"))).cast("bigint")
    placed = placed.select(key, "piece", F.col("n").alias("n_tokens"), (F.get("base", F.col("i")) + inside).alias("container"))
    empty = pieces.filter("n = 0").select(key, "piece", F.col("n").alias("n_tokens"), F.lit(0).cast("bigint").alias("container"))
    return placed.unionByName(empty)
