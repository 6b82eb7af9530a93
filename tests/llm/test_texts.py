import base64
import contextlib
import gc
import random
import threading
import time
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waypost.llm import tokens, truncation
from waypost.llm.email_layout import newly_written, new_lines, parse_layout
from waypost.llm.packing import best_fit, packed, plan, reduce_by_dominance
from waypost.llm.pii import find_pii, normalise, pii_spans, redact, redacted
from waypost.session import shared_folder


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to a.b+c@x.org or jo [at] mail dot test.", "Write to [EMAIL] or [EMAIL]."),
        ("Kindly use <mailto:a@x.org> now", "Kindly use <mailto:[EMAIL]> now"),
        ("Call (404) 555 - 0154 or +44 1632 960523, x12", "Call [PHONE] or [PHONE]"),
        ("Call five five five, two one two five five five oh one nine nine", "Call five five five, [PHONE]"),
        ("SSN on the form reads 979-30-3865. Chart BWF-443-2077; ticket 9400 1164 8536 0689; key LGF-539", "SSN on the form reads [ID]. Chart [ID]; ticket 9400 1164 8536 0689; key LGF-539"),
        ("address is 2329 Crevcombe Boul, Suite 268, Reed, TX 75001. PO Box 12", "address is [ADDRESS]. [ADDRESS]"),
        ("Dear Mr. Harold Quell,\nHello William,\nvicky quellstone and R. Quell; Quell, Rita (born)", "Dear Mr. [NAME],\nHello [NAME],\n[NAME] and [NAME]; [NAME] (born)"),
        ("Will Radiology sign? Mark the page. Invoice 77479-82", "Will Radiology sign? Mark the page. Invoice 77479-82"),
        ("", ""), (None, None),
    ],
)
def test_redact(text, want):
    assert redact(text) == want


def test_offsets_point_into_the_source(spark):
    text = "café ​а.b@x.org and jo (at) x dot org"
    spans = find_pii(text)
    assert [text[a:b] for a, b, _ in spans] == ["а.b@x.org", "jo (at) x dot org"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "email_id long, text string").withColumn("key", F.lit(1))
    assert [r["start_pos"] for r in pii_spans(df).orderBy("start_pos").collect()] == [a for a, _, _ in spans]
    assert [r["text"] for r in redacted(df, ["text"]).orderBy("email_id").collect()] == [redact(text), None, ""]


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_pii_never_fails(text):
    t, at = normalise(text)
    assert at is None or len(at.start) == len(at.end) == len(t)
    spans = find_pii(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


TOP = "Hi all,\n\nNew text.  Here.\nRegards to the desk.\n\nBest regards,\nRita Quell\nClerk\n\nOn 24 May 2025, at 5:44, Bob Orr\n<b@x.org> wrote:\n> Old\n>\n> > Older\n"
INLINE = "On Jan 3, 2023, Bob Orr wrote:\r\n> Which zip?\r\n62737\r\n> Who signs?\r\nRita does.\r\n"


def test_new_lines(spark):
    assert new_lines(TOP, None, "Rita Quell <r@x.org>") == ["Hi all,", "New text. Here.", "Regards to the desk."]
    assert new_lines(INLINE, None, None) == ["62737", "Rita does."]
    assert new_lines("Text\n\nRita\n\n-----Original Message-----\nFrom: B\nSent: x\nTo: y\n\nOld", None, "rita.quell@x.org") == ["Text"]
    assert new_lines("Text\nNOTICE: this communication is private\nmore", None, None) == ["Text"]
    html = "<html><head><style>p{}</style></head><p>A&nbsp;b<br>c</p><div>On Jan 3, 2023, Bob wrote:</div><blockquote><p>old</p></blockquote><p>Sent from my phone</p></html>"
    assert new_lines(None, html, None) == ["A b", "c"] == new_lines("", html, None)
    assert new_lines(None, None, None) == [] and new_lines("> only\n> quotes", None, None) == []
    nodes = parse_layout(TOP.split("\n"))
    assert [n.kind for n in nodes] == ["authored", "signature", "history"] and [c.kind for c in nodes[2].children()] == ["authored", "history"]
    below = "-----Original Message-----\nFrom: Bob Orr\nSent: x\nTo: y\n\nHi,\nplease send the chart.\n\nThanks,\n\nBob Orr\nClerk\n\nIt went out today.\nSee page 2.\n\nRegards,\nRita\n"
    assert new_lines(below, None, "Rita Quell <r@x.org>") == ["It went out today.", "See page 2."]
    assert new_lines("New.\n" + below, None, "Rita Quell") == ["New."] and new_lines(below, None, "Sam Vole") == [] and new_lines(below, None, None) == []
    nested = "From: Ann Hale\nSent: x\nTo: y\n\nFwd.\n" + below
    assert new_lines(nested, None, "Rita Quell") == ["It went out today.", "See page 2."]
    assert new_lines(">" * 5000 + " deep", None, "Rita Quell") == []
    df = spark.createDataFrame([(1, TOP, None, "Rita Quell"), (2, None, None, None)], "email_id long, text string, html string, sender string").withColumn("key", F.lit(0))
    assert newly_written(df).count() == 3 and newly_written(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def table():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.BpeTable(f.read())


def test_encoding_equals_the_library(spark, table):
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e, r = tokens.Encoder(table), random.Random(1)
    texts = ["", "Hello, world's  end\n\n", "a" * 5000, "漢字 \U0001f600 ñ"] + ["".join(r.choice("abcdeiort  \n019.,'é漢!-") for _ in range(r.randint(1, 80))) for _ in range(500)]
    for t in texts:
        ids = e.encode(t)
        assert ids == lib.encode_ordinary(t) and table.decode(ids).decode() == t
    for _ in range(100):
        s = "".join(r.choice("abct") for _ in range(300))
        assert table.encode_piece(s) == lib.encode_ordinary(s)
    df = spark.createDataFrame([(1, "Hello there"), (2, None), (3, "")], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit(1))
    got = {x["doc_id"]: x["ids"] for x in tokens.encoded(df).collect()}
    assert got == {1: lib.encode_ordinary("Hello there"), 2: [], 3: []}
    assert {x["doc_id"]: x["n_tokens"] for x in tokens.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plans_hold_every_item_once(counts):
    used: dict[int, int] = {}
    for pattern, n in plan(counts, 40):
        assert n > 0 and sum(s * m for s, m in pattern) <= 40
        for s, m in pattern:
            used[s] = used.get(s, 0) + m * n
    assert used == counts
    bins = sum(n for _, n in plan(counts, 40))
    assert bins <= sum(n for _, n in best_fit(dict(counts), 40)) + 1 and bins >= -(-sum(s * c for s, c in counts.items()) // 40)


def test_dominance_is_optimal_on_small_cases():
    assert sum(n for _, n in plan({6: 2, 5: 2, 4: 4}, 10)) == 4
    rest = {9: 1, 1: 1}
    assert reduce_by_dominance(rest, 10) and not rest


def test_packed(spark):
    sizes = [(i, 10) for i in range(300)] + [(1000, 250), (1001, 0), (1002, None), (1003, 100)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("n", F.lit(1)).withColumn("salt", F.lit(1))
    rows = packed(df, 100).collect()
    fill: dict[int, int] = {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 100 and len(rows) == 303 + 3 and len(fill) == 34 and sum(fill.values()) == 3350
    assert sorted(r["piece"] for r in rows if r["doc_id"] == 1000) == [0, 1, 2]
    assert packed(df.limit(0), 100).count() == 0


def test_endings():
    state = lambda t: truncation.ending(t)[0]
    assert [state(t) for t in (None, " \n", "It ended.", "And so on…", "x\nPlano, TX 75023", "x\nP: 214-555-0101", "Key: ABC-1234")] == ["none", "none", "done", "done", "done", "done", "done"]
    assert [state(t) for t in ("<p>It ended.</", "x\nP: 214-55", "x\nPlano, T", "He came, saw,", "so that the earlier notice was returned and the revie…", "x\nRita Quell")] == ["cut", "cut", "cut", "cut", "prose", "line"]


def test_aligned_end():
    long = "the custodian of the records office told us that the older charts were moved to a warehouse after the last revision of the list. " * 3
    assert truncation.aligned_end(long[:-40], long) == "cut" and truncation.aligned_end(long.strip()[:-1], long + "More text.") == "end"
    assert truncation.aligned_end("quite another text with other words in it and so", long) == ""


def test_truncated(spark):
    r = random.Random(5)
    subjects, clauses = ["The custodian", "Our research team", "The night shift"], ["the suite number had changed", "films are stored in another building", "the release form lacked a signature"]
    tails = ["after the last revision", "during the morning call", "because the earlier notice was returned"]
    sentence = lambda: f"{r.choice(subjects)} reported that {r.choice(clauses)} {r.choice(tails)}."
    docs = [(i, " ".join(sentence() for _ in range(6)), "a") for i in range(120)]
    docs += [(1000, "The night shift reported that films are sto", "b"), (1001, "The custodian reported that the suite", "b"), (1002, "Our research team reported that the suite number had changed during the morning call", "b"), (1003, None, "b"), (1004, "", None)]
    docs += [(2000, docs[0][1][:-60], "c"), (2001, docs[0][1], "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("key", F.lit(1))
    got = {x["doc_id"]: x["truncated"] for x in truncation.truncated(df).collect()}
    assert len(got) == len(docs) and {k for k, v in got.items() if v} == {1000, 1001, 2000}
    rates = {x["source"]: x["n_truncated"] for x in truncation.truncation_rates(df).collect()}
    assert rates == {"a": 0, "b": 2, "c": 1, None: 0}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_every_longer_copy_is_verified(spark):
    words = [f"w{i}" for i in range(90)]
    cut, original = " ".join([*words[:84], "wo"]), " ".join([*words[:84], "word", *words[84:87], "end."])
    longer = [" ".join([*words[:20], *[f"x{n}y{i}" for i in range(30)], *words[50:84], "word", f"y{n}", "end."]) for n in range(60)]  # longer than the original, too unlike the cut text
    assert {truncation.aligned_end(cut, x) for x in longer} == {""} and truncation.aligned_end(cut, original) == "cut"
    df = spark.createDataFrame([("cut", cut), ("original", original), *[(f"longer {n}", x) for n, x in enumerate(longer)]], "doc_id string, text string").withColumn("source", F.lit("a"))
    assert {r["doc_id"]: r["found"] for r in truncation.judged(df).collect()}["cut"] == "cut"


def test_a_copy_that_goes_on_outweighs_others(spark):
    words = [f"w{i}" for i in range(60)]
    cut = " ".join(words[:50])
    wrapped = cut + "\n" + " ".join(words[50:54])
    going = " ".join(words[:52])
    same_stop = "z " + cut
    assert truncation.aligned_end(cut, same_stop) == "" and truncation.aligned_end(cut, wrapped) == "end"
    df = spark.createDataFrame([("cut", cut), ("wrapped", wrapped), ("going", going), ("same", same_stop)], "doc_id string, text string").withColumn("source", F.lit("a"))
    assert {r["doc_id"]: r["found"] for r in truncation.judged(df).collect()}["cut"] == "cut"


@pytest.mark.parametrize(
    "stop,rest,want",
    [
        ("to Dr.", " Quell before noon.", "cut"), ("to 10028 N.", " Crevcombe Street today.", "cut"), ("it (see note 4)", " with the form.", "cut"), ("the desk P:", " 214-555-0101 today.", "cut"),
        ("to Acme Inc.", " on Monday.", "cut"), ("see No.", " 12 of these.", "cut"), ("it was sent.", " Then more came.", "end"), ('she said "yes."', " Then more came.", "end"),
        ("<p>It ended.</p>", "<p>More came.</p>", "end"), ("it was sent:", "\nA new line.", "end"),
    ],
)
def test_properly_ended_texts_are_aligned(stop, rest, want):
    short = " ".join([f"w{i}" for i in range(60)]) + " " + stop
    assert truncation.aligned_end(short, short + rest) == want


def test_properly_ended_copies_are_found(spark):
    stops = {"title": ("to Dr.", " Quell before noon."), "street": ("to 10028 N.", " Crevcombe Street."), "note": ("it (see note 4)", " with the form."), "phone": ("the desk P:", " 214-555-0101 today."), "whole": ("it was sent.", " Then more came.")}
    rows = []
    for name, (stop, rest) in stops.items():
        short = " ".join([f"{name}{i}" for i in range(60)]) + " " + stop
        rows += [(name, short, "a"), (f"{name} long", short + rest, "a")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    assert {r["doc_id"] for r in truncation.truncated(df).collect() if r["truncated"]} == {"title", "street", "note", "phone"}


@pytest.mark.parametrize("email", ["jo{at}x.org", "jo<at>x.org", "jo {@} x.org", "jo(at )x.org", "jo@x[dot]org", "jo@x dot org", "jo@mail (dot) x dot org"])
def test_each_disguise_alone_is_redacted(email):
    assert redact(f"Write to {email}, please") == "Write to [EMAIL], please"


def test_counts_of_contexts_against_a_plain_count():
    r = random.Random(2)
    texts = ["\n".join(" ".join(r.choice(["a", "b.", "C,", "d!", "--", "e:", "7"]) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 5))) for _ in range(60)]
    want: dict = {}
    for text in texts:
        lines = [x.split() for x in text.split("\n") if x.split()]
        for n, line in enumerate(lines):
            before: list[str] = []
            for i, t in enumerate(line):
                if not (w := truncation._norm(t)):
                    continue
                if i == len(line) - 1 and n == len(lines) - 1:
                    break
                end = i == len(line) - 1 or t[-1] in ".!?…;:"
                for k in [w, *([truncation._key([before[-1], w])] if before else []), *([truncation._key([*before[-2:], w])] if len(before) > 1 else [])]:
                    e, g = want.get(k, (0, 0))
                    want[k] = (e + end, g + (not end))
                before = [*before[-1:], w] if t[-1] not in ".!?…" else [w]
    tokens = truncation.Tokens()
    contexts = truncation.Contexts(tokens)
    split = [truncation._tokens_of(t) for t in texts]
    for ids, (_, line) in zip(tokens.numbers([x for x, _ in split]), split):
        if len(ids):
            contexts.add(ids, line)
    got: dict = {}
    for row in contexts.counted().to_pylist():
        k = row["word"] if row["key"] is None else row["key"]
        e, g = got.get(k, (0, 0))
        got[k] = (e + row["ends"], g + row["goes"])
    assert got == want


def test_copies_cut_anywhere_are_found(spark):
    """Texts of 30 to 400 words, each cut at a tenth to nine tenths of its length with one word in 100 changed (a similarity of about 0.9), and texts that share a beginning only."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    rows, cut = [], set()
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randint(30, 400))]
        words = [w + "." if j % 12 == 11 else w for j, w in enumerate(words)]
        n = max(10, int(len(words) * r.uniform(0.1, 0.9)))
        n += words[n - 1].endswith(".") and n < len(words) - 2
        copy = [r.choice(vocabulary) if r.random() < 1 / 100 and j < n - 8 else w for j, w in enumerate(words[:n])]
        rows += [(f"o{i}", " ".join(words) + "."), (f"c{i}", " ".join(copy))]
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (copy[:-1], words[: n - 1]))
        if len(x & y) >= 0.8 * len(x | y):
            cut.add(f"c{i}")
        rows.append((f"b{i}", " ".join([*words[:8], *[r.choice(vocabulary) for _ in range(40)]]) + "."))
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("source", F.lit("a"))
    got = {x["doc_id"] for x in truncation.judged(df).filter("found = 'cut'").collect()}
    assert len(cut) > 120 and got <= cut and len(got) >= 0.95 * len(cut), (len(got), len(cut), sorted(got - cut))


def test_a_hot_group_of_copies_makes_no_pairs_of_copies(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{words} x{i}.") for i in range(400)] + [(1000, words + " more of this"), (1001, words + " more of")], "doc_id long, text string").withColumn("source", F.lit("a"))
    found = {x["doc_id"]: x["found"] for x in truncation.judged(df).filter("found is not null").collect()}
    assert found[1001] == "cut" and set(found) <= {1000, 1001}


def test_near_copies_take_little_disk(spark, tmp_path):
    """Originals and copies cut in the middle, all of which meet: the files at any one time stay below 4 times the input."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    rows = []
    for i in range(900):
        words = [r.choice(vocabulary) for _ in range(900)]
        rows += [(f"o{i}", " ".join(words) + "."), (f"c{i}", " ".join(words[: r.randint(330, 600)]))]
    spark.createDataFrame(rows, "doc_id string, text string").withColumn("source", F.lit("a")).write.parquet(str(tmp_path / "in"))
    size = lambda folder: sum(f.stat().st_size for f in Path(folder).rglob("*") if not f.name.endswith(".crc"))
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(f"{shared_folder(spark)}/waypost-{spark.sparkContext.applicationId}".removeprefix("file://"))
    Path(folders[-1]).mkdir(exist_ok=True)
    peak, done = [], threading.Event()

    def watch():
        while not done.wait(0.05):
            with contextlib.suppress(FileNotFoundError):  # files go while they are counted
                peak.append(sum(map(size, folders)))

    for _ in range(2):  # files of earlier tests
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)
    before = sum(map(size, folders))
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = {x["doc_id"] for x in truncation.judged(spark.read.parquet(str(tmp_path / "in"))).filter("found = 'cut'").collect()}
    finally:
        done.set()
        watcher.join()
    assert len(found) == 900 and {x[0] for x in found} == {"c"}
    assert max(peak) - before < 4 * size(tmp_path / "in"), ((max(peak) - before) / size(tmp_path / "in"))


def test_the_filter_holds_every_entry(spark):
    x = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    held = truncation._filter(spark.createDataFrame([(int(v),) for v in x[:10_000]], "x bigint")).value
    got = truncation._may_hold(held, x.view(np.uint64))
    assert got[:10_000].all() and got[10_000:].mean() < 0.02


def test_maps_of_shingles_never_overstate_what_is_missing():
    r = random.Random(4)
    for _ in range(300):
        x = [r.choice("abcdef") * r.randint(1, 3) for _ in range(r.randint(8, 400))]
        y = [r.choice("abcdef") * r.randint(1, 3) if r.random() < 0.1 else w for w in x]
        cut = r.randint(5, len(y))
        sets, maps = [], []
        for words, n in ((x, len(x)), (y, cut)):
            hashes = truncation._shingles(np.array([truncation.xxhash.xxh64_intdigest(w) for w in words], np.uint64))
            m, distinct = truncation._shingle_maps(hashes, [n - 4])
            sets.append({tuple(words[i : i + 5]) for i in range(n - 4)})
            maps.append([int(v) & (2**64 - 1) for v in m[0]])
            assert distinct[0] == len(sets[-1])
        for a, b in ((0, 1), (1, 0)):
            assert sum((v & ~w).bit_count() for v, w in zip(maps[a], maps[b])) <= len(sets[a] - sets[b])
