"""Problem 9: text cut off by field limits or broken transfers.

Method: near-copies are found through min-hash banding over shingles of five words. A text may have been cut anywhere, and then most of
its original has no counterpart, so what is compared are beginnings: each text has a signature for its first 5, 20, 80, 320 ... words
and looks with the longest one that it fills among all those of the others. Verified pairs - similarity of 0.8 or more between the
text and the part of the other one up to the place where it ends - are aligned at the end of the shorter text: if the longer one goes
on inside the word or the sentence, the shorter one was cut; if its sentence ends there, it wasn't. This holds for texts that end
properly too: one that ends in "Dr." or a bracket may still be cut. What runs on without a near-copy is scored by the terminality of its
closing words, learned from the inside of all texts (contexts that no text ends with aren't counted): how often the last three, two or one words are followed by the end of a sentence or
line, against how often the text goes on. A last word that is no word of the corpus but begins one was cut. Lengths at which a source's
texts pile up without ending are its field limits: there, running text without an end is cut.

Texts are compared as distinct values, so copies cost nothing. One pass over them gives endings, contexts and signatures. A pair can only
align where the last words before the end of the shorter text stand inside the longer one, so the texts of a bucket are joined on these
words. Which words of a text can meet a shorter one's end is asked of a Bloom filter where the text is read, so that only those are
shuffled; the join after it is exact. The longest text of each continuation is verified first, since in a group of near-copies nearly any
one shows the cut; a text it doesn't settle is verified against every other one. Texts are joined only to pairs that can be alike: a bit map
of the shingles on either side tells how many the other one lacks at least, and no pair of similarity 0.8 fails it. Copies that stop at the
same word say nothing about each other and never pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypost.session import dropped, lean

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 10, 5, 0.8  # beginnings alike by 0.8 share one of the bands with a chance of 0.981, by 0.9 of 0.9999, by 0.3 of 0.02
GROWTH = 4  # ratio of the lengths of the beginnings compared
KNOWN = 3  # times a word or context must occur inside texts to count as evidence
TERMINAL = 0.08  # share of ends below which closing words are inside a sentence
TAIL = 6  # words before the last one that a near-copy must have in the same order; shorter texts have no near-copies
SHIFT = 0.25  # share of its words by which the end of a text may stand elsewhere in a near-copy
LIMIT_SHARE = 0.05  # share of a source's open-ended texts that one length needs to be a field limit
FLUSH = 2_000_000  # tokens whose contexts are counted before they are handed on
FILTER_BITS, FILTER_MOST = 16, 1 << 30  # bits of the Bloom filter for each entry, and in all; one that is too full lets more rows through to the join, never fewer
CHUNK = 512  # 64-bit words of the filter that are handed to the driver in one row
MAP = 256  # bits of a text's map of shingles

# Marks of a cut, and phrases that end in dots by habit.
MARKS = re.compile(r"(?:\s*(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\[?\(?(?:message |text )?(?:clipped|truncated|cut off|continued|more)\)?\]|�+|<more>))+\s*$", re.I)
HABIT = re.compile(r"(?:and so on|we shall see|and so forth|to be continued|etc)\s*$", re.I)

_END = re.compile(r"[.!?:;)\]}\"”»’'✓✗>]\s*$|[.!?]\s*(?::\)|:-\))\s*$|:\)\s*$")
_PHONE = re.compile(r"(?:p|t|tel|phone|fax|o|direct|cell)?[.:]?\s*(?:\+\d{1,3} ?)?(?:\d{1,2}[- ])?(?:\(\d{3}\) ?|\d{3}[-. ]?)\d{3}(?: - |[-. ]?)\d{4}(?:\s*(?:x|ext\.?)\s*\d+)?|\S*\s*\+44 \d{4} \d{6}", re.I)
_PHONE_HEAD = re.compile(r"(?:p|tel|phone|fax)[.:]?\s*[\d+(][\d+() .-]*(?:x|ext?\.?|ex)?", re.I)
_CSZ = re.compile(r"[A-Z][\w.' -]*, [A-Z]{2} \d{5}(?:-\d{4})?")
_CSZ_HEAD = re.compile(r"[A-Z][A-Za-z.' ]*,(?: [A-Z]{0,2}(?: \d{0,4})?)?")
_CLOSED = re.compile(r"(?:[^\w\s\"'(\[¿¡<$]+(?: ?\w+){0,2}(?: ?[^\w\s]+)?|.*\bto present|key: [a-z]{2,4}-\d{3,5}|.*#\d+[a-z]?|.*\b(?:suite|ste\.?|unit|box) \d+[a-z]?)", re.I)
_TOKEN = re.compile(r"\S+")
_CLOSERS = re.compile(r"(?:</?[A-Za-z][^<>]*>|[\"'”»’)\]}*_])+$")
_BLOCK_END = re.compile(r"</?(?:p|div|li|ul|ol|td|th|tr|table|h[1-6]|br|hr|body|html|blockquote|pre)\b[^<>]*>$", re.I)
_SHORTENED = re.compile(r"[\"'“«(\[{]*(?:[A-HJ-Z]|Dr|Drs|Mr|Mrs|Ms|Messrs|Prof|Rev|Hon|vs|e\.g|i\.e|c/o|attn)\.", re.I)
_NUMBERED = re.compile(r"[\"'“«(\[{]*(?:No|Nos|Fig|p|pp|vol|ch|sec|ste|apt|bldg|rm|ext|tel|ph|box)\.", re.I)


def _norm(token: str) -> str:
    return re.sub(r"\d", "0", token.lower().strip("\"'“”‘’()[]{}<>«»¿¡,;:.!?…*|"))


_C = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """One hash of each row of hashes, depending on their order."""
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(_C) + c
    return out ^ (out >> np.uint64(32))


def _key(words: list[str]) -> int:
    """_mixed() of a few words, as a signed number."""
    out = 0
    for w in words:
        out = ((out ^ (out >> 29)) * _C + xxhash.xxh64_intdigest(w)) & _MASK
    out ^= out >> 32
    return out - (1 << 64) if out >> 63 else out


def _bits(x: np.ndarray) -> np.ndarray:
    """The bits of an entry in its word of the filter."""
    one = np.uint64(1)
    return one << (x & np.uint64(63)) | one << ((x >> np.uint64(6)) & np.uint64(63)) | one << ((x >> np.uint64(12)) & np.uint64(63)) | one << (x >> np.uint64(58))


def _place(x: np.ndarray, words: int) -> np.ndarray:
    """The word of an entry in a filter of so many words, a power of two."""
    return ((x >> np.uint64(20)) & np.uint64(words - 1)).astype(np.int64)


def _may_hold(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the filter may hold x; False is certain."""
    b = _bits(x)
    return words[_place(x, len(words))] & b == b


def _filter_batches(words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of the filter whose entries are in this partition; their rows are disjoint from those of others."""
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, bits = _place(x, words), _bits(x)
            order = np.argsort(at, kind="stable")
            at, bits = at[order], bits[order]
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            for i, v in zip(at[starts].tolist(), np.bitwise_or.reduceat(bits, starts) if len(at) else bits):
                parts.setdefault(i // CHUNK, np.zeros(CHUNK, np.uint64))[i % CHUNK] |= v
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], names=["chunk", "bits"])

    return build


def _filter(entries: DataFrame) -> Broadcast:
    """A Bloom filter of the entries (x bigint)."""
    words = CHUNK
    most = entries.count() * FILTER_BITS
    while words * 64 < min(most, FILTER_MOST):
        words *= 2
    chunk = F.shiftright(F.col("x"), 20).bitwiseAND(words - 1)
    chunk = F.floor(chunk / CHUNK)
    held = np.zeros(words, np.uint64)
    for r in entries.select("x").repartition(chunk).mapInArrow(_filter_batches(words), "chunk bigint, bits binary").toLocalIterator():
        held[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] |= np.frombuffer(r["bits"], np.uint64)
    return entries.sparkSession.sparkContext.broadcast(held)


class Tokens:
    """Numbers tokens and holds, by number, the hashes of their forms - as they stand, lower case, normalised - and what they can end."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.norms: list[str] = []
        self.arrays: list[np.ndarray] = []

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's tokens."""
        ids, new = self.ids, []
        for t in set().union(*texts).difference(ids):
            ids[t] = len(ids)
            n = _norm(t)
            self.norms.append(n)
            new.append([xxhash.xxh64_intdigest(x) for x in (t, t.lower(), n)] + [n != "", t[-1] in ".!?…;:\"”)", t[-1] in ".!?…", *_closing(t)])
        cols = [np.array(c, np.uint64 if i < 3 else bool) for i, c in enumerate(list(zip(*new)) or [()] * 12)]
        self.arrays = [np.concatenate(x) for x in zip(self.arrays, cols)] if self.arrays else cols
        return [np.fromiter(map(ids.__getitem__, x), np.int64, len(x)) for x in texts]


class Contexts:
    """Counts, inside texts, how often words and two and three words in a row end a sentence or line, and how often the text goes on."""

    def __init__(self, tokens: Tokens, asked: np.ndarray | None = None):
        """asked: a filter of the contexts of two and three words to count; None for all."""
        self.tokens, self.asked, self.held, self.size = tokens, asked, [], 0

    def add(self, ids: np.ndarray, line: np.ndarray) -> None:
        """ids of one text's tokens and the number of each one's line."""
        self.held.append((ids, line + (self.held[-1][1][-1] + 1 if self.held else 0)))
        self.size += len(ids)

    def counted(self) -> pa.RecordBatch:
        ids, line = (np.concatenate(x) if self.held else np.zeros(0, np.int64) for x in (zip(*self.held) if self.held else ((), ())))
        last_of = np.array([x[1][-1] for x in self.held], np.int64)
        self.held, self.size = [], 0
        _, _, norm, there, ends, stops = self.tokens.arrays[:6] or [np.zeros(0, t) for t in (np.uint64,) * 3 + (bool,) * 3]
        final = np.append(line[1:] != line[:-1], True) if len(line) else np.zeros(0, bool)
        kept = there[ids] & ~(final & np.isin(line, last_of))  # the end of the text itself is no evidence
        end = ((ends[ids] | final) & kept)[kept]
        ids, line = ids[kept], line[kept]
        h, stop = norm[ids], stops[ids]
        two = line[1:] == line[:-1]
        three = two[1:] & two[:-1] & ~stop[1:-1]  # contexts of three don't reach over sentences
        keys = np.concatenate([_mixed(h[:-1], h[1:])[two], _mixed(h[:-2], h[1:-1], h[2:])[three]]) if len(h) > 2 else _mixed(h[:-1], h[1:])[two] if len(h) > 1 else h[:0]
        key_end = np.concatenate([end[1:][two], end[2:][three]]) if len(h) > 2 else end[1:][two] if len(h) > 1 else end[:0]
        if self.asked is not None:
            sel = _may_hold(self.asked, keys)
            keys, key_end = keys[sel], key_end[sel]
        keys, at = np.unique(keys, return_inverse=True)
        n, e = np.bincount(at, minlength=len(keys)), np.bincount(at, key_end, len(keys)).astype(np.int64)
        words, at = np.unique(ids, return_inverse=True)
        wn, we = np.bincount(at, minlength=len(words)), np.bincount(at, end, len(words)).astype(np.int64)
        none = len(words)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(keys.view(np.int64)), pa.nulls(none, pa.int64())]), pa.array([*[None] * len(keys), *[self.tokens.norms[i] for i in words]], pa.string()),
                pa.array(np.concatenate([e, we])), pa.array(np.concatenate([n - e, wn - we])),
            ], names=["key", "word", "ends", "goes"],
        )


def _tokens_of(text: str) -> tuple[list[str], np.ndarray]:
    """The tokens of a text and the number of each one's line."""
    lines = [x for line in re.split(r"[\r\n]+", text) if (x := line.split())]
    return [t for x in lines for t in x], np.repeat(np.arange(len(lines)), [len(x) for x in lines])


_MARK_ROOM = 400


def _marked(text: str) -> int:
    """Where the marks of a cut at the end of text begin, or its length."""
    start = max(0, len(text) - _MARK_ROOM)
    m = MARKS.search(text, start)
    if m and m.start() == start and start:
        m = MARKS.search(text)
    return m.start() if m else len(text)


def ending(text: str | None) -> tuple[str, str, int, int]:
    """(state, last word, key of the last two words, key of the last three).

    state: 'none' (no text), 'done' (ends properly), 'cut' (inside a tag, after a comma or an opening mark, inside a phone number or
    postal line), 'line' (a line that isn't running text) or 'prose' (running text without an end).
    """
    if not text or not text.strip():
        return "none", "", 0, 0
    body = text[: _marked(text)].rstrip()
    if not body or HABIT.search(body[-40:]):
        return "done", "", 0, 0
    if "<" in body[-200:] and re.search(r"<[/!]?[A-Za-z]?[^<>]{0,200}$", body[-260:]):
        tail = body[body.rindex("<") :]
        if ">" not in tail and re.match(r"</?[a-z][^<>]*$|</?$", tail):
            return "cut", "", 0, 0
    line = body[max(body.rfind("\n"), body.rfind("\r")) + 1 :].strip()
    if _END.search(line) and not (line[-1] in "'’" and len(line) > 1 and line[-2] == " "):
        if not (line[-1] == ":" and re.fullmatch(r"(?:P|Tel|Phone|Key)\W*", line)) and not (line[-1] == ")" and _PHONE_HEAD.fullmatch(line)):
            return "done", "", 0, 0
    if line[-1] in ",(-–—&/¿¡\"“«[$" and not re.fullmatch(r"[-–—*_=]{2,}|.*\s-", line):
        return "cut", "", 0, 0
    tokens = _TOKEN.findall(line)
    if _PHONE.fullmatch(line) or _CSZ.fullmatch(line) or (_CLOSED.fullmatch(line) and len(tokens) <= 10):
        return "done", "", 0, 0
    if _PHONE_HEAD.fullmatch(line) or _CSZ_HEAD.fullmatch(line):
        return "cut", "", 0, 0
    words = [w for t in tokens[-3:] if (w := _norm(t))]
    if not words:
        return "done", "", 0, 0
    sentence = re.split(r"(?<=[.!?])\s+", re.sub(r"<[^<>]*>", " ", line))[-1].split()
    small = sum(t.islower() for t in sentence)
    state = "prose" if small >= 2 and small >= 0.4 * len(sentence) or len(tokens) > 5 and len(re.split(r"(?<=[a-z][.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡])", line)) > 1 else "line"
    broken = [t for t in tokens[-3:-1] if t[-1] in ".!?"]
    two = _key(words[-2:]) if len(words) > 1 else 0
    three = _key(words) if len(words) > 2 and not broken else 0
    return state, words[-1], two, three


_A = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(6).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def _shingles(h: np.ndarray) -> np.ndarray:
    """The hashes of five consecutive words, in their order; h: the words' hashes."""
    n = max(0, len(h) - SHINGLE + 1)
    return _mixed(*[h[i : i + n] for i in range(SHINGLE)])


def beginnings(n: int) -> list[int]:
    """The lengths of the beginnings that a text of n words is compared by."""
    out, k = [], SHINGLE
    while k <= n:
        out.append(k)
        k *= GROWTH
    return out


def bands(h: np.ndarray) -> np.ndarray:
    """Band hashes of a text's beginnings, the longest last: one for the first, whose one shingle is all, and BANDS for each other; h: the hashes of its words in lower case."""
    ks = beginnings(len(h))
    if not ks:
        return np.zeros(0, np.int64)
    s = _shingles(h[: ks[-1]])
    with np.errstate(over="ignore"):
        least = np.minimum.reduceat((s[:, None] * _A[None, :] + _B[None, :]) >> np.uint64(16), [0, *[k - SHINGLE + 1 for k in ks[:-1]]], axis=0)
    least = np.minimum.accumulate(least, axis=0).reshape(len(ks), BANDS, ROWS)
    which = np.arange(len(ks) * BANDS, dtype=np.uint64)
    return _mixed(which, *[least[:, :, i].reshape(-1) for i in range(ROWS)]).view(np.int64)[BANDS - 1 :]


_ENDS = "h bigint, state string, last string, two bigint, three bigint"
_PASS = "h bigint, bands array<bigint>, key bigint, word string, ends bigint, goes bigint"


def _ending_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ending of each text."""
    names = [x.split()[0] for x in _ENDS.split(", ")]
    for b in batches:
        rows = list(zip(*map(ending, b.column(1).to_pylist()))) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()))]], names=names)


def _pass_batches(asked: Broadcast):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text with its bands (h is not null), and rows with counts of words and of the contexts asked for."""
        tokens = Tokens()
        contexts = Contexts(tokens, asked.value)

        def counts() -> pa.RecordBatch:
            c = contexts.counted()
            return pa.RecordBatch.from_arrays([pa.nulls(c.num_rows, pa.int64()), pa.nulls(c.num_rows, pa.list_(pa.int64())), *c.columns], names=names)

        names = [x.split()[0] for x in _PASS.split(", ")]
        for b in batches:
            split, signed = [_tokens_of(t) for t in b.column(1).to_pylist()], []
            for ids, (_, line) in zip(tokens.numbers([x for x, _ in split]), split):
                signed.append(bands(tokens.arrays[1][ids]))
                if len(ids):
                    contexts.add(ids, line)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            if contexts.size > FLUSH:
                yield counts()
                tokens = Tokens()
                contexts = Contexts(tokens, asked.value)
        yield counts()

    return read


def aligned_end(short: str, long: str) -> str:
    """'cut' if long, a near-copy as far as short goes, goes on inside the word or sentence where short ends; 'end' if its sentence ends there; else ''."""
    s = short[: _marked(short)].split()
    if len(s) < TAIL + 2:
        return ""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(long)]
    t = [long[x:y] for x, y in spans]
    tail, last = s[-TAIL - 1 : -1], s[-1]
    reach = SHIFT * len(s) + 1
    at = [i + TAIL for i in range(len(t) - TAIL) if t[i] == tail[0] and abs(i + TAIL + 1 - len(s)) <= reach and t[i : i + TAIL] == tail and t[i + TAIL].startswith(last)]
    if not at:
        return ""
    i = min(at, key=lambda j: abs(j + 1 - len(s)))
    x, y = (set(zip(*[[w.lower() for w in words][k:] for k in range(SHINGLE)])) for words in (s[:-1], t[:i]))
    if len(x & y) < SIMILARITY * len(x | y):
        return ""
    there = t[i]
    if there == last:
        return _goes(long, spans, i)
    rest = there[len(last) :]
    return "end" if re.fullmatch(r"[.!?…:;)\"”]+", rest) or (rest[0] == "<" or last[-1] == ">") and _closed(last, rest.lstrip("<")) else "cut"


def _closing(token: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """What _closed() asks of a token: it closes by itself, it has a stop, it is a shortened or a numbered one; as the next word, it begins small or with a digit."""
    core = _CLOSERS.sub("", token)
    bare = token.lstrip("\"'“«([{")[:1]
    return (
        bool(_BLOCK_END.search(token) or re.search(r"[:;]-?\)$", token)), core[-1:] in set(".!?…"), bool(_SHORTENED.fullmatch(core)), bool(_NUMBERED.fullmatch(core)), bare.islower(), bare.isdigit()
    )


def _closed(last: str, follows: str) -> bool:
    """Whether last ends a sentence or block of markup where follows comes next; an abbreviation or initial doesn't."""
    alone, stop, short, numbered, _, _ = _closing(last)
    _, _, _, _, small, digit = _closing(follows)
    return alone or stop and not (small or short or digit and numbered)


def _goes(long: str, spans: list[tuple[int, int]], i: int) -> str:
    """'cut' if the sentence of long goes on after its word i, 'end' if it ends there; '' if long has no further word."""
    if i + 1 == len(spans):
        return ""
    (begin, end), (start, stop) = spans[i : i + 2]
    return "end" if "\n" in long[end:start] or _closed(long[begin:end], long[start:stop]) else "cut"


def _sought(band: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """What a text with this band looks for: the words before its end and how the last one begins (tail)."""
    with np.errstate(over="ignore"):
        x = (band ^ (band >> np.uint64(29))) * np.uint64(_C) + tail
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_C)
    return x ^ (x >> np.uint64(32))


def _initial(words: list[str]) -> np.ndarray:
    return np.fromiter((ord(w[0]) for w in words), np.uint64, len(words))


def _shingle_maps(s: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For the first so many of the shingles s: the map of their bits, as MAP / 64 numbers, and how many are distinct."""
    _, first = np.unique(s, return_index=True)
    at = np.full(MAP, len(s))
    slots = (s >> np.uint64(40)) % np.uint64(MAP)
    at[slots[::-1].astype(np.int64)] = np.arange(len(s))[::-1]  # where each bit is first set
    n = np.array(lengths, np.int64).reshape(-1, 1)
    return np.packbits(at[None, :] < n, axis=1).view(np.int64), np.searchsorted(np.sort(first), n[:, 0])


_MAPS = [f"b{i}" for i in range(MAP // 64)]
_TAIL = "h bigint, open boolean, last string, size int, tail bigint, n int, xs array<bigint>, " + ", ".join(f"{c} bigint" for c in _MAPS)
_INSIDE = "x0 bigint, there string, goes int, other bigint, at int, n_words int, n int, " + ", ".join(f"{c} bigint" for c in _MAPS)


def _tail_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each seeking text's last word, its number of words, what it looks for and the map of its shingles. Columns: h, open, text, its own bands."""
    names = [c.split()[0] for c in _TAIL.split(", ")]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        for h, open_, text, sought in zip(*(c.to_pylist() for c in b.columns)):
            s = text[: _marked(text)].split()
            if len(s) < TAIL + 2 or not sought:
                continue
            w = np.array([xxhash.xxh64_intdigest(x) for x in s[-TAIL - 1 : -1]], np.uint64).reshape(-1, 1)
            tail = _mixed(*w, _initial(s[-1:]))
            shingles = _shingles(np.array([xxhash.xxh64_intdigest(x.lower()) for x in s[:-1]], np.uint64))
            maps, n = _shingle_maps(shingles, [len(shingles)])
            xs = _sought(np.array(sought, np.int64).view(np.uint64), tail).view(np.int64).tolist()
            for c, v in zip(rows, (h, open_, s[-1], len(s), int(tail.view(np.int64)[0]), int(n[0]), xs, *maps[0].tolist())):
                c.append(v)
        kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * len(_MAPS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)


def _inside_batches(held: Broadcast):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word of a text that the end of a shorter one may meet: what that one looks for, the word, what follows it - nothing (0), more of
        its sentence (1) or another sentence or line (2) -, its place, and the map of the shingles before it. Columns: h, text, bands, the beginning of each."""
        names = [c.split()[0] for c in _INSIDE.split(", ")]
        words = held.value
        for b in batches:
            tokens = Tokens()
            split = [_tokens_of(t) for t in b.column(1).to_pylist()]
            numbers = tokens.numbers([x for x, _ in split])
            initial, out = _initial(list(tokens.ids)), []
            for h, ids, (_, line), sought, ks in zip(b.column(0).to_pylist(), numbers, split, b.column(2).to_pylist(), b.column(3).to_pylist()):
                n = len(ids) - TAIL
                if n <= 0:
                    continue
                w = tokens.arrays[0][ids]
                tail = _mixed(*[w[i : i + n] for i in range(TAIL)], initial[ids[TAIL:]])
                spots = np.flatnonzero(_may_hold(words, tail))
                if not len(spots):
                    continue
                band, begins = np.array(sought, np.int64).view(np.uint64), SHINGLE * float(GROWTH) ** np.array(ks)
                at = spots + TAIL + 1
                x = _sought(band[:, None], tail[spots][None, :])
                reached = (at >= begins[:, None] * (1 - SHIFT) - 1) & (at <= begins[:, None] * GROWTH * (1 + SHIFT) + 1)  # where a text with this beginning can end
                which, spot = np.nonzero(reached & _may_hold(words, x))
                if not len(spot):
                    continue
                met, back = np.unique(spot, return_inverse=True)
                maps, distinct = _shingle_maps(_shingles(tokens.arrays[1][ids]), [max(0, i - SHINGLE) for i in at[met].tolist()])
                alone, stop, short, numbered, small, digit = (x[ids] for x in tokens.arrays[6:])
                closed = alone[:-1] | (stop[:-1] & ~(small[1:] | short[:-1] | (digit[1:] & numbered[:-1])))
                goes = np.append(np.where(closed | (line[1:] != line[:-1]), 2, 1), 0)
                m, i = len(spot), at[spot] - 1
                out.append((x[which, spot].view(np.int64), ids[i], goes[i], np.full(m, h, np.int64), i + 1, np.full(m, len(ids)), distinct[back], *maps[back].T))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
            there = pa.array(list(tokens.ids), pa.string()).take(pa.array(cols[1]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), there, pa.array(cols[2], pa.int32()), pa.array(cols[3]), *[pa.array(c, pa.int32()) for c in cols[4:7]], *map(pa.array, cols[7:])], names=names)

    return read


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [aligned_end(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["h", "found"])


def _aligned(texts: DataFrame, signed: DataFrame, opens: DataFrame) -> DataFrame:
    """(h, found): the texts (h, text) that end where a near-copy goes on ('cut' if any goes on in mid-sentence, else 'end').

    signed: h and bands of each text; opens: its h and open. 'end' is told for open ones only, as it changes nothing about others. A text looks with the bands of its longest beginning among those of all beginnings.
    The files of texts and signed go when they have been read.
    """
    i, n = F.col("i"), F.col("n")
    k = F.floor((i + BANDS - 1) / BANDS).cast("int")  # one band for the first beginning
    each = signed.filter("size(bands) > 0").select("h", F.size("bands").alias("n"), F.posexplode("bands").alias("i", "band")).select("h", "band", k.alias("k"), (k == F.floor((n + BANDS - 2) / BANDS)).alias("seeks"))
    bucket = Window.partitionBy("band")
    each = each.withColumns({"m": F.count("*").over(bucket), "wanted": F.max("seeks").over(bucket)}).filter("m > 1 and wanted")
    each = lean(each.select("h", "band", "k", "seeks"), "buckets")
    dropped(signed)
    own = each.groupBy("h").agg(F.collect_list("band").alias("bands"), F.collect_list("k").alias("ks"), F.collect_list(F.when(F.col("seeks"), F.col("band"))).alias("own"))
    near = lean(texts.join(own.join(opens, "h"), "h"), "near")
    dropped(texts, each)
    tails = lean(near.select("h", "open", "text", "own").mapInArrow(_tail_batches, _TAIL), "tails")
    ends = tails.select("h", "last", "open", F.explode("xs").alias("x0"))
    held = _filter(ends.select(F.col("x0").alias("x")).unionAll(tails.select(F.col("tail").alias("x"))))
    inside = near.select("h", "text", "bands", "ks").mapInArrow(_inside_batches(held), _INSIDE)
    # a copy that stops at the same word says nothing, and one whose sentence ends there only something about open texts
    alike = F.col("there").startswith(F.col("last")) & ((F.col("there") != F.col("last")) | (F.col("goes") == 1) | (F.col("open") & (F.col("goes") == 2)))
    # what a text looks for: a beginning like its own, the words before its end, and its last word to start the word in that place
    sought = F.xxhash64("x0", "last", "open").alias("x")
    inside = inside.join(ends.select("x0", "last", "open").distinct(), "x0").filter(alike)
    inside = lean(inside.select(sought, F.xxhash64("there", "goes").alias("way"), "other", "at", "n_words", F.col("n").alias("m"), *[F.col(c).alias(f"o{c}") for c in _MAPS]), "inside")
    held.destroy()
    longest = inside.groupBy("x", "way").agg(F.max_by(F.struct("other", "at", "m", *[f"o{c}" for c in _MAPS]), F.struct("n_words", "other", "at")).alias("o")).select("x", "way", "o.*")
    longest = lean(longest, "longest")
    ends = ends.select("h", sought).join(longest.select("x").distinct(), "x", "left_semi")
    ends = lean(ends.join(tails.select("h", "size", "n", *_MAPS), "h"), "ends")
    dropped(tails)
    lacks = lambda a, b: sum((F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) for x, y in zip(a, b)), F.lit(0))
    theirs = [f"o{c}" for c in _MAPS]
    common = F.least(F.col("n") - lacks(_MAPS, theirs), F.col("m") - lacks(theirs, _MAPS))  # shingles that both can have, at most
    alike = (F.col("h") != F.col("other")) & (F.abs(F.col("at") - F.col("size")) <= SHIFT * F.col("size") + 1) & (common * (1 + SIMILARITY) >= SIMILARITY * (F.col("n") + F.col("m")) - 1e-6)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(alike).select("h", "other").distinct()
        pairs = pairs.join(near.select("h", "text"), "h").join(near.select(F.col("h").alias("other"), F.col("text").alias("long")), "other")
        pairs = pairs.select("h", "text", "long").mapInArrow(_pair_batches, "h bigint, found string")
        return lean(pairs.filter("found <> ''").groupBy("h").agg(F.min("found").alias("found")), "aligned")

    first = verified(ends.join(longest, "x"))
    rest = ends.join(first.filter("found = 'cut'"), "h", "left_anti")
    others = inside.join(longest.select("x", "way", "other", "at"), ["x", "way", "other", "at"], "left_anti")
    second = verified(rest.join(others, "x"))
    dropped(near, inside, longest, ends)
    return first.unionByName(second).groupBy("h").agg(F.min("found").alias("found"))


def judged(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, truncated boolean, reason): one row for each document.

    Null, empty and blank texts are not truncated. Documents with the same text get the same answer unless only one of their sources
    has a field limit there. An empty table gives no rows.
    """
    docs = df.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text", F.length("text")))  # 64 bits tell the distinct texts apart
    texts = lean(docs.filter("trim(text) <> ''").groupBy("h").agg(F.first("text").alias("text")), "texts")
    ends = lean(texts.mapInArrow(_ending_batches, _ENDS), "ends")
    open_ = ends.filter("state in ('prose', 'line')")
    asked = _filter(open_.select(F.explode(F.array("two", "three")).alias("x")).filter("x <> 0"))
    once = lean(texts.mapInArrow(_pass_batches(asked), _PASS), "pass")
    asked.destroy()

    counts = once.filter("h is null").groupBy("key", "word").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    counts = lean(counts, "contexts")
    by_key = counts.filter("key is not null").select("key", "ends", "goes")
    by_word = counts.filter(f"word is not null and ends + goes >= {KNOWN}").select("word", "ends", "goes")
    scored = open_
    for c, short in (("three", "3"), ("two", "2")):
        scored = scored.join(by_key.select(F.col("key").alias(c), F.col("ends").alias(f"e{short}"), F.col("goes").alias(f"g{short}")), c, "left")
    scored = scored.join(by_word.select(F.col("word").alias("last"), F.col("ends").alias("e1"), F.col("goes").alias("g1")), "last", "left")
    stems = by_word.filter("length(word) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("last")).distinct()
    scored = scored.join(stems.withColumn("stem", F.lit(True)), "last", "left")
    n = lambda c: F.coalesce(F.col(f"e{c}") + F.col(f"g{c}"), F.lit(0))
    rate = lambda c: F.col(f"e{c}") / n(c)
    score = F.when(n("3") >= KNOWN, rate("3")).when(n("2") >= KNOWN, rate("2")).when(n("1") >= KNOWN, F.greatest(rate("1"), F.lit(TERMINAL) / 2))
    scored = scored.select("h", "state", score.alias("score"), (F.col("e1").isNull() & F.col("stem").isNotNull()).alias("part"), (n("2") > 0).alias("seen"))

    aligned = _aligned(texts, once.filter("h is not null").select("h", "bands"), ends.select("h", F.col("state").isin("prose", "line").alias("open")))

    answers = lean(ends.select("h", F.col("state").alias("s")).join(scored.drop("state"), "h", "left").join(aligned, "h", "left"), "answers")
    sized = docs.select("id", "source", "h", F.length("text").alias("chars"), F.octet_length("text").alias("octets")).join(answers, "h", "left")
    dropped(ends, counts)
    sized = lean(sized, "sized")
    loose = sized.filter("s = 'prose'")
    total = loose.groupBy("source").agg(F.countDistinct("h").alias("all"))
    limits = [
        loose.groupBy("source", c).agg(F.countDistinct("h").alias("n")).join(total, "source").filter(f"n >= {KNOWN} and n >= {LIMIT_SHARE} * all").select("source", c, F.lit(True).alias(f"at_{c}"))
        for c in ("chars", "octets")
    ]
    full = sized.join(limits[0], ["source", "chars"], "left").join(limits[1], ["source", "octets"], "left")
    limit = F.coalesce(F.col("at_chars"), F.col("at_octets"), F.lit(False))
    prose, line = F.col("s") == "prose", F.col("s") == "line"
    reason = (
        F.when(F.col("s") == "cut", "broken mark").when(F.col("found") == "cut", "copy goes on").when(F.col("found") == "end", None)
        .when(prose & limit, "field limit").when((prose | line) & F.col("part"), "part of a word")
        .when(prose & (F.col("score") < TERMINAL), "closing words").when(line & limit & (F.col("score") < TERMINAL) & F.col("seen"), "field limit")
    )
    return full.select(F.col("id").alias(key), F.col("source").alias(source), reason.isNotNull().alias("truncated"), reason.alias("reason"), "s", "score", "part", "found", limit.alias("at_limit"))


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, truncated, reason): see judged()."""
    return judged(df, key, text, source).select(key, source, "truncated", "reason")


def truncation_rates(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, n_docs, n_truncated, share): how often each source truncates; a null source is a source of its own."""
    rows = truncated(df, key, text, source).groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if("truncated").alias("n_truncated"))
    return rows.withColumn("share", F.col("n_truncated") / F.col("n_docs"))
