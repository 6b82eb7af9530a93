"""Problem 5: quoted history and signatures in e-mails.

Method: a recursive layout grammar over the lines of a mail,

    message   := (authored | signature | history)*
    authored  := lines that are none of the others
    signature := (closing | delimiter | own name | disclaimer | device note) line*     up to the next history
    history   := heading quoted-message | heading rest | quoted-message
    heading   := "On ... wrote:" | From/Sent/To/Subject block | "Original message" rule | "Begin forwarded message:"
    quoted-message := message, one quoting level ('>' or '|') deeper
    rest      := message [answer]                   by the one the heading names
    answer    := authored, behind that one's signature and closed by the sender's name

The tree is serialised from the outermost message: its authored nodes are newly written. Where it has none, the sender may have written
below what is quoted without marks, so the rests are parsed and descended into, each with the name of its own writer, for an answer.
HTML is first turned into lines, block quotes into quoting levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.people import GIVEN

# Closing formulas, and how the lines of disclaimers and device notes begin.
CLOSINGS = (
    "thanks|thank you|thx|many thanks|thanks again|thanks in advance|thank you very much|best|best regards|kind regards|warm regards|regards|kindest regards|best wishes"
    "|sincerely|sincerely yours|yours sincerely|yours truly|respectfully|cordially|cheers|take care|saludos|un saludo|saludos cordiales|atentamente|gracias|muchas gracias|cordialmente|mit freundlichen grüßen"
)
DISCLAIMERS = (
    r"(?:confidentiality |legal |privacy )?(?:notice|disclaimer|warning)\s*:|this (?:e-?mail|message|communication|transmission)\b.*(?:confidential|privileged|intended|addressee|protected)"
    r"|the (?:sender|information|contents?)\b.*(?:liability|confidential|privileged|intended|transmi)|please consider\b.*\bprint|if you (?:have )?received this|este (?:mensaje|correo)\b.*confidencial"
)
DEVICES = r"sent (?:from|via|with|using) (?:my|the|a|an|outlook|yahoo|mail)\b|get (?:the|outlook|our) .{0,40}\b(?:app|ios|android|phone|tablets?)\b|enviado desde mi\b"

_CLOSING = re.compile(rf"(?:{CLOSINGS})\s*[,.!]?", re.I)
_TAIL = re.compile(rf"(?:{DISCLAIMERS}|{DEVICES})", re.I)
_RULE = re.compile(r"(?:-{2,3}|_{2,6}|\*{3,}|={3,}|~{3,}|—|–)")
_WROTE = re.compile(
    r"(?:(?:on|el|am|le|il)\b.{4,160}\b(?:wrote|escribió|schrieb|a écrit|ha scritto)|\S.{1,80}\b(?:wrote|escribió|schrieb)\s+(?:on|am|el)\s+\d.{4,30})\s*:", re.I
)
_OPENS = re.compile(r"(?:on|el|am|le|il)\b.{4,120}\d", re.I)
_ORIGINAL = re.compile(r"[-_ ]{2,}\s*(?:original message|forwarded message|mensaje original|mensaje reenviado|ursprüngliche nachricht)\s*[-_ ]{2,}|begin forwarded message\s*:", re.I)
_HEADER = re.compile(r"\*?(?:from|sent|date|to|cc|bcc|subject|reply-to|de|enviado|fecha|para|asunto|von|gesendet|an|betreff)\s*:\*?(?:\s|$)", re.I)
_FROM = re.compile(r"\*?(?:from|de|von)\s*:\*?(?:\s|$)", re.I)
_QUOTE = re.compile(r"\s*[>|]")


@dataclass
class Node:
    """A part of a mail: kind 'authored', 'signature' or 'history', with its lines (quoting of one level taken off).

    by: the writer that a history's heading names; rest: whether it is all that follows an unquoted heading.
    """

    kind: str
    lines: list[str] = field(default_factory=list)
    by: Signer | None = None
    rest: bool = False

    def children(self) -> list[Node]:
        """The parts of an earlier message."""
        return parse_layout(self.lines, self.by) if self.kind == "history" else []

    def answer(self, signer: Signer) -> list[str]:
        """What signer wrote below the message of a rest: the lines between that writer's signature and signer's own name."""
        if not (self.rest and signer.words) or self.by is None or self.by.words & signer.words:
            return []
        lines = self.lines
        stop = next((i for i, x in enumerate(lines) if x.strip() and (_QUOTE.match(x) or _heading(lines, i) > i)), len(lines))
        i = next((i for i in range(stop) if lines[i].strip() and _starts_signature(lines[i].strip(), self.by, False)), stop)
        while i < stop:  # the signature's paragraphs: a closing may stand apart from the name
            i = next((k for k in range(i, stop) if not lines[k].strip()), stop)
            k = _next(lines, i)
            if k >= stop or not _starts_signature(lines[k].strip(), self.by, False):
                break
            i = k
        end = next((k for k in range(i, stop) if (w := re.findall(r"[^\W\d_]+", lines[k].lower())) and len(w) <= 3 and not re.search(r"[\d@:;?!]", lines[k]) and signer.signs(w)), i)
        found = [x for x in lines[i:end] if x.strip()]
        while found and _CLOSING.fullmatch(found[-1].strip()):
            found.pop()
        return found


def _unquote(line: str) -> str:
    return re.sub(r"^\s*[>|] ?", "", line, count=1)


def _next(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i].strip():
        i += 1
    return i


def _heading(lines: list[str], i: int) -> int:
    """The index behind a heading that begins at line i, or i."""
    s = lines[i].strip()
    if s[-1] == ":" and (_WROTE.fullmatch(s) or _ORIGINAL.fullmatch(s)):
        j = i + 1
    elif _OPENS.match(s) and any(_WROTE.fullmatch(re.sub(r"\s+", " ", " ".join(x.strip() for x in lines[i:k]))) for k in (i + 2, i + 3) if k <= len(lines)):
        return i + 2 if lines[i + 1].strip().endswith(":") else i + 3
    elif _ORIGINAL.fullmatch(s) or re.fullmatch(r"_{8,}|-{8,}", s) and (k := _next(lines, i + 1)) < len(lines) and _FROM.match(lines[k].strip()):
        j = i + 1
    elif _FROM.match(s) and sum(bool(_HEADER.match(x.strip())) for x in lines[i + 1 : i + 5]) >= 2:
        j = i
    else:
        return i
    k = _next(lines, j)
    if k < len(lines) and _FROM.match(lines[k].strip()):
        while k < len(lines) and _HEADER.match(lines[k].strip()):
            k += 1
        return k
    return j


def _writer(heading: list[str]) -> Signer:
    """Whom a heading names as the writer of what follows."""
    said = next((m[0].split(":", 1)[1] for x in heading if (m := re.match(r"\s*\*?(?:from|de|von)\s*:.*", x, re.I))), "")
    if not said and (m := re.search(r"([^\d,<>:]+?)\s*(?:<[^<>]*>)?\s*(?:wrote|escribió|schrieb|a écrit|ha scritto)\b", " ".join(heading), re.I)):
        said = m[1]
    return Signer.of(said)


def written(nodes: list[Node], signer: Signer) -> list[str]:
    """The newly written lines of a message: its authored leaves, or else an answer below a rest, however deep the rest is nested."""
    out = [x for n in nodes if n.kind == "authored" for x in n.lines]
    while not out and (rest := next((n for n in nodes if n.rest), None)):
        out = rest.answer(signer)
        nodes = rest.children()
    return out


def _starts_signature(s: str, signer: Signer, first: bool) -> bool:
    if len(s) < 40 and _CLOSING.fullmatch(s):
        return True
    if s[0] in "-_*=~—–" and _RULE.fullmatch(s):
        return True
    if len(s) < 60 and signer.words and s[0].isalpha() and not (first and s.endswith(",")):
        words = re.findall(r"[^\W\d_]+", s.lower())
        if 0 < len(words) <= 3 and not re.search(r"[\d@:;?!,]", s.rstrip(",")) and signer.signs(words):
            return True
        if "," in s and (m := re.match(r"([^,]+),\s*(.+)", s)) and _CLOSING.fullmatch(m[1]) and (w := re.findall(r"[^\W\d_]+", m[2].lower())) and signer.signs(w):
            return True
    return len(s) > 11 and s[0].lower() in "cndtlpwisge" and bool(_TAIL.match(s))


def parse_layout(lines: list[str], signer: Signer | None = None) -> list[Node]:
    """The parts of a message in their order. signer: the sender, whose bare name is a signature."""
    nodes: list[Node] = []
    signed = False
    first = True
    i = 0
    while i < len(lines):
        line = lines[i]
        s = line.strip()
        if not s:
            i += 1
            continue
        if _QUOTE.match(line):
            j = i
            while j < len(lines) and (_QUOTE.match(lines[j]) or not lines[j].strip()):
                j += 1
            nodes.append(Node("history", [_unquote(x) for x in lines[i:j]]))
            i, signed = j, False
            continue
        if (j := _heading(lines, i)) > i:
            k = _next(lines, j)
            if k < len(lines) and _QUOTE.match(lines[k]):
                i = k  # what is quoted follows; new text may come behind it
            else:
                nodes.append(Node("history", lines[j:], _writer(lines[i:j]), rest=True))
                break
            signed = False
            continue
        if not signed and _starts_signature(s, signer or NOBODY, first):
            signed = True
            nodes.append(Node("signature"))
        if not signed and (not nodes or nodes[-1].kind != "authored"):
            nodes.append(Node("authored"))
        nodes[-1].lines.append(line)
        first = False
        i += 1
    return nodes


class _Lines(HTMLParser):
    BLOCKS = frozenset("p div br li tr table ul ol h1 h2 h3 h4 h5 h6 blockquote body hr section article header footer pre".split())
    HIDDEN = frozenset("style script title head template".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.now: list[str] = []
        self.depth = self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.out.append("> " * self.depth + text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.flush()
            self.depth += tag == "blockquote"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.flush()
            self.depth = max(0, self.depth - (tag == "blockquote"))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.now.append(data)


def html_lines(html: str) -> list[str]:
    """The visible lines of html, one for each paragraph, division or line break, block quotes marked by '> '."""
    p = _Lines()
    p.feed(html)
    p.close()
    p.flush()
    return p.out


@dataclass(frozen=True)
class Signer:
    """What is known of the sender's name: words, from the display name or else the mailbox, and the initials a mailbox shows."""

    words: frozenset[str] = frozenset()
    initials: frozenset[str] = frozenset()
    mailbox: bool = False

    @staticmethod
    def of(sender: str | None) -> Signer:
        shown = re.sub(r"<.*?>|\S+@\S+", " ", sender or "")
        if re.search(r"[A-Za-z]{2}", shown):
            return Signer(frozenset(w for w in re.findall(r"[^\W\d_]+", shown.lower()) if len(w) > 1))
        m = re.search(r"([^\s<>@]+)@", sender or "")
        parts = re.findall(r"[^\W\d_]+", m[1].split("+")[0].lower()) if m else []
        return Signer(frozenset(w for p in parts for w in (p, p[1:]) if len(w) > 2), frozenset(p[0] for p in parts), True)

    def signs(self, words: list[str]) -> bool:
        """Whether these words alone on a line are the sender's name."""
        if not self.mailbox:
            return any(w in self.words for w in words) and all(w in self.words or len(w) == 1 for w in words)
        return any(w in self.words for w in words) if len(words) > 1 else words[0] in self.words or words[0][0] in self.initials and words[0] in GIVEN


NOBODY = Signer()


def new_lines(text: str | None, html: str | None, sender: str | None) -> list[str]:
    """The distinct non-blank lines newly written by the sender, white space collapsed, in their order."""
    if text:
        lines = re.split(r"\r\n|\r|\n", text)
    elif html:
        lines = html_lines(html)
    else:
        return []
    out: dict[str, None] = {}
    signer = Signer.of(sender)
    for x in written(parse_layout(lines, signer), signer):
        if s := " ".join(x.split()):
            out[s] = None
    return list(out)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, lines = [], []
        for key, text, html, sender in zip(*(c.to_pylist() for c in b.columns)):
            for s in new_lines(text, html, sender):
                ids.append(key)
                lines.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(lines, pa.string())], names=["key", "line_text"])


def newly_written(df: DataFrame, key: str = "email_id") -> DataFrame:
    """(key, line_text): each distinct line that the sender newly wrote.

    Mails whose text and html are both null or empty, and mails that only quote, have no rows; a null sender only means that a
    bare name isn't taken for a signature. Reads key, text, html and sender; other columns are ignored. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col("text").cast("string"), F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.col("html")).alias("html"), "sender")
    return rows.mapInArrow(_batches, f"key {kind}, line_text string").withColumnRenamed("key", key)
