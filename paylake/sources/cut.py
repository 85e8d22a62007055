"""Cutting: one namespace-aware pass over each document gives a row per segment with its raw text
and the text of its declared fields.

This is the one step that Spark's XML functions cannot express (they match prefixes, not namespace
URIs), so it is an Arrow-batched Python function: documents in, segments out, nothing shuffled. The
plan is pushed into it by hand: only declared kinds and fields are kept. A document is one row and is
parsed by one task; a partition's documents are parsed one after another, and segments leave in
bounded batches. For single documents too large for that, see ``rows_of_tag``.

Defined results: an ill-formed document gives the segments closed before the fault and one row with
kind null, seg_id -1 and the fault; a null or empty document is ill-formed. Elements inside a segment
never start another one. Of kinds with equal paths the first declared wins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAX_REPEATED, REPEATED, Schema
from .columns import Columns

CUT_DDL = "seg_id int, kind string, raw string, vals array<array<string>>, fault struct<code:string,message:string,line:int,column:int,context:string>, is_last boolean, tag string"
BATCH_ROWS, BATCH_BYTES, BATCH_DOCS = 4096, 16 << 20, 1024
FEW_DOCS = 16  # of a slice, for which arrays do not pay
SLICE_BYTES = 1 << 19  # of documents that are cut together; their arrays stay in a core's cache
_TAG = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")


class _Node:
    """A step of the declared paths."""

    __slots__ = ("next", "kind", "fields", "attributes")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.kind: int | None = None
        self.fields: list[int] = []  # of the element's text; last declared first
        self.attributes: list[tuple[str, int]] = []


def compile_schema(schema: Schema) -> tuple[_Node, list[tuple[str, _Node, list[bool]]]]:
    """The tree of segment paths, and for each kind its name, the tree of its fields below its own
    root, and which of them repeat."""
    top, kinds = _Node(), []
    for n, s in enumerate(schema.segments):
        path, fields = schema.paths[s.name]
        node = top
        for step in path.steps:
            node = node.next.setdefault(step, _Node())
        if node.kind is None:
            node.kind = n
        own = _Node()
        for k, p in enumerate(fields):
            node = own
            for step in p.steps[1:]:
                node = node.next.setdefault(step, _Node())
            if p.attribute:
                node.attributes.append((p.attribute, k))
            else:
                node.fields.insert(0, k)
        kinds.append((s.name, own, [f.cardinality == REPEATED for f in s.fields]))
    return top, kinds


def context_of(content: bytes, line: int) -> str:
    """The line of a fault between its neighbours."""
    lines = content.split(b"\n")
    return b"\n".join(lines[max(0, line - 2) : line + 1]).decode("utf-8", "replace")[:2000]


class Cutter:
    """Cuts one document at a time."""

    def __init__(self, top: _Node, kinds: list[tuple[str, _Node, list[bool]]], is_text: bool = False):
        self.top, self.kinds, self.is_text = top, kinds, is_text  # is_text: UTF-8 whatever a document declares

    def cut(self, content: bytes | None) -> Iterator[tuple]:
        """(seg_id, kind, raw, vals, fault, is_last, tag) rows. ``tag`` is the segment's open tag with the namespaces that
        it inherits, so tag and raw together are a document of their own."""
        content, is_text = content or b"", self.is_text
        if content[:2] in (b"\xff\xfe", b"\xfe\xff"):  # two bytes a character: places are found in UTF-8
            content, is_text = content.decode("utf-16", "replace").encode(), True
        for n, (kind, vals, start, a, z, inherited, encoding, fault, last) in enumerate(self.places(content, is_text)):
            if fault:
                yield -1, None, None, None, fault, None, None
                continue
            own = content[start:a].decode(encoding, "replace")
            yield n, kind, content[a:z].decode(encoding, "replace"), vals, None, last, with_namespaces(own, inherited)

    def places(self, content: bytes, is_text: bool) -> Iterator[tuple]:
        """(kind, vals, start of the open tag, its end, end of the close tag, inherited namespaces, encoding, fault, is_last)."""
        found: list[tuple] = []
        p = expat.ParserCreate("utf-8" if is_text else None, namespace_separator="}")
        p.buffer_text = True
        encoding = "utf-8"
        scope: dict[str | None, list[str]] = {}  # namespaces by prefix, innermost last
        fresh: set[str | None] = set()  # prefixes that the element to be opened declares
        inherited = ""
        above: list[_Node | None] = [self.top]  # of the open elements outside segments
        inside: list[_Node | None] = []  # of the open elements of the segment
        kind, start, vals, texts = -1, 0, [], []
        repeats: list[bool] = []

        def declared(version, name, standalone):
            nonlocal encoding
            encoding = encoding if is_text else name or encoding

        def bound(prefix, uri):
            scope.setdefault(prefix, []).append(uri or "")
            fresh.add(prefix)

        def unbound(prefix):
            scope[prefix].pop()
            if not scope[prefix]:
                del scope[prefix]

        def attributes(node, attrs):
            for name, k in node.attributes:
                if not vals[k] and name in attrs:
                    vals[k].append(attrs[name])

        def opened(name, attrs):
            nonlocal kind, start, vals, repeats, inherited
            if inside:
                if fresh:  # what an element inside declares is not the next segment's own
                    fresh.clear()
                node = inside[-1] and inside[-1].next.get(name)
                inside.append(node)
                if node:
                    attributes(node, attrs)
                    if node.fields:
                        texts.append([])
                        p.CharacterDataHandler = text
                return
            node = above[-1] and above[-1].next.get(name)
            above.append(node)
            if node and node.kind is not None:
                mine = ((f" xmlns:{x}" if x else " xmlns", u[-1]) for x, u in scope.items() if u and x not in fresh)
                inherited = "".join(f"{x}={quoteattr(u)}" for x, u in mine)
                kind, start = node.kind, p.CurrentByteIndex
                _, own, repeats = self.kinds[kind]
                vals = [[] for _ in repeats]
                inside.append(own)
                attributes(own, attrs)
                if own.fields:
                    texts.append([])
                    p.CharacterDataHandler = text
            if fresh:
                fresh.clear()

        def text(data):
            # only of the innermost open element, and only if it is a field
            if inside[-1] and inside[-1].fields:
                texts[-1].append(data)

        def closed(name):
            nonlocal kind
            if not inside:
                above.pop()
                return
            node = inside.pop()
            if node and node.fields:
                value = "".join(texts.pop())
                if not texts:
                    p.CharacterDataHandler = None
                for k in node.fields:
                    if repeats[k] or not vals[k]:
                        if len(vals[k]) < MAX_REPEATED:
                            vals[k].append(value)
                        break
            if not inside:
                above.pop()
                tag = _TAG.match(content, start)
                a = tag.end() if tag else start
                z = a if content[a - 2 : a] == b"/>" else content.find(b">", p.CurrentByteIndex) + 1
                found.append((self.kinds[kind][0], vals, start, a, z, inherited, encoding))
                kind = -1

        p.XmlDeclHandler, p.StartElementHandler, p.EndElementHandler = declared, opened, closed
        p.StartNamespaceDeclHandler, p.EndNamespaceDeclHandler = bound, unbound
        fault, at, held = None, 0, None
        while not fault and (at < len(content) or not at):
            fault = parsed(p, content, at)
            at += 1 << 20
            for one in found:  # one is held back until the next is known
                if held:
                    yield *held, None, False
                held = one
            found.clear()
        if held:
            yield *held, None, True
        if fault:
            yield None, None, 0, 0, 0, "", "", fault, None


def parsed(p, content: bytes, at: int) -> dict | None:
    """Gives the parser the next part of a document; its fault, if it has one."""
    try:
        p.Parse(content[at : at + (1 << 20)], at + (1 << 20) >= len(content))
    except (expat.ExpatError, LookupError, ValueError) as e:
        line = getattr(e, "lineno", p.CurrentLineNumber)
        code = "syntax_error" if content.strip() else "xml_empty"
        return {"code": code, "message": str(e), "line": line, "column": getattr(e, "offset", 0), "context": context_of(content, line)}
    return None


def with_namespaces(tag: str, inherited: str) -> str:
    end = -2 if tag.endswith("/>") else -1
    return tag[:end] + inherited + tag[end:]


#: A text between two tags, with the end of the tag before it, or the value of an attribute with its quotes. What follows tells one from the other.
_SLOT = re.compile(r"""(>[^<]+(?=<)|"[^"<]*"(?=[\s/>])|'[^'<]*'(?=[\s/>]))""", re.A)
_DECLARATION = re.compile(r"""<\?xml\s+version\s*=\s*(?:"1\.0"|'1\.0')(?:\s+encoding\s*=\s*(?:"[Uu][Tt][Ff]-8"|'[Uu][Tt][Ff]-8'))?\s*\?>""")
_NAMESPACE = re.compile(r"xmlns[^\s=]*\s*=\s*$")
_NAME = re.compile(r"<([^\s/>]+)")
_TAG_TEXT = re.compile(_TAG.pattern.decode())
_MARK = re.compile("\x7f([0-9]+)\x7f")
_CONTROLS = bytes(k for k in range(32) if k not in (9, 10))


class _Part:
    """What the markup of a part of a document says of its segments. ``pieces``: the part's markup and its slots in turn."""

    __slots__ = ("faulty", "broken", "after", "n", "kinds", "fields", "lengths", "get", "sources", "joins", "attributes", "places", "closers", "size")

    def __init__(self, cutter: Cutter, before: str, pieces: list[str], fixed: list[int], last: bool):
        # the part with a mark in each slot goes through the cutter; the marks tell where values come from
        marked = [x if k % 2 == 0 or k in fixed else f">\x7f{k}\x7f" if x[0] == ">" else f"{x[0]}\x7f{k}\x7f{x[0]}" for k, x in enumerate(pieces)]
        coded = [x.encode() for x in marked]
        head = len(before.encode())
        starts = [head, *(head + n for n in accumulate(map(len, coded)))]

        def place(at: int) -> tuple[int, int]:
            k = bisect_right(starts, at, hi=len(coded)) - 1
            return k, len(coded[k][: at - starts[k]].decode())

        text = before + "".join(marked)
        above = open_tags(text)
        self.after = "".join(above) or ("<r/>" if "<" in text else "")
        # between parts, the elements that are open are closed for the parser
        content = text.encode() if last else (text + "".join(f"</{_NAME.match(x)[1]}>" for x in reversed(above))).encode()
        segments = list(cutter.places(content, True))
        self.faulty = bool(segments and segments[-1][7])
        segments = segments[: len(segments) - self.faulty]
        self.broken = any(x[2] < head or x[4] > starts[-1] for x in segments)  # a segment goes on beyond the part
        self.n, self.kinds = len(segments), [x[0] for x in segments]
        self.fields = [len(x[1]) for x in segments]
        self.lengths = [len(v) for x in segments for v in x[1]]
        sources = [[int(k) for k in _MARK.findall(v)] for x in segments for vs in x[1] for v in vs]
        # an empty text is the last piece, which is added to the part's own
        self.get = itemgetter(-1, -1, *[k[0] if k else -1 for k in sources])
        self.sources = [k[0] if k else -1 for k in sources]
        self.joins = [(k, own) for k, own in enumerate(sources) if len(own) > 1]
        self.attributes = [k for k, own in enumerate(sources) if own and pieces[own[0]][0] != ">"]
        self.places = [] if self.broken else [(*place(x[2]), *place(x[3]), *place(x[4]), x[5]) for x in segments]
        self.closers = {content[content.rfind(b"<", 0, x[4]) : x[4]].decode() for x in segments if content[x[4] - 2 : x[4]] != b"/>"}
        self.size = sum(map(len, pieces[::2])) + 64 * len(pieces) + 300 * len(segments) + 500


def open_tags(text: str) -> list[str]:
    """The tags that are open at the end of a part, without the values that are marked."""
    above: list[str] = []
    for tag in _TAG_TEXT.findall(text):
        if tag[1] == "/":
            if above:
                above.pop()
        elif tag[-2] != "/":
            above.append(_MARK.sub("", tag))
    return above


class _Template:
    """A part's markup with places for its values. Each step is a literal, which ends with the first character of a slot, its
    length, and what ends the slot. Values that stayed as they were for ``SAME`` matches become literals of ``folded``."""

    __slots__ = ("part", "last", "pieces", "slots", "steps", "end", "folded", "seen", "count", "misses", "number")
    SAME, MISSES = 32, 64

    def __init__(self, part: _Part, last: bool, pieces: list[str], slots: list[int], base: _Template | None = None):
        self.part, self.last, self.pieces, self.slots = part, last, pieces, slots
        self.steps, lit, own = [], [], set(slots)
        for k, x in enumerate(pieces):
            lit.append(x[0] if k in own else x)
            if k in own:
                one, to = "".join(lit), "<" if x[0] == ">" else x[0]
                self.steps.append((one, len(one), to))
                lit = [] if to == "<" else [to]
        self.end = "".join(lit)
        self.folded: _Template | None = None
        self.seen, self.count, self.misses = None, -1 if base else 0, 0
        self.number = -1  # among the templates that ``_Known`` has seen

    def take(self, text: str, at: int) -> tuple[_Template, int, list[str]] | None:
        """``match``, with the values first that are expected."""
        if self.folded is None:
            return self.match(text, at)
        if (found := self.folded.match(text, at)) or not (found := self.match(text, at)):
            return found
        self.misses += 1
        if self.misses > self.MISSES:  # other values are the same now
            self.folded, self.seen, self.count, self.misses = None, None, 0, 0
        return found

    def match(self, text: str, at: int) -> tuple[_Template, int, list[str]] | None:
        """The template, where the part ends that begins at ``at``, and the values of its slots."""
        values = []
        starts, find = text.startswith, text.find
        for lit, size, to in self.steps:
            if not starts(lit, at):
                return None
            at += size
            z = find(to, at)
            if z <= at and (z < 0 or to == "<"):
                return None
            value = text[at:z]
            if to != "<" and "<" in value:
                return None
            values.append(value)
            at = z
        if not starts(self.end, at):
            return None
        at += len(self.end)
        if self.last and at != len(text):
            return None
        if self.count >= 0:
            self.compare(values)
        return self, at, values

    def compare(self, values: list[str]) -> None:
        self.seen = [a if a == b else None for a, b in zip(self.seen, values)] if self.seen else values
        self.count += 1
        if self.count == self.SAME:
            self.count = -1
            pieces = self.filled([(v or "") for v in self.seen])
            slots = [k for k, v in zip(self.slots, self.seen) if v is None]
            if len(slots) < len(self.slots):
                self.folded = _Template(self.part, self.last, pieces, slots, self)

    def filled(self, values: list[str]) -> list[str]:
        """The pieces of a part with these values."""
        pieces = self.pieces.copy()
        for k, v in zip(self.slots, values):
            q = pieces[k][0]
            pieces[k] = q + v if q == ">" else q + v + q
        return pieces


class Shapes:
    """Cuts documents by their markup. A document is taken in parts, each up to the end of a segment. Parts of one markup (its
    namespaces included) below the same open tags have the same segments and the same places of values, so the parser sees one
    of each. Texts and values of attributes cannot change this, since what could (references, comments, CDATA, instructions,
    control characters, line ends to be changed, other encodings) leaves a document to the parser; so does its size, beyond
    ``MOST_BYTES``.

    Parts that were met become templates. A document is first followed along them, each literal compared at once and each value
    taken up to its end; only one that no template goes on with is split at all its slots."""

    MOST_BYTES, MOST_KNOWN, MOST_CLOSERS, TRIALS = 8 << 20, 32 << 20, 16, 4096
    MOST_TEMPLATES, WINDOW, LESSONS = 256, 1024, 96

    def __init__(self, cutter: Cutter):
        self.cutter, self.known, self.size = cutter, {}, 0
        self.learned: list[_Template] = []
        # by the tags that are open before them: those up to a close tag by the number of tags before it, and the last of documents
        self.below: dict[str, tuple[dict[str, dict[int, list[_Template]]], list[_Template]]] = {}
        self.template_bytes = 0
        self.followed = self.met = self.lessons = self.rest = 0
        self.closers: list[str] = []  # close tags of segments as they were met
        self.text, self.ends = "", []  # of the document followed last, and where its parts end
        self.tried = self.hits = self.skip = 0

    def of(self, content: bytes, clean: bool) -> tuple[list[tuple[str, list[str], _Part]], dict | None] | None:
        """The parts of a document (text, pieces, what they say) and its fault; None if it is one for the parser. ``clean``: it
        is known to have no control characters."""
        if self.skip:  # few documents share their markup
            self.skip -= 1
            return None
        text = self.text_of(content, clean)
        if text is None:
            return None
        known = self.follow(content, text)
        return (self.parts(known[0]), known[1]) if known else self.split(content, text)

    @staticmethod
    def parts(steps: list[tuple[_Template, list[str]]]) -> list[tuple[str, list[str], _Part]]:
        filled = [(t, t.filled(values)) for t, values in steps]
        return [("".join(pieces), pieces, t.part) for t, pieces in filled]

    def quick(self, content: bytes | None, clean: bool) -> tuple[list | None, list | None, dict | None] | None:
        """A document along templates: them and their values, None, and its fault; or, if a lesson can still be taken from it,
        None and what ``of`` says."""
        if self.rest:
            self.rest -= 1
            return None
        # of a clean document in ASCII only the values are looked at, since literals come from documents that were looked at
        text = content.decode() if clean and content and content.isascii() and len(content) <= self.MOST_BYTES else None
        if text is None:
            if (text := self.text_of(content, clean)) is None:
                return None
        elif declared := _DECLARATION.match(text):
            text = text[declared.end() :]
        self.met += 1
        out = None
        if known := self.follow(content, text):
            values = "".join(["".join(v) for _, v in known[0]])
            if "&" not in values and "]]" not in values:
                self.followed += 1
                out = known[0], None, known[1]
        elif self.lessons < self.LESSONS:
            self.lessons += 1
            if (text := self.text_of(content, clean)) is not None and (known := self.split(content, text)):
                out = None, *known
        if self.met == self.WINDOW:
            self.rest = 8 * self.WINDOW if self.followed * 2 < self.met else 0
            self.met = self.followed = self.lessons = 0
        return out

    def text_of(self, content: bytes, clean: bool) -> str | None:
        """A document without its declaration; None if it is one for the parser."""
        if not content or len(content) > self.MOST_BYTES or b"&" in content or b"<!" in content or b"]]>" in content:
            return None
        if not clean and len(content.translate(None, _CONTROLS)) < len(content):
            return None
        try:
            text = content.decode()
        except UnicodeDecodeError:
            return None
        if declared := _DECLARATION.match(text):
            text = text[declared.end() :]
        if "<?" in text or not text.isascii() and (text[:1] == "\ufeff" or "\ufffe" in text or "\uffff" in text):
            return None
        return text

    def follow(self, content: bytes, text: str) -> tuple[list[tuple[_Template, list[str]]], dict | None] | None:
        """The templates that a document consists of and their values, and its fault; None where no template goes on."""
        out, at, before = [], 0, ""
        self.text, self.ends = text, []
        while known := self.below.get(before):
            found = None
            for close, by in known[0].items():
                if (z := text.find(close, at)) >= 0:
                    for t in by.get(text.count("<", at, z), ()):
                        if found := t.take(text, at):
                            break
                    if found:
                        break
            else:
                for n, t in enumerate(known[1]):
                    if found := t.take(text, at):
                        known[1].insert(0, known[1].pop(n))
                        break
            if not found:
                return None
            of, at, values = found
            out.append((of, values))
            self.ends.append(at)
            if t.part.faulty:
                fault = self.fault(content)
                return (out, fault) if fault else None
            if t.last:
                return out, None
            before = t.part.after
        return None

    def split(self, content: bytes, text: str) -> tuple[list[tuple[str, list[str], _Part]], dict | None] | None:
        """A document split at all its slots, part by part; the parts become templates."""
        for c in self.closers:
            text = text.replace(c, c + "\0")
        texts = text.split("\0")
        out, before, most = [], "", len(texts) - 1
        for n, one in enumerate(texts):
            pieces = _SLOT.split(one)
            part = self.part(before, pieces, n == most)
            if part.broken:
                return None
            out.append((one, pieces, part))
            self.learn(before, pieces, part, n == most)
            if part.faulty:
                fault = self.fault(content)
                return (out, fault) if fault else None
            before = part.after
        return out, None

    def learn(self, before: str, pieces: list[str], part: _Part, last: bool) -> None:
        size = sum(map(len, pieces)) + 64 * len(pieces)
        if not last and pieces == [""] or len(self.learned) >= self.MOST_TEMPLATES or self.template_bytes + size > self.MOST_KNOWN // 4:
            return
        fixed = {k for k in range(1, len(pieces), 2) if pieces[k][0] != ">" and _NAMESPACE.search(pieces[k - 1])}
        slots = [k for k in range(1, len(pieces), 2) if k not in fixed]
        if any(t.part is part and t.last == last and t.slots == slots for t in self.learned):
            return
        t = _Template(part, last, list(pieces), slots)
        inner, lasts = self.below.setdefault(before, ({}, []))
        if last:
            lasts.append(t)
        else:
            tags = sum(lit.count("<") for lit, _, _ in t.steps) + t.end.count("<") - 1
            inner.setdefault(t.end[t.end.rfind("<") :], {}).setdefault(tags, []).append(t)
        self.learned.append(t)
        self.template_bytes += size

    def part(self, before: str, pieces: list[str], last: bool) -> _Part:
        key = before, last, "\0".join(pieces[::2])
        self.tried += 1
        if (at := self.known.get(key)) is None:
            fixed = [k + 1 for k in range(0, len(pieces) - 1, 2) if pieces[k + 1][0] != ">" and _NAMESPACE.search(pieces[k])]
            at = fixed, {}
            self.add(key, at, len(key[2]))
        fixed, parts = at
        names = tuple([pieces[k] for k in fixed]) if fixed else ()
        if (part := parts.get(names)) is None:
            part = parts[names] = _Part(self.cutter, before, pieces, fixed, last)
            self.add(key, at, part.size + sum(map(len, names)))
            for c in part.closers:
                if len(self.closers) < self.MOST_CLOSERS and not any(c.endswith(x) or x.endswith(c) for x in self.closers):
                    self.closers.append(c)
        else:
            self.hits += 1
        if self.tried == self.TRIALS:
            self.skip = self.TRIALS if self.hits * 8 < self.tried else 0
            self.tried = self.hits = 0
        return part

    def add(self, key: tuple, at: tuple, size: int) -> None:
        if self.size + size > self.MOST_KNOWN:
            self.known.clear()
            self.size = 0
        self.known[key] = at
        self.size += size

    def fault(self, content: bytes) -> dict | None:
        """The fault of a document that is known to have one."""
        return fault_at(content)[0]


def fault_at(content: bytes) -> tuple[dict | None, int]:
    """The fault of a document in UTF-8, and its place."""
    p, fault, at = expat.ParserCreate("utf-8", namespace_separator="}"), None, 0
    while not fault and (at < len(content) or not at):
        fault = parsed(p, content, at)
        at += 1 << 20
    return fault, p.ErrorByteIndex


class _Rows:
    """Segments in columns, until they leave as a batch."""

    FAULT = pa.struct([("code", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("context", pa.string())])

    def __init__(self, raw: bool):
        self.with_raw, self.n, self.size = raw, 0, 0
        self.docs, self.counts = [], []  # a document and the number of its rows
        self.ids, self.kinds, self.lasts, self.fields, self.lengths, self.texts = [], [], [], [], [], []  # texts: each after a ">"
        self.raws, self.tags, self.faults = [], [], []

    def row(self, doc: int, seg: tuple) -> None:
        """A segment as the parser gives it."""
        seg_id, kind, raw, vals, fault, last, tag = seg
        self.docs.append(doc)
        self.counts.append(1)
        self.ids.append(seg_id)
        self.kinds.append(kind)
        self.lasts.append(last)
        self.fields.append(-1 if vals is None else len(vals))
        for v in vals or ():
            self.lengths.append(len(v))
            self.texts.extend([">" + x for x in v])
        if self.with_raw:
            self.raws.append(raw)
            self.tags.append(tag)
        if fault:
            self.faults.append((self.n, fault))
        self.n += 1
        self.size += len(raw or "")

    def document(self, doc: int, parts: list[tuple[str, list[str], _Part]], fault: dict | None) -> None:
        """All segments of a document whose parts are known."""
        n = 0
        for text, pieces, s in parts:
            if not s.n:
                continue
            n += s.n
            self.kinds.extend(s.kinds)
            self.fields.extend(s.fields)
            self.lengths.extend(s.lengths)
            pieces.append(">")
            vals = s.get(pieces)[2:]
            if s.joins or s.attributes:
                vals = list(vals)
                for k, own in s.joins:
                    vals[k] = ">" + "".join([pieces[j][1:] for j in own])
                for k in s.attributes:
                    vals[k] = ">" + vals[k][1:-1].replace("\n", " ").replace("\t", " ")
            self.texts.extend(vals)
            if self.with_raw:
                starts = [0, *accumulate(map(len, pieces))]
                for k1, o1, k2, o2, k3, o3, inherited in s.places:
                    a = starts[k2] + o2
                    self.raws.append(text[a : starts[k3] + o3])
                    self.tags.append(with_namespaces(text[starts[k1] + o1 : a], inherited))
            self.size += len(text)
        if n:
            self.docs.append(doc)
            self.counts.append(n)
            self.ids.extend(range(n))
            self.lasts.extend([False] * (n - 1))
            self.lasts.append(True)
            self.n += n
        if fault:
            self.row(doc, (-1, None, None, None, fault, None, None))

    def batch(self, keep: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        rows = pa.array(np.repeat(self.docs, self.counts))
        offsets = _offsets
        texts = pc.utf8_slice_codeunits(pa.array(self.texts, pa.string()), 1)
        inner = pa.ListArray.from_arrays(offsets(self.lengths), texts)
        fields = np.array(self.fields, dtype=np.int64)
        vals = pa.ListArray.from_arrays(offsets(np.maximum(fields, 0)), inner, mask=pa.array(fields < 0))
        none = pa.nulls(self.n, pa.string())
        faults = [None] * self.n
        for k, fault in self.faults:
            faults[k] = fault
        cols = [pa.array(self.ids, pa.int32()), pa.array(self.kinds, pa.string()), pa.array(self.raws, pa.string()) if self.with_raw else none, vals, pa.array(faults, self.FAULT), pa.array(self.lasts, pa.bool_()), pa.array(self.tags, pa.string()) if self.with_raw else none]
        return pa.RecordBatch.from_arrays([*[c.take(rows) for c in keep], *cols], names=names)


class _Known:
    """Segments of documents along templates, until they leave as a batch: only values are held, row by row, and raw texts
    if ``raw``."""

    def __init__(self, raw: bool = False):
        self.raw, self.places = raw, []
        self.templates: list[_Template] = []
        self.pool: dict[str, int] = {"": 0}  # values that are part of a template, and the empty text
        self.tables: list[tuple[np.ndarray, ...]] = []
        self.clear()

    def clear(self) -> None:
        self.docs, self.counts, self.of, self.values, self.raws, self.tags = [], [], [], [], [], []

    def able(self, steps: list[tuple[_Template, list[str]]]) -> bool:
        """Numbers the templates of a document. Values of several pieces are left to ``_Rows``."""
        for t, _ in steps:
            if t.number < 0 and (t.part.joins or not self.add(t)):
                return False
        return True

    def add(self, t: _Template) -> bool:
        if len(self.templates) >= 2 * Shapes.MOST_TEMPLATES:
            return False
        t.number = len(self.templates)
        self.templates.append(t)
        own, places, part = {k: n for n, k in enumerate(t.slots)}, t.part.sources, t.part
        layout = []
        for k in places:
            if k in own:
                layout.append(own[k])
                continue
            x = t.pieces[k] if k >= 0 else ""
            text = x[1:] if x[:1] == ">" else x[1:-1].replace("\n", " ").replace("\t", " ")
            layout.append(-1 - self.pool.setdefault(text, len(self.pool)))
        kinds = [self.pool.setdefault(k, len(self.pool)) for k in part.kinds]
        self.tables.append(tuple(np.array(x, np.int64) for x in (layout, part.lengths, part.fields, kinds)))
        # a segment from before the first slot to after the last stands at fixed distances from the part's ends
        fixed, most = None, len(t.pieces) - 1
        if part.n == 1 and part.places[0][0] == part.places[0][2] == 0 and part.places[0][4] == most:
            _, o1, _, o2, _, o3, inherited = part.places[0]
            fixed = o2, len(t.pieces[most]) - o3, with_namespaces(t.pieces[0][o1:o2], inherited)
        self.places.append(fixed)
        return True

    def fragments(self, t: _Template, values: list[str], text: str, at: int, to: int) -> None:
        """Raw texts and tags of a part, from ``at`` to ``to`` of the text."""
        if fixed := self.places[t.number]:
            before, after, tag = fixed
            self.raws.append(text[at + before : to - after])
            self.tags.append(tag)
            return
        starts = list(accumulate(map(len, t.filled(values)), initial=at))
        for k1, o1, k2, o2, k3, o3, inherited in t.part.places:
            a = starts[k2] + o2
            self.raws.append(text[a : starts[k3] + o3])
            self.tags.append(with_namespaces(text[starts[k1] + o1 : a], inherited))

    def document(self, doc: int, steps: list[tuple[_Template, list[str]]], text: str, ends: list[int]) -> None:
        n = 0
        for number, (t, values) in enumerate(steps):
            if t.part.n:
                n += t.part.n
                if self.raw:
                    self.fragments(t, values, text, ends[number - 1] if number else 0, ends[number])
                self.of.append(t.number)
                if t.part.attributes:
                    values = [v if t.steps[k][2] == "<" else v.replace("\n", " ").replace("\t", " ") for k, v in enumerate(values)]
                self.values.extend(values)
        if n:
            self.docs.append(doc)
            self.counts.append(n)

    def rows(self) -> tuple:
        """What ``_batch_of`` takes."""
        of = np.array(self.of)
        n_values = np.array([len(t.slots) for t in self.templates])[of]
        layout, lengths, fields, kinds = (_ragged([x[k] for x in self.tables], of) for k in range(4))
        n_texts = np.array([len(x[0]) for x in self.tables])[of]
        first = np.repeat(np.cumsum(n_values) - n_values, n_texts)
        pick = np.where(layout >= 0, layout + first, len(self.values) - 1 - layout)
        texts = pa.array([*self.values, *self.pool], pa.string()).take(pa.array(pick))
        counts = np.array(self.counts)
        doc, ends = np.repeat(self.docs, counts), np.cumsum(counts)
        last = np.zeros(len(doc), bool)
        last[ends - 1] = True
        number = np.arange(len(doc)) - np.repeat(ends - counts, counts)
        return doc, number, pa.array(list(self.pool), pa.string()).take(pa.array(kinds)), fields, lengths, texts, last, *([pa.array(x, pa.string()) for x in (self.raws, self.tags)] if self.raw else (None, None))


def _ragged(tables: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """One table after another, as ``of`` names them."""
    sizes = np.array([len(t) for t in tables])
    starts, n = np.cumsum(sizes) - sizes, sizes[of]
    return np.concatenate(tables)[np.repeat(starts[of] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))


def _batch_of(rows: tuple, keep: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The segments that ``Columns`` has found."""
    doc, number, kinds, fields, lengths, texts, last, raws, tags = rows
    vals = pa.ListArray.from_arrays(_offsets(fields), pa.ListArray.from_arrays(_offsets(lengths), texts))
    at, none = pa.array(doc), pa.nulls(len(doc), pa.string())
    cols = [pa.array(number, pa.int32()), kinds, none if raws is None else raws, vals, pa.nulls(len(doc), _Rows.FAULT), pa.array(last), none if tags is None else tags]
    return pa.RecordBatch.from_arrays([*[c.take(at) for c in keep], *cols], names=names)


def flat_fields(schema: Schema) -> tuple[list[int], list[int]]:
    """Numbers of fields that some kind has once, and of those that some kind repeats."""
    all_ = [(k, f.cardinality == REPEATED) for s in schema.segments for k, f in enumerate(s.fields)]
    return sorted({k for k, repeated in all_ if not repeated}), sorted({k for k, repeated in all_ if repeated})


def _flat(b: pa.RecordBatch, at: int, singles: list[int], lists: list[int]) -> pa.RecordBatch:
    """A batch with its column ``at``, vals, as a column for each field."""
    vals = b.column(at)
    inner = vals.values
    texts, starts = inner.values, vals.offsets.to_numpy()
    places = inner.offsets.to_numpy()
    n, out = np.diff(starts), {}

    def field(k: int) -> tuple[np.ndarray, np.ndarray]:
        has = n > k
        return has, np.where(has, starts[:-1] + k, 0)

    for k in singles:
        has, row = field(k)
        if has.any():
            has = has & (places[row + 1] > places[row])
        out[f"_s{k}"] = texts.take(pa.array(np.where(has, places[row], 0), mask=~has)) if has.any() else pa.nulls(len(n), pa.string())
    for k in lists:
        has, row = field(k)
        out[f"_a{k}"] = inner.take(pa.array(row, mask=~has)) if has.any() else pa.nulls(len(n), inner.type)
    own = [c for c in range(b.num_columns) if c != at]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *out.values()], names=[*[b.schema.names[c] for c in own], *out])


def _slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Where to slice documents: at most ``BATCH_DOCS`` and ``most`` bytes, but one at least."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = min(int(np.searchsorted(ends, ends[at] + most, "right")) - 1, at + BATCH_DOCS, len(column))
        yield at, max(to, at + 1) - at
        at = max(to, at + 1)


def _clean(column: pa.Array) -> bool:
    """True if no document of a column has control characters besides tabs and line feeds."""
    if not len(column):
        return True
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return True
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.count_nonzero(data < 32) == np.count_nonzero(data == 9) + np.count_nonzero(data == 10)


def cut(docs: DataFrame, schema: Schema, keep: tuple[str, ...] = ("doc_ndx",), content: str = "content", raw: bool = True, flat: bool = False) -> DataFrame:
    """``docs`` (content: binary, or string whatever encoding it declares) -> a row per segment: the ``keep`` columns, seg_id,
    kind, raw, vals (texts of each field in order of declaration), fault, is_last and tag. Unless ``raw``, the columns raw
    and tag, by far the largest, are null.

    ``flat``: instead of vals, column _s<k> has the first text of a kind's k-th field and _a<k> all of them, where some kind
    repeats it. Nested lists are dear to take from Python and to store."""
    fields, compiled = [docs.schema[c] for c in keep], compile_schema(schema)
    out = T.StructType([*fields, *T._parse_datatype_string(CUT_DDL).fields])

    names, is_text = out.names, isinstance(docs.schema[content].dataType, T.StringType)
    singles, lists = flat_fields(schema)
    if flat:
        own = [f for f in out.fields if f.name != "vals"]
        out = T.StructType([*own, *[T.StructField(f"_s{k}", T.StringType()) for k in singles], *[T.StructField(f"_a{k}", T.ArrayType(T.StringType())) for k in lists]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(*compiled, is_text)
        shapes, columns, quick = Shapes(cutter), Columns(*compiled), _Known(raw)
        for whole in batches:
            documents = whole.column(whole.num_columns - 1)
            if pa.types.is_large_binary(documents.type):
                documents = documents.cast(pa.binary())
            for at, size in _slices(documents, 4 * SLICE_BYTES) if whole.num_rows else ():
                kept, texts = [c.slice(at, size) for c in whole.columns[:-1]], documents.slice(at, size)
                clean, rows, others = _clean(texts), _Rows(raw), []
                for doc, one in enumerate(texts.to_pylist()):
                    if (known := shapes.quick(one, clean)) is None:
                        others.append(doc)
                        continue
                    steps, parts, fault = known
                    if steps is not None and quick.able(steps):
                        quick.document(doc, steps, shapes.text, shapes.ends)
                        parts = []
                    rows.document(doc, parts if parts is not None else shapes.parts(steps), fault)
                    if rows.n >= BATCH_ROWS or rows.size >= BATCH_BYTES:
                        yield rows.batch(kept, names)
                        rows = _Rows(raw)
                if quick.docs:
                    yield _batch_of(quick.rows(), kept, names)
                quick.clear()
                left = pa.array(others, pa.int64())
                rest = texts.take(left)
                for at, size in _slices(rest) if others else ():
                    some, number = rest.slice(at, size), np.array(others[at : at + size])
                    one_by_one = np.arange(size)
                    if size > FEW_DOCS and some.nbytes <= Shapes.MOST_BYTES:
                        known, found, faults = columns.cut(some, lambda d: fault_at(some[int(d)].as_py()), raw)
                        one_by_one = np.flatnonzero(~known)
                        if found:
                            yield _batch_of((number[found[0]], *found[1:]), kept, names)
                        for doc, fault in faults:
                            rows.row(int(number[doc]), (-1, None, None, None, fault, None, None))
                    for k in map(int, one_by_one):
                        one, doc = some[k].as_py(), int(number[k])
                        known = shapes.of(one, clean)
                        if known:
                            rows.document(doc, *known)
                        else:
                            for seg in cutter.cut(one):
                                rows.row(doc, seg)
                                if rows.n >= BATCH_ROWS or rows.size >= BATCH_BYTES:
                                    yield rows.batch(kept, names)
                                    rows = _Rows(raw)
                        if rows.n >= BATCH_ROWS or rows.size >= BATCH_BYTES:
                            yield rows.batch(kept, names)
                            rows = _Rows(raw)
                if rows.n:
                    yield rows.batch(kept, names)

    def run_flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_flat(b, names.index("vals"), singles, lists) for b in run(batches))

    return docs.select(*keep, F.col(content).cast("binary")).mapInArrow(run_flat if flat else run, out)


def rows_of_tag(spark: SparkSession, path: str, tag: str, ddl: str) -> DataFrame:
    """The fast way for very large documents whose prefixes are known: Spark's own XML reader, which
    splits files. It matches local names of any namespace, so it is no substitute for ``cut``."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("ignoreSurroundingSpaces", "false").schema(ddl).load(path)
