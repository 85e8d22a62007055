"""Cutting many documents at once, in arrays: tags are numbered, levels come from a running sum, and the declared paths are
followed level by level for all elements together.

Only plain documents are taken: no references, comments, CDATA, instructions or control characters, namespaces declared by the
root alone, fields without elements inside. Each distinct tag goes through the parser once, and every open tag has to meet its
close tag. Of others the caller is told that they are not known. A document whose only fault is a close tag of another name gives the
segments before it, if the parser finds its fault at that place.
"""

from __future__ import annotations

import re
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa

from ..schema import MAX_REPEATED

DECLARATION = re.compile(rb"""<\?xml\s+version\s*=\s*(?:"1\.0"|'1\.0')(?:\s+encoding\s*=\s*(?:"[Uu][Tt][Ff]-8"|'[Uu][Tt][Ff]-8'))?\s*\?>""")
_CLOSE = re.compile(rb"</([^\s/>]+)\s*>")
_OPEN = re.compile(rb"<([^\s/>]+)")
OPEN, CLOSE, EMPTY, PROLOG, BAD = range(5)
_STEP = np.array([1, -1, 0, 0, 0], np.int64)


class _Tag:
    """A distinct tag: what it does, and its name as written."""

    __slots__ = ("does", "name", "declares")

    def __init__(self, tag: bytes):
        self.does, self.name, self.declares = BAD, b"", b"xmlns" in tag
        if tag[:2] == b"<?":
            self.does = PROLOG if DECLARATION.fullmatch(tag) else BAD
        elif close := _CLOSE.fullmatch(tag):
            self.does, self.name = CLOSE, close[1]
        elif tag[:2] not in (b"</", b"<!") and (name := _OPEN.match(tag)):
            empty = tag[-2:] == b"/>"
            try:
                expat.ParserCreate("utf-8").Parse(tag if empty else tag + b"</" + name[1] + b">", True)
                self.does, self.name = EMPTY if empty else OPEN, name[1]
            except expat.ExpatError:
                pass


def _expanded(root: bytes, tag: bytes | None) -> tuple[str, dict[str, str], str] | None:
    """Name and attributes of a tag below a root (None: of the root), and the namespaces that it inherits; None if they are faulty."""
    seen, bound, close = [], [], lambda t: b"" if t[-2:] == b"/>" else b"</" + _OPEN.match(t)[1] + b">"
    p = expat.ParserCreate("utf-8", namespace_separator="}")
    p.StartElementHandler = lambda name, attrs: seen.append((name, attrs))
    p.StartNamespaceDeclHandler = lambda prefix, uri: bound.append((prefix, uri or ""))
    if tag is not None and root[-2:] == b"/>":
        return None
    try:
        p.Parse(root + (tag + close(tag) if tag is not None else b"") + close(root), True)
    except expat.ExpatError:
        return None
    inherited = "".join(f"{f' xmlns:{x}' if x else ' xmlns'}={quoteattr(u)}" for x, u in bound) if tag is not None else ""
    return *seen[-1], inherited


def _between(data: pa.Buffer, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of places that do not overlap, in ascending order; each is at twice its number."""
    offsets = np.empty(2 * len(starts) + 1, np.int32)
    offsets[:-1:2], offsets[1::2], offsets[-1] = starts, ends, ends[-1] if len(ends) else 0
    return pa.StringArray.from_buffers(2 * len(starts), pa.py_buffer(offsets), data)


class Columns:
    """Cuts slices of documents. ``top`` and ``kinds`` as ``compile_schema`` gives them."""

    MOST_TAGS, MOST_ROOTS, MOST_KNOWN = 1024, 8, 1 << 16

    def __init__(self, top, kinds):
        self.kinds = kinds
        # states: 0 is no declared path; children of a segment's root are those of its fields
        self.names: dict[str, int] = {}
        nodes, self.steps = [None, (top, -1)], []
        for n, at in enumerate(nodes):  # grows
            if at:
                node, kind = at
                inside = kinds[node.kind][1] if kind < 0 and node.kind is not None else node
                below = node.kind if kind < 0 and node.kind is not None else kind
                for name, child in inside.next.items():
                    self.steps.append((n, self.names.setdefault(name, len(self.names) + 1), len(nodes)))
                    nodes.append((child, below))
        self.kind = np.full(len(nodes), -1)
        self.field = np.full(len(nodes), -1)
        self.attributes: dict[int, list[tuple[str, int]]] = {}
        self.able = top.kind is None
        for n, at in enumerate(nodes[1:], 1):
            node, kind = at
            if kind < 0 and node.kind is not None:
                self.kind[n], node = node.kind, kinds[node.kind][1]
            elif kind < 0:
                continue
            self.able &= len(node.fields) < 2
            if node.fields:
                self.field[n] = node.fields[0]
            if node.attributes:
                self.attributes[n] = node.attributes
        self.next = np.zeros((len(nodes), len(self.names) + 1), np.int64)
        for a, name, b in self.steps:
            self.next[a, name] = b
        self.sizes = np.array([len(repeats) for _, _, repeats in kinds])
        most = max(self.sizes)
        self.limits = np.array([[MAX_REPEATED if k < len(r) and r[k] else 1 for k in range(most)] for _, _, r in kinds])
        self.kind_names = pa.array([name for name, _, _ in kinds], pa.string())
        self.tags: dict[bytes, _Tag] = {}
        self.below: dict[tuple[bytes, bytes | None], tuple | None] = {}

    def tag(self, text: bytes) -> _Tag:
        if (t := self.tags.get(text)) is None:
            if len(self.tags) > self.MOST_KNOWN:
                self.tags.clear()
            t = self.tags[text] = _Tag(text)
        return t

    def expanded(self, root: bytes, tag: bytes | None) -> tuple | None:
        key = root, tag
        if key not in self.below:
            if len(self.below) > self.MOST_KNOWN:
                self.below.clear()
            self.below[key] = _expanded(root, tag)
        return self.below[key]

    def cut(self, column: pa.Array, fault_at, raw: bool):
        """``column``: documents, binary, without offset of its own. (known, rows, faults): which documents are known; of their
        segments document, number, kind, lengths of fields, texts, is_last, raw and tag; and faults (document, fault).
        ``fault_at``: from a document to its fault and the place."""
        n_docs = len(column)
        known = np.zeros(n_docs, bool)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n_docs + 1].astype(np.int64)
        if not self.able or offsets[-1] == offsets[0]:
            return known, None, []
        buffer = column.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0])
        data = np.frombuffer(buffer, np.uint8)
        offsets -= offsets[0]
        lt, gt = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
        if not len(lt) or not len(gt):
            return known, None, []
        ok = np.ones(n_docs, bool)
        doc_of = lambda at: np.searchsorted(offsets, at, "right") - 1

        # bytes that leave a document to the parser
        if np.count_nonzero(data < 32) != np.count_nonzero(data == 9) + np.count_nonzero(data == 10):
            ok[doc_of(np.flatnonzero((data < 32) & (data != 9) & (data != 10)))] = False
        ok[doc_of(np.flatnonzero(data == 38))] = False
        ends = gt[(data[gt - 1] == 93) & (data[gt - 2] == 93)]
        ok[doc_of(ends)] = False
        if (data > 127).any():
            try:
                text = str(buffer, "utf-8")
                fine = not any(c in text for c in "\ufeff\ufffe\uffff") and not (data[offsets[:-1][np.diff(offsets) > 0]] & 0xC0 == 0x80).any()
            except UnicodeDecodeError:
                fine = False
            if not fine:
                ok[doc_of(np.flatnonzero(data > 127))] = False

        # tags, from each "<" to the first ">" after it
        if len(lt) == len(gt) and (lt < gt).all() and (gt[:-1] < lt[1:]).all():
            end = gt + 1
        else:
            at = np.searchsorted(gt, lt)
            end = gt[np.minimum(at, len(gt) - 1)] + 1
            wrong = (at == len(gt)) | (end > np.append(lt[1:], len(data)))
            ok[doc_of(lt[wrong])] = False
            end[wrong] = lt[wrong] + 1
        first = np.searchsorted(lt, offsets)
        if (end[np.maximum(first[1:] - 1, 0)] > offsets[1:]).any():  # a tag that its document does not end
            ok[end[np.maximum(first[1:] - 1, 0)] > offsets[1:]] = False
        ok &= np.diff(first) > 0
        tokens = _between(buffer, lt, end)  # a tag, and the text after it
        places = np.frombuffer(tokens.buffers()[1], np.int32)
        coded = pa.StringArray.from_buffers(2 * len(lt), pa.py_buffer(np.append(places[:-1], np.int32(len(data)))), buffer)
        tags = coded.cast(pa.binary(), safe=False).take(pa.array(np.arange(0, 2 * len(lt), 2))).dictionary_encode()
        if len(tags.dictionary) > self.MOST_TAGS:
            return known, None, []
        code, texts = tags.indices.to_numpy(zero_copy_only=False).astype(np.int64), tags.dictionary.to_pylist()
        kinds_of = [self.tag(t) for t in texts]
        does = np.array([t.does for t in kinds_of], np.int8)
        declares = np.array([t.declares for t in kinds_of])
        numbers: dict[bytes, int] = {}
        name = np.array([numbers.setdefault(t.name, len(numbers)) for t in kinds_of])
        counts = np.diff(first)
        doc = np.repeat(np.arange(n_docs), counts)
        do = does[code]
        ok[doc[do == BAD]] = False
        prolog = np.flatnonzero(do == PROLOG)
        ok[doc[prolog[lt[prolog] != offsets[doc[prolog]]]]] = False
        token = np.arange(len(lt))
        if len(prolog):
            keep = do != PROLOG
            token, code, doc, do = token[keep], code[keep], doc[keep], do[keep]
        counts = np.bincount(doc, minlength=n_docs)
        ok &= counts > 0
        tail = np.cumsum(counts)
        head = tail - counts
        some = np.flatnonzero(counts)
        # before the root, after it and after the declaration there are blanks only
        root_token, last_token = token[head[some]], token[tail[some] - 1]
        from_ = np.where(root_token > first[some], end[np.maximum(root_token - 1, 0)], offsets[some])
        whole = memoryview(buffer)
        around = zip(some.tolist(), from_.tolist(), lt[root_token].tolist(), end[last_token].tolist(), offsets[some + 1].tolist())
        ok[[d for d, a, b, c, e in around if bytes(whole[a:b]).strip(b" \t\n") or bytes(whole[c:e]).strip(b" \t\n")]] = False

        # levels; the root is the only element of the first
        step = _STEP[do]
        total = np.cumsum(step)
        base = np.zeros(n_docs, np.int64)
        base[some] = total[head[some]] - step[head[some]]
        level = total - base[doc] + (step <= 0)
        ok[doc[level < 1]] = False
        ok[some[total[tail[some] - 1] - base[some] != 0]] = False
        top = np.bincount(doc[level == 1], minlength=n_docs)
        alone = np.zeros(n_docs, bool)
        alone[some] = (counts[some] == 1) & (do[head[some]] == EMPTY)
        ends_root = np.zeros(n_docs, bool)
        ends_root[some] = (do[head[some]] == OPEN) & (level[tail[some] - 1] == 1) & (do[tail[some] - 1] == CLOSE)
        ok &= alone | (ends_root & (top == 2))
        ok[doc[(level > 1) & declares[code]]] = False
        ok[doc[level > 250]] = False
        level = np.clip(level, 0, 251).astype(np.uint8)

        # an open tag and the next tag of its level belong together
        order = np.argsort(level, kind="stable")
        partner = np.full(len(order), -1)
        partner[order[:-1]] = order[1:]
        opens = np.flatnonzero(do == OPEN)
        close = partner[opens]
        lost = (close < 0) | (do[close] != CLOSE) | (level[close] != level[opens]) | (doc[close] != doc[opens])
        ok[doc[opens[lost]]] = False
        other = ~lost & (name[code[close]] != name[code[opens]])
        stop = np.full(n_docs, len(order) + 1)
        np.minimum.at(stop, doc[opens[other]], close[other])
        closes = np.arange(len(order))
        closes[opens] = close

        # names below each root
        of_doc = np.zeros(n_docs, np.int64)
        roots, of_doc[some] = np.unique(code[head[some]], return_inverse=True)
        if len(roots) > self.MOST_ROOTS:
            return known, None, []
        is_open = (does == OPEN) | (does == EMPTY)
        names = np.full((len(roots), len(texts)), -1)
        root_names = np.full(len(roots), -1)
        entries: dict[tuple[int, int], tuple] = {}
        for r, c in enumerate(roots):
            if does[c] not in (OPEN, EMPTY):
                continue
            if own := self.expanded(texts[c], None):
                root_names[r], entries[r, -1] = self.names.get(own[0], 0), own
            for k in np.flatnonzero(is_open):
                if found := self.expanded(texts[c], texts[k]):
                    names[r, k], entries[r, k] = self.names.get(found[0], 0), found

        # paths, level by level
        state = np.zeros(len(order), np.int64)
        by_level = order[do[order] != CLOSE]
        bounds = np.searchsorted(level[by_level], np.arange(1, 253))
        above = None
        for n in range(251):
            mine = by_level[bounds[n] : bounds[n + 1]]
            if not len(mine):
                break
            root_of = of_doc[doc[mine]]
            if above is None:
                own, parents = root_names[root_of], np.ones(len(mine), np.int64)
                ok[doc[mine[own < 0]]] = False
                state[mine] = self.next[parents, np.maximum(own, 0)]
            else:
                own = names[root_of, code[mine]]
                ok[doc[mine[own < 0]]] = False
                if len(above):
                    at = np.searchsorted(above, mine, "right") - 1
                    parents = above[np.maximum(at, 0)]
                    inside = (at >= 0) & (mine < closes[parents])
                    state[mine] = np.where(inside, self.next[state[parents], np.maximum(own, 0)], 0)
            above = mine[(do[mine] == OPEN) & (state[mine] > 0)]

        live = np.flatnonzero(state)
        fields = live[self.field[state[live]] >= 0]
        deep = fields[(do[fields] == OPEN) & (closes[fields] != fields + 1) & (closes[fields] < stop[doc[fields]])]
        ok[doc[deep]] = False

        # faults of close tags
        faults = []
        for d in np.flatnonzero(ok & (stop <= len(order))):
            fault, at = fault_at(d)
            begin = lt[token[stop[d]]] - offsets[d]
            if fault and begin <= at <= begin + 2:
                faults.append((int(d), fault))
            else:
                ok[d] = False
        known |= ok

        # segments and the texts of their fields
        segments = live[self.kind[state[live]] >= 0]
        segments = segments[known[doc[segments]] & (closes[segments] < stop[doc[segments]])]
        if not len(segments):
            return known, None, faults
        seg_doc, seg_kind = doc[segments], self.kind[state[segments]]
        inside = live[known[doc[live]]]
        at = np.searchsorted(segments, inside, "right") - 1
        inside_of = (at >= 0) & (inside <= closes[segments[np.maximum(at, 0)]])
        inside, at = inside[inside_of], at[inside_of]
        starts = np.cumsum(self.sizes[seg_kind]) - self.sizes[seg_kind]
        is_field = self.field[state[inside]] >= 0
        rows, where = [at[is_field]], [inside[is_field]]
        ks, source = [self.field[state[where[0]]]], [2 * token[where[0]] + 1]
        # of an empty element the text after it is not its own
        source[0] = np.where(do[where[0]] == EMPTY, -1, source[0])
        constants: list[str] = [""]
        for s, wanted in self.attributes.items():
            here = np.flatnonzero(state[inside] == s)
            if not len(here):
                continue
            e = inside[here]
            pairs = np.where(level[e] == 1, -1, code[e]) + (len(texts) + 1) * of_doc[doc[e]]
            distinct, back = np.unique(pairs, return_inverse=True)
            for attribute, k in wanted:
                number = np.zeros(len(distinct), np.int64)
                for i, pair in enumerate(distinct):
                    r, c = divmod(int(pair) + 1, len(texts) + 1)
                    value = entries[r, c - 1][1].get(attribute)
                    if value is not None:
                        constants.append(value)
                        number[i] = len(constants) - 1
                number = number[back]
                has = number > 0
                rows.append(at[here[has]])
                where.append(e[has])
                ks.append(np.full(int(has.sum()), k))
                source.append(-1 - number[has])
        row, place, k, src = (np.concatenate(x) for x in (rows, where, ks, source))
        key = starts[row] + k
        sort = np.lexsort((place, key))
        row, k, src, key = row[sort], k[sort], src[sort], key[sort]
        n_keys = int(self.sizes[seg_kind].sum())
        per_key = np.bincount(key, minlength=n_keys)
        rank = np.arange(len(key)) - (np.cumsum(per_key) - per_key)[key]
        taken = rank < self.limits[seg_kind[row], k]
        src, key = src[taken], key[taken]
        lengths = np.bincount(key, minlength=n_keys)
        own = src >= 0
        pool = pa.concat_arrays([coded.take(pa.array(src[own])), pa.array(constants, pa.string())])
        pick = np.where(own, np.cumsum(own) - 1, own.sum() - 1 - src)
        values = pool.take(pa.array(pick))

        per_doc = np.bincount(seg_doc, minlength=n_docs)
        number = np.arange(len(segments)) - (np.cumsum(per_doc) - per_doc)[seg_doc]
        last = number == per_doc[seg_doc] - 1
        raws = open_tags = None
        if raw:
            a, z = end[token[segments]], end[token[closes[segments]]]
            evens = pa.array(np.arange(0, 2 * len(segments), 2))
            raws = _between(buffer, a, z).take(evens)
            pairs = np.where(level[segments] == 1, -1, code[segments]) + (len(texts) + 1) * of_doc[seg_doc]
            distinct, back = np.unique(pairs, return_inverse=True)
            shown = []
            for pair in distinct:
                r, c = divmod(int(pair) + 1, len(texts) + 1)
                tag = texts[c - 1 if c else roots[r]].decode()
                cut_at = -2 if tag.endswith("/>") else -1
                shown.append(tag[:cut_at] + entries[r, c - 1][2] + tag[cut_at:])
            open_tags = pa.array(shown, pa.string()).take(pa.array(back))
        return known, (seg_doc, number, self.kind_names.take(pa.array(seg_kind)), self.sizes[seg_kind], lengths, values, last, raws, open_tags), faults
