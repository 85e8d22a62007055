"""Splits texts into pieces that byte-level BPE encodes independently, and remembers pieces.

The pattern of byte-level BPE cuts wherever a single blank stands between two characters that are
no white space, and around a single line feed. So most text falls apart at blanks. Arrow splits a
batch of texts and finds its distinct pieces; only those are looked up, matched and merged, and a
text's ids are a cut of what its pieces stand for, laid end to end. Texts with other runs of white
space take the pattern itself; both ways give the same ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces remembered at a time; the older half is forgotten when full. Bounds a worker's memory.
MOST_PIECES = 300_000
AT_ONCE = 1000  # texts whose distinct pieces are found together
MOST_NEW = 15_000
FIRST = "\x01"  # marks a text's first piece, before which there is no blank
ODD = b"odd"  # stands for pieces that may match differently beside their neighbours


class PieceEncoder:
    """``encode(text) -> ids`` is asked once for many distinct pieces; ``lengths`` has the bytes of each id."""

    def __init__(self, encode: Callable[[str], np.ndarray], lengths: np.ndarray, most: int = MOST_PIECES, at_once: int = AT_ONCE, most_new: int = MOST_NEW, whole: tuple[str, ...] = ()):
        self.encode, self.lengths, self.most, self.at_once, self.most_new = encode, lengths, most, at_once, most_new
        self.whole = whole  # texts that hold one of these are encoded whole
        self.marks = {c: encode(c).tobytes() for c in ",."}
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Pieces may stand side by side as in a text, so one call encodes many; the ids are told
        apart by the bytes they cover."""
        now, old = self.now, self.old
        new, marked = [], []
        for p in pieces:
            if (x := old.get(p)) is not None:
                now[p] = x
            elif p.isalnum():  # most are words
                new.append(p)
            elif p[-1:] in (",", ".") and p[-2:-1].isalpha():  # a word and one mark after it are encoded apart
                marked.append(p)
            else:
                self._sort(p, new)
        self._encode_all(new)
        words = []
        for w in dict.fromkeys([p[:-1] for p in marked]):
            if w not in now:
                if (x := old.get(w)) is not None:
                    now[w] = x
                else:
                    self._sort(w, words)
        self._encode_all(words)
        for p in marked:
            now[p] = ODD if (base := now[p[:-1]]) is ODD else base + self.marks[p[-1]]

    def _sort(self, p: str, new: list[str]) -> None:
        body = p[1:] if p[:1] in ("\n", FIRST) else p
        if not (body[:1].isspace() or body[-1:].isspace()) if body else p == "\n":
            new.append(p)
        else:
            self.now[p] = ODD

    def _encode_all(self, new: list[str]) -> None:
        for k in range(0, len(new), self.most_new):
            self._encode_some(new[k : k + self.most_new])

    def _encode_some(self, new: list[str]) -> None:
        now = self.now
        # a text's first piece comes after a line feed here, which is one id of its own
        texts = [" " + p if (c := p[0]) != "\n" and c != FIRST else "\n" + p[1:] for p in new]
        text = "".join(texts)
        if any(w in text for w in self.whole):  # pieces with such a string stay odd
            now.update(dict.fromkeys(new, ODD))
            new, n = [p for p, t in zip(new, texts) if not any(w in t for w in self.whole)], len(new)
            if 0 < len(new) < n:
                self._encode_some(new)
            return
        ids = self.encode(text)
        upto = np.cumsum(self.lengths[ids])
        sizes = map(len, texts) if text.isascii() else [len(x) if x.isascii() else len(x.encode()) for x in texts]
        at = (np.searchsorted(upto, np.cumsum(np.fromiter(sizes, np.int64, len(texts)))) + 1) * 4
        data, a = ids.tobytes(), 0
        for p, z in zip(new, at.tolist()):
            now[p] = data[a + 4 : z] if p[0] == FIRST else data[a:z]
            a = z

    def _split(self, texts: pa.Array) -> list[bytes]:
        marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        found = lists.flatten().dictionary_encode()
        pieces = found.dictionary.to_pylist()
        known = list(map(self.now.get, pieces))
        if missing := [p for p, x in zip(pieces, known) if x is None]:
            self._learn(missing)
            now = self.now
            known = [now[p] if x is None else x for p, x in zip(pieces, known)]
        ids = pa.array(known, pa.binary()).take(found.indices)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        data, cuts = memoryview(ids.buffers()[2] or b""), offsets[at].tolist()
        odd = np.zeros(len(texts), bool)
        if bad := [k for k, x in enumerate(known) if x is ODD]:
            where = np.flatnonzero(np.isin(found.indices.to_numpy(), bad))
            odd[np.searchsorted(at, where, "right") - 1] = True
        for p in ("\n\n\n", "\n\n ", FIRST, *self.whole):
            odd |= pc.match_substring(texts, p).to_numpy(zero_copy_only=False)
        odd |= pc.ends_with(texts, "\n\n").to_numpy(zero_copy_only=False)
        out = []
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if odd[k]:
                out.append(self.encode(text).tobytes() if (text := texts[k].as_py()) else b"")
            else:
                out.append(bytes(data[a:z]))
        if len(self.now) > self.most // 2:
            self.now, self.old = {}, self.now
        return out

    def texts(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text (null: none) as little-endian 32-bit integers."""
        col = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        return [x for k in range(0, len(col), self.at_once) for x in self._split(col.slice(k, self.at_once))]
