"""Tokenising whole columns: each distinct part of a text is encoded once by a worker.

For byte-level BPE files whose splitting pattern is one of the two below, no
match crosses the start of a run of ASCII white space, nor the place between a
letter and an ASCII mark other than an apostrophe. A text may be cut there and
the ids of the parts joined. Parts repeat, so a worker keeps the ids of those it
has seen, and a part that is one word of Latin letters goes straight to the
library's BPE model. A part is found by its hash and then compared byte by byte.
Rows with any other white space (vertical tab, no-break space, ...), for which a
cut may fall inside a run, rows that hold the string of an added token, and all
rows of any other kind of file are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from quadrille.llm.kernel import LOWER, byte_class, ragged, span_hash
from quadrille.llm.memo import KeyTable, Rows

_SPACE = byte_class(b" \t\n\r")
_LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARK = byte_class(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
#: Parts that a worker remembers before it starts anew.
MEMO_PARTS = 2_000_000
# The patterns that allow cuts (fixed values: those of the tokenizer files).
_SPLITS_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def other_space(data: np.ndarray) -> np.ndarray:
    """Positions where white space outside of space, tab, line feed and carriage return starts."""
    found = [np.flatnonzero((data == 0x0B) | (data == 0x0C))]

    def after(lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(data == lead)
        return at, data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]

    at, b, _ = after(0xC2)
    found.append(at[(b == 0x85) | (b == 0xA0)])
    at, b, c = after(0xE1)
    found.append(at[(b == 0x9A) & (c == 0x80)])
    at, b, c = after(0xE3)
    found.append(at[(b == 0x80) & (c == 0x80)])
    at, b, c = after(0xE2)
    found.append(at[((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))])
    return np.concatenate(found)


def found_at(data: bytes, wanted: bytes) -> np.ndarray:
    """Positions where the wanted bytes start."""
    out, at = [], data.find(wanted)
    while at >= 0:
        out.append(at)
        at = data.find(wanted, at + 1)
    return np.array(out, np.int64)


def latin_ends(data: np.ndarray) -> np.ndarray:
    """Whether each byte is the last one of a letter up to U+024F; U+0130, which lower-cases to a letter and a mark, is left out."""
    out = _LETTER[data]
    lead, tail = data[:-1], data[1:]
    out[1:] |= (tail >= 0x80) & (tail < 0xC0) & (((lead >= 0xC4) & (lead <= 0xC8) & ~((lead == 0xC4) & (tail == 0xB0))) | ((lead == 0xC3) & (tail != 0x97) & (tail != 0xB7)) | ((lead == 0xC9) & (tail <= 0x8F)))
    return out


def _byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(more)
            more += 1
    return [out[b] for b in range(256)]


class Encoder:
    """Encodes Arrow text buffers with a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, memo_parts: int = MEMO_PARTS, hash=span_hash):
        self.hash = hash
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        # the strings of added tokens have ids of their own; a row that holds one, in any case, is encoded whole
        self.added = [t["content"].encode().lower() for t in spec.get("added_tokens") or [] if t["content"]]
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        inner = before.get("pretokenizers", [])
        self.led = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not norm
        self.lowers = len(inner) == 2 and inner[0].get("pattern", {}).get("Regex") == _SPLITS_WORDS and inner[0].get("behavior") == "Removed" and inner[1].get("type") == "ByteLevel" and steps == ["NFC", "Replace", "Lowercase"]
        self.parts = (self.led or self.lowers) and spec["model"].get("type") == "BPE"
        self.letters = _byte_letters()
        self.most = memo_parts
        self.forget()

    def forget(self) -> None:
        self.table, self.place, self.flat = KeyTable(), Rows(np.int64), Rows(np.uint32, 1 << 16)
        self.begin, self.length = Rows(np.int64), Rows(np.int32)
        self.bytes, self.byte_begin, self.byte_length = Rows(np.uint8, 1 << 16), Rows(np.int64), Rows(np.int64)

    def _word(self, text: str) -> list[int] | None:
        """The ids of one Latin word (led by a space, if that counts), or None for any other part."""
        word = text[1:] if text[:1] == " " else text
        if not word.isalpha() or max(word) > "ɏ":
            return None
        if self.lowers:
            text = word.lower()
            if not text.isalpha() or max(text) > "ɏ":
                return None
        mapped = "".join([self.letters[b] for b in text.encode()]) if self.led or not text.isascii() else text
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        out = [self._word(t) for t in texts] if self.parts else [None] * len(texts)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, parts: list[bytes], seen: list[bytes]) -> np.ndarray:
        """Keep the ids of parts under the bytes that stand for them; the new rows."""
        found = self.ids([p.decode("utf-8", "replace") for p in parts])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.begin.extend(self.flat.n + np.cumsum(lengths) - lengths)
        self.length.extend(lengths)
        self.flat.extend(np.array([i for x in found for i in x], np.uint32))
        sizes = np.fromiter(map(len, seen), np.int64, len(seen))
        self.byte_begin.extend(self.bytes.n + np.cumsum(sizes) - sizes)
        self.byte_length.extend(sizes)
        self.bytes.extend(np.frombuffer(b"".join(seen), np.uint8))
        return np.arange(self.length.n - len(parts), self.length.n)

    def _unlike(self, part: np.ndarray, seen: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places whose bytes are not those of the row that their hash led to; the places cover `seen` without gaps."""
        size = ends - starts
        same = self.byte_length.data[part] == size
        if same.all():
            theirs = self.bytes.data[ragged(self.byte_begin.data[part], size)]
            wrong = np.flatnonzero(theirs != seen[starts[0] : ends[-1]]) + starts[0]
            return np.unique(np.searchsorted(starts, wrong, "right") - 1) if len(wrong) else wrong
        mine = np.flatnonzero(same)
        theirs, here = self.bytes.data[ragged(self.byte_begin.data[part[mine]], size[mine])], seen[ragged(starts[mine], size[mine])]
        wrong = np.repeat(mine, size[mine])[theirs != here]
        return np.union1d(np.flatnonzero(~same), wrong)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and where each row's start (with the end)."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if self.length.n > self.most:
            self.forget()
        cut = np.zeros(len(data), bool)
        if self.parts:
            space = _SPACE[data]
            cut[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & latin_ends(data)[:-1])
        full = np.flatnonzero(off[1:] > off[:-1])
        cut[off[full]] = True
        starts = np.flatnonzero(cut)
        rows = np.searchsorted(off, starts, "right") - 1
        odd = np.concatenate([other_space(data), *[found_at(LOWER[data].tobytes(), t) for t in self.added]]) if self.parts else ()
        if len(odd):
            whole = np.zeros(n, bool)
            whole[np.searchsorted(off, odd, "right") - 1] = True
            keep = ~whole[rows] | (starts == off[rows])
            starts, rows = starts[keep], rows[keep]
        ends = np.append(starts[1:], len(data))
        seen = LOWER[data] if self.parts and self.lowers else data
        hashes = self.hash(seen, starts, ends)
        row = self.table.find(hashes)
        part = np.where(row < 0, row, self.place.data[row])
        raw, low = data.tobytes(), seen.tobytes()
        cuts = lambda at, x: [x[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        new = np.flatnonzero(part < 0)
        if len(new):
            keys, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            learnt = self._learn(cuts(at, raw), cuts(at, low))
            self.table.add(keys)
            self.place.extend(learnt)
            part[new] = learnt[inverse]
        if len(odd := self._unlike(part, seen, starts, ends)):  # equal hashes of different bytes: rows of their own
            part[odd] = self._learn(cuts(odd, raw), cuts(odd, low))
        lengths = self.length.data[part].astype(np.int64)
        ids = self.flat.data[ragged(self.begin.data[part], lengths)]
        per_row = np.bincount(rows, weights=lengths, minlength=n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its memo lives on between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with `end_id` after each."""
    n = len(off) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    new = off + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new
