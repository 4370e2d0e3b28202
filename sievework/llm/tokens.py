"""Token ids of whole texts by the tokenizers library, with the ids of frequent words remembered.

Both vocabularies used here part a text into words by a pattern and encode each word by itself, so the ids of a text are
those of its words. Texts of ASCII and Latin letters (where the pattern is spelled out below) are parted here, each
distinct word is encoded by the library once, and its ids are remembered; all other texts go to the library whole. Texts in
an Arrow array are parted and looked up together, with nothing per word in Python but for the distinct words of some
hundred texts. A word of up to 16 bytes is told by its bytes (its first and last eight) and its length, a longer one by all
of it; texts with a word over LONGEST bytes, or with one that its hash doesn't lead to, go to the library. Words of letters are
one piece for the library's model and go to it directly. Where memory is full, words that were met in one batch only go first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .base import _KEEP, mix

#: Distinct words whose ids a worker remembers.
CACHE = 900_000
#: Bytes of a word that is remembered.
LONGEST = 256
#: Characters whose class is the same in all versions of Unicode: ASCII without U+001C to U+001F, and Latin letters up to
#: U+024F (U+0130 excepted, whose lower case is two characters).
_PLAIN = re.compile("[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-įı-ɏ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_BLANK = "\x09-\x0d\x20"
#: How each vocabulary's own pattern parts such texts.
_PATTERNS = {
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_BLANK}{_LETTER}0-9]+"),
}


class Encoder:
    """kind says how the vocabulary parts texts: `byte` (byte-level BPE, nothing changed), `word` (lower case, blanks
    dropped) or None (no short way: the library encodes all texts whole)."""

    def __init__(self, path: str, kind: str | None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lower, self.pattern, self.known = kind == "word", _PATTERNS.get(kind), {}
        parting = self.tokenizer.encode("\0", add_special_tokens=False).ids if self.pattern else [0]
        if len(parting) != 1:
            self.pattern = None  # no short way to encode words together
        self.parting = parting[0]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Adds the words' ids. Words of letters are encoded many at once, with a character between that parts them."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        plain = [w for w in words if w[-1].isalpha() and w[0] != "'"]
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\0".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.parting)
            if len(at) != len(part) - 1:
                raise RuntimeError("the vocabulary doesn't keep words apart")
            data, edges = ids.tobytes(), (np.stack([np.append(0, at + 1), np.append(at, len(ids))], 1) * 4).tolist()
            self.known.update(zip(part, (data[s:e] for s, e in edges), strict=True))
        other = [w for w in words if not (w[-1].isalpha() and w[0] != "'")]
        for w, ids in zip(other, self._whole(other), strict=True):
            self.known[w] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        rest, waiting, new = [], [], set()
        find, get = (self.pattern.findall if self.pattern else None), self.known.get
        for i, t in enumerate(texts):
            if find is None or not _PLAIN.fullmatch(t):
                rest.append(i)
                continue
            words = find(t.lower() if self.lower else t)
            ids = list(map(get, words))
            if None in ids:
                waiting.append((i, words))
                new.update(w for w, x in zip(words, ids, strict=True) if x is None)
            else:
                out[i] = np.frombuffer(b"".join(ids), "<u4")
        if waiting:
            if len(self.known) + len(new) > CACHE:  # all go but what is needed now
                new = set().union(*(w for _, w in waiting))
            self._learn(new)
            for i, words in waiting:
                out[i] = np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


#: Classes of bytes: 0 blank, 1 letter (so is any byte of a character that isn't ASCII), 2 digit, 3 other, 4 not for the short
#: way (nor are characters but those from U+00C0 to U+017F, by their first bytes).
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
_CLASS[[*range(0x1C, 0x20), 0x7F, *range(0xC0, 0xC3), *range(0xC6, 0x100)]] = 4
_CLASSES = {"byte": _CLASS.tobytes(), "word": bytes(4 if i in (0xC4, 0xC5) else c for i, c in enumerate(_CLASS.tolist()))}  # those two: lower case by no simple rule
_AFTER_MARK = np.zeros(256, bool)
_AFTER_MARK[[ord(c) for c in "strvmldSTRVMLD"]] = True
#: The characters that stand for bytes in byte-level vocabularies: printable ones themselves, the others from U+0100 on.
#: A line feed stays one here; it parts words.
_SPELLED = np.arange(256, dtype="<u2")
_UNPRINTED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_SPELLED[_UNPRINTED] = 0x100 + np.arange(len(_UNPRINTED))
_SPELLED[0x0A] = 0x0A
#: Words looked at, at most, to find one by its hash.
PROBES = 64


def _spelled(words: list[bytes]) -> list[str]:
    """Words of letters, with or without a blank before, as byte-level vocabularies spell them."""
    return _SPELLED[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-16-le").split("\n") if words else []


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places from each begin on, count of them."""
    end = np.cumsum(count)
    return np.repeat(begin - end + count, count) + np.arange(end[-1] if len(end) else 0)


class ArrayEncoder:
    """Ids of the texts of Arrow arrays, the short way where it holds (see above), else by `Encoder`."""

    def __init__(self, path: str, kind: str):
        self.slow, self.word, self.classes = Encoder(path, kind), kind == "word", _CLASSES[kind]
        self.model = self.slow.tokenizer.model
        # a word of letters is one piece for the model, if it spells bytes as expected
        letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180)) if c not in (0xD7, 0xF7, 0x130)]
        probes = [*letters, "".join(letters), "internationalisation", "Geschwindigkeitsbeschränkungen"]
        probes = [w.lower() for w in probes] if self.word else [b + w for w in probes for b in ("", " ")]
        self.direct = all(e.tolist() == [t.id for t in self.model.tokenize(w)] for e, w in zip(self.slow._whole(probes), _spelled([w.encode() for w in probes]), strict=True))
        self.count, self.seen = 0, np.zeros(0, bool)
        self._forget()

    def _forget(self) -> None:
        """Makes room: words that no later batch had go; all do, where more than half would stay."""
        stay = np.flatnonzero(self.seen[: self.count])
        if len(stay) > CACHE // 2:
            stay = stay[:0]
        m, room = len(stay), 1 << max(16, len(stay).bit_length())
        old = [x[stay] for x in (self.begin, self.length, self.size, self.head, self.tail, self.hash)] if m else [0] * 6
        flat = self.ids[_spread(*old[:2])] if m else np.zeros(0, np.uint32)
        self.long = {w: int(np.searchsorted(stay, i)) for w, i in self.long.items() if self.seen[i]} if m else {}
        # of each word: where its ids begin, how many, its bytes, the first and last eight of them, a hash, whether a later batch had it
        self.begin, self.length, self.size, self.head, self.tail, self.hash = (np.zeros(room, k) for k in (np.int64, np.int32, np.int32, np.uint64, np.uint64, np.uint64))
        for x, y in zip((self.length, self.size, self.head, self.tail, self.hash), old[1:], strict=True):
            x[:m] = y
        self.begin[:m] = np.cumsum(self.length[:m]) - self.length[:m]
        self.seen = np.zeros(room, bool)
        self.ids, self.used, self.count = np.zeros(1 << max(20, len(flat).bit_length()), np.uint32), len(flat), m
        self.ids[: len(flat)] = flat
        self.slots = np.full(1 << max(16, (2 * m).bit_length()), -1, np.int32)
        self._place(np.flatnonzero(self.size[:m] <= 16))

    def _place(self, words: np.ndarray) -> None:
        """Gives each short word the first free slot from its hash on."""
        if 2 * self.count > len(self.slots):
            self.slots = np.full(1 << (3 * self.count).bit_length(), -1, np.int32)
            words = np.flatnonzero(self.size[: self.count] <= 16)
        last = len(self.slots) - 1
        at = (self.hash[words] & np.uint64(last)).astype(np.int64)
        for _ in range(PROBES):  # one without a slot then is not found
            if not len(words):
                break
            free = self.slots[at] < 0
            self.slots[at[free]] = words[free]
            rest = self.slots[at] != words
            words, at = words[rest], (at[rest] + 1) & last

    def _find(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The short words' numbers, and whether each has one (else the number means nothing)."""
        last = len(self.slots) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        found = self.slots[at].astype(np.int64)
        same = (found >= 0) & (self.head[found] == head) & (self.tail[found] == tail) & (self.size[found] == size)
        left = np.flatnonzero(~same & (found >= 0))
        for i in range(1, PROBES):
            if not len(left):
                break
            f = self.slots[(at[left] + i) & last].astype(np.int64)
            ok = (f >= 0) & (self.head[f] == head[left]) & (self.tail[f] == tail[left]) & (self.size[f] == size[left])
            found[left], same[left] = f, ok
            left = left[~ok & (f >= 0)]
        return found, same

    def _add(self, words: list[bytes], size: np.ndarray, lanes: np.ndarray) -> None:
        """Remembers the words' ids. Words of letters go to the vocabulary's model, the few others to the library whole.
        lanes: a word's first and last eight bytes, and its hash."""
        first, n = self.count, len(words)
        while first + n > len(self.seen):
            for k in ("begin", "length", "size", "head", "tail", "hash", "seen"):
                x = getattr(self, k)
                setattr(self, k, np.concatenate([x, np.zeros_like(x)]))
        plain = [i for i, w in enumerate(words) if w[-1] >= 0x80 or w[-1:].isalpha()] if self.direct else []
        other = sorted(set(range(n)) - set(plain))
        counts, parts, tokenize = [], [], self.model.tokenize
        for i in range(0, len(plain), 5000):
            got = [tokenize(w) for w in _spelled([words[j] for j in plain[i : i + 5000]])]
            counts.extend(map(len, got))
            parts.append(np.array([t.id for g in got for t in g], np.uint32))
        for ids in self.slow._whole([words[i].decode() for i in other]):
            counts.append(len(ids))
            parts.append(ids)
        order, count, flat = np.array([*plain, *other]), np.array(counts, np.int64), np.concatenate(parts)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[first + order], self.length[first + order] = self.used + np.cumsum(count) - count, count
        self.size[first : first + n] = size
        self.head[first : first + n], self.tail[first : first + n], self.hash[first : first + n] = lanes
        self.used += len(flat)
        self.count += n

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null as the empty text."""
        texts = texts.fill_null("")
        if not len(texts):
            return []
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32, count=len(texts) + 1, offset=texts.offset * 4).astype(np.int64)
        size = int(at[-1] - at[0])
        if not size:
            return [np.zeros(0, np.uint32)] * len(texts)
        raw = data[int(at[0]) : int(at[-1])].to_pybytes() + bytes(8)
        at -= at[0]
        b, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(self.classes), np.uint8)
        # U+00D7, U+00F7 and U+0130 are no letters of the short way; marks before some letters may part words
        lead, mark = np.flatnonzero(b >= 0xC3), np.flatnonzero(b == 0x27)
        after = b[lead + 1]
        lead = lead[(b[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (b[lead] == 0xC4) & (after == 0xB0)]
        odd = np.concatenate([np.flatnonzero(kind == 4), lead, mark[_AFTER_MARK[b[mark + 1]]]])
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(at, odd, "right") - 1] = True
        if self.word:
            b = b.copy()
            b[(b >= 0x41) & (b <= 0x5A)] += 32
            b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)] += 32
            raw = b.tobytes()
        edge = np.zeros(size + 1, bool)
        edge[at] = True
        # where words begin
        new = np.ones(size, bool)
        before, here = kind[: size - 1], kind[1:size]
        if self.word:
            new[1:] = (here != before) | (here == 2)
        else:
            blank = kind[: size + 1] == 0
            blank[size] = False
            ends_run = ~blank[2:] & ~edge[2:]  # the next byte is of the same text and no blank
            new[1:] = (here != before) & ((b[: size - 1] != 0x20) | blank[1:size]) | blank[1:size] & blank[: size - 1] & ends_run
        new |= edge[:size]
        start = np.flatnonzero(new)
        end = np.append(start[1:], size)
        first = np.searchsorted(start, at)
        keep = ~np.repeat(whole, np.diff(first)) if whole.any() else None  # words of texts that go to the library aren't looked up
        if self.word:
            keep = (kind[start] != 0) & (True if keep is None else keep)
        if keep is not None:
            first = np.append(0, np.cumsum(keep))[first]
            start, end = start[keep], end[keep]
        found, unsure = self._look_up(raw, b, start, end)
        whole[np.searchsorted(first, unsure, "right") - 1] = True
        length = self.length[found]
        flat, ends = self.ids[_spread(self.begin[found], length)], np.append(0, np.cumsum(length))[first].tolist()
        out = [flat[i:j] for i, j in zip(ends, ends[1:])]
        rest = np.flatnonzero(whole)
        for i, ids in zip(rest.tolist(), self.slow.encode(texts.take(pa.array(rest)).to_pylist()), strict=True):
            out[i] = ids
        return out

    def _look_up(self, raw: bytes, b: np.ndarray, start: np.ndarray, end: np.ndarray, room: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and the places of words that have none."""
        size = end - start
        lane = np.ndarray(len(b) - 7, "<u8", b, strides=(1,))
        short = size <= 16
        head, tail = lane[start] & _KEEP[np.minimum(size, 8)], np.where(size > 8, lane[np.maximum(end - 8, 0)], np.uint64(0))
        hashes = mix(head ^ mix(tail + size.astype(np.uint64)))
        long = np.flatnonzero(~short & (size <= LONGEST))
        long_words = [raw[x:y] for x, y in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        found, same = self._find(head, tail, size, hashes)
        self.seen[found[same]] = True
        self.seen[[self.long[w] for w in long_words if w in self.long]] = True
        miss = np.flatnonzero(~same & short)
        miss = miss[np.unique(hashes[miss], return_index=True)[1]]
        new = {w: i for w, i in zip(long_words, long.tolist(), strict=True) if w not in self.long}
        if not room and self.count + len(miss) + len(new) > CACHE:
            self._forget()
            return self._look_up(raw, b, start, end, True)
        if len(miss) or new:
            i, n = np.concatenate([miss, np.array(list(new.values()), np.int64)]), self.count
            self._add([raw[x:y] for x, y in zip(start[i].tolist(), end[i].tolist(), strict=True)], size[i], np.stack([head[i], tail[i], hashes[i]]))
            self._place(np.arange(n, n + len(miss)))
            self.long.update(zip(new, range(n + len(miss), self.count), strict=True))
            again = np.flatnonzero(~same & short)
            found[again], same[again] = self._find(head[again], tail[again], size[again], hashes[again])
        if len(long):
            found[long], same[long] = [self.long[w] for w in long_words], True
        found[~same] = 0
        return found, np.flatnonzero(~same)


def largest_id(path: str) -> int:
    """The largest id that a vocabulary's file has."""
    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


_ENCODERS: dict = {}


def encoder(path: str, kind: str) -> ArrayEncoder:
    """One for all tasks of a worker, so that what it remembers serves the next."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = ArrayEncoder(path, kind)
    return _ENCODERS[path, kind]
