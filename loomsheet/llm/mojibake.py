"""Text garbled by a wrong character encoding: found, and restored where possible.

A text is worked on in pieces (line breaks and intact sentence ends part them), for garbling comes in
places.  A best-first search runs over operations on a piece: encode by one codec and decode by
another, and unescape references.  Visited texts are kept by hash; the cost that orders the queue is
the plausibility of the characters (code length under the language models, of ``language``) plus a
charge for each operation; the cheapest reachable text wins when it saves enough.

An operation is weighed place by place: of the spans it changes those are kept whose code, in their
context and under the language that suits the context best, becomes shorter.  So a single garbled
character in a long intact sentence, and a garbled place beside a language of another script, count
as much as a text garbled whole.  Every operation kept shortens the code, hence the search ends of
itself: it goes on until no text in the queue has a sign or an unlikely span left.

A piece is searched if it has a sign (characters that are the bytes of a UTF-8 sequence in a
single-byte codec), an escape, or a span of characters beyond ASCII whose own code is longer than
intact text has (``UNLIKELY``); without such a span only decoding as UTF-8 is tried, for any other
repair has to save ``SAVED`` bits, which likely characters don't have to spare.

Defined results: null and empty texts are clean; a piece that only shows garbled characters within
quotation marks is clean; text whose bytes are lost (replacement characters) is found, and restored
only as far as bytes are left; the result for a text depends on nothing but the text and the models;
texts are processed whole.
"""

from __future__ import annotations

import functools
import heapq
import html
import itertools
import re
import urllib.parse
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsheet.llm import ppm

#: fixed values: codecs a text may have been decoded by wrongly, and codecs it may have been written in
SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp874", "cp1250", "iso8859-15")
DOUBLE = ("gbk", "cp932", "big5", "euc_jp")
RIGHT = ("utf-8", "gb18030", "cp932", "euc_jp", "big5", "cp1251", "koi8-r", "cp874", "cp1252", "cp866")
#: pairs that give the same as another pair, or nothing that occurs: single-byte Latin text read as Latin
_USELESS = {(w, "cp1252") for w in ("latin-1", "cp1252", "iso8859-15", "cp1250", *DOUBLE)} | {("gbk", "gb18030")} | {(c, c) for c in RIGHT} | {(d, s) for d in DOUBLE for s in ("cp1251", "koi8-r", "cp874", "cp866")}
PAIRS = tuple((w, r) for w in SINGLE + DOUBLE for r in RIGHT if (w, r) not in _USELESS)
#: the pairs most garbling is by, for those who need the language of a text rather than its restoration
COMMON = tuple((w, "utf-8") for w in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "gbk")) + (
    ("latin-1", "gb18030"), ("latin-1", "euc_jp"), ("latin-1", "cp932"), ("cp1252", "cp932"), ("latin-1", "cp874"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "koi8-r"),
)
#: bits charged for an operation, and what a repair must save
CHARGE = {"utf-8": 4.0}
OTHER_CHARGE = 16.0
#: bits a place must save to be changed, and bits a repair must save in all: from UTF-8, or by other codecs
PLACE, STRICT, SAVED = 2.0, 6.0, 24.0
#: share of its code a piece must save by other codecs if the outcome still has unlikely spans
MUCH = 0.2
#: texts costlier than the cheapest that are tried without reaching a cheaper one before the search ends
PATIENCE = 1
#: share of the characters beyond ASCII that a codec has above which whole UTF-8 sequences aren't by chance
MOSTLY = 0.6
#: bits by which the spans of a piece beyond ASCII may exceed so many bits a byte in all, if it is intact
UNLIKELY = (9.0, 3.0)
#: characters of context on either side of a changed span
CONTEXT = 12
#: pieces searched side by side, and characters whose code is looked up in one go
ABREAST, LOOKED_UP = 256, 1 << 16
#: bits an unseen character costs more, and one that prints nothing or is lost
UNSEEN = 12.0
LOST = re.compile("\ufffd|锟斤|斤拷|锟拷|ï¿½|\ufffd")
_GONE = re.compile(f"((?:{LOST.pattern})+)")
_BAD = re.compile("[\\ufffd\\x80-\\x9f\\ue000-\\uf8ff]")
_ESCAPE = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[0-9A-Fa-f]{2}){2,}")
QUOTED = re.compile(r"[“„«‘「『\"'](?P<in>[^“”„«»‘’「」『』\"'\n]{1,24})[”“»’」』\"']")
_END = re.compile("([.!?] |। |[。！？][”’」』）]*|[\n\r\t])")


def cut(text: str) -> list[str]:
    """Pieces that give the text again when joined: parted at line breaks and intact sentence ends."""
    parts = _END.split(text)
    return [p for p in (a + b for a, b in zip(parts[::2], [*parts[1::2], ""], strict=True)) if p]


def _class(codec: str, low: int, high: int) -> str:
    out = []
    for byte in range(low, high + 1):
        try:
            ch = bytes([byte]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(byte)
        out.append(re.escape(ch))
    return "[" + "".join(out) + "]"


@functools.cache
def signs() -> re.Pattern:
    """Characters that, in one of the single-byte codecs, are the bytes of a UTF-8 sequence; built from the codecs."""
    parts = ["[\x80-\x9f\ufffd\ue000-\uf8ff]"]
    for codec in SINGLE:
        tail = _class(codec, 0x80, 0xBF)
        plain = "(?![а-яёА-ЯЁ]{2})" if codec in ("cp1251", "koi8-r", "cp866") else ""  # Russian words aren't signs
        parts.append(f"{plain}(?:{_class(codec, 0xC2, 0xDF)}{tail}|{_class(codec, 0xE0, 0xEF)}{tail}{tail}|{_class(codec, 0xF0, 0xF4)}{tail}{{3}})")
    return re.compile("|".join(parts))


@functools.cache
def _sequence(codec: str) -> re.Pattern:
    """The bytes of a UTF-8 sequence as characters of a single-byte codec; without a match, decoding as UTF-8 changes nothing."""
    tail = _class(codec, 0x80, 0xBF)
    return re.compile(f"{_class(codec, 0xC2, 0xDF)}{tail}|{_class(codec, 0xE0, 0xEF)}{tail}{tail}|{_class(codec, 0xF0, 0xF4)}{tail}{{3}}")


@functools.cache
def _unmapped(codec: str) -> dict[str, int]:
    """Control characters that stand for the bytes a single-byte codec leaves open."""
    if codec not in SINGLE:
        return {}
    return {chr(b): b for b in range(0x80, 0xA0) if bytes([b]).decode(codec, "replace") == "\ufffd"}


def _encode(text: str, codec: str) -> bytes:
    extra = _unmapped(codec)
    if extra and any(c in text for c in extra):
        return b"".join(bytes([extra[c]]) if c in extra else c.encode(codec) for c in text)
    return text.encode(codec)


@functools.cache
def _runs(codec: str) -> re.Pattern:
    """Runs of characters a single-byte codec has."""
    return re.compile(rf"(?:[\x00-\x7f]|{_class(codec, 0x80, 0xFF)})+")


@functools.cache
def _high(codec: str) -> frozenset[str]:
    """Characters beyond ASCII that a single-byte codec has."""
    return frozenset(chr(b) if (c := bytes([b]).decode(codec, "replace")) == "\ufffd" else c for b in range(0x80, 0x100)) - frozenset(map(chr, range(0x80)))


@functools.lru_cache(50_000)
def _has(codec: str, ch: str) -> bool:
    try:
        ch.encode(codec)
    except UnicodeError:
        return False
    return True


def _bytes(part: str, codec: str) -> bytes | None:
    """Bytes of a run, or None where a codec takes its characters one by one but not together."""
    try:
        return _encode(part, codec)
    except UnicodeError:
        return None


def _encoded(text: str, high: set[str], wrong: str) -> list[tuple[int, str, bytes]]:
    """The runs of characters a codec has, of a text with the characters ``high`` beyond ASCII: those that aren't all ASCII, with their places and bytes."""
    if wrong in SINGLE:
        if high.isdisjoint(_high(wrong)):
            return []
        found = [(m.start(), m.group()) for m in _runs(wrong).finditer(text)]
    else:
        own = {c for c in high if _has(wrong, c)}
        if not own:
            return []
        found = [(0, text)]
        if len(own) < len(high):
            found, start, other = [], 0, high - own
            for k, ch in enumerate(text):
                if ch in other:
                    if start < k:
                        found.append((start, text[start:k]))
                    start = k + 1
            found.append((start, text[start:]))
    return [(begin, part, data) for begin, part in found if not part.isascii() and (data := _bytes(part, wrong)) is not None]


_SEQUENCES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_UTF8 = re.compile(rb"(?:" + _SEQUENCES.pattern + rb"|[\x00-\x7f])+")
#: a letter of Latin beside one of Cyrillic or a later alphabet (not Greek: units): a sequence by chance in an intact word
_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0400-\u1dff]|[\u0400-\u1dff][A-Za-z\u00c0-\u024f]")
_BEYOND = re.compile("[^\x00-\x7f]+")


def _pairs_of(codec: str, right: str) -> bool:
    return codec in SINGLE and right in _NARROW


_NARROW = {c for c in RIGHT if c not in ("utf-8", "gb18030", "cp932", "euc_jp", "big5")}


def _changes(runs: list[tuple[int, str, bytes]], wrong: str, right: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, new text) that change when runs are decoded by another codec."""
    out: list[tuple[int, int, str]] = []
    for begin, part, data in runs:
        if right == "utf-8":
            if wrong in SINGLE:  # one character a byte: each maximal run of whole sequences is a span of its own
                for m in _SEQUENCES.finditer(data):
                    try:
                        new = m.group().decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if len(new) > 1 or not _MIXED.search(part[: m.start()][-1:] + new + part[m.end() : m.end() + 1]):
                        out.append((begin + m.start(), begin + m.end(), new))
                continue
            new = _decoded(data, wrong)
        else:
            try:
                new = data.decode(right)
            except UnicodeDecodeError:
                continue
        if new is None or new == part:
            continue
        if _pairs_of(wrong, right):  # one character a byte on both sides
            out.extend((begin + m.start(), begin + m.end(), new[m.start() : m.end()]) for m in _BEYOND.finditer(part) if new[m.start() : m.end()] != m.group())
            continue
        a, b = _ends(part, new)
        out.append((begin + a, begin + len(part) - b, new[a : len(new) - b]))
    return out


def _decoded(data: bytes, wrong: str) -> str | None:
    """Bytes of two-byte characters read as UTF-8; what isn't in a whole sequence stays what it was."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        if sum(map(len, _SEQUENCES.findall(data))) < 0.6 * sum(b > 0x7F for b in data):
            return None  # intact characters of two bytes are full of sequences by chance
    out, place = [], 0
    try:
        for m in _UTF8.finditer(data):
            out.append(data[place : m.start()].decode(wrong, "replace") + m.group().decode("utf-8"))
            place = m.end()
    except UnicodeDecodeError:
        return None
    return "".join(out) + data[place:].decode(wrong, "replace")


def _unescape(text: str) -> str:
    new = html.unescape(text)
    new = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), new)
    if re.search(r"(?:%[0-9A-Fa-f]{2}){2,}", new):
        new = urllib.parse.unquote(new)
    return new


_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)


def _lowered(text: str) -> str:
    """Small letters, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _coded(low: str) -> bytes:
    """UTF-8 with one digit for all; lone surrogates are a question mark."""
    return low.encode("utf-8", "replace").translate(_DIGITS)


def _normal(text: str) -> bytes:
    return _coded(_lowered(text))


def _ends(old: str, new: str) -> tuple[int, int]:
    """Lengths of the common start and of the common end of two texts."""
    least = min(len(old), len(new))
    a = 0
    while a < least and old[a] == new[a]:
        a += 1
    b = 0
    while b < least - a and old[-1 - b] == new[-1 - b]:
        b += 1
    return a, b


def _groups(spans: list[tuple[int, int, str]]) -> list[list[tuple[int, int, str]]]:
    """Spans in order, those within each other's context together."""
    out: list[list[tuple[int, int, str]]] = []
    for span in spans:
        if out and span[0] - out[-1][-1][1] <= CONTEXT:
            out[-1].append(span)
        else:
            out.append([span])
    return out


def _replaced(text: str, spans: list[tuple[int, int, str]], begin: int = 0, end: int | None = None) -> str:
    """Part of a text with spans replaced."""
    out, place = [], begin
    for a, b, new in spans:
        out.append(text[place:a])
        out.append(new)
        place = b
    return "".join(out) + text[place:end]


def _signed(text: str) -> bool:
    """Whether a text has bytes of a UTF-8 sequence as characters, or an escape."""
    return bool(not text.isascii() and signs().search(text) or _ESCAPE.search(text))


#: what a search asks of the models: a kind and its items; the answer is one value an item
Asking = Generator[tuple[str, list], list, "tuple | list | str"]


class Repairer:
    """Finds and repairs pieces; equal pieces are worked on once per worker within a bounded store.

    Searches run side by side, as generators that ask for the bits of windows and the like; what they
    ask at a time is looked up in the models together. An answer depends on its own item only.
    """

    STORE = 100_000

    def __init__(self, models: ppm.Models, pairs: tuple[tuple[str, str], ...] = PAIRS, expansions: int | None = None):
        """All ``pairs`` until the search ends; or at most ``expansions`` texts a piece and no span alone, for those who need the language only."""
        self.models, self.pairs, self.expansions = models, pairs, expansions
        self.known: dict[str, tuple[str, bool]] = {}
        self.judged: dict[str, tuple[str, bool]] = {}
        self.letters: dict[str, float] = {}
        self.usual: set[str] = set(map(chr, range(0x80)))
        self.odd: dict[str, bool] = {}

    def _meet(self, texts: list[str]) -> None:
        """Make the extra bits of all characters known."""
        fresh = [c for c in set().union(*texts) if c not in self.letters]
        if fresh:
            seen = self.models.seen([_normal(c) for c in fresh])
            self.letters.update((c, 0.0 if c < "\x80" or s and not _BAD.match(c) else UNSEEN) for c, s in zip(fresh, seen, strict=True))
            self.usual.update(c for c in fresh if not self.letters[c])

    def _extra(self, text: str) -> float:
        """Bits for characters the models have never seen, that print nothing or are lost; of texts met before."""
        if text.isascii() or self.usual.issuperset(text):
            return 0.0
        return sum(map(self.letters.__getitem__, text))

    def costs(self, texts: list[str]) -> list[float]:
        """Bits of each text under the language that suits it best; characters that print nothing, are lost or unseen cost more."""
        self._meet(texts)
        bits = self.models.bits([_normal(t) for t in texts]).min(axis=1).tolist()
        return [b + self._extra(t) for b, t in zip(bits, texts, strict=True)]

    def unlikely(self, pieces: list[str]) -> list[bool]:
        """Whether a piece has a span beyond ASCII whose code, under the language its context suits best, is longer than that of intact text."""
        self._meet(pieces)
        out = [self._extra(p) > 0 for p in pieces]
        for first, last in _portions([len(p) for p in pieces]):
            part = [_lowered(p.rstrip("\r\n\t")) for p in pieces[first:last]]
            text = "\n".join(part).encode("utf-8", "replace").decode("utf-8")  # pieces are parted by a character that is in no span
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            step = np.diff(np.concatenate([[0], points >= 0x80, [0]]).astype(np.int8))
            a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            if not len(a):
                continue
            sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            at = np.concatenate([[0], np.cumsum(sizes)])
            data = _coded(text)
            codes, _ = self.models.codes_of([data[i:j] for i, j in zip(at[begins].tolist(), at[ends].tolist(), strict=True)])
            sums = _running(codes)
            who = np.searchsorted(begins, a, side="right") - 1
            begin, end = at[a] - who, at[b] - who
            wide_begin, wide_end = at[np.maximum(a - 2 * CONTEXT, begins[who])] - who, at[np.minimum(b + 2 * CONTEXT, ends[who])] - who
            best = (sums[wide_end] - sums[wide_begin]).argmin(axis=1)
            own = sums[end, best] - sums[begin, best]
            over = np.bincount(who, np.maximum(own - UNLIKELY[1] * (end - begin), 0.0), len(part))
            for k in np.flatnonzero(over > UNLIKELY[0]).tolist():
                out[first + k] = True
        return out

    def _weighed(self, text: str, groups: list[tuple[tuple[str, str], list[tuple[int, int, str]]]]) -> Asking:
        """The groups of spans that save something, by operation, with the bits saved by each span; and the other groups."""
        out: dict[tuple[str, str], list[tuple[int, int, str, float]]] = {}
        olds, news = [], []
        for _, some in groups:
            a, b = max(0, some[0][0] - CONTEXT), some[-1][1] + CONTEXT
            new = _replaced(text, some, a, b)
            olds.append((text[a:b], some[0][0] - a, some[-1][1] - a))
            news.append((new, some[0][0] - a, len(new) - len(text[some[-1][1] : b])))
        asked = list(dict.fromkeys(olds))
        bits = dict(zip(asked, (yield "placed", asked), strict=True))
        self._meet([new for new, _, _ in news])
        # what its characters cost more is part of the bits of a window: where that is too much already, they aren't looked up
        asked = list(dict.fromkeys(new for new, old in zip(news, olds, strict=True) if new not in bits and bits[old] - self._extra(new[0]) >= PLACE))
        bits.update(zip(asked, (yield "placed", asked), strict=True))
        failed = []
        for (pair, some), old, new in zip(groups, olds, news, strict=True):
            gain = bits[old] - bits[new] if new in bits else 0.0
            if gain >= PLACE:
                out.setdefault(pair, []).extend((*s, gain / len(some)) for s in some)
            else:
                failed.append((pair, some))
        return out, failed

    def _placed(self, windows: list[tuple[str, int, int]]) -> list[float]:
        """Bits of windows (text, start, end of the span): all under one language, or what precedes and follows the span each under its own, and the span under one of these."""
        out: list[float] = []
        self._meet([t for t, _, _ in windows])
        for start, stop in _portions([len(t) for t, _, _ in windows]):
            part = windows[start:stop]
            data, before, own_size = [], [], []
            for text, i, j in part:
                low = _lowered(text)
                x, y = _coded(low[:i]), _coded(low[i:j])
                data.append(x + y + _coded(low[j:]))
                before.append(len(x))
                own_size.append(len(y))
            codes, begin = self.models.codes_of(data)
            sums = _running(codes)
            end = begin + np.fromiter(map(len, data), np.int64, len(data))
            a = begin + np.array(before)
            b = a + np.array(own_size)
            left, own, right = sums[a] - sums[begin], sums[b] - sums[a], sums[end] - sums[b]
            lines = np.arange(len(data))
            first, last = left.argmin(axis=1), right.argmin(axis=1)
            first, last = np.where(a > begin, first, last), np.where(b < end, last, first)
            parts = left.min(axis=1) + right.min(axis=1) + np.minimum(own[lines, first], own[lines, last])
            whole = (left + own + right).min(axis=1)
            best = np.where((a > begin) | (b < end), np.minimum(parts, whole), whole)
            out.extend(bits + self._extra(w[0]) for w, bits in zip(part, best.tolist(), strict=True))
        return out

    def _search(self, piece: str) -> Asking:
        """Cheapest text reachable from a piece, the bits it saves, and whether only UTF-8 was decoded on the way; then the cheapest by UTF-8 only."""
        best = sure = (0.0, piece, True)
        queue: list[tuple[float, int, bool, bool, str]] = [(0.0, 0, True, False, piece)]
        visited = {hash(piece)}
        serial, idle, done = 0, 0, 0
        while queue and idle <= PATIENCE and done != self.expansions:
            done += 1
            spent, _, pure, firm, text = heapq.heappop(queue)
            odd = yield from self._odd(text)
            if serial and spent <= best[0] and (firm or not odd) and not _signed(text):
                break  # the cheapest text, and nothing in it asks for a repair any more; other codecs could only bend what whole sequences gave
            idle += spent > best[0]
            high = {c for c in set(text) if c > "\x7f"}
            runs: dict[str, list[tuple[int, str, bytes]]] = {}
            found: dict[str, tuple[float, bool]] = {}
            mostly = False
            kept: dict[tuple[str, str], list[tuple[int, int, str, float]]] = {}
            failed: list = []
            # whole UTF-8 sequences are evidence by themselves and come first; spans alone are for texts that nothing else improves
            for step in ("utf-8", "other", "alone"):
                if step == "alone" and (found or self.expansions) or step != "utf-8" and not odd:
                    break
                if step == "alone":
                    groups = [(pair, [s]) for pair, some in failed if len(some) > 1 for s in some]
                else:
                    groups = []
                    for wrong, right in self.pairs:
                        if (right == "utf-8") == (step == "utf-8"):
                            if step == "utf-8" and wrong in SINGLE and not _sequence(wrong).search(text):
                                continue
                            if wrong not in runs:
                                runs[wrong] = _encoded(text, high, wrong)
                            if not runs[wrong]:
                                continue
                            groups.extend(((wrong, right), group) for group in _groups(_changes(runs[wrong], wrong, right)))
                if not groups:
                    continue
                saving, rest = yield from self._weighed(text, groups)
                failed.extend(rest)
                for pair, spans in saving.items():
                    kept[pair] = sorted([*kept.get(pair, []), *spans])
                    new = _replaced(text, [k[:3] for k in kept[pair]])
                    total = spent - sum(k[3] for k in kept[pair]) + CHARGE.get(pair[1], OTHER_CHARGE)
                    found[new] = min(found.get(new, (9e9, False)), (total, pure and pair[1] == "utf-8"))
                if step == "utf-8" and any(sum(b - a for a, b, _, _ in spans) > MOSTLY * sum(c > "\x7f" for _, part, _ in runs[wrong] for c in part) for (wrong, _), spans in kept.items()):
                    mostly = True
                    break  # other bytes have such sequences by chance only; what is left is for the next text
                if found and min(found.values())[0] < spent - STRICT and not (yield from self._open(min(found, key=found.get))):
                    break
            if _ESCAPE.search(text):
                new = _unescape(text)
                old_cost, new_cost = yield "costs", [text, new]
                found.setdefault(new, (spent + new_cost - old_cost + 1.0, pure))
            for new, (total, strict) in found.items():
                if total < spent and hash(new) not in visited:  # every operation has to save something, so the search ends
                    visited.add(hash(new))
                    serial += 1
                    if total < best[0]:
                        best, idle = (total, new, strict), 0
                    if strict and total < sure[0]:
                        sure = (total, new, True)
                    heapq.heappush(queue, (total, serial, strict, mostly and strict, new))
        return [(best[1], -best[0], best[2]), (sure[1], -sure[0], True)]

    def _open(self, text: str) -> Asking:
        return _signed(text) or (yield from self._odd(text))

    def _odd(self, text: str) -> Asking:
        if text not in self.odd:
            (self.odd[text],) = yield "odd", [text]
        return self.odd[text]

    def _judge(self, piece: str) -> Asking:
        lost = bool(LOST.search(piece))
        outside = QUOTED.sub("“”", piece)
        if outside != piece and not LOST.search(outside) and (yield from self._mended(outside)) == outside:
            return piece, False  # it only quotes such characters
        text = piece
        if lost:
            text = ""
            for k, part in enumerate(_GONE.split(piece)):
                text += part if k % 2 else (yield from self._mended(part))
        else:
            text = yield from self._mended(piece)
        return text, lost or text != piece

    def _mended(self, piece: str) -> Asking:
        if not piece or not (yield from self._open(piece)):
            return piece
        for text, saved, strict in (yield from self._search(piece)):
            if text == piece or saved <= (STRICT if strict else SAVED):
                continue
            # without a strict code to vouch for it, what comes out must be likely text, or much likelier
            if strict or not (yield from self._odd(text)):
                return text
            a, b = _ends(piece, text)
            if saved > MUCH * (yield "costs", [piece[max(0, a - CONTEXT) : len(piece) - b + CONTEXT]])[0]:
                return text
        return piece

    def judge(self, pieces: list[str]) -> list[tuple[str, bool]]:
        """(restored text, whether found) of pieces, searched side by side."""
        answers = {"odd": self.unlikely, "placed": self._placed, "costs": self.costs}
        out: list[tuple[str, bool]] = [("", False)] * len(pieces)
        waiting: list[tuple[int, Generator, list | None]] = []
        ahead = iter(enumerate(pieces))
        while True:
            waiting.extend((k, self._judge(p), None) for k, p in itertools.islice(ahead, ABREAST - len(waiting)))
            if not waiting:
                return out
            asked: dict[str, list[tuple[int, Generator, list]]] = {}
            for k, search, answer in waiting:
                try:
                    kind, items = search.send(answer)
                    asked.setdefault(kind, []).append((k, search, items))
                except StopIteration as end:
                    out[k] = end.value
            waiting = []
            for kind, some in asked.items():
                every = list(dict.fromkeys(x for _, _, items in some for x in items))
                known = dict(zip(every, answers[kind](every), strict=True))
                waiting.extend((k, search, [known[x] for x in items]) for k, search, items in some)

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) > self.STORE:
            self.known = {}
        if len(self.judged) > self.STORE:
            self.judged = {}
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        ascii_ = [p for p in new if p.isascii() and not _ESCAPE.search(p)]
        self.known.update((p, (p, False)) for p in ascii_)
        self.known.update((p, self.judged[p]) for p in new if p in self.judged)
        new = [p for p in new if p not in self.known]
        odd = dict(zip(new, self.unlikely(new), strict=True))
        searched = [p for p in new if odd[p] or _signed(p) or LOST.search(p)]
        self.odd = {p: odd[p] for p in searched}
        self.known.update((p, (p, False)) for p in new)
        self.judged.update(zip(searched, self.judge(searched), strict=True))
        self.known.update((p, self.judged[p]) for p in searched)

    def repair(self, texts: list[str]) -> list[tuple[str, int]]:
        """(restored text, pieces found) of each text."""
        cuts = [cut(t) for t in texts]
        self.learn([p for row in cuts for p in row])
        out = []
        for text, row in zip(texts, cuts, strict=True):
            results = [self.known[p] for p in row]
            found = sum(f for _, f in results)
            out.append(("".join(t for t, _ in results), found) if found else (text, 0))
        return out


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of items with about ``LOOKED_UP`` characters each."""
    first, held = 0, 0
    for k, n in enumerate(sizes):
        held += n
        if held >= LOOKED_UP:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _running(codes: np.ndarray) -> np.ndarray:
    """Sums of code lengths up to each byte."""
    out = np.zeros((len(codes) + 1, codes.shape[1]))
    np.cumsum(codes, axis=0, dtype=np.float64, out=out[1:])
    return out


#: the models of a worker's latest task with their repairer, for the next task to go on with
_latest: list[tuple[ppm.Models, Repairer]] = []


def _repairer(models: ppm.Models) -> Repairer:
    if not _latest or _latest[0][0] is not models:
        _latest[:] = [(models, Repairer(models))]
    return _latest[0][1]


REPAIRED = "doc_id bigint, pieces_found int, restored string"


def repaired_rows(documents: DataFrame, models: ppm.Models, block: int = 1_000_000) -> DataFrame:
    """(doc_id, pieces_found, restored) of the garbled ones among documents (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = _repairer(shared.value)

        def emit(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            rows = [(i, n, t) for i, (t, n) in zip(ids, repairer.repair(texts), strict=True) if n]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "pieces_found", "restored"])

        for batch in batches:
            ids: list[int] = []
            texts: list[str] = []
            held = 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                ids.append(batch.column(0)[i].as_py())
                texts.append(text)
                held += len(text)
                if held >= block:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield emit(ids, texts)

    return documents.select("doc_id", "text").mapInArrow(run, REPAIRED)
