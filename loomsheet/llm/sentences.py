"""Sentence units in any of ten languages, by a linear-chain model over characters.

Every character carries the tag boundary (last of its unit) or inside.  Characters that can't end a
unit have one possible tag, so the chain is decoded over the others: clusters of closing
punctuation, closers of quotations and brackets, and in scripts without periods the blanks between
two letters, or before another script.  Emissions are the log-odds of a log-linear model on the
context (kind of cluster, blank, case and kind of what follows, shape of the word before, and the
words themselves); transitions are the log-ratios of pairs of tags, for neighbours close together and
others; Viterbi decoding gives the best tags of a line.

All weights are learnt from a bounded sample of rows (``SAMPLE_ROWS``) by what line breaks tell: a
line end is a true boundary, so lines are joined and the joint is a boundary with its context; where
the script uses no period, lines are stripped of punctuation before they are joined.  The candidates
inside lines are unlabelled.  A first model parts joints from them: an abbreviation, a unit or a word
that goes on is common inside lines but never stands at a joint, so its odds are far below those of
joints.  Unlabelled candidates with odds like joints are taken for boundaries, those far below for inside, and the
model is fitted again on these tags (``ROUNDS``).  No list of words is given.

Defined results: null and blank texts give no unit; a line break always ends a unit; a line with tabs
(a row of a table) is one unit; lines ``--- ... ---`` are none; a blank between two Thai letters ends
a unit; units have no blanks at either end; offsets count code points; texts of any length are
processed whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.llm.canonical import LOOK_ALIKES
from loomsheet.llm.sampling import bounded

#: rows of the bounded training sample
SAMPLE_ROWS = 2_000

BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
MARKER = re.compile(r"\s*-{3}.*-{3}\s*$")
_CLOSERS = "”’\"»“」』)）\\]】〉》"
#: a cluster of terminals with its closers, an opener or closer alone, or a blank between Thai letters
EVENT = re.compile(r"(?P<t>(?:[!?！？。।॥｡…]|\.(?!\d))+)|(?P<q>[“”„«»「」『』《》〈〉()（）\[\]【】\"])|(?P<w>(?<=[ก-๎])[^\S\t\n]+(?=[^\W\d_]))")
_THAI = re.compile("[ก-๎]")
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", "【": "】"}
_FOLD = str.maketrans(LOOK_ALIKES | {c: None for c in "\u200b\u200c\u200d\u2060\ufeff\u00ad"})
_TO_FOLD = re.compile("[" + re.escape("".join(map(chr, _FOLD))) + "]")
_NUMBERS = re.compile(r"[\d.,]*\d")
_SHUT = set(_OPEN.values())
_BRACKETS = {"(", "（", "[", "【"}


def _class_after(rest: str) -> str:
    if not rest:
        return "end"
    ch = rest[0]
    if ch.isupper():
        return "upper"
    if ch.islower():
        return "lower"
    if ch.isdigit():
        return "digit"
    if ch in "(（[【":
        return "bracket"
    if ch in "“„«「『《〈\"¿¡":
        return "open"
    if ch in "—–-":
        return "dash"
    return "letter" if ch.isalpha() else "punct"


def _shape(word: str, before: str) -> str:
    """Shape of the word before a cluster: its kind, length and case, and whether a number stands before it."""
    if not word:
        return "none"
    after_number = "9" if before[-1:].isdigit() else ""
    if word[-1].isdigit():
        return "number"
    if "." in word:
        return "dotted"
    if not word[-1].isalpha():
        return "sign"
    if ord(word[-1]) >= 0x2E80:
        return "wide"
    return f"{after_number}{'U' if word.isupper() else 'u' if word[0].isupper() else 'l'}{min(len(word), 5)}"


class Candidate:
    """A place in a line where a unit may end: ``end`` is exclusive; ``parts`` describe the context."""

    __slots__ = ("end", "parts")

    def __init__(self, end: int, parts: tuple):
        self.end, self.parts = end, parts


def _fold(text: str) -> str:
    return text.translate(_FOLD) if not text.isascii() and _TO_FOLD.search(text) else text


def _context(line: str, start: int, end: int, mark: str, closed: str) -> tuple:
    """(cluster kind, shape before, blank, class after, word before, word before that, word after, closing kind)."""
    head = _fold(line[max(0, start - 40) : start])
    words = head.split()
    word = words[-1].lstrip("([{（«“„\"'‘—–") if words and not head[-1:].isspace() else ""
    word = re.split("[。！？，；：、]", word)[-1]
    whole, _, tail = word.rpartition(".")
    if len(whole) > 3 and tail:
        word = tail  # a unit ended before it without a blank
    before = words[-2].lstrip("([{（«“„\"'") if len(words) > 1 and word else ""
    following = _fold(line[end : end + 64])
    rest = following.lstrip()
    blank = len(rest) < len(following)
    after_word = re.match(r"\w*", rest).group()[:12]
    if mark.strip("…") == "":
        kind = "dots"
    elif mark[0] in "。！？।॥｡" or mark[-1] in "。！？।॥｡":
        kind = "full"
    elif "!" in mark or "?" in mark:
        kind = "call"
    else:
        kind = "stop"
    after = _class_after(rest)
    if after == "upper" and len(after_word) > 1 and not after_word[1].islower():
        after = "capitals"
    if after_word and ord(after_word[0]) >= 0x0900:
        after_word = after_word[:2]
    shape = _shape(word.rstrip("."), before) if kind == "stop" else "any"
    word, before, after_word = (_NUMBERS.sub("0", w) for w in (word.lower()[-12:], before.lower().rstrip(".")[-6:], after_word))
    return kind, shape, blank, after, word, before, after_word, closed


def _thai_context(line: str, start: int, end: int) -> tuple:
    """The context of a blank after Thai: what follows, and how many small words of it in Latin script."""
    rest = line[end : end + 80]
    nxt = rest[0]
    if _THAI.match(nxt):
        return "space", "any", True, "thai", "", "", "", ""
    words = re.match(r"(?:[^\W\d_\u0900-\uffff][\w.,%°’'-]*\s+)*", rest).group().split()
    after = f"latin{min(4, sum(w.strip('.,').islower() for w in words))}" if ord(nxt) < 0x370 else "script"
    return "space", "any", True, after, "", "", "", ""


def candidates(line: str, at: int | None = None) -> list[Candidate]:
    """Places of a line where a unit may end, but for its own end, or the one ``at`` an end; none inside a matched quotation or bracket."""
    events = [(m.start(), m.end(), m.lastgroup, m.group()) for m in EVENT.finditer(line)]
    stack: list[tuple[str, int]] = []
    spans: dict[int, int] = {}
    for k, (_, _, kind, mark) in enumerate(events):
        if kind != "q":
            continue
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == mark:
                spans[stack[depth][1]] = k
                del stack[depth:]
                break
        else:
            if mark in _OPEN:
                stack.append((_OPEN[mark], k))
            elif mark == '"':
                stack.append(('"', k))
    found: list[Candidate] = []
    k = 0
    while k < len(events):
        start, end, kind, mark = events[k]
        if k in spans:
            last = spans[k]
            close = events[last][1]
            inner = events[last - 1]
            if last - 1 > k and inner[2] == "t" and not line[inner[1] : events[last][0]].strip():
                fresh = not line[:start].strip() or line[:start].rstrip()[-1] in ".!?。！？।…”」』»）)"
                closed = ("bracket" if mark in _BRACKETS else "quote") + ("_fresh" if fresh else "")
                nxt = events[last + 1] if last + 1 < len(events) else None
                if at in (None, close) and not (nxt and nxt[2] == "t" and nxt[0] == close):  # a terminal follows the closer at once
                    found.append(Candidate(close, _context(line, inner[0], close, inner[3], closed)))
            k = last + 1
            continue
        if kind == "t":
            stop = end
            while stop < len(line) and line[stop] in "”’»」』)）]】" and (k + 1 >= len(events) or events[k + 1][0] != stop or k + 1 not in spans):
                stop += 1
                if k + 1 < len(events) and events[k + 1][0] < stop:
                    k += 1
            if at in (None, stop):
                found.append(Candidate(stop, _context(line, start, stop, mark, "loose" if stop > end else "")))
        elif kind == "w" and at in (None, start):
            found.append(Candidate(start, _thai_context(line, start, end)))
        k += 1
    return [c for c in found if line[c.end :].strip()]


def features(parts: tuple) -> list[str]:
    kind, shape, blank, after, word, before, after_word, closed = parts
    out = [f"k{kind}|{blank:d}|{after}|{closed}", f"a{kind}|{after}", f"c{kind}|{closed}|{blank:d}"]
    if kind == "stop":
        out += [f"b{shape}|{after}|{blank:d}", f"n{after_word}", f"s{shape}|{after_word}"]
        if not closed:  # words within a quotation or bracket say nothing of what follows it
            out += [f"w{word}", f"w{word}|{after}"]
            if len(word) < 4 and word.isalpha():
                out.append(f"p{before}|{word}")
    elif kind != "space":
        out += [f"m{after_word}|{closed[:5]}", f"m{after_word[:1]}|{closed[:5]}"]
    return out


#: log-ratios of the tags (inside, boundary) of neighbouring candidates, [close or not][tag before][tag]
Links = tuple[tuple[tuple[float, float], tuple[float, float]], tuple[tuple[float, float], tuple[float, float]]]
NO_LINKS: Links = (((0.0, 0.0), (0.0, 0.0)), ((0.0, 0.0), (0.0, 0.0)))


class Model:
    """Weights of the chain: features of a boundary, and ``links`` of the tags of neighbours within ``NEAR`` characters and beyond."""

    NEAR = 2

    def __init__(self, weights: dict[str, float], links: Links | float = NO_LINKS):
        self.weights, self.links = weights, links if isinstance(links, tuple) else NO_LINKS
        self.known: dict[tuple, float] = {}

    def score(self, parts: tuple) -> float:
        """Log-odds of a boundary."""
        value = self.known.get(parts)
        if value is None:
            if len(self.known) > 50_000:
                self.known.clear()
            value = self.known[parts] = self.weights.get("", 0.0) + sum(self.weights.get(f, 0.0) for f in features(parts))
        return value

    def decode(self, line: str) -> list[int]:
        """Ends of units inside the line, by Viterbi over the candidates."""
        found = candidates(line)
        if not found:
            return []
        inside, boundary = 0.0, self.score(found[0].parts)
        back: list[tuple[bool, bool]] = [(False, False)]
        place = found[0].end
        for c in found[1:]:
            (ii, ib), (bi, bb) = self.links[0 if c.end - place <= self.NEAR else 1]
            back.append((boundary + bi > inside + ii, boundary + bb > inside + ib))
            inside, boundary = max(inside + ii, boundary + bi), max(inside + ib, boundary + bb) + self.score(c.parts)
            place = c.end
        tag, ends = boundary > inside, []
        for c, (i, b) in zip(reversed(found), reversed(back), strict=True):
            if tag:
                ends.append(c.end)
            tag = b if tag else i
        return ends[::-1]

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of the units of a text in code points."""
        out: list[tuple[int, int]] = []
        place = 0
        for piece in _with_breaks(text or ""):
            line, at = piece, place
            place += len(piece)
            line = line.rstrip("\r\n\x0b\x0c\x85\u2028\u2029")
            if not line.strip() or MARKER.match(line):
                continue
            ends = [] if "\t" in line.strip() else self.decode(line)
            begin = 0
            for end in [*ends, len(line)]:
                part = line[begin:end]
                left = len(part) - len(part.lstrip())
                size = len(part.strip())
                if size:
                    out.append((at + begin + left, at + begin + left + size))
                begin = end
        return out


def _with_breaks(text: str) -> Iterator[str]:
    begin = 0
    for m in BREAK.finditer(text):
        yield text[begin : m.end()]
        begin = m.end()
    if begin < len(text):
        yield text[begin:]


#: starts of the lines that follow a line end with which it is joined
STARTS = 3
#: how far below the median joint the log-odds of an unlabelled candidate must be for inside, and may be for a boundary
FAR, NEXT = 3.0, 1.5
#: rounds of tagging the unlabelled candidates anew
ROUNDS = 2


def _fitted(rows: list[np.ndarray], width: int, tags: np.ndarray, weights: np.ndarray, steps: int = 60, rate: float = 0.5, penalty: float = 0.02) -> np.ndarray:
    """Weights of a logistic model over binary features by adaptive gradient steps on all rows at once."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names = np.concatenate(rows)
    own = np.zeros(width)
    squares = np.full(width, 1e-6)
    for _ in range(steps):
        z = np.bincount(owner, own[names], len(rows))
        error = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - tags)
        gradient = np.bincount(names, error[owner], width) + penalty * own
        squares += gradient**2
        own -= rate * gradient / np.sqrt(squares)
    return own


def _lines(text: str | None) -> list[str]:
    return [x.strip() for x in BREAK.split(text or "") if x.strip() and "\t" not in x and not MARKER.match(x)]


def _joint(first: str, second: str, glued: bool) -> tuple | None:
    """The context of the joint of two lines, if a unit may end there."""
    if _THAI.search(first[-1:]) and re.match(r"[^\W\d_]", second):  # a script without periods: joined without punctuation
        first, second = (re.sub(r"[.!?…,;:]", "", x) for x in (first, second))
    gap = "" if glued or first[-1:] in "。！？」』”）" or ord(first[-2:-1] or "a") >= 0x2E80 else " "
    return next((c.parts for c in candidates(first + gap + second[:80], len(first))), None)


def train(texts: Iterable[str | None]) -> Model:
    """Fit the chain on the joints of lines and the unlabelled candidates within them; order of texts doesn't matter."""
    joints: Counter[tuple] = Counter()
    inner: Counter[tuple] = Counter()
    chains: Counter[tuple] = Counter()
    for text in texts:
        lines = _lines(text)
        for line in lines:
            found = candidates(line)
            inner.update(c.parts for c in found)
            chains.update((b.end - a.end <= Model.NEAR, a.parts, b.parts) for a, b in zip(found, found[1:], strict=False))
        for k, first in enumerate(lines):
            for n, second in enumerate(lines[k + 1 : k + 1 + STARTS]):
                for glued in (False, True)[: 2 - (n > 0)]:  # typing errors leave the blank out
                    parts = _joint(first, second, glued)
                    if parts:
                        joints[parts] += 1
    if not joints:
        return Model({}, NO_LINKS)
    contexts = sorted({*joints, *inner}, key=repr)
    index: dict[str, int] = {"": 0}
    rows = [np.array([0, *(index.setdefault(f, len(index)) for f in features(p))]) for p in contexts]
    at_joint = np.array([joints[p] for p in contexts], float)
    within = np.array([inner[p] for p in contexts], float)

    def odds(own: np.ndarray) -> np.ndarray:
        return np.array([own[r].sum() for r in rows])

    # joints against unlabelled candidates: both halves weigh the same
    both = [*rows, *rows]
    halves = np.concatenate([at_joint / at_joint.sum(), within / max(1.0, within.sum())]) * len(contexts)
    z = odds(_fitted(both, len(index), np.repeat([1.0, 0.0], len(rows)), halves, penalty=0.3))
    order = np.argsort(z)
    middle = z[order][np.searchsorted(np.cumsum(at_joint[order]), at_joint.sum() / 2)]
    tags = np.where(z > middle - NEXT, 1.0, np.where(z < middle - FAR, 0.0, np.nan))
    for _ in range(ROUNDS):
        sure = ~np.isnan(tags)
        weight = np.concatenate([np.log1p(at_joint), np.where(sure, np.log1p(within), 0.0)])
        own = _fitted(both, len(index), np.concatenate([np.ones(len(rows)), np.where(sure, tags, 0.0)]), weight)
        z = odds(own)
        tags = np.where(np.abs(z) > 1, (z > 0).astype(float), np.nan)
    weights = {f: round(float(own[i]), 4) for f, i in index.items() if abs(own[i]) > 1e-3}
    return Model(weights, _links(chains, dict(zip(contexts, z > 0, strict=True))))


def _links(chains: Counter[tuple], tag: dict[tuple, bool]) -> Links:
    """Log-ratios of the pairs of tags of neighbours to what the tags by themselves make likely."""
    out = []
    for close in (True, False):
        n = np.full((2, 2), 1.0)
        for (near, a, b), times in chains.items():
            if near == close:
                n[int(tag[a]), int(tag[b])] += times
        expected = n.sum(axis=1, keepdims=True) * n.sum(axis=0, keepdims=True) / n.sum()
        out.append(tuple(tuple(round(float(x), 4) for x in row) for row in np.log(n / expected)))
    return tuple(out)


def fit(texts: DataFrame, column: str, key: str, rows: int = SAMPLE_ROWS) -> Model:
    """A model from the ``rows`` rows with the lowest hash of their key: a bounded sample, the same at every run."""
    return train(r[column] for r in bounded(texts.filter(F.col(column).isNotNull()), key, [column], rows).collect())


UNIT_ROWS = "word_id bigint, field_name string, item_no int, sent_start int, sent_end int"


def unit_rows(items: DataFrame, model: Model) -> DataFrame:
    """Units of items (word_id, field_name, item_no, text) as rows of ``UNIT_ROWS``."""
    weights, links = model.weights, model.links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, links)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = ["word_id", "field_name", "item_no", "sent_start", "sent_end"]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, field, item, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for a, b in own.units(text):
                    for cell, value in zip(out, (key, field, item, a, b), strict=True):
                        cell.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return items.select("word_id", "field_name", "item_no", "text").mapInArrow(run, UNIT_ROWS)
