"""Oversized texts into pieces within a limit, cut at natural boundaries, with overlap.

A recursive hierarchy of separators (section, paragraph, sentence, word, character) gives parts that
fit; parts are packed greedily, and every further piece starts about ``overlap`` characters before the
end of the one before, at the start of a sentence or word where there is one near.

Defined results: texts within the limit, null and empty ones give no piece; no piece is longer than
the limit; the pieces without their overlaps are the text again; combining marks aren't parted from
their letter, unless the limit leaves no other way; texts of any length are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomsheet.llm import sentences

#: how far the start of an overlap may be from where it should be
NEAR = 30
_SECTION = re.compile(r"\n(?=[ \t]*-{3}[^\n]*-{3}[ \t]*(?:\n|$))|\n[ \t]*\n+|\n(?=\d+(?:\.\d+)*\.?[ \t]+\S)")
_PARAGRAPH = re.compile(r"\r\n|[\n\r  ]")
_WORD = re.compile(r"\s+|(?<=[、，；：,;:])")


def _mark(text: str, at: int) -> bool:
    """Whether the character at a place belongs to the one before."""
    return at < len(text) and (unicodedata.category(text[at])[0] == "M" or text[at] in "\u200d\u200c") or text[at - 1 : at] == "\u200d"


def _cuts(text: str, a: int, b: int, level: int, model: sentences.Model) -> list[int]:
    """Places inside (a, b) at which a level parts the text; blanks stay with what is before them."""
    if level == 0:
        found = [m.end() for m in _SECTION.finditer(text, a, b)]
    elif level == 1:
        found = [m.end() for m in _PARAGRAPH.finditer(text, a, b)]
    elif level == 2:
        found = [a + start for start, _ in model.units(text[a:b])]
    else:
        found = [m.end() for m in _WORD.finditer(text, a, b)]
    return [x for x in found if a < x < b and not _mark(text, x)]


def _parts(text: str, a: int, b: int, room: int, level: int, model: sentences.Model) -> Iterator[tuple[int, int]]:
    if b - a <= room:
        yield a, b
        return
    if level > 3:
        while b - a > room:
            cut = a + room
            while cut > a + 1 and _mark(text, cut):
                cut -= 1
            if cut == a + 1:
                cut = a + room
            yield a, cut
            a = cut
        if b > a:
            yield a, b
        return
    edges = [a, *_cuts(text, a, b, level, model), b]
    for x, y in zip(edges, edges[1:], strict=False):
        yield from _parts(text, x, y, room, level + 1, model)


def _overlap_start(text: str, end: int, overlap: int, least: int, model: sentences.Model) -> int:
    """Where the next piece starts: a sentence, else a word, near ``overlap`` characters before ``end``."""
    want = end - overlap
    low, high = max(least, want - NEAR), min(end, want + NEAR)
    if want <= least:
        return max(least, want)
    for level in (1, 2, 3):
        places = [x for x in _cuts(text, max(least, low - 200), end, level, model) if low <= x <= high]
        if places:
            return min(places, key=lambda x: (abs(x - want), x))
    while want > low and _mark(text, want):
        want -= 1
    return want


def split(text: str | None, limit: int, overlap: int, model: sentences.Model) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of the pieces: ``fresh`` is where text not in the piece before begins."""
    if not text or len(text) <= limit:
        return []
    room = limit - overlap - NEAR
    if room < 1 or overlap < 0:
        raise ValueError("the limit must leave room beside the overlap")
    packed: list[list[int]] = []
    for a, b in _parts(text, 0, len(text), room, 0, model):
        if packed and b - packed[-1][0] <= (room if len(packed) > 1 else limit):
            packed[-1][1] = b
        else:
            packed.append([a, b])
    out = [(0, 0, packed[0][1])]
    for a, b in packed[1:]:
        start = _overlap_start(text, a, overlap, max(out[-1][0] + 1, b - limit), model) if overlap else a
        out.append((start, a, b))
    return out


PIECES = "word_id bigint, field_name string, item_no int, piece_no int, piece_start int, fresh_start int, piece_end int, piece string"


def pieces(items: DataFrame, model: sentences.Model) -> DataFrame:
    """Pieces of the oversized among items (word_id, field_name, item_no, text, size_limit, overlap)."""
    weights, links = model.weights, model.links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sentences.Model(weights, links)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = ["word_id", "field_name", "item_no", "piece_no", "piece_start", "fresh_start", "piece_end", "piece"]
        for batch in batches:
            rows = []
            for key, field, item, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for n, (a, fresh, b) in enumerate(split(text, limit, overlap, own)):
                    rows.append((key, field, item, n, a, fresh, b, text[a:b]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

    return items.select("word_id", "field_name", "item_no", "text", "size_limit", "overlap").mapInArrow(run, PIECES)
