"""Languages of records and of the segments of mixed records, with a confidence.

Per-language byte context trees (``ppm``) score the exact code length of each piece of text; the
language is the one with the shortest code, and its confidence the posterior ``2^-bits`` over all
languages.  ``fit`` trains the models on a bounded sample of labelled rows (``SAMPLE_ROWS`` rows and
``TRAIN_BYTES`` bytes a language), ``fit_all`` on all rows; labels being wrong in part, pieces are
labelled anew by the words that the rows of each label share.

Rows are first cut into pieces at plain sentence ends and line breaks.  Where all pieces with
evidence agree, that is the row's language.  Other rows are cut into sentence units by the model of
``sentences``, each unit gets its language, and runs of units in one language are the segments.

Defined results: null and blank texts and rows without any sentence or heading (formulas, commands,
sequences, codes, bare names) give no row; such lines neither count nor part a segment; equal counts
of sentences are settled by length in bytes, then by the code of the language; texts are scored whole.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.llm import mojibake, ppm, sentences
from loomsheet.llm.canonical import canonical_batch
from loomsheet.llm.sampling import bounded, spread
from loomsheet.session import checkpoint

SAMPLE_ROWS = 5_000
TRAIN_BYTES = 120_000
#: bits a byte above which a piece of Latin script, or of another, is in none of the languages
NO_LANGUAGE = 4.2
#: bits by which a piece must favour a language to make a row contested
EVIDENCE = 14.0

#: fixed values: names and codes of the languages
NAMES = {
    "en": "en eng english anglais englisch inglés inglês 英语 英文 英語 английский अंग्रेज़ी อังกฤษ",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 中国語 chinesisch chinois chino chinês китайский",
    "de": "de deu ger german deutsch allemand alemán alemão 德语 德文 ドイツ語 немецкий",
    "fr": "fr fra fre french français francais französisch francés francês 法语 法文 フランス語 французский",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol 西班牙语 西语 スペイン語 испанский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués 葡萄牙语 葡语 ポルトガル語 португальский",
    "ja": "ja jpn japanese 日本語 日语 日文 japanisch japonais japonés японский",
    "ru": "ru rus russian русский russisch russe ruso russo 俄语 俄文 ロシア語",
    "hi": "hi hin hindi हिन्दी हिंदी 印地语",
    "th": "th tha thai ไทย ภาษาไทย 泰语 タイ語",
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}
CODES = sorted(NAMES)

_OWN_SCRIPT = {"zh": re.compile(r"[一-鿿]"), "ja": re.compile(r"[぀-ヿ]"), "ru": re.compile(r"[Ѐ-ӿ]{2}"), "hi": re.compile(r"[ऀ-ॿ]"), "th": re.compile(r"[฀-๿]")}
_WRITES = _OWN_SCRIPT | {"ja": re.compile(r"[぀-ヿ一-鿿]")}
_OTHER_SCRIPT = re.compile(r"[Ѐ-ӿऀ-๿぀-ヿ一-鿿]")
#: cheap sign of text that needs its consistent form first: no-width, full-width and mixed-script characters
_DIRTY = re.compile(r"[\u200b-\u200d\u2060\ufeff\u00ad０-９Ａ-Ｚａ-ｚ⼀-⿕ﬀ-ﬆ\u0300-\u036f]|[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z]")
#: a command with options, a long code, phonetic signs
_CODE = re.compile(r"(?:^|\s)--?[a-z][\w-]*(?:\s|=|$)|[<>|]\s*[\w./-]+\.[a-z]{2,5}\s*$|[0-9A-Za-z+/=]{26,}|[ɐ-ʯˈˌː]|\ufffd")
_WORD = re.compile(r"[^\W\d_]{2,}|[぀-ヿ一-鿿]")
#: cheap sign of text garbled by a wrong encoding
_GARBLED = re.compile("[\\x80-\\x9f\\ufffd\\ue000-\\uf8ff\\u2500-\\u257f]|[\\u00a1-\\u00ff]{3}|[\\u00c0-\\u00f4][\\u0080-\\u00bf\\u0152-\\u0192\\u02c6\\u02dc\\u2013-\\u2122]|锟斤|斤拷")
_LOT = re.compile(r"[a-z]{2,4}[-/‐‑]?0{3,}", re.ASCII)
_TOKEN = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]|[^\W\d_\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]+")
_ENDS = (". ", "! ", "? ", "। ", "。", "！", "？", "\r")


def label_language(label: str | None) -> str | None:
    """The language a label names, or None: codes of two and three letters, region suffixes, usual names."""
    if not label:
        return None
    low = label.strip().lower()
    return _BY_NAME.get(low) or _BY_NAME.get(re.split(r"[-_ (（]", low)[0])


def cut(text: str) -> list[str]:
    """Pieces at plain sentence ends, digits alike; a cheap over-segmentation."""
    for digit in "123456789":
        text = text.replace(digit, "0")
    for end in _ENDS:
        text = text.replace(end, end[0] + "\n")
    return [p for p in text.split("\n") if p and not p.isspace()]


def plain(text: str) -> str:
    """A unit in the form pieces have."""
    for digit in "123456789":
        text = text.replace(digit, "0")
    return text.replace("\n", " ")


def _worded(piece: str) -> bool:
    """Whether a piece unlike the training text still has the look of a sentence or heading rather than of bare names."""
    words = re.findall(r"[^\W\d_]{2,}", piece)
    return len(_OTHER_SCRIPT.findall(piece)) > 2 or sum(w.islower() and len(w) > 2 for w in words) > 1 or (len(words) > 2 and piece.isupper())


class Identifier:
    """Scores pieces; equal pieces are scored once per worker within a bounded store."""

    STORE = 150_000

    def __init__(self, models: ppm.Models):
        self.models = models
        self.repairer = mojibake.Repairer(models, mojibake.COMMON, 2)
        self.known: dict[str, tuple[int, float, float, bool]] = {}

    def learn(self, pieces: list[str]) -> None:
        """Make the scores of all pieces known."""
        if len(self.known) > self.STORE:
            self.known = {}
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if not new:
            return
        clean = [p.lower() for p in new]
        dirty = [i for i, p in enumerate(new) if _DIRTY.search(p)]
        for i, form in zip(dirty, canonical_batch([new[i] for i in dirty]), strict=True):
            clean[i] = form.lower()
        data = [p.encode("utf-8", "replace") for p in clean]
        self._store(new, clean, data)
        # pieces garbled by a wrong encoding are scored as restored; where bytes are lost they have no language
        odd = [i for i, p in enumerate(new) if (self.known[p][0] < 0 or self.known[p][3]) and _GARBLED.search(p)]
        gone = {p for p in (new[i] for i in odd) if 6 * len(mojibake.LOST.findall(p)) > len(p)}
        self.known.update((p, (-1, 0.0, 0.0, True)) for p in gone)
        # garbled characters shown within quotation marks don't count
        showing = [(p, bare) for p in new if _GARBLED.search(p) and p not in gone and (bare := mojibake.QUOTED.sub("", p)) != p and not _GARBLED.search(bare)]
        self._store([p for p, _ in showing], [b.lower() for _, b in showing], [b.lower().encode("utf-8", "replace") for _, b in showing])
        shown = {p for p, _ in showing}
        odd = [i for i in odd if new[i] not in gone and new[i] not in shown]
        if odd:
            fixed = self.repairer.repair([new[i] for i in odd])
            lost = [new[i] for i, (text, n) in zip(odd, fixed, strict=True) if n and text == new[i]]
            self.known.update((p, (-1, 0.0, 0.0, True)) for p in lost)
            mended = [(new[i], text) for i, (text, n) in zip(odd, fixed, strict=True) if n and text != new[i]]
            self._store([p for p, _ in mended], [t.lower() for _, t in mended], [plain(t).lower().encode("utf-8", "replace") for _, t in mended])
        # names of samples and lots are in no language: pieces that look like none are scored without them
        again = [i for i, p in enumerate(new) if self.known[p][0] < 0 and _LOT.search(clean[i])]
        if again:
            bare = [_LOT.sub("", clean[i]) for i in again]
            self._store([new[i] for i in again], bare, [p.encode("utf-8", "replace") for p in bare])

    def _store(self, new: list[str], clean: list[str], data: list[bytes]) -> None:
        scripted = {i: _WRITES[c] for i, c in enumerate(self.models.classes) if c in _WRITES}
        for a in range(0, len(data), 4096):
            part = data[a : a + 4096]
            bits = self.models.bits(part)
            order = np.argsort(bits, axis=1)[:, :2]
            lines = np.arange(len(part))
            best = bits[lines, order[:, 0]]
            margin = bits[lines, order[:, 1]] - best
            post = 1 / np.exp2(np.clip(best[:, None] - bits, -60, 0)).sum(axis=1)
            for k, (c, m, p, b) in enumerate(zip(order[:, 0].tolist(), margin.tolist(), post.tolist(), best.tolist(), strict=True)):
                piece = clean[a + k]
                if c in scripted and not scripted[c].search(piece):
                    # a language can't win on text without its script; small models are cheap on unknown text
                    row = bits[k].copy()
                    row[[i for i, script in scripted.items() if not script.search(piece)]] = np.inf
                    first, second = np.argsort(row)[:2]
                    c, b = int(first), float(row[first])
                    m = float(row[second] - row[first]) if np.isfinite(row[second]) else 0.0
                    p = float(1 / np.exp2(np.clip(row[first] - row, -60, 0)).sum())
                odd = b > NO_LANGUAGE * len(part[k]) + 12
                if _CODE.search(piece) or not _WORD.search(piece) or (odd and not _worded(new[a + k])):
                    c, m = -1, 0.0
                self.known[new[a + k]] = (c, m, p, odd)

    def scores(self, pieces: list[str]) -> list[tuple[int, float, float]]:
        """(class or -1, margin in bits, confidence) of pieces already learnt."""
        return [self.known[p][:3] for p in pieces]


def _winner(votes: dict[int, list[float]]) -> int:
    return min(votes, key=lambda c: (-votes[c][0], -votes[c][1], c))


def analyse(rows: list[list[str]], identifier: Identifier, units: sentences.Model) -> list[tuple[int, float, list[tuple[int, float]]]]:
    """(main class or -1, confidence, segments (class, confidence)) of each row of texts in reading order."""
    pieces = [[p for text in row for p in cut(text)] for row in rows]
    identifier.learn([p for row in pieces for p in row])
    out: list[tuple[int, float, list[tuple[int, float]]]] = [(-1, 0.0, [])] * len(rows)
    contested = []
    for r, row in enumerate(pieces):
        votes: dict[int, list[float]] = {}
        strong = set()
        worth = 0.0
        for p, (c, margin, post) in zip(row, identifier.scores(row), strict=True):
            if c < 0:
                continue
            vote = votes.setdefault(c, [0, 0.0, 0.0])
            if margin >= EVIDENCE:
                strong.add(c)
                vote[0] += 1
            vote[1] += margin
            vote[2] += post * len(p)
            worth += len(p)
        if len(strong) > 1:
            contested.append(r)
        elif votes:
            main = _winner(votes)
            out[r] = (main, votes[main][2] / worth, [])
    found = {r: [plain(text[a:b]) for text in rows[r] for a, b in units.units(text)] for r in contested}
    identifier.learn([u for row in found.values() for u in row])
    for r, row in found.items():
        kept = [(u, *s) for u, s in zip(row, identifier.scores(row), strict=True) if s[0] >= 0]
        votes = defaultdict(lambda: [0, 0.0])
        runs: list[list] = []
        for k, (u, c, margin, post) in enumerate(kept):
            if margin < EVIDENCE / 2:  # little evidence: the languages beside it decide where they agree
                beside = {kept[j][1] for j in (k - 1, k + 1) if 0 <= j < len(kept) and kept[j][2] >= EVIDENCE / 2}
                if len(beside) == 1:
                    c = beside.pop()
            votes[c][0] += 1
            votes[c][1] += len(u)
            if not runs or runs[-1][0] != c:
                runs.append([c, 0.0, 0.0])
            runs[-1][1] += post * len(u)
            runs[-1][2] += len(u)
        if votes:
            main = _winner(votes)
            total = sum(v[1] for v in votes.values())
            segments = [(c, s / n) for c, s, n in runs] if len(votes) > 1 else []
            out[r] = (main, votes[main][1] / total, segments)
    return out


def _words(piece: str) -> set[str]:
    """Words of a piece; in scripts without blanks, characters."""
    return set(_TOKEN.findall(piece))


def _teaching(text: str | None) -> list[str]:
    """The pieces of a text that models may learn from."""
    return [p for p in cut((text or "").lower()) if _teaches(p)]


def _teaches(piece: str) -> bool:
    # the signs of garbling and of other forms are all beyond ASCII, or beside such a character
    return len(piece) > 3 and bool(_WORD.search(piece)) and (piece.isascii() or not _GARBLED.search(piece) and not _DIRTY.search(piece)) and not _CODE.search(piece)


class Taught:
    """What pieces teach, by piece: its words, and in a second pass its language and pairs; bounded, for a worker."""

    STORE = 50_000

    def __init__(self, held: dict[str, list[int]] | None = None, sizes: np.ndarray | None = None, codes: list[str] | None = None):
        self.codes = codes or []
        self.place = {w: k for k, w in enumerate(held or ())}
        self.logs = np.log((np.array(list(held.values())) + 0.2) / (sizes + 1)) if held else np.zeros((0, 1))
        self.words: dict[str, tuple[str, ...] | None] = {}
        self.told: dict[str, tuple[str, str, tuple[str, ...]] | None] = {}

    def words_of(self, text: str) -> set[str]:
        """All words of the pieces of a text that teach."""
        out: set[str] = set()
        for piece in cut(text.lower()):
            if piece not in self.words:
                if len(self.words) >= self.STORE:
                    self.words = {}
                self.words[piece] = tuple(map(sys.intern, _words(piece))) if _teaches(piece) else None
            if own := self.words[piece]:
                out.update(own)
            elif own is not None:
                out.add("")
        return out

    def told_of(self, texts: list[str]) -> list[list[tuple[str, str, str, tuple[str, ...]]]]:
        """(language, piece, piece without lots, pairs) of the pieces of texts whose words tell the language."""
        cuts = [cut(t.lower()) for t in texts]
        if len(self.told) >= self.STORE:
            self.told = {}
        new = [p for p in dict.fromkeys(p for row in cuts for p in row) if p not in self.told]
        self.told.update(dict.fromkeys(new))
        new = [(p, words) for p in new if _teaches(p) and (words := _words(p))]
        if new:
            at = np.fromiter((self.place[w] for _, words in new for w in words), np.int64)
            sizes = np.fromiter((len(words) for _, words in new), np.int64, len(new))
            scores = np.add.reduceat(self.logs[at], np.cumsum(sizes) - sizes, axis=0)
            for (piece, _), score, order in zip(new, scores.tolist(), np.argsort(-scores, axis=1, kind="stable").tolist(), strict=True):
                if code := _clear(piece, score, order, self.codes):
                    self.told[piece] = code, _LOT.sub("0", piece), tuple(map(sys.intern, _pairs(piece)))
        return [[(told[0], p, told[1], told[2]) for p in row if (told := self.told[p])] for row in cuts]


def _clear(piece: str, score: list[float], order: list[int], codes: list[str]) -> str | None:
    """The first language in order that a piece may be in by its script, if the next is well behind."""
    first = None
    for k in order:
        if codes[k] in _OWN_SCRIPT and not _OWN_SCRIPT[codes[k]].search(piece):
            continue
        if first is not None:
            return codes[first] if score[first] - score[k] > 1 else None
        first = k
    return None if first is None else codes[first]


def _logs(held: dict[str, list[int]], sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Logarithms of the shares of rows of each label that hold a word."""
    return {w: np.log((np.array(n) + 0.2) / (sizes + 1)) for w, n in held.items()}


def _anew(piece: str, words: set[str], logs: dict[str, np.ndarray], codes: list[str]) -> str | None:
    """The language of a piece by its words, where they tell."""
    if not words:
        return None
    score = np.sum([logs[w] for w in words], axis=0).tolist()
    return _clear(piece, score, sorted(range(len(codes)), key=lambda i: -score[i]), codes)


def train(rows: list[tuple[str | None, str | None]]) -> ppm.Models:
    """Models from (label, text) rows with partly wrong labels; the order of rows fixes the result.

    A wrong row must not teach a language the text of another, which a context tree would learn by
    heart.  So pieces are labelled anew, each by the shares of the rows of each label that hold its
    words: a label with few wrong rows still has most words of another language in few rows only.
    """
    documents: list[tuple[str, list[tuple[str, set[str]]]]] = []
    for label, text in rows:
        code, pieces = label_language(label), _teaching(text)
        if code and pieces:
            documents.append((code, [(p, _words(p)) for p in pieces]))
    total = Counter(code for code, _ in documents)
    codes = sorted(total)
    held: dict[str, list[int]] = {}
    for code, pieces in documents:
        place = codes.index(code)
        for word in set().union(*(w for _, w in pieces)):
            held.setdefault(word, [0] * len(codes))[place] += 1
    sizes = np.array([total[c] for c in codes])
    logs = _logs(held, sizes)
    found: list[tuple[int, str, str]] = []
    for row, (_, pieces) in enumerate(documents):
        for piece, words in pieces:
            if code := _anew(piece, words, logs, codes):
                found.append((row, code, piece))
    return _fit_pieces(_usual(found))


def _usual(found: list[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """(language, piece) without the pieces garbled by a wrong encoding, of (row, language, piece).

    A few rows teach a context tree each garbling by heart. It shows by pairs of characters beyond
    ASCII that hardly any row of the language has: a piece is left out if a fifth of its pairs are such.
    """
    rows: dict[str, set[int]] = defaultdict(set)
    held: dict[str, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
    for row, code, piece in found:
        rows[code].add(row)
        own = held[code]
        for pair in _pairs(piece):
            own[pair].add(row)
    out = []
    for _, code, piece in found:
        if _plausible(piece, {p: len(held[code][p]) for p in _pairs(piece)}, len(rows[code])):
            out.append((code, piece))
    return out


def _plausible(piece: str, held: dict[str, int], rows: int) -> bool:
    """Whether most pairs of a piece are held by more than a few of the rows of its language."""
    pairs = _pairs(piece)
    return sum(held.get(p, 0) < 2 + rows / 100 for p in pairs) <= len(pairs) / 5


def _pairs(piece: str) -> set[str]:
    """Neighbouring characters of which one at least is beyond ASCII."""
    return set() if piece.isascii() else {a + b for a, b in zip(piece, piece[1:], strict=False) if a > "\x7f" or b > "\x7f"}


def _fit_pieces(found: list[tuple[str, str]]) -> ppm.Models:
    """Models of at most ``TRAIN_BYTES`` a language: frequent pieces first, up to half of it, then others of all kinds."""
    room = dict.fromkeys(CODES, TRAIN_BYTES)
    chosen: dict[str, list[bytes]] = {c: [] for c in CODES}
    shown: dict[tuple[str, str], str] = {}
    times: Counter[tuple[str, str]] = Counter()
    for code, piece in found:
        key = (code, _LOT.sub("0", piece))
        shown[key] = piece
        times[key] += 1
    mixed = sorted(shown, key=lambda k: (zlib.crc32(k[1].encode("utf-8", "replace")), k))
    often = sorted((k for k in mixed if times[k] > 2), key=lambda k: -times[k])
    for (code, bare), half in [*((k, True) for k in often), *((k, False) for k in mixed)]:
        piece = shown.get((code, bare))
        if piece is None or (half and room[code] < TRAIN_BYTES // 2):
            continue
        del shown[code, bare]
        data = piece.encode("utf-8", "replace")
        if room[code] >= len(data):
            room[code] -= len(data)
            chosen[code].append(data)
    return ppm.Models.train(chosen)


def fit(table: DataFrame, key: str, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS) -> ppm.Models:
    """Models from at most ``rows`` labelled rows: those with the lowest hash of their key."""
    named = table.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    return train([(r[label], r[text]) for r in bounded(named, key, [label, text], rows).collect()])


def fit_all(table: DataFrame, text: str = "text", label: str = "lang") -> ppm.Models:
    """Models from all labelled rows, and from each piece once, however many bytes a language has.

    As ``train`` does, in steps that each pass over the rows in Arrow batches and add up counts by key:
    words by label, pairs of characters and pieces by language, byte strings by language. What goes to
    the driver and the workers is counts of words, pairs and byte strings, of which texts of a language
    repeat most; texts don't.
    """
    spark = table.sparkSession
    rows = spread(table.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text")))
    counts = "kind string, code string, what string, shown string, n bigint"
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def batch_of(held: dict[tuple[str, str, str], list]) -> pa.RecordBatch:
        columns = [*zip(*held, strict=True)] if held else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([*columns, [v[0] for v in held.values()], [v[1] for v in held.values()]], kinds, strict=True)], names=["kind", "code", "what", "shown", "n"])

    def gather(of: Callable[[list[str], list[str]], Iterator[tuple[str, str, str, str | None]]]) -> DataFrame:
        """Counts of what ``of`` gives for the languages of labels and the texts, added up in each task first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, str, str], list] = {}
            for batch in batches:
                labelled = [(code, own) for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (code := label_language(name))]
                for at in range(0, len(labelled), 200):
                    for kind, c, what, shown in of(*map(list, zip(*labelled[at : at + 200], strict=True))):
                        entry = held.get((kind, c, what))
                        if entry is None:
                            entry = held[kind, c, what] = [shown, 0]
                        entry[1] += 1
                        if shown is not None and shown < entry[0]:
                            entry[0] = shown
                    if len(held) > 100_000:
                        yield batch_of(held)
                        held = {}
            yield batch_of(held)

        return rows.mapInArrow(run, counts).groupBy("kind", "code", "what").agg(F.min("shown").alias("shown"), F.sum("n").alias("n"))

    known: dict[str, Taught] = {}

    def words(labels: list[str], texts: list[str]) -> Iterator[tuple[str, str, str, None]]:
        taught = known.setdefault("words", Taught())
        for code, text in zip(labels, texts, strict=True):
            if own := taught.words_of(text):  # the empty word stands for the row
                yield "row", code, "", None
                for word in own - {""}:
                    yield "word", code, word, None

    def told(df: DataFrame) -> list[tuple[str, str, int]]:
        counted = df.select("code", "what", "n").toArrow()
        return list(zip(*(c.to_pylist() for c in counted.columns), strict=True))

    by_label = told(gather(words))
    total = {code: n for code, word, n in by_label if not word}
    codes = sorted(total)
    sizes = np.array([total[c] for c in codes])
    held: dict[str, list[int]] = {}
    for code, word, n in by_label:
        if word:
            held.setdefault(word, [0] * len(codes))[codes.index(code)] = n
    shared = spark.sparkContext.broadcast((held, sizes))

    def pieces_of(_: list[str], texts: list[str]) -> Iterator[tuple[str, str, str, str | None]]:
        if "told" not in known:
            known["told"] = Taught(*shared.value, codes)
        for row in known["told"].told_of(texts):
            pairs: dict[str, set[str]] = {}
            for code, piece, bare, own in row:
                pairs.setdefault(code, set()).update(own)
                yield "piece", code, bare, piece
            for code, every in pairs.items():
                yield "row", code, "", None
                for pair in every:
                    yield "pair", code, pair, None

    found = checkpoint(gather(pieces_of))
    usual: dict[str, dict[str, int]] = {c: {} for c in CODES}
    for code, pair, n in told(found.filter("kind != 'piece'")):
        usual[code][pair] = n
    judged = spark.sparkContext.broadcast(usual)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen: dict[str, list[bytes]] = {}
            for code, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _plausible(piece, judged.value[code], judged.value[code].get("", 0)):
                    chosen.setdefault(code, []).append(piece.encode("utf-8", "replace"))
            for code, own in chosen.items():
                for length, (keys, n) in enumerate(ppm.counted(own)):
                    yield pa.RecordBatch.from_arrays([pa.array([CODES.index(code)] * len(keys), pa.int32()), pa.array([length] * len(keys), pa.int32()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["place", "length", "string", "n"])

    grams = found.filter("kind = 'piece'").select("code", "shown").mapInArrow(strings, "place int, length int, string bigint, n bigint").groupBy("place", "length", "string").agg(F.sum("n").alias("n"))
    table_of = grams.toArrow()
    place, length, string, n = (table_of.column(c).to_numpy() for c in ("place", "length", "string", "n"))
    by_length = []
    for size in range(ppm.ORDER + 2):
        own = []
        for c in range(len(CODES)):
            at = np.flatnonzero((place == c) & (length == size))
            at = at[np.argsort(string[at])]
            own.append((string[at].astype(np.uint64), n[at]))
        by_length.append(own)
    return ppm.Models.of_counts(CODES, by_length)


LANGUAGE_ROWS = "rec_table string, rec_id bigint, segment_no int, lang string, confidence double, label_right boolean"


def language_rows(records: DataFrame, models: ppm.Models, units: sentences.Model, block: int = 400_000) -> DataFrame:
    """Languages of records (rec_table, rec_id, label, texts array<string>): segment 0 is the main one.

    Further rows are the segments of records in two or more languages. Batches are worked off in
    blocks of about ``block`` characters, so that memory doesn't grow with the texts of a batch.
    """
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast((models, units.weights, units.links))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen, weights, links = shared.value
        identifier, model = Identifier(frozen), sentences.Model(weights, links)
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
        names = ["rec_table", "rec_id", "segment_no", "lang", "confidence", "label_right"]

        def emit(heads: list[tuple], texts: list[list[str]]) -> pa.RecordBatch:
            rows: list[tuple] = []
            for (table, key, label), (main, sure, segments) in zip(heads, analyse(texts, identifier, model), strict=True):
                if main < 0:
                    continue
                lang = frozen.classes[main]
                rows.append((table, key, 0, lang, sure, label_language(label) == lang))
                rows.extend((table, key, i, frozen.classes[c], p, None) for i, (c, p) in enumerate(segments, 1))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            heads, texts, held = [], [], 0
            for i in range(batch.num_rows):
                own = [t for t in batch.column(3)[i].as_py() or () if t]
                heads.append(tuple(batch.column(c)[i].as_py() for c in range(3)))
                texts.append(own)
                held += sum(map(len, own))
                if held >= block:
                    yield emit(heads, texts)
                    heads, texts, held = [], [], 0
            if heads:
                yield emit(heads, texts)

    return records.select("rec_table", "rec_id", "label", "texts").mapInArrow(run, LANGUAGE_ROWS)


def label_counts(rows: list[tuple[str | None, str]]) -> Counter:
    """How often each label language occurs among rows; for reports on a sample."""
    return Counter(label_language(x) for x, _ in rows)
