"""Benchmark decontamination by template canonicalisation.

Words become template words: numbers, names and units turn into typed placeholders, the rest is lower-cased and
stripped of signs. Windows of template words are hashed. The benchmark's windows are also kept as a bitmap of fixed
size, which drops nearly all document windows before the hash join; the join then decides. A run of name words, or of
numbers and units, is one placeholder, so fillers may differ in their number of words. Matches in a row on one diagonal
of document and item positions form a block; blocks that follow each other in both texts on neighbouring diagonals form
an occurrence, so words may be inserted or missing. It counts if it covers enough of the item and its slots are
consistent: each filler of the item corresponds to one filler of the document, so a question with other numbers or
names is caught and a chance meeting of templates is not.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, releasing

WINDOW = 8
#: Share of an item's windows that an occurrence must match; those over an edit count if matches meet around it.
MIN_COVERAGE = 0.5
#: Blocks of an occurrence may be that share of the item's words apart in their diagonals, or a window if that is more.
MAX_DRIFT = 0.25
#: Share of a window's words that must be no placeholders. Items of which no window has so many are matched by all their
#: windows that have SLOTTED_WORDS of them, but must be covered to SLOTTED_COVERAGE; items without those, if verbatim.
MIN_LITERAL = 0.5
SLOTTED_WORDS, SLOTTED_COVERAGE = 2, 0.9
#: Bits of the bitmap of benchmark windows: its size, 2 MB, doesn't depend on the data.
BITMAP_BITS = 24
VOCABULARY_LIMIT = 100_000

UNITS = set(
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent usd eur gbp dollar dollars euro euros cent cents "
    "k c f kb mb gb tb w kw kwh v a hz khz mhz ghz pa kpa j kj cal kcal mph kmh km/h m/s degrees degree".split()
)
# Words that are no names though they often begin a sentence.
OPENERS = set(
    "a about above after again all also although always an and another any anyone are as at because been before below beside besides between both but by can could "
    "did do does during each either even every everyone except few finally find first for from give given had has have he hence her here hers his how however i if in "
    "instead into is it its just last later let many more most much my neither never next no nobody none nor not nothing now of off often on once one only or other our "
    "over perhaps please several she should show since so some someone sometimes soon still such suppose than that the their them then there therefore these they this "
    "those though three through thus to today together tomorrow too two under unless until up upon us use was we were what whatever when whenever where whereas which "
    "while who whoever whom whose why with within without would write yesterday yet you your".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|[a-zA-Z]{1,3})?$")
_SIGNS = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_LITERAL, _NAME, _NUM = 0, 1, 2


class _Vocabulary(dict):
    """Numbers of the words seen lately, and their properties by number."""

    def __init__(self):
        super().__init__()
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.hashes, self.flags = array("Q"), array("B")

    def __missing__(self, word: str) -> int:
        import xxhash

        bare = _SIGNS.sub("", word)
        small = bare.lower()
        number = bool(_NUMBER.match(bare))
        name = not number and len(bare) > 1 and bare[0].isupper() and any(c.islower() for c in bare[1:]) and small not in OPENERS
        pause = word.rstrip("\"')]»”")[-1:] in ".!?:" or word[-1:] in ",;"
        self.hashes.append(xxhash.xxh64_intdigest(small.encode()))
        self.flags.append((_NUM if number else _NAME if name else _LITERAL) | (small in UNITS) << 2 | bool(small) << 3 | pause << 4)
        self[word] = n = len(self.flags) - 1
        return n

    def columns(self) -> tuple:
        """Hash, kind, whether a unit, whether not only signs, whether a pause follows."""
        flags = np.array(self.flags, np.uint8)
        return np.array(self.hashes, np.uint64), flags & 3, (flags >> 2 & 1).astype(bool), (flags >> 3 & 1).astype(bool), (flags >> 4).astype(bool)


@lru_cache(maxsize=1)
def _vocabulary() -> _Vocabulary:
    return _Vocabulary()


_PLACEHOLDERS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)


def template(texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its words and their hashes, the places of its template words, their hashes and whether each is a
    slot. Words of signs only are left out. A capitalised word is a name wherever it stands, but for OPENERS: so a name is
    a slot at the start of a sentence too, and what stands before a question in a text doesn't matter. Name words in a
    row are one slot, and so are numbers and units, up to a pause."""
    vocab = _vocabulary()
    if len(vocab) > VOCABULARY_LIMIT:
        vocab.empty()
    split = [(t or "").split() for t in texts]
    numbers = [np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)) for words in split]
    out = []
    hashes, kind, unit, kept, pause = vocab.columns()
    for words, n in zip(split, numbers, strict=True):
        if len(n) and not (keep := kept[n]).all():
            at = np.flatnonzero(keep)
            words, n = [words[i] for i in at], n[at]
        kinds = kind[n]
        after = np.append(False, kinds[:-1] == _NUM) if len(n) else np.zeros(0, bool)
        kinds = np.where(unit[n] & after, _NUM, kinds)
        own = hashes[n]
        begins = np.ones(len(n), bool)
        begins[1:] = (kinds[1:] == _LITERAL) | (kinds[1:] != kinds[:-1]) | pause[n][:-1]
        at = np.flatnonzero(begins)
        kinds = kinds[at]
        out.append((words, own, np.append(at, len(n)), np.where(kinds == _LITERAL, own[at], _PLACEHOLDERS[kinds]), kinds != _LITERAL))
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of template words, as unsigned longs."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = (total ^ hashes[k : k + n]) * _STEP
            total ^= total >> np.uint64(29)
    return total


def _slots(words: list[str], places: np.ndarray, slot: np.ndarray, at: int, width: int) -> list[str]:
    return ["".join(_SIGNS.sub("", w).lower() for w in words[places[i] : places[i + 1]]) for i in range(at, at + width) if slot[i]]


def _edges(own: list[str], first: bool, last: bool) -> list[str]:
    """An item's fillers; those of a slot that begins or ends the item are marked, as a name before or after the item in a
    document belongs to the same slot there."""
    own = [f"<{own[0]}", *own[1:]] if first else own
    return [*own[:-1], f"{own[-1]}>"] if last else own


def _edges_fit(table: dict[str, str]) -> bool:
    return all(y.endswith(table.get(x[1:], "")) if x[:1] == "<" else y.startswith(table.get(x[:-1], "")) if x[-1:] == ">" else True for x, y in table.items())


def _as_in_item(table: dict[str, str]) -> bool:
    return all(y.endswith(x[1:]) if x[:1] == "<" else y.startswith(x[:-1]) if x[-1:] == ">" else x == y for x, y in table.items())


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, pos, width, h, slots, total (windows kept of the item), words (that those have), least (coverage that an
    occurrence must have at least) and verbatim (windows of plain words, as the template has too few of them)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("item_id", "pos", "width", "h", "slots", "total", "words", "least", "verbatim")}
        for item, (words, own, places, hashes, slot) in zip(rows["item_id"], template(rows["text"]), strict=True):
            width = min(WINDOW, len(hashes))
            found = windows(hashes, width) if width else []
            literal = [int((~slot[i : i + width]).sum()) for i in range(len(found))]
            kept, least = [i for i, n in enumerate(literal) if n >= MIN_LITERAL * width], 0.0
            if not kept:
                kept, least = [i for i, n in enumerate(literal) if n >= SLOTTED_WORDS], SLOTTED_COVERAGE
            verbatim = not kept
            if verbatim:
                width = min(WINDOW, len(words))
                found = windows(own, width) if width else []
                kept, least, slot = list(range(len(found))), 0.0, np.zeros(len(words), bool)
            held = len({i + k for i in kept for k in range(width)})
            for i in kept:
                for k, v in zip(out, (item, i, width, int(found[i].view(np.int64)), _edges(_slots(words, places, slot, i, width), not i and slot[0], i == len(found) - 1 and slot[-1]), len(kept), held, least, verbatim), strict=True):
                    out[k].append(v)
        return out

    return map_texts(benchmark.select("item_id", "text"), run, "item_id long, pos int, width int, h long, slots array<string>, total int, words int, least double, verbatim boolean")


def _bitmap(items: DataFrame) -> np.ndarray:
    """The set of window hashes, by their upper bits, as a bitmap of fixed size."""
    place = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words = items.select(F.shiftright(place, 5).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    for r in words.collect():  # at most 2 ** (BITMAP_BITS - 5) rows, whatever the benchmark's size
        out[r.word] = r.bits
    return out.view(np.uint8)


def document_windows(docs: DataFrame, items: DataFrame, keep_words: bool = True) -> DataFrame:
    """doc_id, start, width, verbatim, h and slots of the document windows whose hashes the bitmap has."""
    kinds = sorted((r.width, r.verbatim) for r in items.select("width", "verbatim").distinct().collect())  # at most 2 * WINDOW values
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(items))

    def run(rows: dict[str, list]) -> dict[str, list]:
        bits = shared.value
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "width", "verbatim", "h", "slots")}
        for doc, (words, own, places, hashes, slot) in zip(rows["doc_id"], template(rows["text"]), strict=True):
            for width, verbatim in kinds:
                found = windows(own if verbatim else hashes, width)
                place = (found >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                for i in np.flatnonzero(bits[place >> 3] >> (place & 7) & 1).tolist():
                    for k, v in zip(out, (doc, i, width, verbatim, int(found[i].view(np.int64)), [] if verbatim else _slots(words, places, slot, i, width)), strict=True):
                        out[k].append(v)
        return out

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, start int, width int, verbatim boolean, h long, slots array<string>", done=None if keep_words else _vocabulary.cache_clear)


def _merged(x: dict[str, str], y: dict[str, str]) -> dict[str, str] | None:
    """Both fillers' tables, or None if an item's filler has two of the document."""
    return x | y if all(x.get(k, v) == v for k, v in y.items()) else None


def _blocks(hits: list[dict]) -> list[tuple[int, int, int, int, dict[str, str]]]:
    """First and last start, first and last pos, fillers: hits in a row on one diagonal, if their slots are consistent."""
    out, rows = [], sorted({(h["start"] - h["pos"], h["start"]): h for h in hits}.items())
    for k, ((diagonal, start), hit) in enumerate(rows):
        if not k or rows[k - 1][0] != (diagonal, start - 1):
            out.append([start, start, hit["pos"], hit["pos"], {}])
        block = out[-1]
        block[1], block[3] = start, hit["pos"]
        for x, y in zip(hit["own"], hit["slots"], strict=True):
            if block[4] is not None:
                block[4] = _merged(block[4], {x: y})
    return sorted(tuple(b) for b in out if b[4] is not None)


def occurrence(hits: list[dict], width: int, total: int, words: int, min_coverage: float) -> tuple[float, bool] | None:
    """Coverage and verbatim of the best occurrence of an item in a text, if one has enough; hits: start, pos, own, slots.

    Each block is joined to the chain of earlier blocks that covers most with it.
    """
    drift, best = max(WINDOW, int(MAX_DRIFT * words)), None
    chains: list[tuple] = []
    for block in sorted(_blocks(hits), key=lambda b: b[:4]):
        first, last, low, high, fillers = block
        own = (set(range(low, high + 1)), set(range(low, high + width)), fillers)
        most = own
        for before, (pos, held, table) in reversed(chains):
            if first - before[0] > 2 * (words + drift):
                break
            if before[1] < last and before[0] < first and before[2] < low and before[3] < high and abs((first - low) - (before[0] - before[2])) <= drift:
                if len(held | own[1]) > len(most[1]) and (both := _merged(table, fillers)) is not None:
                    most = (pos | own[0], held | own[1], both)
        chains.append((block, most))
        coverage = min(1.0, max(len(most[0]) / total, (len(most[1]) - width + 1) / (words - width + 1)))
        if coverage >= min_coverage and _edges_fit(most[2]):
            same = _as_in_item(most[2])
            best = (max(coverage, best[0]), same or best[1]) if best else (coverage, same)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, keep_words: bool = True) -> DataFrame:
    """doc_id, item_id, coverage and verbatim for each document (doc_id, text) that holds a benchmark item (item_id, text).

    coverage is the share of the item's windows that the best occurrence matches, as if its words were in a row; verbatim says that its slots are
    filled as in the item. Null, empty and wordless texts and items match nothing; an item of fewer words than a
    window is one window; repeated rows count once; an item that occurs twice in a text is reported once. Either
    table may be empty. Whole texts are read, other columns are not. keep_words lets workers keep their table of words
    from task to task, which is faster and takes about 100 MB each.
    """
    items = item_windows(benchmark)
    found = document_windows(docs, items, keep_words).join(items.withColumnRenamed("slots", "own"), ["h", "width", "verbatim"])
    hits = (
        found.where(F.size("own") == F.size("slots"))
        .groupBy("doc_id", "item_id")
        .agg(F.collect_set(F.struct("start", "pos", "own", "slots")).alias("hits"), F.first("width").alias("width"), F.first("total").alias("total"), F.first("words").alias("words"), F.first("least").alias("least"))
    )

    def judge(batches):
        for batch in batches:
            rows = [(r["doc_id"], r["item_id"], *best) for r in batch.to_pylist() if (best := occurrence(r["hits"], r["width"], r["total"], r["words"], max(min_coverage, r["least"])))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["doc_id", "item_id", "coverage", "verbatim"])

    return hits.mapInArrow(releasing(judge), "doc_id long, item_id long, coverage double, verbatim boolean")
