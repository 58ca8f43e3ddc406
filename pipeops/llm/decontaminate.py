"""Benchmark passages in documents, by pigeonhole pieces and Myers' bit-parallel distance.

An item of ``m`` words may differ from a passage in ``k = floor(error_rate * m)`` words
(replaced, left out or put in). Cut into ``k + 1`` pieces, at least one stands unchanged in
the passage. All pieces of a block of items are searched at once in the words of a document;
around each hit, the item is compared with the words where it could lie by Myers' method: a
bit per word of the item, a few integer operations per word of the document.

The items are a query set: blocks of at most about ``block_words`` words pass through the
driver one at a time, and each is held against all documents where they lie, no shuffle.

Words are runs of letters and digits in lower case, so case, punctuation and white space do
not count; in scripts without blanks (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each
character is one. Defined results: null and wordless texts hold nothing, and null and wordless
items are held by nothing; items of fewer than ``min_words`` words are searched exactly, and so
are items of fewer than ``SHORT_CHARS`` characters in a script without blanks, as a character
says less than a word; ``min_chars`` leaves out what is too short to be evidence (nothing, if
not given); a very long text is searched whole, by one pass over its words; without documents
or items there are no rows; equal items each give a row; repeated documents give repeated rows; of several passages for one item the one with
the least distance, then the first, is reported; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import stored

#: Letters and marks of scripts that put no blanks between words.
UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
WORD = re.compile(f"[^\\W_{UNSPACED}]+|[{UNSPACED}]")
#: Share of an item's words that may differ.
ERROR_RATE = 0.2
MIN_WORDS = 5
#: An item of unspaced letters with fewer characters is searched exactly.
SHORT_CHARS = 16
#: Words of the items that are searched in one pass over the documents.
BLOCK_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def error_budget(words: list[str], error_rate: float, min_words: int = MIN_WORDS, min_chars: int = 1) -> int | None:
    """Words of an item that may differ, none in a short one; None if its words have under ``min_chars`` characters."""
    size = sum(map(len, words))
    if size < max(1, min_chars):
        return None
    if len(words) < min_words or (size < SHORT_CHARS and any(re.match(f"[{UNSPACED}]", word) for word in words)):
        return 0
    return math.floor(error_rate * len(words))


def pieces(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """The words in ``errors + 1`` runs of nearly equal length, each with its place."""
    cuts = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(pattern: list[str], text: Iterable[str]) -> Iterable[int]:
    """For each word of the text the least edits from the pattern to a run that ends there (Myers 1999)."""
    size = len(pattern)
    match: dict[str, int] = {}
    for i, word in enumerate(pattern):
        match[word] = match.get(word, 0) | 1 << i
    mask, last = (1 << size) - 1, 1 << size - 1
    up, down, score = mask, 0, size
    for word in text:
        same = match.get(word, 0)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        rise = down | ~(diagonal | up) & mask
        fall = up & diagonal
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = rise << 1 & mask
        fall = fall << 1 & mask
        up = fall | ~(vertical | rise) & mask
        down = rise & vertical
        yield score


def best_passage(pattern: list[str], words: list[str], errors: int) -> tuple[int, int, int] | None:
    """``(distance, first word, after the last)`` of the nearest run within the error budget."""
    least, end = min(((d, i) for i, d in enumerate(distances(pattern, words))), default=(errors + 1, 0))
    if least > errors:
        return None
    back = words[max(0, end + 1 - len(pattern) - errors) : end + 1][::-1]
    span = next(i for i, d in enumerate(distances(pattern[::-1], back)) if d == least)
    return least, end - span, end + 1


class Block:
    """The pieces of some items ``(key, words, errors)`` in one search automaton."""

    def __init__(self, items: list[tuple]) -> None:
        import ahocorasick

        self.items = items
        wanted: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, words, errors) in enumerate(self.items):
            for place, piece in pieces(words, errors):
                wanted.setdefault(f" {' '.join(piece)} ", []).append((i, place, len(piece)))
        self.search = ahocorasick.Automaton()
        for piece, owners in wanted.items():
            self.search.add_word(piece, owners)
        self.search.make_automaton()  # without words it stays empty, and cannot be searched

    def passages(self, text: str) -> list[tuple]:
        """``(item, words, distance, first word, after the last)`` for each item found."""
        if not self.items:
            return []
        words = words_of(text)
        line = f" {' '.join(words)} "
        starts = None
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, owners in self.search.iter(line):
            if starts is None:
                starts, at = [], 1
                for word in words:
                    starts.append(at)
                    at += len(word) + 1
            after = bisect_right(starts, end)  # words up to the piece's last
            for i, place, length in owners:
                _, item, errors = self.items[i]
                first = after - length - place
                windows.setdefault(i, []).append((max(0, first - errors), first + len(item) + errors))
        found = []
        for i, spans in windows.items():
            key, item, errors = self.items[i]
            best = None
            for a, b in joined(spans):
                passage = best_passage(item, words[a:b], errors)
                if passage and (best is None or passage[0] < best[0]):
                    best = (passage[0], passage[1] + a, passage[2] + a)
            if best:
                found.append((key, len(item), *best))
        return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _held_against(docs: DataFrame, items: list[tuple], item_field: T.StructField) -> DataFrame:
    """The documents' passages for one block of items."""
    fields = [T.StructField(n, T.LongType()) for n in ("item_words", "distance", "start", "end")]
    schema = T.StructType([docs.schema[0], item_field, *fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        block = Block(items)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                value = text.as_py() or ""
                found = block.passages(value)
                if found:
                    places = [m.span() for m in WORD.finditer(value.lower())]
                    # lower case may change the length of a text; then places are those of the lower-cased one
                    rows += [(key.as_py(), item, n, d, places[a][0], places[b - 1][1]) for item, n, d, a, b in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return docs.mapInArrow(run, schema)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, min_chars: int = 1, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``id_col, item_col, item_words, distance, start, end``: a row per document and item it holds.

    ``distance`` counts words, ``start`` and ``end`` are code points of the passage. Items of
    fewer than ``min_words`` words are searched exactly, however short; ``item_words`` tells them
    apart, and ``min_chars`` leaves out those with fewer characters in their words.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    key = F.col(item_col).alias("item_id" if item_col == id_col else item_col)
    asked = benchmark.where(F.col(item_text_col).isNotNull()).select(key, F.col(item_text_col).alias("asked"))
    field = asked.schema[0]
    blanks = F.length("asked") - F.length(F.regexp_replace("asked", r"\s", "")) + 1
    unspaced = F.length(F.regexp_replace("asked", f"[^{UNSPACED}]", ""))
    total = asked.agg(F.sum(blanks + unspaced)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == block).collect()
        items = [(row[0], words, errors) for row in rows if (errors := error_budget(words := words_of(row[1]), error_rate, min_words, min_chars)) is not None]
        part = _held_against(source, sorted(items, key=repr), field)
        if blocks > 1:  # so that the driver lets go of the block
            part = stored(part, "passages")
        found = part if found is None else found.union(part)
    return found
