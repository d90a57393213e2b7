"""Cutting oversized texts at natural boundaries.

Lexical cohesion: the words in the block before a possible cut are compared with those in the block after it. Where
their similarity has a deep valley, the topic changes. A piece ends at the deepest valley among the ends of lines within its
window; where valleys are about as deep (LIKE), the end of a definition, section or paragraph goes before that of a line.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters on either side of a possible cut whose words are compared.
BLOCK = 600
#: Valleys that differ by less than this in depth, a difference of cosines, count as equally deep.
LIKE = 0.05
_WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+|[^\x00-\x7f]")
_DEFINITION = re.compile(r"(?:export |public |private |protected |static |async |final |abstract |pub(?:\([a-z]+\))? |default |unsafe |#\[|@\w)*(?:def|class|func|function|fn|impl|struct|enum|trait|interface|type|const|let|var|module|namespace|package|mod|use|import|resource|\[|FROM|RUN)\b|@\w|#\[|\[\[?\w")
_HEADING = re.compile(r"#{1,6} |={3,}|-{3,}|\S.{0,200}:$", re.M)
_BLANK = re.compile(r"[^\S\n]*(?:\n|\Z)")
_INDENT = re.compile(r"[ \t]*")
_SENTENCE = re.compile(r"[.!?。！？][\"')\]]*(?:[ \t]+|(?<=[。！？])|(?=\n|$))")
PROSE_ENDINGS = (".md", ".txt", ".rst", ".adoc", ".markdown")


class Lines:
    """The line ends of a text, found once."""

    def __init__(self, text: str) -> None:
        self.ends = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
        self.size = len(text)

    def end(self, at: int) -> int:
        """The first line end at or after a place, or the end of the text."""
        i = bisect_left(self.ends, at)
        return int(self.ends[i]) if i < len(self.ends) else self.size

    def start(self, at: int) -> int:
        """Where the line of a place begins."""
        i = bisect_left(self.ends, at)
        return int(self.ends[i - 1]) + 1 if i else 0

    def within(self, start: int, stop: int) -> np.ndarray:
        """The line ends from start on that lie before stop."""
        return self.ends[bisect_left(self.ends, start) : bisect_left(self.ends, stop)]


def _places(text: str, lines: Lines, start: int, stop: int, prose: bool, nested: bool) -> dict[int, int]:
    """Places within (start, stop] where a piece may end, with their rank: 3 a part ends, 2 a line, 1 a sentence within a line."""
    at: dict[int, int] = {}
    for i in lines.within(max(0, start), stop).tolist():
        after = i + 1
        blank_before = text[lines.start(i) : i].isspace() or lines.start(i) == i
        part = blank_before and not _BLANK.match(text, after)
        if prose:
            part = part or bool(_HEADING.match(text, after))
        else:
            # within a symbol its own parts are indented
            begins = _INDENT.match(text, after).end() if nested else after
            part = (part and not text[after : after + 1].isspace()) or (bool(_DEFINITION.match(text, begins)) and (nested or text[i - 1 : i] in ("}", "\n", "")))
        at[after] = 3 if part else 2
    if prose:
        for m in _SENTENCE.finditer(text, max(0, start), stop):
            if start < m.end() <= stop:
                at.setdefault(m.end(), 1)
    return at


def _cohesion(text: str, places: list[int]) -> np.ndarray:
    """How alike the words of the blocks before and after each place are, as a cosine."""
    base = max(0, places[0] - BLOCK)
    found = [(m.start() + base, m[0]) for m in _WORDS.finditer(text[base : places[-1] + BLOCK].lower())]
    if not found:
        return np.zeros(len(places))
    ids: dict[str, int] = {}
    word = np.array([ids.setdefault(w, len(ids)) for _, w in found])
    pos = np.array([p for p, _ in found])
    sums = np.zeros((len(word) + 1, len(ids)), np.float32)
    sums[np.arange(1, len(word) + 1), word] = 1
    np.cumsum(sums, axis=0, out=sums)
    at = np.array(places)
    mid, lo, hi = (np.searchsorted(pos, x) for x in (at, at - BLOCK, at + BLOCK))
    left, right = sums[mid] - sums[lo], sums[hi] - sums[mid]
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    return np.divide((left * right).sum(1), norm, out=np.zeros(len(places), np.float32), where=norm > 0)


def _deepest(text: str, places: dict[int, int]) -> int:
    """The place whose cohesion lies lowest below the heights to its left and right; of about equal valleys that of the highest rank, then the deepest, then the last."""
    at = sorted(places)
    c = _cohesion(text, at)
    depth = np.maximum.accumulate(c) + np.maximum.accumulate(c[::-1])[::-1] - 2 * c
    return at[max(np.flatnonzero(depth >= depth.max() - LIKE), key=lambda i: (places[at[i]], round(float(depth[i]), 6), i))]


def split(text: str, limit: int, overlap: int, prose: bool, nested: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, cut) of each piece: at most limit characters, cut 'natural', 'forced' or 'end' after what ends it.

    A piece begins up to overlap characters before the end of the one before, at a line or sentence; where none begins
    there, at a word, else overlap characters before. Line ends are always tried before a line is cut, so a cut is forced
    only inside a line that alone is longer than limit; there it falls at the deepest valley between sentences (in prose)
    or words if it can, and never between the halves of a CRLF. An overlap is shortened only where a whole line would be cut for it.
    nested tells that the text is one symbol, whose parts are indented. Time grows with the length of the text, however long its lines are.
    """
    pieces: list[tuple[int, int, str]] = []
    lines = Lines(text)
    done, n = 0, len(text)
    natural = lambda places: {p: r for p, r in places.items() if r >= 2}
    while True:
        least = max(done - overlap, pieces[-1][0] + 1) if done and overlap else done
        start = _begin(text, lines, least, done, prose, nested)
        if n - start <= limit:
            pieces.append((start, n, "end"))
            return pieces
        stop = start + limit
        places = _places(text, lines, done, stop, prose, nested)
        late = {p: r for p, r in places.items() if p > done + limit // 2} or places
        if not natural(late) and start < done and text[done - 1] == "\n":  # the overlap may not cost a natural cut
            if n - done <= limit:
                pieces.append((_begin(text, lines, max(least, n - limit), done, prose, nested), n, "end"))
                return pieces
            if text[done + limit : done + limit + 1] == "\n" or text[done + limit : done + limit + 2] == "\r\n":
                stop = done + limit
            places = _places(text, lines, done, done + limit, prose, nested)
            if natural(places) or stop == done + limit:
                late = {p: r for p, r in places.items() if p > done + limit // 2} or places
            else:
                places = {p: r for p, r in places.items() if p <= stop}
        cut = "natural"
        if natural(late):
            end = _deepest(text, natural(late))
        elif text[stop : stop + 1] == "\n" or text[stop : stop + 2] == "\r\n":
            end = stop
        elif natural(places):
            end = max(natural(places))
        else:
            line = lines.start(done) if done and text[done - 1] != "\n" else done
            cut = "forced" if lines.end(done) - line > limit else "natural"
            end = _deepest(text, late or dict.fromkeys(_word_ends(text, done + limit // 2, stop) or [stop], 0))
        if end - start > limit:
            start = _begin(text, lines, max(least, end - limit), done, prose, nested)
        pieces.append((start, end, cut))
        done = end


def _word_ends(text: str, start: int, stop: int) -> list[int]:
    """Places within (start, stop] that are not inside a word, nor between the halves of a CRLF."""
    return [i for i in range(start + 1, stop + 1) if not (text[i - 1].isalnum() and text[i].isalnum()) and text[i - 1 : i + 1] != "\r\n"]


def _begin(text: str, lines: Lines, least: int, done: int, prose: bool, nested: bool) -> int:
    """Where within [least, done) a piece begins that repeats what stands before done: the first line or (in prose) sentence there, else the first word, else least."""
    if least >= done:
        return done
    behind = [p for p in _places(text, lines, least - 1, done - 1, prose, nested) if p >= least]
    words = (p for p in range(least, done) if text[p].isalnum() and not text[p - 1].isalnum())
    start = min(behind) if behind else next(words, least)
    return done if text[start - 1 : start + 1] == "\r\n" else start


def cut_oversized(rows: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", path_col: str = "path", kind_col: str = "kind", limit: int = 8000, overlap: int = 400) -> DataFrame:
    """(id, piece, start, end, cut, text): the pieces of every text of more than limit Unicode characters.

    piece counts from 0; start and end are character offsets, start of a later piece at most overlap before the end of the
    one before, so that pieces without their overlaps join to the whole text. cut tells how a piece ends: 'natural',
    'forced' inside a line longer than limit, or 'end'. Texts within the limit, null texts and null ids give no rows;
    a row given twice gives its pieces twice. Null paths are taken as code, whose lines are not cut at sentences; so are symbols
    (kind), whose parts are indented, whatever their path.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, path, kind in zip(batch["id"].tolist(), batch["text"].tolist(), batch["path"].tolist(), batch["kind"].tolist(), strict=True):
                symbol = kind == "symbol"
                prose = not symbol and bool(path) and path.strip().lower().endswith(PROSE_ENDINGS)
                out += [(i, k, s, e, cut, text[s:e]) for k, (s, e, cut) in enumerate(split(text, limit, overlap, prose, symbol))]
            yield pd.DataFrame(out, columns=[id_col, "piece", "start", "end", "cut", "text"], dtype=object)

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cut", T.StringType()), T.StructField("text", T.StringType())])
    large = rows.filter(F.col(id_col).isNotNull() & (F.length(text_col) > limit)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"), F.col(kind_col).alias("kind"))
    return large.mapInPandas(run, schema)


def current_chunks(chunks: DataFrame, limit: int) -> DataFrame:
    """The current rows (greatest ingested_at) of the chunk_ids that have a text beyond the limit, without moving other texts.

    First only ids and times are compared, with partial sums before the shuffle; then the long texts are kept whose time is the greatest.
    """
    newest = chunks.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max("ingested_at").alias("_newest"))
    long = chunks.filter(F.length("text") > limit)
    return long.join(newest, "chunk_id").filter(F.col("ingested_at").eqNullSafe(F.col("_newest"))).dropDuplicates(["chunk_id"]).drop("_newest")
