"""Cutting oversized texts into overlapping pieces at natural boundaries.

Sizes are tokens of a public tokenizer. Candidate cuts are headings, paragraphs, lines and sentences; where a stretch
has none for long, word ends, and where it has no word ends either, token ends that don't split a character. Dynamic
programming over the candidates minimises the sum of cut penalties and squared deviations from equal sizes, subject
to the maximum length. Each piece after the first starts `overlap` tokens before the cut (at the character start at
or before that token, where a token holds part of a character only).

Every piece is at most `limit` tokens, counted over its own text; only a single character that has more by itself is a
longer piece. Where the limit is so near the overlap that no division gives whole overlaps, pieces repeat less. Texts
within the limit, empty and null ones have no rows. Repeated documents are cut each. Whole texts are used, however long; one text is the unit of work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import bpe

# Kinds of cut with their penalties, the better first.
HEADING, PARAGRAPH, LINE, SENTENCE, WORD, TOKEN = range(6)
KINDS = ("heading", "paragraph", "line", "sentence", "word", "token")
PENALTY = np.array([0.0, 0.2, 0.5, 0.9, 2.0, 4.0])
#: Weight of a piece's squared relative deviation from the equal size.
BALANCE = 2.0

_LINE = re.compile(rb"\n(?=[^\n])")
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n(?=[^\n])")
_HEADING = re.compile(rb"\n(?=#{1,6} |={3,}|[^\n]{1,80}\n[=-]{3,}\n)")
_SENTENCE = re.compile(rb"[.!?](?=[ \t\n])|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xd8\x9f|\xe0\xa5\xa4")
_WORD = re.compile(rb"[^ \t\r\n](?=[ \t\r\n])")


def candidates(raw: bytes, ends: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(token index, kind) of the possible cuts, sorted; index i cuts before token i. ends: byte end of each token."""
    kinds = np.full(len(ends) + 1, 99, dtype=np.int8)
    starts = np.concatenate([[0], ends])

    def mark(pattern: re.Pattern, kind: int) -> None:
        at = np.fromiter((m.end() for m in pattern.finditer(raw)), dtype=np.int64)
        if len(at):
            i = np.minimum(np.searchsorted(starts, at), len(ends))
            kinds[i[starts[i] == at]] = kind

    for pattern, kind in ((_SENTENCE, SENTENCE), (_LINE, LINE), (_PARAGRAPH, PARAGRAPH), (_HEADING, HEADING)):
        mark(pattern, kind)
    kinds[0] = kinds[-1] = HEADING
    if _fill(kinds, room):
        rest = kinds.copy()
        mark(_WORD, WORD)
        kinds[rest < 99] = rest[rest < 99]
        data = np.frombuffer(raw, dtype=np.uint8)
        inner = starts[1:-1]
        whole = np.flatnonzero((data[inner] & 0xC0) != 0x80) + 1
        for low, high in _fill(kinds, room):
            fine = whole[(whole > low) & (whole < high)]
            fine = fine[kinds[fine] == 99]
            kinds[fine] = TOKEN
    index = np.flatnonzero(kinds < 99)
    return index, kinds[index]


def _fill(kinds: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The stretches longer than room without a candidate."""
    at = np.flatnonzero(kinds < 99)
    wide = np.flatnonzero(np.diff(at) > room)
    return [(at[i], at[i + 1]) for i in wide]


def best_cuts(index: np.ndarray, kinds: np.ndarray, starts: np.ndarray, limit: int, ideal: float) -> list[int] | None:
    """Positions in index of the cuts of the cheapest division; None if there is none.

    starts: for each candidate the token at which the next piece would begin.
    """
    n = len(index)
    cost = np.full(n, np.inf)
    cost[0] = 0.0
    back = np.zeros(n, dtype=np.int64)
    penalty = PENALTY[kinds].copy()
    penalty[-1] = 0.0
    low = np.searchsorted(starts, index - limit).tolist()
    # The square of (end - start) / ideal - 1, taken apart so that a step is one product and one sum over its window.
    weight = BALANCE**0.5 / ideal
    begin = starts * weight + BALANCE**0.5
    end = (index * weight).tolist()
    open_ = np.full(n, np.inf)
    open_[0] = begin[0] ** 2
    for j in range(1, n):
        i = low[j]
        if i >= j:
            continue
        x = end[j]
        total = open_[i:j] - begin[i:j] * (2.0 * x)
        k = int(total.argmin())
        cost[j] = total[k] + x * x + penalty[j]
        back[j] = i + k
        open_[j] = cost[j] + begin[j] ** 2
    if not np.isfinite(cost[-1]):
        return None
    out = [n - 1]
    while out[-1]:
        out.append(int(back[out[-1]]))
    return out[::-1]


@lru_cache(maxsize=4)
def _token_lengths(path: str) -> np.ndarray:
    tokens, _ = bpe.load(path)
    out = np.zeros(max(tokens.values()) + 1, dtype=np.int64)
    for raw, i in tokens.items():
        out[i] = len(raw)
    return out


def pieces(text: str, encoder, lengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(start byte, end byte, tokens, tokens repeated, kind of the cut at the end) of each piece; [] within the limit."""
    ids = encoder.encode_to_numpy(text, disallowed_special=())
    if len(ids) <= limit:
        return []
    raw = text.encode("utf-8")
    ends = np.cumsum(lengths[ids])
    bytes_at = np.concatenate([[0], ends])
    data = np.concatenate([np.frombuffer(raw, dtype=np.uint8), [0]])
    whole = (data[bytes_at] & 0xC0) != 0x80
    floor = np.maximum.accumulate(np.where(whole, np.arange(len(whole)), 0))
    index, kinds = candidates(raw, ends, max(1, (limit - overlap) // 3))
    cap = limit
    while cap - overlap >= 1:
        starts = floor[np.maximum(index - overlap, 0)]
        parts = max(2, -(-(len(ids) - overlap) // (cap - overlap)))
        cuts = best_cuts(index, kinds, starts, cap, (len(ids) - overlap) / parts + overlap)
        if cuts is None:
            # No candidate within reach somewhere: allow every whole character.
            every = np.flatnonzero(whole)
            known = np.full(len(whole), TOKEN, dtype=np.int8)
            known[index] = kinds
            if len(every) == len(index):
                break
            index, kinds = every, known[every]
            continue
        out, over = [], 0
        count = _counter_of(raw, data, bytes_at, encoder)
        for a, b in zip(cuts, cuts[1:]):
            first, last = (int(starts[a]) if a else 0), int(index[b])
            low, high = int(bytes_at[first]), int(bytes_at[last])
            n = count(low, high)
            over = max(over, n - limit)
            out.append((low, high, n, (int(index[a]) - first) if a else 0, KINDS[kinds[b]] if b < len(index) - 1 else "end"))
        if over <= 0:
            return out
        # A piece's own text took more tokens than its part of the whole: leave that much room.
        cap -= over
    return _one_by_one(raw, bytes_at, whole, floor, _counter_of(raw, data, bytes_at, encoder), limit, overlap)


def _one_by_one(raw: bytes, bytes_at: np.ndarray, whole: np.ndarray, floor: np.ndarray, count, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Where the limit leaves hardly any room beside the overlap: each piece as long as its own tokens allow, at least one
    character beyond what it repeats, of which it repeats less if that is the only way."""
    ends = np.flatnonzero(whole)[1:]
    out, cut = [], 0
    while cut < len(whole) - 1:
        low = int(bytes_at[floor[max(cut - overlap, 0)]]) if cut else 0
        later = ends[ends > cut]
        fits = 0
        while fits < len(later) and count(low, int(bytes_at[later[fits]])) <= limit:
            fits += 1
        if not fits:
            while low < int(bytes_at[cut]) and count(low, int(bytes_at[later[0]])) > limit:
                low += 1
                while (raw[low] & 0xC0) == 0x80:
                    low += 1
            fits = 1
        end = int(later[fits - 1])
        first = int(np.searchsorted(bytes_at, low))
        out.append((low, int(bytes_at[end]), count(low, int(bytes_at[end])), max(cut - first, 0), KINDS[TOKEN] if end < len(whole) - 1 else "end"))
        cut = end
    return out


def _counter_of(raw: bytes, data: np.ndarray, bytes_at: np.ndarray, encoder):
    """A function of (start, end byte): the tokens of that part taken by itself.

    No word of the vocabulary's pattern spans the end of a visible ASCII character before a blank, so between the first
    and the last such place the tokens are those of the whole text; only what is outside them is encoded again.
    """
    visible = (data[:-1] > 32) & (data[:-1] < 127)
    blank = np.isin(data[1:], (9, 10, 13, 32))
    safe = np.flatnonzero(visible & blank) + 1
    own = lambda part: len(encoder.encode_ordinary(part.decode("utf-8")))

    def count(low: int, high: int) -> int:
        a, b = np.searchsorted(safe, (low, high), side="right")
        if b - a < 2:
            return own(raw[low:high])
        first, last = int(safe[a]), int(safe[b - 1])
        if last == high:
            last = int(safe[b - 2])
        inner = np.searchsorted(bytes_at, (first, last))
        return own(raw[low:first]) + int(inner[1] - inner[0]) + own(raw[last:high])

    return count


def split_oversized(docs: DataFrame, limit: int = 512, overlap: int = 64, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_no from 1, start_char, end_char, n_tokens, overlap_tokens, cut, text) of each oversized text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    vocab = path or bpe.vocabulary_path()
    key_type = docs.schema[key].dataType
    # A text has no more tokens than bytes.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    names = [key, "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens", "cut", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = bpe._counter(vocab), _token_lengths(vocab)
        for batch in batches:
            keys = batch.column("key")
            took: list[int] = []
            columns: list[list] = [[] for _ in names[1:]]
            for row, value in enumerate(batch.column("text").to_pylist()):
                raw, char, at = value.encode("utf-8"), 0, 0
                for no, (low, high, n, repeated, kind) in enumerate(pieces(value, encoder, lengths, limit, overlap), 1):
                    char += len(raw[at:low].decode("utf-8")) if low >= at else -len(raw[low:at].decode("utf-8"))
                    at = low
                    piece = raw[low:high].decode("utf-8")
                    took.append(row)
                    for column, v in zip(columns, (no, char, char + len(piece), n, repeated, kind, piece)):
                        column.append(v)
            kinds = [pa.int32()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(took, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    return rows.mapInArrow(run, f"{key} {key_type.simpleString()}, piece_no int, start_char int, end_char int, n_tokens int, overlap_tokens int, cut string, text string")
