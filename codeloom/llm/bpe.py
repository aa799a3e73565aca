"""Encoding of whole texts with a byte-level BPE vocabulary file, and decoding.

Plan: the JVM cuts every text into words with the vocabulary's own pattern (whole-stage code, no Python), Arrow hands
the words over, and each Python worker looks at distinct words only. Words it has not met yet are encoded all at once
by a recursive DuckDB query: token-position rows join the merge table, every word contracts the occurrences of its
minimum-rank pair from left to right, until no word has a pair left; an ordered aggregation gives the ids. The recursion
keeps one row per position, its last: a word's rows of its last round are its tokens. A word takes as many rounds as it
has distinct merges, so the time for one unbroken word of n letters grows with n times those, and is one task's.
Ids are assembled per text with Arrow's take, without a Python loop over tokens.

Null and empty texts get an empty list. Texts with characters the JVM's Unicode tables don't know are cut in the
worker with the same pattern. No special tokens are added or recognised.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern of the vocabulary, for the JVM (which needs its blanks spelled out) and for Python.
JVM_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: Characters the JVM's Unicode tables don't know.
UNKNOWN = r"\p{Cn}"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A worker forgets its words when it has met so many distinct ones.
MOST_WORDS = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """folder, else CODELOOM_TOKENIZERS, else where the tokenizer files are installed."""
    folder = folder or os.environ.get("CODELOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for b, c in [*((b, b) for b in plain), *((b, 256 + i) for i, b in enumerate(rest))]}


@lru_cache(maxsize=4)
def load(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int, int]]]:
    """(bytes of each token to its id, rows (left, right, rank, new) of the merge table)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, alphabet = model["vocab"], _alphabet()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)]
    tokens = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if all(c in alphabet for c in t)}
    return tokens, merges


ENCODE = """
with recursive state(w, pos, round, tok) using key (w, pos) as (
    select w, pos, 0, tok from pieces
    union all
    select w, pos, round + 1, tok from (
        select round, w, pos, case when take then new else tok end as tok,
               coalesce(lag(take) over (partition by w order by pos), false) as swallowed
        from (
            select round, w, pos, tok, new,
                   hit and sum(hit::int) over (partition by w, island order by pos) % 2 = 1 as take
            from (
                select *, sum((not hit)::int) over (partition by w order by pos) as island
                from (
                    select *, coalesce(rank = best, false) as hit
                    from (
                        select s.round, s.w, s.pos, s.tok, m.rank, m.new, min(m.rank) over (partition by s.w) as best
                        from (select *, lead(tok) over (partition by w order by pos) as nxt from state) s
                        left join merges m on m.l = s.tok and m.r = s.nxt
                    ) where best is not null
                )
            )
        )
    ) where not swallowed
)
select w, list(tok order by pos) as ids
from (select *, max(round) over (partition by w) as last from state) where round = last
group by w order by w
"""


class WordEncoder:
    """Encodes distinct words with a DuckDB of its own; keeps what it has encoded."""

    def __init__(self, path: str):
        import duckdb

        self.tokens, merges = load(path)
        self.byte_ids = np.array([self.tokens.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB"})
        table = np.array(merges, dtype=np.int32).reshape(-1, 4)
        merges_ = pa.table({k: table[:, i] for i, k in enumerate(("l", "r", "rank", "new"))})
        self.db.register("merges_", merges_)
        self.db.execute("create table merges as select * from merges_")
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.known = pa.array([], pa.list_(pa.int32()))

    def positions(self, words: list[str]) -> np.ndarray:
        """Where each word's ids are in self.known; encodes the new ones."""
        if len(self.index) > MOST_WORDS:
            self.reset()
        new = [w for w in words if w not in self.index]
        if new:
            self.known = pa.concat_arrays([self.known, self._encode(new)])
            start = len(self.index)
            self.index.update((w, start + i) for i, w in enumerate(new))
        return np.fromiter((self.index[w] for w in words), dtype=np.int64, count=len(words))

    def _encode(self, words: list[str]) -> pa.Array:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        pos = (np.arange(len(word)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        pieces = pa.table({"w": word, "pos": pos, "tok": tok})
        self.db.register("pieces", pieces)
        rows = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("pieces")
        ids = rows["ids"].combine_chunks()
        return (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).cast(pa.list_(pa.int32()))


def gather(lists: pa.Array, chosen: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each text the concatenation of lists[chosen[i]] for i within bounds."""
    picked = lists.take(pa.array(chosen))
    inner = np.asarray(picked.offsets)
    values = picked.flatten()
    return pa.ListArray.from_arrays(pa.array((inner - inner[0])[bounds], pa.int32()), values)


def words_of(text: Column | str) -> Column:
    """The words of a text; null for null texts and for those whose characters the JVM doesn't know."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(~text.rlike(UNKNOWN), F.regexp_extract_all(text, F.lit(JVM_PATTERN), F.lit(0)))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row; other columns are ignored, repeated rows stay."""
    vocab = path or vocabulary_path()
    rows = docs.select(F.col(key).alias("key"), words_of(text).alias("words"), F.when(F.col(text).rlike(UNKNOWN), F.col(text)).alias("odd"))
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        own = regex.compile(PATTERN)
        encoder = WordEncoder(vocab)
        for batch in batches:
            words, odd = batch.column("words"), batch.column("odd")
            if odd.null_count < len(odd):
                texts = odd.to_pylist()
                words = pa.array(
                    [own.findall(t) if t is not None else w for t, w in zip(texts, words.to_pylist())], pa.list_(pa.string())
                )
            words = words.fill_null([]) if words.null_count else words
            flat = words.flatten()
            offsets = np.asarray(words.offsets)
            coded = pc.dictionary_encode(flat)
            place = encoder.positions(coded.dictionary.to_pylist())
            chosen = place[np.asarray(coded.indices)] if len(flat) else np.empty(0, np.int64)
            ids = gather(encoder.known, chosen, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], names=[key, "ids"])

    return rows.mapInArrow(run, f"{key} {key_type.simpleString()}, ids array<int>")


DECODE = """
select t.doc, string_agg(v.hex, '' order by t.pos) as hex
from ids t left join vocabulary v on v.id = t.id group by t.doc order by t.doc
"""


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids): the way back, an ordered aggregation in DuckDB per batch."""
    vocab = path or vocabulary_path()
    key_type = encoded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB"})
        tokens, _ = load(vocab)
        vocabulary = pa.table({"id": pa.array(list(tokens.values()), pa.int32()), "hex": [t.hex() for t in tokens]})
        db.register("vocabulary", vocabulary)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            offsets = np.asarray(lists.offsets)
            sizes = np.diff(offsets)
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            pos = np.arange(len(doc), dtype=np.int64)
            ids = pa.table({"doc": doc, "pos": pos, "id": lists.flatten()})
            db.register("ids", ids)
            texts = [""] * len(sizes)
            for d, hexes in db.execute(DECODE).fetchall():
                texts[d] = bytes.fromhex(hexes).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {key_type.simpleString()}, text string")


@lru_cache(maxsize=4)
def _counter(path: str):
    import tiktoken

    tokens, _ = load(path)
    special = {"<|endoftext|>": len(tokens)}
    plain = {t: i for t, i in tokens.items() if t != b"<|endoftext|>"}
    return tiktoken.Encoding("codeloom", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={k: v for k, v in special.items() if v not in plain.values()})


def token_counts(texts: Iterable[str | None], path: str) -> list[int]:
    """How many tokens each text has, by a compiled encoder of the same vocabulary; 0 for null."""
    encoder = _counter(path)
    return [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]
