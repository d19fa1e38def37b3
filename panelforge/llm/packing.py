"""Packing documents into fixed-length sequences by cutting-stock column generation.

Tokenise once. Each document is cut into whole sequences of ``CAPACITY`` ids and a remainder, and a
remainder of more than half a sequence once more at the half: pieces of at most half a sequence fit
together almost without padding, where longer ones would leave about a tenth. The remainders'
lengths, rounded up to ``GRAIN``, form a histogram of at most CAPACITY / GRAIN classes, whatever the
corpus. On it the cutting-stock linear program (fewest sequences that hold the demand
of each class) is solved by column generation: the master's duals price new patterns through a
knapsack dynamic program. Patterns are rounded down, the small rest is packed by first fit
decreasing. Documents are ranked within their class, and a rank gives the sequence by arithmetic on
the patterns' ranges: nothing larger than the histogram reaches the driver, and the pattern table
that is broadcast is bounded by classes x classes.

The ids come from the merges of the ``tokenizers`` library. Byte-level BPE never joins ids over a
single space between two non-blank characters, so a text's ids are those of its space-led words put
together; a text is first cut at the tokenizer's added tokens, as the library does. Words seen
before come from a cache of bounded size. ``tests/llm`` holds this against the library's encoding
of whole texts.

Defined results: null and empty texts hold only the closing id 0; whole texts count, however long. An
empty table gives no pieces. Repeated rows, and rows that share an id or have none, are packed one by
one; equal lengths lie in the order of id, start and checksum. Only doc_id and text are read, so other
columns may have any name. Ids within a document are neither dropped nor repeated.
"""

from __future__ import annotations

import logging
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

CAPACITY = 1024
GRAIN = 4
END_ID = 0
#: Words in each of the two generations of a worker's cache of ids.
CACHE_WORDS = 400_000
CACHED_MARKS = 20_000
CACHED_LENGTH = 24
#: Rounds of column generation at most; the patterns found until then are used.
MAX_ROUNDS = 4000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, chunk int, idx long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class OddSpaceError(ValueError):
    """A space that is not alone between two non-blank characters: there words can't be taken apart."""


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level BPE writes for bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """ids of a text as little-endian unsigned 32-bit bytes. As a dictionary: a word's ids, with the
    space before it; two generations of CACHE_WORDS words each."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take in or depend on their neighbours can't be cut off")
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split if added else None
        self.model = self.tok.model
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.space = " ".translate(self.letters)
        self.bytes = [struct.pack("<I", i) for i in range(self.tok.get_vocab_size())]
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The library's own encoding of a whole text."""
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, s: str) -> bytes:
        """A piece of the tokenizer's own cutting goes through its merges."""
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.letters))])

    def mark(self, s: str) -> bytes:
        """A short piece without a space: mostly punctuation."""
        found = self.marks.get(s)
        if found is None:
            found = self.piece(s)
            if len(s) <= 4 and len(self.marks) < CACHED_MARKS:
                self.marks[s] = found
        return found

    def run(self, s: str) -> bytes:
        """Any string, by the tokenizer's own pieces; a string that is one piece isn't looked up."""
        parts = self.pieces(s)
        if len(parts) == 1:
            return self.piece(s)
        return b"".join([self[p[1:]] if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() else self.mark(p) for p in parts])

    def letters_only(self, word: str) -> bytes:
        """A word of letters and the space before it are one piece; ASCII letters stand for themselves."""
        if word.isascii():
            return b"".join([self.bytes[t.id] for t in self.model.tokenize(self.space + word)])
        return self.piece(" " + word)

    def __missing__(self, word: str) -> bytes:
        found, keep = self.old.get(word), True
        if found is None:
            if word.isalpha():
                found = self.letters_only(word)
            elif not word or word[0].isspace() or word[-1].isspace():
                raise OddSpaceError
            else:
                n = len(self)
                found = self.run(" " + word)
                keep = len(self) == n and "\n" not in word  # a word just met isn't kept with its marks, too
            keep = keep and len(word) <= CACHED_LENGTH
        if keep:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        if self.cut and any(map(text.__contains__, self.added)):
            return b"".join([self.added.get(p) or self.plain(p) for p in self.cut(text)])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """A text without added tokens. The cache holds no blank words and none that begin or end with
        white space, so a text whose words are all found in it has single spaces only."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.run(first) + b"".join(map(self.__getitem__, rest))
            except OddSpaceError:
                pass
        parts = _split_odd(text)
        return b"".join([self[p[1:]] if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() else self.run(p) for p in parts if p])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """A worker's own, for all the tasks that it runs."""
    return Encoder(path)


_SAFE = re.compile(r"(?<=\S)(?= \S)")


def _split_odd(text: str) -> list[str]:
    at = [0, *[m.start() for m in _SAFE.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]


def _cut(path: str, capacity: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        enc, chunk = encoder(path), TaskContext.get().partitionId()
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        seen: Counter = Counter()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc(text.as_py() or "") + end
                n = len(ids) // 4
                whole = n - n % capacity
                cuts = [*range(0, whole, capacity), *range(whole, n, capacity // 2), n]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    part = ids[4 * s : 4 * e]
                    m = len(part) // 4
                    c = -(-m // grain)
                    rows.append((doc, s, m, zlib.crc32(part), n, c, chunk, seen[c]))
                    seen[c] += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "chunk", "idx"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Best pattern: values[c - 1] is the price of a piece of c grains; any number of each."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        total = values[:c] + best[c - 1 :: -1][:c]
        k = int(total.argmax())
        if total[k] > best[c - 1] + 1e-12:
            best[c], take[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = Counter()
    c = capacity
    while c > 0:
        if take[c]:
            pattern[int(take[c])] += 1
            c -= int(take[c])
        else:
            c -= 1
    return float(best[capacity]), dict(pattern)


def column_generation(demand: dict[int, int], capacity: int, max_rounds: int = MAX_ROUNDS) -> list[tuple[dict[int, int], float]]:
    """The linear program's patterns and how often each is used: a revised simplex on the classes
    in demand, starting from patterns of one class each."""
    classes = sorted(c for c, n in demand.items() if n > 0)
    m = len(classes)
    if not m:
        return []
    row = {c: i for i, c in enumerate(classes)}
    patterns = [{c: capacity // c} for c in classes]
    inverse = np.diag([1.0 / (capacity // c) for c in classes])
    d = np.asarray([float(demand[c]) for c in classes])
    x = inverse @ d
    for i in range(max_rounds):
        dual = inverse.sum(axis=0)
        prices = np.full(capacity, -1.0)
        for c in classes:
            prices[c - 1] = dual[row[c]]
        value, new = knapsack(prices, capacity)
        if value <= 1 + 1e-7:
            break
        if i == max_rounds - 1:
            logging.getLogger(__name__).warning("column generation ended after %d rounds, %.2g from optimal", max_rounds, value - 1)
        column = np.zeros(m)
        for c, k in new.items():
            column[row[c]] = k
        move = inverse @ column
        ok = move > 1e-9
        ratio = np.where(ok, x / np.where(ok, move, 1), np.inf)
        out = int(ratio.argmin())
        theta = max(ratio[out], 0.0)
        x = np.maximum(x - theta * move, 0)
        x[out] = theta
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        patterns[out] = new
        if i % 400 == 399:  # rounding errors don't pile up
            basis = np.zeros((m, m))
            for j, p in enumerate(patterns):
                for c, k in p.items():
                    basis[row[c], j] = k
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ d, 0)
    return [(p, float(n)) for p, n in zip(patterns, x, strict=True) if n > 1e-9]


def plan(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns that hold exactly the demand: the program's, rounded down, then first fit
    decreasing for what is left (fewer pieces than classes x pieces in a pattern)."""
    left = Counter({c: n for c, n in demand.items() if n > 0})
    plans: list[tuple[dict[int, int], int]] = []
    if n := left.pop(capacity, 0):
        plans.append(({capacity: 1}, n))
    for p, x in column_generation(dict(left), capacity):
        n = min(int(x + 1e-6), *[left[c] // k for c, k in p.items()])
        if n > 0:
            plans.append((p, n))
            for c, k in p.items():
                left[c] -= n * k
    bins: list[list] = []
    for c in sorted(left, reverse=True):
        for _ in range(left[c]):
            fit = min((b for b in bins if b[0] >= c), key=lambda b: b[0], default=None)
            if fit is None:
                bins.append(fit := [capacity, Counter()])
            fit[0] -= c
            fit[1][c] += 1
    same = Counter(tuple(sorted(b[1].items())) for b in bins)
    return plans + [(dict(p), n) for p, n in sorted(same.items())]


def slots(plans: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each class, ranges of ranks: (first rank, first sequence, pieces in each sequence)."""
    out, first, rank = defaultdict(list), 0, Counter()
    for p, n in plans:
        for c, k in p.items():
            out[c].append((rank[c], first, k))
            rank[c] += n * k
        first += n
    return dict(out)


def _assign(table: dict[int, list[tuple[int, int, int]]]):
    at = {c: [np.asarray(v, dtype=np.int64) for v in zip(*rows, strict=True)] for c, rows in table.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            cls, rank = b.column(names.index("cls")).to_numpy(), b.column(names.index("rank")).to_numpy()
            seq = np.zeros(len(cls), dtype=np.int64)
            for c in np.unique(cls):
                lo, first, k = at[int(c)]
                here = cls == c
                j = np.searchsorted(lo, rank[here], side="right") - 1
                seq[here] = first[j] + (rank[here] - lo[j]) // k[j]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([b.column(names.index(n)) for n in keep] + [pa.array(seq)], names=[*keep, "sequence_id"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(path, capacity, grain), PIECES), "pack_pieces")
    counts = materialize(pieces.groupBy("chunk", "cls").agg(F.count("*").alias("n")), "pack_counts")
    demand = {r[0]: r[1] for r in counts.groupBy("cls").agg(F.sum("n")).collect()}  # at most capacity / grain rows
    table = slots(plan(demand, capacity // grain))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.withColumn("before", before).drop("n"), ["chunk", "cls"]).withColumn("rank", F.col("idx") + F.col("before"))
    out = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank").mapInArrow(_assign(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32")
    offset = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("offset", F.coalesce(offset, F.lit(0).cast("long")))
