"""Best-fit packing of tokenised documents into sequences.

Bounded-space online best-fit: pieces come in the order of their rows; a fixed number of bins is open,
and a bitset keyed by free space finds the tightest one that still holds a piece. If none does, a bin
is opened; beyond the fixed number the fullest closes first. Each input partition packs its own
sequences; no text is shuffled and a task holds only its open bins. What is in bins that a partition
leaves open with room to spare is packed again, long pieces first, together with what other partitions
left: few rows, in groups of a bounded number. So many small partitions give few more sequences than one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, stage

#: Words whose ids are remembered at a time (beyond, the memory starts anew), and bytes of text that are split at once.
REMEMBERED_WORDS, TEXT_BYTES = 900_000, 1 << 20
#: Latin letters, none of which normalising changes, and then marks that are never part of a contraction: the tokenizer cuts between the two.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?#*$%&|<>()\[\]{}+=/\\_\"@~^-]*)")
_tokenizers: dict[str, "WordIds"] = {}


class WordIds(dict):
    """Ids of a word, as little-endian unsigned 32-bit bytes, asked of the tokenizer once.

    For tokenizers that drop white space and never look past it, so that a text's ids are those of its
    words in a row. With `plain`, also ones that lower case and split letters from marks: ids of plain
    Latin words then come from the tokenizer's model, without the normalising that they don't need.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))})
        probe = "Plain WORDS, end. $$$ a|b x!! Été ñandúÿ ÜBER. straße***"
        self.plain = all(self._encode([w.encode()])[0] == b"".join(self._model(p) for p in _PLAIN.fullmatch(w).groups() if p) for w in probe.split() if _PLAIN.fullmatch(w))

    def _encode(self, words: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _model(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part.lower().translate(self.letters))]).tobytes()

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + 2 * len(new) > REMEMBERED_WORDS:
            self.clear()
            new = list(words)
        rest = []
        for w in new:
            if not (self.plain and (m := _PLAIN.fullmatch(w.decode()))):
                rest.append(w)
                continue
            ids = b""
            for part in m.groups():
                if part:
                    key = part.lower().encode()
                    known = self.get(key)
                    if known is None:
                        known = self[key] = self._model(part)
                    ids += known
            self[w] = ids
        for k in range(0, len(rest), 4096):
            self.update(zip(rest[k : k + 4096], self._encode(rest[k : k + 4096]), strict=True))

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text; texts are taken together up to a bound, so that new words are learned in bulk."""
        k = 0
        while k < len(texts):
            lists, size = [], 0
            while k < len(texts) and size < TEXT_BYTES:
                lists.append(texts[k].split())
                size += len(texts[k])
                k += 1
            self.learn(set().union(*lists))
            ids = self.__getitem__
            for words in lists:
                yield b"".join(map(ids, words))


def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


class BestFit:
    """Open bins by free space: a bit for each free space that some bin has, and a stack of those bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.stacks, self.open, self.made = 0, {}, 0, 0
        self.closed: list[int] = []  # bins that no piece will join any more, for the caller to take

    def _put(self, free: int, bin_: int) -> None:
        if self.bits >> free & 1:
            self.stacks[free].append(bin_)
        else:
            self.bits |= 1 << free
            self.stacks[free] = [bin_]
        self.open += 1

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
            del self.stacks[free]
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        if free > length:
            self._put(free - length, bin_)
            if self.open > self.open_bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        else:
            self.closed.append(bin_)
        return bin_, self.capacity - free

    def left(self) -> Iterator[tuple[int, int]]:
        """(bin, free space) of the open bins."""
        for free, stack in self.stacks.items():
            for bin_ in stack:
                yield bin_, free


#: A row per piece; again: whether it is to be packed again.
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary, again boolean"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]
#: Free space from which on a bin that a partition leaves open is packed again (a share of the capacity), and pieces of one task that does so.
SPARE, AGAIN_PIECES = 1 / 64, 200_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def packed(pieces: Iterator[list[tuple]], capacity: int, open_bins: int, base: int, again: bool) -> Iterator[pa.RecordBatch]:
    """Lists of (doc_id, piece, start, length, ids_crc32, ids) -> batches of placed pieces; with again, those in bins left with room are marked instead of placed."""
    bins, held = BestFit(capacity, open_bins), {}
    for some in pieces:
        for p in some:
            bin_, offset = bins.place(p[3])
            held.setdefault(bin_, []).append((*p[:5], base + bin_, offset, p[5], False))
        out = [row for bin_ in bins.closed for row in held.pop(bin_)]
        bins.closed.clear()
        if out:
            yield _batch(out)
    out = []
    for bin_, free in bins.left():
        loose = again and free > capacity * SPARE
        out += [(*row[:5], None, None, row[7], True) if loose else row for row in held.pop(bin_)]
    if out:
        yield _batch(out)


def best_fit_packing(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, open_bins: int = 1024, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """documents(doc_id, text, ...) -> a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    A document is its ids and end_id; longer ones than capacity are cut into pieces of capacity tokens,
    the last of which may be shorter. `ids` holds little-endian unsigned 32-bit ids (with_ids only, else
    null). Null and blank texts are a document of end_id alone. Repeated rows and null doc_ids are packed
    like any other row, each in its place; of bins that fit equally well the one last used is taken. An
    empty table gives no row. Other columns are ignored, whatever their names.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        ids_of, end = word_ids(tokenizer_path), int(end_id).to_bytes(4, "little")
        for b in batches:
            texts, docs, some = as_bytes(b.column(1)), b.column(0).to_pylist(), []
            for doc, ids in zip(docs, ids_of.of([t or b"" for t in texts]), strict=True):
                data = ids + end
                for k in range(0, len(data), 4 * capacity):
                    piece = data[k : k + 4 * capacity]
                    some.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
            yield some

    def number() -> int:
        from pyspark import TaskContext

        return (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(tokenised(batches), capacity, open_bins, number(), True)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), strict=True)) for b in batches)
        yield from packed(rows, capacity, open_bins, number() | 1 << 62, False)

    texts = bounded_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces, _ = stage(texts.mapInArrow(first, _PIECE), "pieces")
    loose = pieces.where("again")
    tasks = max(1, -(-loose.count() // AGAIN_PIECES))
    dealt = loose.repartition(tasks, "ids_crc32", "doc_id", "piece") if tasks > 1 else loose.coalesce(1)
    placed = dealt.sortWithinPartitions(F.col("length").desc(), "doc_id", "piece", "ids_crc32").mapInArrow(second, _PIECE)
    return pieces.where("not again").unionByName(placed).drop("again")
