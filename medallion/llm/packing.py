"""Packing by shortest-pack-first over the histogram of lengths.

A document's token ids are cut into whole sequences and one rest. The histogram of piece lengths,
at most ``capacity`` numbers, decides everything: lengths are placed longest first, each into the
open pack that is shortest so far, a pack being a pattern with a count. Patterns are then ranges
of ranks per length, and a piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, ranked

CAPACITY = 2048
END = 1  # id that ends a document
CACHED_WORDS = 500_000  # words whose ids a task remembers before it starts afresh

# Marks that the tokenizer always parts from the letters before them.
_MARKS = ".,;:!?*$&%#|()/-"

# Characters that str.split takes for white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes; forgets all when it is full.

    The tokenizer drops white space and never joins across it, so a text's ids are its words'
    ids one after the other. It lower-cases, and parts marks from letters, so a word of Latin-1
    letters has the ids of its lower-case form and those of the marks that follow it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._merged = self._tokenizer.model.tokenize

    def encode(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters.isalpha() and max(letters) < "\u0100":
            low = letters.lower()
            if low == word and not low.isascii():
                ids = self.encode(word)
            elif low == word:
                ids = np.asarray([t.id for t in self._merged(word)], dtype="<u4").tobytes()
            else:
                ids = self[low] + (self[word[len(letters):]] if letters != word else b"")
        else:
            ids = self.encode(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _NOT_SPACE.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, identity: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every row's ids."""
    kind = docs.schema[identity].dataType
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches):
        words = WordIds(path)
        for batch in batches:
            rows, which = [], []
            for at, value in enumerate(batch.column(1)):
                ids = words.of(value.as_py()) + end
                for start in range(0, len(ids), 4 * capacity):
                    part = ids[start:start + 4 * capacity]
                    which.append(at)
                    rows.append((start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 4)
            owner = batch.column(0).take(pa.array(which, pa.int32()))
            yield pa.record_batch([owner, *[pa.array(columns[:, i]) for i in range(4)]],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = T.StructType([T.StructField("doc_id", kind)] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])
    return docs.select(F.col(identity).alias("doc_id"), F.col(text).alias("text")
                       ).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list]]:
    """(count, [(length, times), ...]): how many packs hold which lengths, longest first.

    A length goes to the open pattern with the most room; one that has more packs than there are
    pieces is split. Pieces that fit nowhere open packs, as many in each as it holds.
    """
    room: dict[int, list] = defaultdict(list)  # room left -> open patterns
    largest: list[int] = []  # heap of -room
    closed = []

    def keep(count: int, items: list, left: int) -> None:
        if not count:
            return
        if not left:
            closed.append((count, items))
            return
        if not room[left]:
            heapq.heappush(largest, -left)
        room[left].append((count, items))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo > 0:
            while largest and not room[-largest[0]]:
                heapq.heappop(largest)
            left = -largest[0] if largest else 0
            if left >= length:
                count, items = room[left].pop()
                used = min(count, todo)
                keep(count - used, items, left)
                last = items[-1]
                grown = ([*items[:-1], (length, last[1] + 1)] if last[0] == length
                         else [*items, (length, 1)])
                keep(used, grown, left - length)
                todo -= used
            else:
                each = capacity // length
                packs, rest = divmod(todo, each)
                keep(packs, [(length, each)], capacity - each * length)
                keep(int(rest > 0), [(length, rest)], capacity - rest * length)
                todo = 0
    return closed + [p for opened in room.values() for p in opened]


def _ranges(packs: list[tuple[int, list]]) -> pd.DataFrame:
    """A row per pattern and length: from which rank on its pieces go to which sequences."""
    rows, taken, base = [], defaultdict(int), 0
    for count, items in packs:
        offset = 0
        for length, times in items:
            rows.append((length, taken[length], base, times, offset))
            taken[length] += count * times
            offset += length * times
        base += count
    return pd.DataFrame(sorted(rows), columns=["length", "rank", "base", "times", "offset"])


def packed(found: DataFrame, capacity: int = CAPACITY, order=("doc_id", "start", "ids_crc32",
                                                              "doc_tokens")) -> DataFrame:
    """``found`` with ``sequence_id`` and ``offset``: every piece (by ``length``) in a sequence.

    The driver holds the histogram and the patterns, whose number depends on ``capacity`` and not
    on the rows. Repeated rows are pieces of their own; an empty table gives no rows.
    ``found`` is read several times: pass a checkpoint.
    """
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    table = _ranges(patterns(histogram, capacity))
    lengths, firsts = table["length"].to_numpy(np.int64), table["rank"].to_numpy(np.int64)
    starts = (lengths << 44) + firsts
    values = table[["base", "times", "offset"]].to_numpy(np.int64).reshape(-1, 3)

    def place(frames):
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame.pop("_rank").to_numpy()
            at = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            base, times, offset = values[at].T
            step = rank - firsts[at]
            frame["sequence_id"] = base + step // times
            frame["offset"] = offset + step % times * length
            yield frame

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked(found, ["length"], list(order), "_rank").mapInPandas(
        place, f"{names}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
         identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    A null or empty text is the end id alone. Null ids and repeated rows are documents of their
    own. No other column of ``docs`` is read.
    """
    found = checkpointed(pieces(docs, path or tokenizer_path(), capacity, identity, text))
    return packed(found, capacity)


def padding(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequences, tokens, padding): a sequence is padded to ``capacity`` unless its length is a
    power of two."""
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    short = F.when(F.bit_count("used") == 1, 0).otherwise(F.lit(capacity) - F.col("used"))
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"),
                    F.sum(short).alias("padding"))
