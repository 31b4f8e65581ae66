"""Collocations from a truncated suffix tree that is built in groups of word prefixes.

Every place in a piece of text is the begin of a suffix of up to five words. Suffixes are divided
vertically: by their first word and, where a prefix has more suffixes than the memory budget, by
one word more, up to the whole depth. Prefixes are dealt to as many groups as the budget asks for.
Each group is one task: its suffixes, sorted by Spark, are walked once, and the open path of the
depth-truncated subtree is all that is held; a node's count is the total of its leaves. Prefixes
that were divided have nodes in several groups, whose totals are added.

Prefixes of one and two words are counted first. Words and pairs that are too rare to be part of a
phrase end a suffix. They are told by bitmaps of a fixed largest size; a rare one that a bitmap
lets pass costs work and changes no count.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed

LEAST = 100  # occurrences of a phrase
LONGEST = 5  # words of a phrase
TOP = 2000  # phrases of a language
SHARE = 100  # percent of a phrase's occurrences that a longer one must have to replace it
UNKNOWN = "und"
BUDGET = 1 << 20  # suffixes of a group, at least
MOST_DIVIDED = 1 << 15  # prefixes of one depth that may be divided: the budget grows for it
BITS_PER_WORD, MOST_BITS = 16, 1 << 27
HELD = 400_000  # different words that a task holds before it passes their counts on,
HELD_BYTES = 1 << 27  # bytes of texts they come from,
HELD_NUMBERS = 1 << 24  # and numbers of words in paths
PART = 1 << 22  # bytes of a text that are read at a time
LONG_WORD = 100  # longer words are not remembered
CODES = 1 << 16  # words that have a code of two bytes in pairs
PAIR = 40_503  # an odd factor that tells the words of a pair apart; sums stay below 2^49

# What ends a piece, and what ends a word within one.
_PIECES = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b"\t "
# End of the fixed values.
_TO_LINES = bytes.maketrans(_BLANKS + _PIECES, b" " * len(_BLANKS) + b"\n" * len(_PIECES))
_SEPARATOR = b"\0"  # sorts before every byte of a word, so that a prefix's suffixes are together


def _prepared(text: str | None) -> bytes:
    """Lower-case bytes with pieces as lines. The separator is written as two bytes where it is
    part of a word, and so is the byte that marks this."""
    return _written((text or "").encode().lower().translate(_TO_LINES))


def _written(data: bytes) -> bytes:
    if b"\0" in data or b"\1" in data:
        data = data.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")
    return data


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Every text's group and bytes, a long text's in parts that end between two pieces."""
    for batch in batches:
        for group, text in zip(batch.column(0), batch.column(1)):
            group, data, at = group.as_py(), _prepared(text.as_py()), 0
            while len(data) - at > PART:
                end = data.rfind(b"\n", at, at + PART) + 1 or data.find(b"\n", at + PART) + 1
                if not end:
                    break
                yield group, data[at:end]
                at = end
            yield group, data[at:] if at else data


def _words(batches):
    """(group, word, n) over a task's texts."""
    held: dict[str, Counter] = {}
    size = 0

    def counted():
        for group, counter in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(counter), pa.string()),
                 pa.array([_plain(w).decode() for w in counter], pa.string()),
                 pa.array(counter.values(), pa.int64())], ["group", "word", "n"])
        held.clear()

    for group, data in _texts(batches):
        held.setdefault(group, Counter()).update(data.split())
        size += len(data)
        if size > HELD_BYTES or sum(map(len, held.values())) > HELD:
            yield from counted()
            size = 0
    yield from counted()


def _plain(path: bytes) -> bytes:
    """The phrase of a path."""
    text = path.replace(_SEPARATOR, b" ")
    return text.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in text else text


def _marked(bitmap: np.ndarray, at: np.ndarray | int):
    at = at & (len(bitmap) * 8 - 1)
    return bitmap[at >> 3] >> (at & 7) & 1


class _Numbers(dict):
    """A task's numbers of a group's words that may be frequent, and -1 for the others."""

    def __init__(self, group: str, bitmap: np.ndarray):
        super().__init__({_SEPARATOR: -1})
        self.start, self.bitmap = zlib.crc32(group.encode()), bitmap
        self.words: list[bytes] = []
        self.sums: list[int] = []  # checksums
        self._table = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        checksum = zlib.crc32(_plain(word), self.start)
        number = -1
        if _marked(self.bitmap, checksum):
            number = len(self.words)
            self.words.append(word)
            self.sums.append(checksum)
        if number >= 0 or len(self) < HELD and len(word) <= LONG_WORD:
            self[word] = number
        return number

    def of(self, data: bytes) -> np.ndarray:
        """The numbers of a text's words, with -1 where a piece ends."""
        tokens = data.replace(b"\n", b" \0 ").split()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def checksums(self, numbers: np.ndarray) -> np.ndarray:
        if len(self._table) < len(self.sums):
            self._table = np.append(self._table, self.sums[len(self._table):])
        return self._table[numbers]

    def path(self, row: Iterable[int]) -> bytes:
        return _SEPARATOR.join([self.words[i] for i in row if i >= 0])


def _windows(numbers: np.ndarray, linked: np.ndarray, least: int, longest: int) -> np.ndarray:
    """The rows of ``longest`` numbers that begin at each place with ``least`` linked ones or
    more; a row ends, filled with -1, where the next number isn't linked."""
    reach = np.zeros(len(numbers), np.int8)
    alive = np.append(linked, False)
    for step in range(1, longest):
        reach += alive
        alive = alive & np.append(linked[step:], np.zeros(step + 1, bool))[:len(alive)]
    at = np.flatnonzero(reach >= least - 1)
    rows = np.full((len(at), longest), -1, np.int32)
    for step in range(longest):
        some = reach[at] >= step
        rows[some, step] = numbers[at[some] + step]
    return rows


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, in order, and how often each occurs."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def _counted(bitmap, pairs, least: int, longest: int, columns):
    """A task that counts paths of ``least`` to ``longest`` words, each as long as its words and
    the pairs of them may be frequent. ``columns`` (group, numbers, rows) are put between the
    group and the count. What is held is passed on before it takes much memory."""
    def run(batches):
        known: dict[str, _Numbers] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def passed():
            for group, parts in held.items():
                rows, counts = _distinct(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(rows), pa.string()),
                     *[a for _, a in columns(group, known[group], rows)],
                     pa.array(counts, pa.int64())],
                    ["group", *[n for n, _ in columns(group, known[group], rows[:0])], "n"])
            held.clear()
            for group in [g for g, n in known.items() if len(n) > HELD]:
                del known[group]

        marks = np.frombuffer(bitmap.value, np.uint8)
        pair_marks = np.frombuffer(pairs.value, np.uint8) if pairs else None
        for group, data in _texts(batches):
            if group not in known:
                known[group] = _Numbers(group, marks)
            numbers = known[group].of(data)
            if len(numbers) < least:
                continue
            linked = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
            if pairs:
                at = np.flatnonzero(linked)
                first, second = (known[group].checksums(numbers[at + i]) for i in (0, 1))
                linked[at] = _marked(pair_marks, first * PAIR + second)
            rows = _windows(numbers, linked, least, longest)
            if len(rows):
                held.setdefault(group, []).append(rows)
                size += rows.size
            if size > HELD_NUMBERS or len(known[group]) > 2 * HELD:
                yield from passed()
                size = 0
        yield from passed()

    return run


def _short(codes):
    """Columns of the pairs: two codes if both words are among the most frequent ones."""
    def columns(group: str, numbers: _Numbers, rows: np.ndarray):
        known = codes.value
        own = np.array([known.get((group, w), -1) for w in numbers.words], np.int32)[rows]
        coded = (own >= 0).all(axis=1)
        packed = own[coded].astype(">u2").tobytes()
        paths = np.empty(len(rows), object)
        paths[coded] = [_SEPARATOR + packed[i:i + 4] for i in range(0, len(packed), 4)]
        paths[~coded] = [numbers.path(r) for r in rows[~coded].tolist()]
        return [("path", pa.array(paths, pa.binary()))]

    return columns


def _spoken(codes):
    """(group, path, phrase, n): paths with codes as words, and their phrases."""
    def run(batches):
        words = [word for _, word in codes.value]  # in the order of the codes
        for batch in batches:
            paths = [
                _SEPARATOR.join(words[i] for i in struct.unpack(">HH", p[1:]))
                if p.startswith(_SEPARATOR) else p for p in batch.column("path").to_pylist()]
            phrases = [_plain(p).decode() for p in paths]
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), pa.array(paths, pa.binary()), pa.array(phrases, pa.string()),
                 batch.column("n")], ["group", "path", "phrase", "n"])

    return run


def _dealt(divided, groups: int):
    """Columns of a suffix: the group of prefixes it belongs to, and itself."""
    def columns(group: str, numbers: _Numbers, rows: np.ndarray):
        heavy = divided.value
        first = {n for n, w in enumerate(numbers.words) if (group, w) in heavy} if heavy else ()
        suffixes, dealt = [], []
        for row in rows.tolist():
            suffixes.append(path := numbers.path(row))
            if row[0] in first:
                end = path.index(_SEPARATOR)
                while end > 0 and (group, path[:end]) in heavy:
                    end = path.find(_SEPARATOR, end + 1)
                prefix = path if end < 0 else path[:end]
                dealt.append(zlib.crc32(prefix, numbers.start) % groups)
            else:
                dealt.append(numbers.sums[row[0]] % groups)
        return [("dealt", pa.array(dealt, pa.int64())), ("suffix", pa.array(suffixes, pa.binary()))]

    return columns


def _extending(heavy: frozenset[tuple[str, bytes]], depth: int):
    """Columns of the paths of ``depth`` words that are longer by one than those in ``heavy``."""
    def columns(group: str, numbers: _Numbers, rows: np.ndarray):
        paths = [numbers.path(r) for r in rows.tolist()]
        kept = [p if (group, p[:p.rindex(_SEPARATOR)]) in heavy else None for p in paths]
        return [("path", pa.array(kept, pa.binary()))]

    return columns


def _subtrees(divided, least: int):
    """(group, phrase, words, n): the nodes of three words or more of the subtrees whose suffixes
    come sorted. Nodes of prefixes that were divided are given whatever their count."""
    def run(batches):
        heavy = divided.value
        group, path, totals, out = None, [], [], []

        def close(depth: int) -> None:
            """Close the nodes below ``depth``; a node's total goes to the one above."""
            while len(path) > depth:
                total = totals.pop()
                if len(path) > 2 and (total >= least or (
                        heavy and (group, _SEPARATOR.join(path)) in heavy)):
                    out.append((group, _plain(_SEPARATOR.join(path)).decode(), len(path),
                                total))
                path.pop()
                if totals:
                    totals[-1] += total

        def flush():
            columns = zip(*out) if out else [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.int32(), pa.int64())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["group", "phrase", "words", "n"])
            out.clear()
            return batch

        last = None
        for batch in batches:
            for own, suffix, n in zip(*[batch.column(c).to_pylist()
                                        for c in ("group", "suffix", "n")]):
                if own != group:
                    close(0)
                    group, last = own, None
                if suffix != last:
                    words = suffix.split(_SEPARATOR)
                    same = 0
                    while same < len(path) and same < len(words) and path[same] == words[same]:
                        same += 1
                    close(same)
                    path.extend(words[same:])
                    totals.extend([0] * (len(words) - same))
                    last = suffix
                # Also if the suffix is a prefix of the ones to come: its node is the open one.
                totals[-1] += n
            yield flush()
        close(0)
        yield flush()

    return run


def _checksum(word: Column) -> Column:
    return F.crc32(F.concat("group", word).cast("binary"))


def _bitmap(sums: DataFrame) -> bytes:
    """A bitmap of the numbers ``sum``, of at most ``MOST_BITS`` bits."""
    wanted = max(1, sums.count()) * BITS_PER_WORD
    bits = min(MOST_BITS, max(1 << 15, 1 << math.ceil(math.log2(wanted))))
    at = F.col("sum") % bits
    pages = sums.groupBy(F.floor(at / 32768).alias("page")).agg(
        F.bitmap_construct_agg(at % 32768).alias("bits")).collect()
    whole = bytearray(bits // 8)
    for page in pages:  # of 4096 bytes, so many as ``MOST_BITS`` allows
        whole[page["page"] * 4096:page["page"] * 4096 + len(page["bits"])] = page["bits"]
    return bytes(whole)


def _divided(texts: DataFrame, prefixes: list[DataFrame], bitmaps, budget: int,
             longest: int) -> frozenset[tuple[str, bytes]]:
    """Prefixes with more suffixes than ``budget``. Those of one and two words are counted
    (``prefixes``); each further round counts the ones that extend what was too heavy."""
    def collected(counts: DataFrame) -> frozenset:  # at most MOST_DIVIDED
        heavy = counts.filter(F.col("n") > budget).select("group", "path").collect()
        return frozenset((r["group"], bytes(r["path"])) for r in heavy)

    found = frozenset()
    for depth in range(1, longest):
        if depth <= len(prefixes):
            heavy = collected(prefixes[depth - 1])
        else:
            counts = texts.mapInArrow(
                _counted(*bitmaps, depth, depth, _extending(heavy, depth)),
                "group string, path binary, n long").filter("path IS NOT NULL")
            heavy = collected(counts.groupBy("group", "path").agg(F.sum("n").alias("n")))
        if not heavy:
            break
        found |= heavy
    return found


def counted(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST,
            longest: int = LONGEST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(group, phrase, words, n) of the phrases of 1 to ``longest`` words that occur ``least``
    times or more in a group's texts, and (group, n) of all words.

    A null text counts as empty, a null group as ``und``. Letters A to Z are lower-cased. Words
    are what stands between blanks in a piece; pieces end at ``.,;:!?`` and line ends.
    """
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)).alias("group"),
                        F.col(text).alias("text")).filter("text IS NOT NULL")
    every = (
        texts.mapInArrow(_words, "group string, word string, n long")
        .groupBy("group", "word").agg(F.sum("n").alias("n"))
    )
    # Rare words are one row a group, for the total.
    vocabulary = checkpointed(
        every.groupBy("group", F.when(F.col("n") >= least, F.col("word")).alias("phrase"))
        .agg(F.sum("n").alias("n")))
    totals = vocabulary.groupBy("group").agg(F.sum("n").alias("n"))
    words = vocabulary.filter("phrase IS NOT NULL")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bitmap = spark.sparkContext.broadcast(
        _bitmap(words.select(_checksum(F.col("phrase")).alias("sum"))))
    frequent = words.filter(F.length("phrase") <= LONG_WORD).orderBy(
        F.desc("n"), "group", "phrase").limit(CODES).collect()
    codes = spark.sparkContext.broadcast(
        {(r["group"], _written(r["phrase"].encode())): i for i, r in enumerate(frequent)})
    pairs = checkpointed(
        texts.mapInArrow(_counted(bitmap, None, 2, 2, _short(codes)),
                         "group string, path binary, n long")
        .groupBy("group", "path").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        .mapInArrow(_spoken(codes), "group string, path binary, phrase string, n long"))
    both = pairs.withColumn("parts", F.split("phrase", " ")).select(
        (_checksum(F.get("parts", F.lit(0))) * PAIR + _checksum(F.get("parts", F.lit(1)))).alias("sum"))
    bitmaps = bitmap, spark.sparkContext.broadcast(_bitmap(both))
    budget = max(budget, total // MOST_DIVIDED)
    heavy = _divided(texts, [words.withColumn("path", F.col("phrase").cast("binary")), pairs],
                     bitmaps, budget, longest)
    divided = spark.sparkContext.broadcast(heavy)
    groups = max(1, math.ceil(total / budget))
    suffixes = texts.mapInArrow(_counted(*bitmaps, 3, longest, _dealt(divided, groups)),
                                "group string, dealt long, suffix binary, n long")
    nodes = (
        suffixes.repartition(groups, "dealt").sortWithinPartitions("group", "suffix")
        .select("group", "suffix", "n")
        .mapInArrow(_subtrees(divided, least), "group string, phrase string, words int, n long")
    )
    phrases = nodes.groupBy("group", "phrase", "words").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= least)

    def sized(frame: DataFrame, size: int) -> DataFrame:
        return frame.select("group", "phrase", F.lit(size).alias("words"), "n")

    return sized(words, 1).unionByName(sized(pairs, 2)).unionByName(phrases), totals


def _part(words: Column, first: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def _ratio(a: Column, n: Column, left: Column, right: Column) -> Column:
    """1000 a n / (l r), rounded down, in whole numbers of up to 38 digits."""
    def wide(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    above = (wide(a) * wide(n)).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", above.cast("decimal(38,0)"),
                           (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, top: int = TOP, share: int = SHARE,
                 budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's first ``top`` phrases.

    A phrase of two words or more is cut where 1000 a n / (l r) is least, rounded down, ties at
    the first cut; a, l and r count the phrase and its parts, n all words of the group. Phrases
    that a longer one contains, with ``share`` percent of their occurrences or more, are left
    out. Ranks go by score, a and the phrase's bytes. See ``counted`` for words, nulls and rare
    phrases. Rows equal in all columns count each; an empty table gives no rows; other columns
    are ignored.
    """
    phrases, totals = counted(docs, text, group, least, longest, budget)
    known = checkpointed(phrases)
    whole = known.filter("words > 1").withColumn("parts", F.split("phrase", " "))
    at = F.col("cut")
    cuts = (
        whole.select("group", "phrase", F.col("n").alias("a"), "words", "parts",
                     F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
        .select("group", "phrase", "a", "cut", _part(F.col("parts"), F.lit(1), at).alias("left"),
                _part(F.col("parts"), at + 1, F.col("words") - at).alias("right"))
        .join(known.select("group", F.col("phrase").alias("left"), F.col("n").alias("l")),
              ["group", "left"])
        .join(known.select("group", F.col("phrase").alias("right"), F.col("n").alias("r")),
              ["group", "right"])
        .join(totals, "group")
    )
    score = _ratio(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    scored = cuts.groupBy("group", "phrase").agg(
        F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("best"))
    within = F.transform(
        F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1),
            lambda first: _part(F.col("parts"), first, size)))
    covering = (
        whole.filter("words > 2")
        .select("group", F.col("n").alias("longer"), F.explode(F.flatten(within)).alias("phrase"))
        .groupBy("group", "phrase").agg(F.max("longer").alias("longer"))
    )
    kept = (
        scored.select("group", "phrase", "best.*").join(covering, ["group", "phrase"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    )
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        .select(F.col("group").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase",
                "a", "l", "r", "n", "score")
    )
