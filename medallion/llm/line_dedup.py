"""Line dedup by content-defined chunks. DataFrame functions only.

A text's lines are hashed, and a rolling hash over each window of line hashes decides whether a
chunk ends there, so an inserted line moves the boundaries near it and no others. Chunks of
several lines are counted by hash over all documents; those that occur more than once are fetched
and grouped by their bytes; all but the first occurrence of equal bytes are removed.

With ``passages``, what is left at the edges of the chunks is matched line by line: every two
neighbouring lines that are not blank, with the blank ones between them, and every line of more
than ``long_words`` words. Later occurrences of a repeated chunk bring only the two lines at their
end to that, as the first one stands for them. So a repeated passage of two lines or more goes from
its first line to its last, whatever stands around it, and copies cost a row a chunk.

Hashes and positions are shuffled for every chunk of several lines; whole texts twice, to fetch
the repeated chunks and to bring the decisions to the documents. A chunk's occurrences are
counted and compared by partial aggregates, so a passage in a third of all documents is one row a
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, count_words, fresh, let

WINDOW = 2  # line hashes that decide a boundary
DIVISOR = 3  # lines of a chunk, on average
PLACE = ("id", "digest", "begin", "end")
LEAST_LINES = 2  # of a chunk that may be removed; blank lines do not count
LONG = 50  # among passages, a line of more words is one of its own


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _filled(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def _range(begin: Column, end: Column) -> Column:
    return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))


def _within(lines: Column, at: Column) -> Column:
    return F.slice(lines, at["begin"] + 1, at["end"] - at["begin"] + 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _ends(hashes: Column, window: int, divisor: int) -> Column:
    """Numbers, from 1, of the lines after which the rolling hash of the last ``window`` line
    hashes, a multiple of ``divisor``, ends a chunk."""
    def closes(line: Column) -> Column:
        seen = [F.coalesce(F.get(hashes, line - 1 - back), F.lit(0).cast("long"))
                for back in range(window)]
        return F.pmod(F.xxhash64(*seen), F.lit(divisor)) == 0

    return F.filter(F.sequence(F.lit(1), F.size(hashes)),
                    lambda line: closes(line) | (line == F.size(hashes)))


def chunks(lines: Column, window: int, divisor: int, least_lines: int) -> Column:
    """First and last line, from 0, and hash of the chunks with ``least_lines`` lines that are not
    blank. Linear in the text."""
    def ranges(at: Column) -> Column:
        return F.transform(at, lambda end, i: _range(
            F.coalesce(F.get(at, i - 1), F.lit(0)), end - 1))

    several = F.filter(
        let(F.transform(lines, lambda x: F.xxhash64(x)),
            lambda hashes: let(_ends(hashes, window, divisor), ranges)),
        lambda r: F.size(F.filter(_within(lines, r), _filled)) >= least_lines)
    return F.transform(several, lambda r: F.struct(
        r["begin"].alias("begin"), r["end"].alias("end"),
        _hash(_joined(_within(lines, r))).alias("hash")))


def chunks_of_filled(lines: Column, window: int, divisor: int, least_lines: int,
                     long_words: int) -> Column:
    """First and last line, from 0, of the chunks of the lines that are not blank; ``hash``, null
    where they are fewer than ``least_lines``; ``at``, the places of these lines and of the next
    chunk's first; ``pairs``, the hashes of each two neighbours in ``at``; ``alone``, place and
    hash of the lines of more than ``long_words`` words. Linear in the text."""
    def hashed(begin: Column, end: Column) -> Column:
        return _hash(_joined(_within(lines, _range(begin, end))))

    def described(at: Column, begin: Column, end: Column) -> Column:
        own = F.slice(at, begin + 1, end - begin)
        more = F.slice(at, begin + 1, end - begin + 1)
        first, last = F.get(at, begin), F.get(at, end - 1)
        return F.struct(
            first.alias("begin"), last.alias("end"),
            F.when(end - begin >= least_lines, hashed(first, last)).alias("hash"),
            more.alias("at"),
            F.zip_with(F.slice(more, F.lit(1), F.size(more) - 1),
                       F.slice(more, F.lit(2), F.size(more)), hashed).alias("pairs"),
            F.transform(F.filter(own, lambda i: count_words(F.get(lines, i)) > long_words),
                        lambda i: F.struct(i.alias("at"), hashed(i, i).alias("hash"))
                        ).alias("alone"))

    def cut(at: Column) -> Column:
        hashes = F.transform(at, lambda i: F.xxhash64(F.get(lines, i)))
        return let(let(hashes, lambda h: _ends(h, window, divisor)), lambda ends: F.transform(
            ends, lambda end, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0)),
                                     lambda begin: described(at, begin, end))))

    filled = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _filled(F.get(lines, i)))
    return let(filled, lambda at: F.when(F.size(at) > 0, cut(at)))


def _repeated(rows: DataFrame) -> DataFrame:
    """(hash, first) of the hashes that occur more than once."""
    return rows.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")
    ).filter("n > 1").drop("n")


def _matched(index: DataFrame, passages: bool, barred: DataFrame | None) -> DataFrame:
    """(hash, place, first, whole) of all that repeats: chunks, for which ``whole`` is true, and
    with ``passages`` pairs and long lines outside of later chunks. Chunks with a hash in
    ``barred`` are taken line by line."""
    whole = index.filter("hash is not null")
    allowed = whole if barred is None else whole.join(barred, "hash", "left_anti")
    again = _repeated(allowed.select("hash", *PLACE))
    if not passages:
        return checkpointed(whole.select("hash", *PLACE).join(again, "hash")
                            .withColumn("whole", F.lit(True)))
    known = checkpointed(whole.join(again, "hash", "left").unionByName(
        index.filter("hash is null"), allowMissingColumns=True))
    later = F.col("first").isNotNull() & ~F.struct(*PLACE).eqNullSafe(F.col("first"))
    pieces = F.concat(
        F.transform("pairs", lambda h, i: F.struct(
            F.get("at", i).alias("begin"), F.get("at", i + 1).alias("end"), h.alias("hash"))),
        F.transform("alone", lambda x: F.struct(
            x["at"].alias("begin"), x["at"].alias("end"), x["hash"].alias("hash"))))
    edges = known.select("id", "digest", F.explode(F.filter(
        pieces, lambda p: ~later | (p["end"] > F.col("end")))).alias("p")).select(
            "id", "digest", "p.*")
    found = known.filter("first is not null").select(
        "hash", *PLACE, "first", F.lit(True).alias("whole"))
    return checkpointed(found.unionByName(
        edges.join(_repeated(edges), "hash").withColumn("whole", F.lit(False))))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without the sorted ranges ``gone``, in one pass over both."""
    def gap(i: Column) -> Column:
        last = F.coalesce(F.get(gone, i - 1)["end"], F.lit(-1))
        following = F.coalesce(F.get(gone, i)["begin"], F.size(lines))
        return F.slice(lines, last + 2, F.greatest(following - last - 1, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), gap))


def deduplicated(docs: DataFrame, identity: str = "doc_id", text: str = "text",
                 removed: str | None = None, window: int = WINDOW, divisor: int = DIVISOR,
                 least_lines: int = LEAST_LINES, passages: bool = False,
                 long_words: int = LONG) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``; other columns are kept as they are.

    The first occurrence, by id and then by place, stays; a null id is the first. A text that
    loses all its chunks is empty. ``removed`` names a column for the number of lines taken out.
    Null texts stay null, empty texts empty. Rows equal in id and text are one document: they
    lose the same chunks. Single lines, and chunks with fewer than ``least_lines`` lines that are
    not blank, always stay.

    With ``passages`` every later occurrence of a run of two or more lines that are not blank goes
    whole, as does that of a line of more than ``long_words`` words; ``window`` and ``divisor``
    change the cost and not the result. Other single lines stay. A line's first occurrence always
    stays.
    """
    ident, digest, gone = fresh(docs.columns, "_id", "_digest", "_gone")
    spare, = fresh(docs.columns, removed or "_removed")

    def cut(lines: Column) -> Column:
        if passages:
            return chunks_of_filled(lines, window, divisor, max(2, least_lines), long_words)
        return chunks(lines, window, divisor, least_lines)

    index = checkpointed(
        docs.filter(F.col(text).isNotNull())
        .select(F.col(identity).alias("id"), F.xxhash64(F.col(text)).alias("digest"),
                F.explode(let(_lines(F.col(text)), cut)).alias("chunk"))
        .select("id", "digest", "chunk.*"))
    place = F.struct(*PLACE)
    whole = docs.select(F.col(identity).alias(ident), F.col(text).alias("text"),
                        F.xxhash64(F.col(text)).alias(digest))

    def fetched(wanted: DataFrame) -> DataFrame:
        """(id, digest, begin, end, hash, bytes) of the chunks ``wanted``."""
        lists = wanted.select("id", "digest", "begin", "end", "hash").distinct().groupBy(
            "id", "digest").agg(F.collect_list(F.struct("begin", "end", "hash")).alias("wanted"))
        same = F.col("id").eqNullSafe(F.col(ident)) & (F.col("digest") == F.col(digest))
        picked = let(_lines(F.col("text")), lambda lines: F.transform(
            "wanted", lambda w: F.struct(
                w["begin"].alias("begin"), w["end"].alias("end"), w["hash"].alias("hash"),
                _joined(_within(lines, w)).alias("bytes"))))
        return (whole.join(lists, same).select("id", "digest", F.explode(picked).alias("c"))
                .select("id", "digest", "c.*"))

    barred = None
    while True:
        found = _matched(index, passages, barred)
        variants = fetched(found).groupBy("hash", "bytes").agg(F.count(F.lit(1)).alias("n"))
        by_hash = checkpointed(variants.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")))
        differing = by_hash.filter("texts > 1").select("hash")
        collided = not differing.isEmpty()
        if not (collided and passages):
            break
        # A chunk that only shares its hash with the first one must bring all its lines.
        unlike = differing.join(found.filter("whole").select("hash"), "hash", "left_semi")
        if unlike.isEmpty():
            break
        barred = unlike if barred is None else barred.unionByName(unlike)
    equal = by_hash.filter("texts = 1").select("hash")

    def later(rows: DataFrame) -> DataFrame:
        """Lines of the chunks that aren't the first ones; those of a first chunk that overlaps
        with its repetition stay."""
        own = (F.col("id").eqNullSafe(F.col("first.id"))
               & (F.col("digest") == F.col("first.digest")))
        begin = F.when(own, F.greatest("begin", F.col("first.end") + 1)).otherwise(F.col("begin"))
        return (rows.filter(~place.eqNullSafe(F.col("first")))
                .select("id", "digest", begin.alias("begin"), "end").filter("begin <= end"))

    doomed = later(found.join(equal, "hash"))
    if collided:  # chunks of one hash and several texts: compare text by text
        several = checkpointed(fetched(found.join(differing, "hash")))
        first = several.groupBy("hash", "bytes").agg(F.min(place).alias("first"))
        doomed = doomed.unionByName(later(several.join(first, ["hash", "bytes"])))
    ranges = F.array_sort(F.collect_set(F.struct("begin", "end")))
    lists = doomed.groupBy("id", "digest").agg(ranges.alias(gone)).select(
        F.col("id").alias(ident), F.col("digest").alias(digest), gone)
    other = [f"{ident}_r", f"{digest}_r"]
    marked = docs.withColumn(digest, F.xxhash64(F.col(text))).join(
        lists.toDF(*other, gone),
        F.col(identity).eqNullSafe(F.col(other[0])) & (F.col(digest) == F.col(other[1])), "left")
    rest = let(_lines(F.col(text)), lambda lines: _without(lines, F.col(gone)))
    changed = F.when(F.col(gone).isNull(), F.col(text)).otherwise(_joined(rest))
    lines = F.when(F.col(gone).isNull(), 0).otherwise(
        F.size(_lines(F.col(text))) - F.size(rest)).cast("int")
    columns = [changed.alias(c) if c == text else F.col(c) for c in docs.columns]
    return marked.select(*columns, *([lines.alias(spare)] if removed else []))
