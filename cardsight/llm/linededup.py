"""Line dedup by an exact set-similarity join (operator 5).

A line (text between line feeds) is the set of its words. It is removed if an earlier line,
by doc_id and place, in any document has Jaccard similarity ``percent`` / 100 or more with it;
this is judged on the input, so a removed line still counts as an earlier one.

1. Equal sets: blocks exchange one fingerprint a line; the first line of each set goes on. The same
   exchange counts words, over the lines that differ inside a block.
2. A line's words are ordered by rarity, and two similar
   lines share a word of both prefixes (the rarest n - ceil(percent * n / 100) + 1 words).
   Prefix words that no other line has are not sent.
3. Lines that share a prefix word are candidates if their lengths allow it, enough words are
   left behind the shared word's places (length and positional filter), and 128-bit maps of
   their words do not differ in more bits than words may differ. In a group of more than
   ``FULL`` lines, a line meets the first ``FIRST`` lines, then the next ones in growing
   steps; a line with a match leaves, so groups of near copies are not expanded into all pairs.
4. Candidates are verified on the full word sets, the nearest candidate of each line first (by
   its map), the others only for lines that it does not match. The word sets are taken from the
   blocks once for all rounds, unless that is more than the first round needs twice over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (HINT_BYTES, Block, answered, bucket_bounds, buckets_for, documents_of, kept_schema, lengthened,
                     read_answer, rows_of, send, shortened, text_bytes, unpack, with_notes, write_blocks)
from .common import finished, query, stored, table
from .suffixdedup import named
from .text import U64, Piece, mix, words

PERCENT = 80
FULL, TRIED, FIRST, GROW = 64, 4096, 4, 8
# A line's key in one long: partition of its block (2^24, 268 TB of text), block of the partition, line of the block.
PART_BITS, LINE_BITS = 11, 28


def line_bounds(b: Block) -> np.ndarray:
    """Offsets of all lines of a block: line i is data[at[i]:at[i + 1]] with its line feed, if any."""
    feeds = np.flatnonzero(b.data == 10) + 1
    # a document that is empty or ends with a line feed has an empty last line
    cuts = np.sort(np.concatenate((feeds, b.offsets[1:-1], b.offsets[:1], b.offsets[-1:])), kind="stable")
    return cuts


def lines_per_document(b: Block) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(b.data == 10), b.offsets)) + 1


def key_of(block: int, line: np.ndarray) -> np.ndarray:
    """One long for a line, in order of documents and places."""
    part, nth = block >> 32, block & 0xFFFFFFFF
    if part >> (63 - PART_BITS - LINE_BITS) or nth >> PART_BITS or (len(line) and int(line.max()) >> LINE_BITS):
        raise OverflowError(f"block {nth} of partition {part} has no room in a line's key")
    return ((part << PART_BITS | nth) << LINE_BITS) + line.astype(np.int64)


def block_of(key: str = "line"):
    k = F.col(key)
    nth = F.shiftright(k, LINE_BITS).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return F.shiftleft(F.shiftright(k, PART_BITS + LINE_BITS), 32) + nth


def line_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, words): the distinct words of each line as hashes, ordered by hash."""
    n = len(at) - 1
    w = words(Piece(0, data, at))
    line = w.doc
    if n < 1 << 20:   # one key for line and hash: equal words of a line become neighbours
        order = np.argsort((line.astype(np.uint64) << U64(44)) | (w.hash >> U64(20)))
    else:
        order = np.lexsort((w.hash, line))
    line, h = line[order], w.hash[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    line, h = line[keep], h[keep]
    return np.searchsorted(line, np.arange(n + 1)), h


def signatures(bounds: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit name of each line's word set; lines without words get 0."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    size = np.diff(bounds)
    has = np.flatnonzero(size)
    if len(has):
        out[has] = mix(np.add.reduceat(mix(h ^ U64(0x5DEECE66D)), bounds[:-1][has]) + size[has].astype(np.uint64))
    return out


class Names:
    """Names of a block's lines (0: no words), and the first line of each."""

    def __init__(self, sig: np.ndarray):
        self.sig = sig
        self.filled = np.flatnonzero(sig)
        self.names, self.index = named(self.sig[self.filled])
        first = np.full(len(self.names), len(self.sig))
        np.minimum.at(first, self.index, self.filled)
        self.first = first

    def repeated(self, answers: list, n_buckets: int) -> np.ndarray:
        """Lines whose set an earlier line has, here or in another block."""
        before = read_answer(answers, self.names, n_buckets)
        out = np.zeros(len(self.sig), bool)
        out[self.filled] = before[self.index] | (self.filled > self.first[self.index])
        return out


class Lines(Names):
    """Lines of a block with their word sets."""

    def __init__(self, b: Block):
        self.at = line_bounds(b)
        self.bounds, self.words = line_sets(b.data, self.at)
        super().__init__(signatures(self.bounds, self.words))

    def cells(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, place in ``words``) of every word of some lines."""
        size = np.diff(self.bounds)[lines]
        start = np.repeat(self.bounds[lines] - (np.cumsum(size) - size), size)
        return np.repeat(lines, size), np.arange(len(start)) + start


def send_counts(block: int, values: np.ndarray, counts: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    at = bucket_bounds(values, n_buckets)
    full = np.flatnonzero(np.diff(at))
    cut = lambda x, t: pa.array([x[at[k]:at[k + 1]].tobytes() for k in full], t)
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int64()), cut(values, pa.binary()),
         cut(counts.astype(np.int32), pa.binary())], names=["bucket", "block", "fps", "counts"])


ASKED = "kind string, bucket int, block long, fps binary, counts binary"


def ask(b: Block, sig_buckets: int, word_buckets: int) -> Iterator[pa.RecordBatch]:
    """What a block wants to know: which of its sets an earlier block has (kind line), and in how many lines its
    words are (kind rarity; lines that differ inside a block count). The names of its lines go along (kind names)."""
    lines = Lines(b)

    def of_kind(kind: str, sent: pa.RecordBatch) -> pa.RecordBatch:
        n, names = sent.num_rows, sent.schema.names
        columns = {c: sent.column(c) if c in names else pa.nulls(n, pa.binary()) for c in ("bucket", "block", "fps", "counts")}
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * n, pa.string()), **columns})

    # the names take as many groups as the sets have buckets, so they are no larger
    yield of_kind("names", pa.RecordBatch.from_pydict(
        {"bucket": pa.array([(b.block >> 32) % sig_buckets], pa.int32()), "block": pa.array([b.block], pa.int64()),
         "fps": pa.array([lines.sig.tobytes()], pa.binary())}))
    if len(lines.names):
        yield of_kind("line", send(b.block, lines.names, sig_buckets))
        _, cell = lines.cells(lines.first)
        yield of_kind("rarity", send_counts(b.block, *np.unique(lines.words[cell], return_counts=True), word_buckets))


def reply(group: pa.Table) -> pa.Table:
    """Answers to one bucket of :func:`ask`, as notes."""
    kind = group.column("kind")[0].as_py()
    if kind == "names":
        out = pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "bits": group.column("fps")})
    else:
        out = answered(group, earlier=True) if kind == "line" else count_bucket(group)
    return out.add_column(1, "kind", pa.array([kind] * out.num_rows, pa.string()))


def count_bucket(group: pa.Table) -> pa.Table:
    """Counts summed over blocks, answered as one byte a word: eight steps a power of two, 0 for
    a count of one."""
    fps = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("fps")]
    names, index = named(np.concatenate(fps))
    total = np.bincount(index, np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in group.column("counts")]))
    level = np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)[index]
    at = np.concatenate(([0], np.cumsum([len(f) for f in fps])))
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"),
                     "bits": pa.array([level[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary())})


def rarity(answers: list[tuple[int, bytes]], values: np.ndarray, n_buckets: int) -> np.ndarray:
    at = bucket_bounds(values, n_buckets)
    out = np.zeros(len(values), np.uint8)
    for k, level in answers:
        out[at[k]:at[k + 1]] = np.frombuffer(level, np.uint8)
    return out


def stable_order(keys: np.ndarray, free: int) -> np.ndarray:
    """Stable order of keys whose lowest ``free`` bits are zero: the place goes there if it fits, as plain numbers sort faster."""
    if len(keys) > 1 << free:
        return np.argsort(keys, kind="stable")
    return (np.sort(keys | np.arange(len(keys), dtype=np.uint64)) & U64((1 << free) - 1)).astype(np.int64)


CHART = 2   # longs of the map of hashed words that travels with an entry


def pair_filter(early, late, n, place, chart, percent: int) -> np.ndarray:
    """Which entries of the same word pass the length and positional filter, and a bound on
    how many words they do not share: bits that differ in the maps of their words."""
    na, nb = n[early], n[late]
    need = -(-percent * (na + nb) // (100 + percent))
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - place[early], nb - place[late]) >= need)
    at = np.flatnonzero(ok)
    apart = sum(np.bitwise_count(x[early[at]] ^ x[late[at]]).astype(np.int64) for x in chart)
    ok[at] = apart <= (na + nb - 2 * need)[at]
    return ok


def word_maps(bounds: np.ndarray, h: np.ndarray, longs: int) -> list[np.ndarray]:
    """Maps of 64 * ``longs`` bits of the hashed words between bounds (none empty), one array a long."""
    spot = (h >> U64(40)) % U64(64 * longs)
    bit = U64(1) << (spot & U64(63))
    return [np.bitwise_or.reduceat(np.where(spot >> U64(6) == U64(i), bit, U64(0)), bounds[:-1]) for i in range(longs)]


ENTRIES = "bucket int, block long, fps binary, line binary, n binary, place binary, chart binary"


def packed(x: np.ndarray) -> bytes:
    """Counts in two bytes each where all fit, else in four."""
    return x.astype(np.uint16 if int(x.max(initial=0)) < 1 << 16 else np.int32).tobytes()


def unpacked(sent: bytes, count: int) -> np.ndarray:
    return np.frombuffer(sent, np.uint16 if len(sent) == 2 * count else np.int32).astype(np.int64)


def candidates(sent: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """(kind 0) pairs a before b that pass the filters: all pairs of a group of up to ``FULL`` lines, else
    those with its first ``FIRST`` lines; (kind 1) the members of larger groups that pass the filters
    with any other line (all members beyond ``TRIED`` lines), with the place of the word in the line and
    of the line in the group, and the map of the line's words. An entry travels in 29 bytes: five of the word's hash
    (two words that share them only make more candidates), the line inside its block, two counts and the map of 128 bits."""
    bits = int(np.log2(n_buckets))

    def bucket(group: pa.Table) -> pa.Table:
        word, line, n, place, chart = [], [], [], [], []
        for r in sorted(rows_of(group), key=lambda r: r["block"]):
            own = np.frombuffer(r["line"], np.int32)
            word.append(lengthened(r["fps"], HINT_BYTES))
            line.append(key_of(r["block"], own))
            n.append(unpacked(r["n"], len(own)))
            place.append(unpacked(r["place"], len(own)))
            chart.append(np.frombuffer(r["chart"], np.uint64).reshape(CHART, -1))
        word, line, n, place = (np.concatenate(x) for x in (word, line, n, place))
        order = stable_order(word, 64 - 8 * HINT_BYTES)     # a block's entries come in order of word, then line
        word = (word >> U64(bits)) | U64(group.column("bucket")[0].as_py() << (64 - bits) if bits else 0)
        word, line, n, place, chart = word[order], line[order], n[order], place[order], np.concatenate(chart, axis=1)[:, order]
        start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.concatenate((start, [len(word)])))
        rank = np.arange(len(word)) - np.repeat(start, size)
        big, huge = np.repeat(size > FULL, size), np.repeat(size > TRIED, size)
        late = np.flatnonzero(rank > 0)
        found = [np.zeros((2, 0), np.int64)]
        fits = huge.copy()      # members of large groups that pass the filters with another one
        for back in range(min(int(size.max()), TRIED) if len(size) else 0):
            late = late[(rank[late] > back) & (~huge[late] | (back < FIRST))]
            early = late - rank[late] + back
            ok = pair_filter(early, late, n, place, chart, percent)
            e, z = early[ok], late[ok]
            if back >= FIRST:
                fits[e] = fits[z] = True
                e, z = e[~big[e]], z[~big[z]]
            found.append(np.stack((e, z)))
        big &= fits
        early, late = np.concatenate(found, axis=1)
        order = np.lexsort((line[late], line[early]))
        a, b = line[early[order]], line[late[order]]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        new &= a != b       # two words of a line may share a hint
        a, b, none, m = a[new], b[new], np.zeros(int(new.sum()), np.int64), int(big.sum())
        early, late = early[order][new], late[order][new]
        apart = sum((np.bitwise_count(x[early] ^ x[late]).astype(np.int64) for x in chart), none)
        both = lambda x, y: pa.array(np.concatenate((x, y)).astype(np.int64), pa.int64())
        return pa.table({"kind": both(none, np.ones(m)), "a": both(a, word[big].view(np.int64)), "b": both(b, line[big]),
                         "n": both(none, n[big]), "place": both(none, place[big]), "nth": both(none, rank[big]), "apart": both(apart, np.zeros(m)),
                         **{f"chart{i}": both(none, x[big].view(np.int64)) for i, x in enumerate(chart)}})

    return sent.groupBy("bucket").applyInArrow(bucket, "kind long, a long, b long, n long, place long, nth long, apart long"
                                               + "".join(f", chart{i} long" for i in range(CHART)))


NOTE = "block long, kind string, bucket int, bits binary"


def line_notes(lines: DataFrame) -> DataFrame:
    """The lines of each block that are asked for, as its note."""
    def note(group: pa.Table) -> pa.Table:
        keys = np.sort(group.column("line").to_numpy())
        return pa.table({"block": group.column("block")[:1], "kind": pa.array(["line"]), "bucket": pa.array([0], pa.int32()),
                         "bits": pa.array([keys.tobytes()], pa.binary())})

    return lines.withColumn("block", block_of()).groupBy("block").applyInArrow(note, NOTE)


def noted_sets(b: Block, bits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, bounds, words) of the lines asked for."""
    keys = np.frombuffer(bits, np.int64)
    at, nth = line_bounds(b), keys & ((1 << LINE_BITS) - 1)
    part = np.concatenate([b.data[at[i]:at[i + 1]] for i in nth])
    return keys, *line_sets(part, np.concatenate(([0], np.cumsum(at[nth + 1] - at[nth]))))


def asked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("line")).unionAll(pairs.select(F.col("b").alias("line"))).distinct()


def word_sets(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, words): the word sets of some lines."""
    def fetch(b: Block, noted: list) -> Iterator[pa.RecordBatch]:
        for _, _, bits in noted:
            keys, bounds, h = noted_sets(b, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([h[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())],
                names=["line", "words"])

    return stored(with_notes(blocks, line_notes(lines), fetch, "line long, words binary", noted_only=True), "sets")


def similar(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines (line) of the pairs (a, b) that are similar on their full word sets."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for b, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    hit.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64())], names=["line"])

    left = sets.select(F.col("line").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("line").alias("b"), F.col("words").alias("wb"))
    return stored(pairs.join(left, "a").join(right, "b").select("b", "wa", "wb").mapInArrow(check, "line long").distinct(), "hits")


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines (line) of all similar pairs (a, b, apart: bits that differ in their maps): a line meets its
    nearest candidate first, and the others only if that one is not similar."""
    first = stored(pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"), "first")
    hits = similar(sets, first, percent)
    rest = stored(pairs.select("a", "b").join(hits.withColumnRenamed("line", "b"), "b", "left_anti")
                  .join(first, ["a", "b"], "left_anti"), "rest")
    return hits if rest.isEmpty() else hits.unionByName(similar(sets, rest, percent))


def similar_lines(blocks: DataFrame, notes: DataFrame, sig_buckets: int, word_buckets: int, percent: int) -> DataFrame:
    """(line): first lines of their set that have a similar, different set before them."""
    of = lambda noted, what: [(k, x) for kind, k, x in noted if kind == what]

    def prefixes(b: Block, noted: list) -> Iterator[pa.RecordBatch]:
        lines = Lines(b)
        first = np.setdiff1d(lines.filled, np.flatnonzero(lines.repeated(of(noted, "line"), sig_buckets)))
        if not len(first):
            return
        names, index = named(lines.words)
        line, cell = lines.cells(first)
        h, level = lines.words[cell], rarity(of(noted, "rarity"), names, word_buckets)[index[cell]].astype(np.uint64)
        # in order of hash before
        order = stable_order(((line.astype(np.uint64) << U64(8)) | level) << U64(64 - LINE_BITS - 8), 64 - LINE_BITS - 8)
        line, h, level = line[order], h[order], level[order]
        n = np.repeat(size := np.diff(lines.bounds)[first], size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        heads = np.flatnonzero(place == 0)
        own = np.cumsum(place == 0) - 1      # the entry's line, as a number among those sent
        maps = word_maps(np.concatenate((heads, [len(h)])), h, CHART)
        keep = (place < n - -(-percent * n // 100) + 1) & (level > 0)
        line, h, n, place, own = line[keep].astype(np.int32), h[keep], n[keep], place[keep], own[keep]
        bits = int(np.log2(word_buckets))
        free = max(64 - 8 * HINT_BYTES - bits, 0)
        order = stable_order(h >> U64(free) << U64(free), free)      # words that travel as the same hint stay in order of line
        line, h, n, place, own = line[order], h[order], n[order], place[order], own[order]
        chart = lambda x: b"".join(m[x].tobytes() for m in maps)
        at = bucket_bounds(h, word_buckets)
        full = np.flatnonzero(np.diff(at))
        cut = lambda x, how=np.ndarray.tobytes: pa.array([how(x[at[k]:at[k + 1]]) for k in full], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(np.full(len(full), b.block), pa.int64()),
             cut(h, lambda x: shortened(x, bits, HINT_BYTES)), cut(line), cut(n, packed), cut(place, packed), cut(own, chart)],
            names=["bucket", "block", "fps", "line", "n", "place", "chart"])

    sent = with_notes(blocks, notes.filter("kind <> 'names'"), prefixes, ENTRIES)
    found = stored(candidates(sent, percent, word_buckets), "candidates")
    charts = [f"chart{i}" for i in range(CHART)]
    groups = found.filter("kind = 1").select(F.col("a").alias("word"), F.col("b").alias("line"), "n", "place", "nth", *charts)
    largest = groups.agg(F.max("nth")).first()[0] or 0
    pairs = stored(found.filter("kind = 0").select("a", "b", "apart").distinct(), "pairs")
    # members of large groups meet in later rounds: their sets come along if they are no more lines than these
    lines, members = asked(pairs), groups.filter(F.col("nth") >= FIRST).select("line").distinct()
    together = members.count() <= lines.count()
    sets = word_sets(blocks, lines.union(members).distinct() if together else lines)
    hits = verified(sets, pairs, percent)
    at = FIRST
    while at <= largest:
        # later lines without a match yet meet the next lines of their groups
        late = groups.filter(F.col("nth") > at).join(hits, "line", "left_anti") \
            .select(F.col("word").alias("_w"), F.col("line").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"),
                    F.col("nth").alias("rb"), *[F.col(c).alias(f"_{c}") for c in charts])
        early = groups.filter((F.col("nth") >= at) & (F.col("nth") < at * GROW))
        need = F.ceil(F.lit(percent) * (F.col("n") + F.col("nb")) / (100 + percent))
        apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in charts)
        fits = (F.col("word") == F.col("_w")) & (F.col("nth") < F.col("rb")) & (F.col("line") != F.col("b")) \
            & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")) \
            & (F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb")) >= need) \
            & (apart <= F.col("n") + F.col("nb") - 2 * need)
        pairs = stored(early.join(late, fits).select(F.col("line").alias("a"), "b", apart.alias("apart")).distinct(), "pairs")
        if not pairs.isEmpty():
            if not together:
                sets = word_sets(blocks, asked(pairs))
            hits = stored(hits.unionByName(verified(sets, pairs, percent)).distinct(), "hits")
        at *= GROW
    return hits


def dedup(docs: DataFrame, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts without later similar lines: doc_id, the columns to keep, n_lines, n_removed, text.

    The lines left are joined by line feeds. Lines without words are never removed and never
    match. Null and empty texts have one line without words and come back as empty texts;
    very long lines are compared whole; rows of one doc_id are taken in order of their texts, a
    null doc_id after all others; an empty table gives no rows; columns not asked for are left out.
    """
    blocks = write_blocks(docs, keep)
    sig_buckets = buckets_for(text_bytes(blocks) / 100)
    word_buckets = buckets_for(text_bytes(blocks) / 6 / 5)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                yield from ask(unpack(r), sig_buckets, word_buckets)

    notes = stored(blocks.mapInArrow(asking, ASKED).groupBy("kind", "bucket").applyInArrow(reply, NOTE), "notes")
    hits = finished(docs.sparkSession, lambda: similar_lines(blocks, notes, sig_buckets, word_buckets, percent), "similar")

    def note(group: pa.Table) -> pa.Table:
        return pa.table({"block": group.column("block")[:1], "kind": pa.array(["similar"]), "bucket": pa.array([0], pa.int32()),
                         "bits": pa.array([np.sort(group.column("line").to_numpy()).tobytes()], pa.binary())})

    gone = hits.withColumn("block", block_of()).groupBy("block").applyInArrow(note, NOTE)

    def cut(b: Block, noted: list) -> Iterator[pa.RecordBatch]:
        lines = Names(next(np.frombuffer(x, np.uint64) for kind, _, x in noted if kind == "names"))
        drop = lines.repeated([(k, x) for kind, k, x in noted if kind == "line"], sig_buckets)
        for kind, _, bits in noted:
            if kind == "similar":
                drop[np.frombuffer(bits, np.int64) & ((1 << LINE_BITS) - 1)] = True
        per = lines_per_document(b)
        first = np.concatenate(([0], np.cumsum(per)))
        texts, removed = [], []
        for i in range(len(b.ids)):
            d = drop[first[i]:first[i + 1]]
            removed.append(int(d.sum()))
            text = b.data[b.offsets[i]:b.offsets[i + 1]].tobytes()
            texts.append(text if not removed[-1] else b"\n".join(x for x, y in zip(text.split(b"\n"), d) if not y))
        columns = documents_of(b, keep)
        columns |= {"n_lines": pa.array(per, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                    "text": pa.array(texts, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_pydict(columns)

    schema = kept_schema(docs, keep) + ", n_lines long, n_removed long, text string"
    return with_notes(blocks, notes.filter("kind <> 'rarity'").unionByName(gone), cut, schema)


@query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
                      F.length("text").alias("kept_chars"))
