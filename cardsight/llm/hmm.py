"""Language-model scoring with a hidden Markov model (operator 7).

Latent states emit symbols: every frequent word is a symbol of its own (words with a share of
at least ``SHARE`` of the training tokens, so at most 1 / SHARE of them), all other words go
by one of 256 classes of their last two bytes, and a text ends with the end symbol. A word
of a class has its share of the class's training count, less a discount of one half that
goes to the words of the class never seen. The states are trained by Baum-Welch: every task
adds up expected counts over its part of the corpus, the parts are summed in Spark, and the
driver normalises a table of fixed size. Training cuts documents into segments of
``SEGMENT`` tokens; scoring does not, it runs the scaled forward recursion over whole texts.

Words are counted over all training documents by the block exchange (``blocks``), which
also gives the unigram base score. A word is known by 56 bits of its hash and its class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, Block, bucket_bounds, buckets_for, rows_of, text_bytes, unpack, with_notes, write_blocks
from .common import finished, query, stored, table
from .linededup import send_counts
from .suffixdedup import as_notes, named
from .text import U64, mix, words

STATES = 6
ROUNDS = 5
SEGMENT = 128
SHARE = 1 / 16384
CLASSES = 256
END = 0                      # symbol of the end; classes follow, then frequent words
FIRST_WORD = 1 + CLASSES
BATCH_TOKENS = 2_000_000


def is_held_out(ids: np.ndarray, mod: int, rest: int) -> np.ndarray:
    return np.array([i != NO_ID and zlib.crc32(str(i).encode()) % mod == rest for i in ids.tolist()], bool)


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(name, document) of each word; the low byte of a name is the word's class."""
    w = words(b.piece)
    if not len(w.hash):
        return w.hash, w.doc
    low = b.data | np.where((b.data >= 65) & (b.data <= 90), 32, 0).astype(np.uint8)
    last = low[w.end - 1].astype(np.uint64)
    before = np.where(w.end - w.start > 1, low[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    cls = mix(last << U64(8) | before) & U64(CLASSES - 1)
    return (w.hash & ~U64(CLASSES - 1)) | cls, w.doc


class Counts(NamedTuple):
    total: int               # training tokens, ends included
    kinds: int               # distinct training tokens
    ends: int
    frequent: np.ndarray     # sorted names of the frequent words
    class_total: np.ndarray  # of the other words: tokens and kinds by class
    class_kinds: np.ndarray


def counted(blocks: DataFrame, mod: int, rest: int) -> tuple[DataFrame, Counts, int]:
    """Training counts of every word: as notes for the blocks that have it, and summed up."""
    spark = blocks.sparkSession
    n_buckets = buckets_for(text_bytes(blocks) / 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                b = unpack(r)
                name, doc = tokens(b)
                if len(name):
                    names, index = named(name)
                    learn = ~is_held_out(b.ids, mod, rest)[doc]
                    yield send_counts(b.block, names, np.bincount(index, learn, len(names)), n_buckets)

    def bucket(group: pa.Table) -> pa.Table:
        fps = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("fps")]
        names, index = named(np.concatenate(fps))
        total = np.bincount(index, np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in group.column("counts")])).astype(np.int64)
        at = np.concatenate(([0], np.cumsum([len(f) for f in fps])))
        own = total[index]
        n = group.num_rows
        cls = (names & U64(CLASSES - 1)).astype(np.int64)
        heavy = total >= max(1, SHARE * total.sum())
        sums = np.stack((np.bincount(cls, total, CLASSES), np.bincount(cls, total > 0, CLASSES))).astype(np.int64)
        key = group.column("bucket")[0].as_py()
        return pa.table({
            "block": pa.concat_arrays([group.column("block").combine_chunks(), pa.nulls(1, pa.int64())]),
            "bucket": pa.array([key] * (n + 1), pa.int32()),
            "bits": pa.array([own[a:z].tobytes() for a, z in zip(at, at[1:])] + [sums.tobytes()], pa.binary()),
            "heavy": pa.array([None] * n + [names[heavy].tobytes()], pa.binary()),
            "heavy_n": pa.array([None] * n + [total[heavy].tobytes()], pa.binary())})

    sent = blocks.mapInArrow(count, "bucket int, block long, fps binary, counts binary")
    answers = stored(sent.groupBy("bucket").applyInArrow(
        bucket, "block long, bucket int, bits binary, heavy binary, heavy_n binary"), "counts")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                s = np.frombuffer(r["bits"], np.int64)
                name, n = np.frombuffer(r["heavy"], np.int64), np.frombuffer(r["heavy_n"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1, 2], [CLASSES, CLASSES, len(name)]), pa.int32()),
                     pa.array(np.concatenate((np.arange(CLASSES), np.arange(CLASSES), name)), pa.int64()),
                     pa.array(np.concatenate((s, n)), pa.int64())], names=["what", "name", "n"])

    sums = answers.filter("block is null").mapInArrow(cells, "what int, name long, n long")
    class_total, class_kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums.filter("what < 2").groupBy("what", "name").agg(F.sum("n").alias("n")).collect():
        (class_total, class_kinds)[r.what][r.name] = r.n

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int((~is_held_out(np.frombuffer(x.as_py(), np.int64), mod, rest)).sum()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    ends = blocks.select("ids").mapInArrow(docs, "n long").agg(F.sum("n")).first()[0] or 0
    total = int(class_total.sum()) + int(ends)
    heavy = sums.filter((F.col("what") == 2) & (F.col("n") >= F.lit(max(2.0, SHARE * total)))).select("name", "n").collect()
    names = np.array([r.name for r in heavy], np.int64).view(np.uint64)
    order = np.argsort(names)
    cls = (names & U64(CLASSES - 1)).astype(np.int64)
    rest_total = class_total - np.bincount(cls, [r.n for r in heavy], CLASSES).astype(np.int64)
    rest_kinds = class_kinds - np.bincount(cls, minlength=CLASSES)
    kinds = int(class_kinds.sum()) + int(ends > 0)
    notes = as_notes(answers.filter("block is not null"), "count")
    return notes, Counts(total, kinds, int(ends), names[order], rest_total, rest_kinds), n_buckets


SEQUENCES = "ids binary, learn binary, sizes binary, known binary, base binary, within binary, symbols binary"


def sequences(blocks: DataFrame, notes: DataFrame, counts: Counts, n_buckets: int, mod: int, rest: int) -> DataFrame:
    """One row a block: symbols of all its documents (uint16), their base scores, and the log10
    probabilities of the words within their classes."""
    shared = blocks.sparkSession.sparkContext.broadcast(counts)

    def translate(b: Block, noted: list) -> Iterator[pa.RecordBatch]:
        k = shared.value
        name, doc = tokens(b)
        n_docs = len(b.ids)
        names, index = named(name)
        own = np.zeros(len(names), np.int64)
        at = bucket_bounds(names, n_buckets)
        for _, bucket, bits in noted:
            if bucket is not None:
                own[at[bucket]:at[bucket + 1]] = np.frombuffer(bits, np.int64)
        scale = k.total + 0.5 * (k.kinds + 1)
        where = np.searchsorted(k.frequent, names)
        where[where == len(k.frequent)] = 0
        frequent = k.frequent[where] == names if len(k.frequent) else np.zeros(len(names), bool)
        cls = (names & U64(CLASSES - 1)).astype(np.int64)
        symbol = np.where(frequent, FIRST_WORD + where, 1 + cls)
        mass = np.where(own > 0, own - 0.5, 0.5 * k.class_kinds[cls])
        share = np.where(k.class_total[cls] > 0, mass / np.maximum(k.class_total[cls], 1), 1.0)
        within = np.where(frequent, 0.0, np.log10(np.maximum(share, 1e-300)))
        base = np.log10((own + 0.5) / scale)
        n_words = np.bincount(doc, minlength=n_docs)
        size = n_words + 1
        start = np.concatenate(([0], np.cumsum(size)))
        out = np.full(start[-1], END, np.uint16)
        if len(doc):
            out[np.arange(len(doc)) + doc] = symbol[index]  # one end before each later document
        total = lambda x: np.bincount(doc, x[index], n_docs)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
            b.ids.tobytes(), (~is_held_out(b.ids, mod, rest)).tobytes(), size.astype(np.int64).tobytes(),
            (total((own > 0).astype(float)).astype(np.int64) + int(k.ends > 0)).tobytes(),
            (total(base) + np.log10((k.ends + 0.5) / scale)).tobytes(), total(within).tobytes(), out.tobytes())],
            names=[x.split()[0] for x in SEQUENCES.split(", ")])

    return with_notes(blocks, notes, translate, SEQUENCES)


class Model(NamedTuple):
    start: np.ndarray  # state
    move: np.ndarray   # state x state
    emit: np.ndarray   # symbol x state


def initial(n_symbols: int, unigram: np.ndarray, states: int, seed: int = 17) -> Model:
    """Sticky states around the unigram distribution, told apart by fixed noise."""
    r = np.random.default_rng(seed)
    emit = (unigram + 1e-6)[:, None] * np.exp(0.7 * r.normal(size=(n_symbols, states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def expected(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, m: Model) -> list[np.ndarray]:
    """Expected counts (start, move, emit) over segments given by starts and sizes; ``first`` marks
    the segments that begin a document."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, first = starts[order], sizes[order], first[order]
    n, steps, k = len(starts), int(sizes[0]), len(m.start)
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")   # segments longer than t
    alpha = np.zeros((steps, n, k), np.float32)
    scale = np.ones((steps, n), np.float32)
    emit, move = m.emit.astype(np.float32), m.move.astype(np.float32)
    even = np.full(k, 1 / k, np.float32)
    for t in range(steps):
        a = live[t]
        x = np.where(first[:a, None], m.start.astype(np.float32), even) if t == 0 else alpha[t - 1, :a] @ move
        x = x * emit[symbols[starts[:a] + t]]
        c = x.sum(1)
        alpha[t, :a] = x / c[:, None]
        scale[t, :a] = c
    moves, emits = np.zeros((k, k)), np.zeros(m.emit.shape)
    beta = np.ones((n, k), np.float32)
    gamma = np.zeros((steps, n, k), np.float32)
    for t in range(steps - 1, -1, -1):
        a = live[t]
        gamma[t, :a] = alpha[t, :a] * beta[:a]
        if t:
            y = emit[symbols[starts[:a] + t]] * beta[:a] / scale[t, :a, None]
            moves += alpha[t - 1, :a].T.astype(np.float64) @ y
            beta[:a] = y @ move.T
    begun = gamma[0, first[:n]].sum(0).astype(np.float64) if first.any() else np.zeros(k)
    place = np.concatenate([starts[:live[t]] + t for t in range(steps)])
    g = np.concatenate([gamma[t, :live[t]] for t in range(steps)])
    s = symbols[place]
    for j in range(k):
        emits[:, j] = np.bincount(s, g[:, j], len(emits))
    return [begun, moves * m.move, emits]


def segments(sizes: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and first marks of the segments of the documents to learn from."""
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1][learn]
    size = sizes[learn]
    n = -(-size // SEGMENT)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(at, n) + nth * SEGMENT
    return start, np.minimum(np.repeat(size, n) - nth * SEGMENT, SEGMENT), nth == 0


def train(seqs: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: one pass over all training sequences a round."""
    spark = seqs.sparkSession
    n_symbols = FIRST_WORD + len(counts.frequent)
    parts = 16
    # as many tasks as the cluster runs in a few waves: each sends one table of counts
    few = seqs.select("learn", "sizes", "symbols").coalesce(4 * max(spark.sparkContext.defaultParallelism, 6))

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_symbols, 1))
        for batch in batches:
            for r in rows_of(batch):
                learn = np.repeat(np.frombuffer(r["learn"], bool), np.frombuffer(r["sizes"], np.int64))
                total[:, 0] += np.bincount(np.frombuffer(r["symbols"], np.uint16)[learn], minlength=n_symbols)
        yield in_parts(total, parts)

    def summed(batches_to_parts) -> np.ndarray:
        sent = few.mapInArrow(batches_to_parts, "part int, counts binary")

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()) for x in group.column("counts"))
            return pa.table({"part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

        rows = sent.groupBy("part").applyInArrow(add, "part int, counts binary").collect()
        got = {r.part: np.frombuffer(r.counts) for r in rows}
        return np.concatenate([got[i] for i in range(parts)]) if got else np.zeros(0)

    uni = summed(unigrams)[:n_symbols]
    if not uni.sum():
        return initial(n_symbols, np.ones(n_symbols) / n_symbols, states)
    model = initial(n_symbols, uni / uni.sum(), states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            begun, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states))
            for batch in batches:
                for r in rows_of(batch):
                    symbols = np.frombuffer(r["symbols"], np.uint16)
                    s = segments(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["learn"], bool))
                    wide = max(1, BATCH_TOKENS // 8 // SEGMENT)
                    for a in range(0, len(s[0]), wide):
                        got = expected(symbols, *(x[a:a + wide] for x in s), m)
                        begun, moves, emits = begun + got[0], moves + got[1], emits + got[2]
            yield in_parts(np.concatenate((begun, moves.ravel(), emits.ravel()))[:, None], parts)

        got = summed(step)
        begun, moves = got[:states], got[states:states + states * states].reshape(states, states)
        emits = got[states + states * states:states + states * states + n_symbols * states].reshape(n_symbols, states)
        # a little of the unigram distribution keeps every symbol possible in every state
        emits = emits + (uni + 0.5)[:, None] / (uni + 0.5).sum() * 100
        model = Model((begun + 1) / (begun + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emits / emits.sum(0))
        shared.unpersist()
    return model


def in_parts(values: np.ndarray, parts: int) -> pa.RecordBatch:
    flat = values.ravel()
    width = -(-len(flat) // parts)
    flat = np.concatenate((flat, np.zeros(width * parts - len(flat)))).reshape(parts, width)
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([f.tobytes() for f in flat], pa.binary())],
                                      names=["part", "counts"])


def forward(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: Model) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion."""
    order = np.argsort(-sizes, kind="stable")
    starts, length = starts[order], sizes[order]
    out = np.zeros(len(starts))
    x = np.tile(m.start, (len(starts), 1))
    live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    pending = np.ones(len(starts))
    for t, a in enumerate(live):
        x = x[:a] @ m.move if t else x[:a]
        x = x * m.emit[symbols[starts[:a] + t]]
        c = x.sum(1)
        x /= c[:, None]
        pending[:a] *= c
        if t % 8 == 7 or t + 1 == len(live):
            out += np.log10(pending)
            pending[:] = 1.0
    back = np.empty(len(starts))
    back[order] = out
    return back


def score(docs: DataFrame, mod: int = 5, rest: int = 1, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Base and model log10 probability of every text, learnt from the documents whose crc32 of
    doc_id as text, modulo ``mod``, is not ``rest`` (a null doc_id is learnt from).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty
    texts are the end alone; very long texts are scored whole; repeated rows are documents of
    their own; an empty table gives no rows; other columns are ignored. Without training
    tokens the base is that of one unknown kind and the states are even.
    """
    found: list[Counts] = []

    def symbols_of() -> DataFrame:
        blocks = write_blocks(docs)
        notes, counts, n_buckets = counted(blocks, mod, rest)
        found.append(counts)
        return sequences(blocks, notes, counts, n_buckets, mod, rest)

    seqs, counts = finished(docs.sparkSession, symbols_of, "sequences"), found[0]
    model = docs.sparkSession.sparkContext.broadcast(train(seqs, counts, states, rounds))
    total = counts.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush():
            sizes = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in held])
            symbols = np.concatenate([np.frombuffer(r["symbols"], np.uint16) for r in held])
            get = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in held])
            ids = get("ids", np.int64)
            value = forward(symbols, np.cumsum(sizes) - sizes, sizes, model.value) + get("within", np.float64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(~get("learn", bool)), pa.array(sizes), pa.array(get("known", np.int64)),
                 pa.array(np.full(len(ids), total), pa.int64()), pa.array(get("base", np.float64)), pa.array(value)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for r in rows_of(batch):
                held.append(r)
                if sum(len(h["symbols"]) for h in held) >= 2 * BATCH_TOKENS:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return seqs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


@query("op7_hmm_score")
def op7_hmm_score(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
