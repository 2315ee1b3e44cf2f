"""Training-order materialisation of token ids as fixed-stride binary shards.

Texts become token ids, end marks between them, cut into sequences of ``seq_len`` ids; the last of an input partition is padded with end marks. A first pass tokenises
and counts the sequences of each partition, so their number N is exact and each has its own, 0 to N-1, by partition and place. A keyed Feistel
network over the smallest even number of bits that holds N numbers, walked until it falls among them, permutes these: its value is a sequence's global slot, which anyone
can compute from its number, and its inverse gives the number back. Shard k holds slots k * ``shard_slots`` onwards, all shards but the last are full; a task sorts its range
of slots and writes it: ids as little-endian 16-bit numbers, ``seq_len`` to a sequence. Any slot is one seek away, and reading may start anywhere.

The first pass writes the sequences of ``KEPT`` of the partitions, as much as the disk may hold beside the shuffle and the shards; the others are tokenised again by the second pass. All are
shuffled once. Both passes must see the same partitions, as scans of files give; a table that has
been shuffled is written first. A partition whose number of sequences differs between the passes fails. A shard is written under a task's own name and then renamed, so that a
task that runs again, or twice, leaves the same file: its content depends on nothing but the input.

Defined results: null and empty texts give no ids; an empty table gives no shard; repeated rows are repeated text; extra columns are left out.
"""

from __future__ import annotations

import itertools
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, small_batches, tidy
from .lengths import END, VOCABULARY, counter, encoder, vocabulary

SEQ_LEN, SHARD_SLOTS, KEY, ROUNDS = 2048, 4096, 0x5EED, 4
#: The share of partitions whose ids are kept between the passes: disk against time, of no matter for results.
KEPT = 0.4


def _round(half: np.ndarray, key: int, k: int) -> np.ndarray:
    x = (half + np.uint64((key + (k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1, or its inverse."""
    x = np.asarray(index, np.uint64).copy()
    if n <= 1:
        return x
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in range(ROUNDS):
            if inverse:
                left, right = right ^ (_round(left, key, ROUNDS - 1 - k) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]  # walk the cycle until it is back in range
    return x


class _Cutter:
    """Turns a stream of (doc_id, ids) into sequences of (doc_ids, ids), keeping no more than one sequence and one document."""

    def __init__(self, seq_len: int) -> None:
        self.seq_len, self.ids, self.docs, self.size = seq_len, [], [], 0

    def add(self, doc, ids: np.ndarray):
        at = 0
        while at < len(ids):
            part = ids[at : at + self.seq_len - self.size]
            self.ids.append(part)
            self.docs.append(doc)
            self.size += len(part)
            at += len(part)
            if self.size == self.seq_len:
                yield self.take()

    def take(self):
        ids = np.concatenate([*self.ids, np.full(self.seq_len - self.size, END, np.uint16)])
        out = list(dict.fromkeys(self.docs)), self.size, ids
        self.ids, self.docs, self.size = [], [], 0
        return out

    def rest(self):
        if self.size:
            yield self.take()


def _stream(batches, vocab: bytes, seq_len: int):
    """Sequences (doc_ids, n_tokens, ids) of a partition, in order."""
    encode, cutter, end = encoder(vocab), _Cutter(seq_len), np.array([END], np.uint16)
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t:
                yield from cutter.add(d, encode(t))
                yield from cutter.add(d, end)
    yield from cutter.rest()


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _kept(part: int) -> bool:
    """Are a partition's sequences written by the first pass? So are ``KEPT`` of any run of partitions."""
    return int((part + 1) * KEPT) > int(part * KEPT)


def _columns(held: list, doc_type) -> list:
    return [pa.array([h[0] for h in held], pa.list_(doc_type)), pa.array([h[1] for h in held], pa.int32()), pa.array([h[2].tobytes() for h in held], pa.binary())]


def first_pass(docs: DataFrame, vocab: bytes, seq_len: int = SEQ_LEN) -> DataFrame:
    """(part, n, place, doc_ids, n_tokens, ids), written: the sequences of kept partitions, with n 1 and their place; of other partitions their number n."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["part", "n", "place", "doc_ids", "n_tokens", "ids"]

    def run(batches):
        part, doc_type = _part(), pa.int64()

        def rows(n, place, columns):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(n, pa.int64()), pa.array(place, pa.int64()), *columns], names)

        if not _kept(part):
            count, tokens = counter(vocab), 0
            for batch in batches:
                doc_type = batch.schema.field(0).type
                tokens += sum(count(t) + 1 for t in batch.column(1).to_pylist() if t)
            if tokens:
                yield rows([-(-tokens // seq_len)], [None], [pa.array([None], pa.list_(doc_type)), pa.array([None], pa.int32()), pa.array([None], pa.binary())])
            return

        def typed(batches):
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field(0).type
                yield batch

        stream, done = _stream(typed(batches), vocab, seq_len), 0
        while held := list(itertools.islice(stream, 500)):
            yield rows(np.ones(len(held)), np.arange(done, done + len(held)), _columns(held, doc_type))
            done += len(held)

    return materialise(docs.select("doc_id", "text").mapInArrow(tidy(run), f"part int, n long, place long, doc_ids array<{kind}>, n_tokens int, ids binary"), "first-pass")


def sequences(docs: DataFrame, first: DataFrame, counts: dict[int, int], vocab: bytes, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """Placed sequences (slot, shard, seq, doc_ids, n_tokens, ids): those of the first pass, and those of the other partitions of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = sum(counts.values())
    parts = sorted(counts)
    offsets = dict(zip(parts, itertools.accumulate((counts[p] for p in parts), initial=0), strict=False))
    held_out = docs.sparkSession.sparkContext.broadcast((counts, offsets))

    def placed(seq: np.ndarray, columns: list) -> pa.RecordBatch:
        slot = feistel(seq, total, key).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // shard_slots).astype(np.int32)), pa.array(seq, pa.int64()), *columns], ["slot", "shard", "seq", "doc_ids", "n_tokens", "ids"])

    def again(batches):
        part = _part()
        if _kept(part):
            for _ in batches:
                pass
            return
        known, offset = held_out.value[0].get(part, 0), held_out.value[1].get(part, 0)
        done, doc_type = 0, pa.int64()

        def typed(batches):
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.schema.field(0).type
                yield batch

        stream = _stream(typed(batches), vocab, seq_len)
        while held := list(itertools.islice(stream, 500)):
            if done + len(held) > known:
                break
            yield placed(np.arange(offset + done, offset + done + len(held)), _columns(held, doc_type))
            done += len(held)
        if done != known or held:
            raise RuntimeError(f"partition {part} has other sequences than the {known} counted before")

    def given(batches):
        offset = held_out.value[1]
        for batch in batches:
            part, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield placed(np.array([offset[p] for p in part], np.int64) + place, batch.columns[2:])

    schema = f"slot long, shard int, seq long, doc_ids array<{kind}>, n_tokens int, ids binary"
    # The tables' tasks come first in a union: their numbers are those of the first pass.
    fresh = docs.select("doc_id", "text").mapInArrow(tidy(again), schema)
    return fresh.unionAll(first.filter("place is not null").select("part", "place", "doc_ids", "n_tokens", "ids").mapInArrow(tidy(given), schema))


def materialise_order(docs: DataFrame, path: str, vocab: bytes, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """Write the shards of ``shard_slots`` sequences and ``meta.json`` under ``path``: (slot, shard, byte_offset, seq, n_tokens, doc_ids) of every sequence."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialise(docs, "training-documents")
    first = first_pass(docs, vocab, seq_len)
    counts = {r["part"]: r["n"] for r in first.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    total, stride = sum(counts.values()), 2 * seq_len
    shards = -(-total // shard_slots)
    rows = sequences(docs, first, counts, vocab, seq_len, shard_slots, key)
    # A task for each shard; hashed, several shards would meet in one.
    dealt = rows.repartitionById(max(1, shards), "shard").sortWithinPartitions("slot")

    def write(batches):
        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        now, stream, temporary, held = None, None, "", 0

        def close():
            if stream is None:
                return
            stream.close()
            final = f"{root}/shard-{now:06d}.bin"
            try:
                store.move(temporary, final)
            except OSError:  # some stores do not overwrite: another attempt at this task was here, with the same content
                if store.get_file_info(final).size != held * stride:
                    raise
                store.delete_file(temporary)

        for batch in batches:
            shard = batch.column(1).to_numpy()
            for i, ids in enumerate(batch.column(5)):
                if shard[i] != now:
                    close()
                    now, held = int(shard[i]), 0
                    temporary = f"{root}/_shard-{now:06d}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(temporary)
                stream.write(ids.as_py())
                held += 1
            yield batch.select(["slot", "shard", "seq", "n_tokens", "doc_ids"])
        close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    written = materialise(dealt.mapInArrow(tidy(write), f"slot long, shard int, seq long, n_tokens int, doc_ids array<{kind}>"), "shard-rows")
    discard(first)
    meta = {"n": total, "seq_len": seq_len, "stride": stride, "shard_slots": shard_slots, "dtype": "<u2", "key": key}
    _write_text(spark, f"{path}/meta.json", json.dumps(meta))
    return written.select("slot", "shard", ((F.col("slot") - F.col("shard") * F.lit(shard_slots).cast("long")) * stride).alias("byte_offset"), "seq", "n_tokens", "doc_ids")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_slots(path: str, start: int, n: int) -> np.ndarray:
    """Ids of slots start..start+n-1 in training order, each row one sequence; reads only the bytes it needs."""
    from pyarrow import fs as pafs

    store, root = pafs.FileSystem.from_uri(path)
    meta = json.loads(store.open_input_stream(f"{root}/meta.json").read())
    out, stop = [], min(start + n, meta["n"])
    while start < stop:
        shard, inner = divmod(start, meta["shard_slots"])
        m = min(stop - start, meta["shard_slots"] - inner)
        with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(inner * meta["stride"])
            out.append(np.frombuffer(f.read(m * meta["stride"]), meta["dtype"]).reshape(m, meta["seq_len"]))
        start += m
    return np.concatenate(out) if out else np.empty((0, meta["seq_len"]), meta["dtype"])


def query(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/punctaria/training-order-{uuid.uuid4().hex}"
    return materialise_order(docs.select("doc_id", "text"), path, vocabulary(spark, vocabulary_path))
