"""Byte-pair encoding of whole texts, each shared content-defined chunk encoded once; decoding.

1. Texts are cut where a rolling hash of the last ``WINDOW`` bytes has ``MASK_BITS`` zero bits, so equal passages are cut alike wherever they stand. A first pass over the
   texts counts chunk keys (128-bit hashes), combined before the shuffle; chunks found twice or more are shared. Their keys go into a bit filter of a fixed size
   (``FILTER_BITS``), which is sent to all tasks.
2. A second pass encodes what the filter does not know where it stands, in runs of chunks. A text without a shared chunk is done there. Of other texts the task writes
   the encoded runs, a reference for each shared chunk, and the text of a shared chunk once a task.
3. Shared chunks are dealt by key and encoded once each; references meet them in a join of two written tables, which adaptive execution can split at a chunk that very many texts share.
4. The pieces of a text come together in order and every join is repaired: the text from the last white space before it to the first white space after it is encoded again and
   compared with the ids that the two sides gave; where they differ it replaces them. A piece without white space belongs to the window as a whole, which grows over as many pieces as it takes.
   The vocabulary's normaliser and pattern start anew at white space and drop it (checked when it is loaded), so ids outside the window agree with those of the whole text exactly.

A wrong bit of the filter only sends a chunk the longer way; it never changes ids. The encoder keeps the ids of up to ``MEMO`` words, delimited by ASCII white space, in each worker.

Defined results: null and empty texts have no ids and decode to the empty text; rows are encoded one by one, so ties, null ids and repeated rows each give their row; very long texts are
encoded in pieces of at most ``MAX_BYTES`` bytes; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches, tidy

WINDOW, MASK_BITS, MIN_BYTES, MAX_BYTES = 32, 10, 256, 1 << 16
#: Bits of the filter of shared keys, 8 MB: the most that the driver and a task hold of it at any size of the corpus.
FILTER_BITS = 26
#: Words that a worker remembers: half of them since it last began anew, and the half before.
MEMO = 1_200_000
#: Longer words, in bytes, are not remembered.
LONG_WORD = 64
_BLOCK = 1 << 20
_BUCKET_BITS = 15  # bits of one row of Spark's bitmap aggregates
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, np.uint32)
_WHITE = b" \t\n\r\x0b\x0c"
#: A word that stands between others when many are encoded at once.
_MARK = "\x02"

_loaded: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _candidates(b: np.ndarray) -> np.ndarray:
    """Places before which the hash of the last bytes allows a cut, never within a character."""
    out = []
    for at in range(0, len(b), _BLOCK):
        lo = max(0, at - WINDOW)
        part = b[lo : at + _BLOCK]
        h = _GEAR[part]
        span = 1
        while span < WINDOW:  # sums of shifted values over 2, 4, ... bytes
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        places = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + lo + 1
        out.append(places[(places > max(at, WINDOW - 1)) & (places < len(b))])
    places = np.concatenate(out) if out else np.zeros(0, np.int64)
    return places[(b[places] & 0xC0) != 0x80]


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    n, last, ends = len(text), 0, []
    b = np.frombuffer(text, np.uint8)
    places = _candidates(b)
    while last < n:
        i = np.searchsorted(places, last + MIN_BYTES)
        end = int(places[i]) if i < len(places) else n
        if end - last > MAX_BYTES:
            end = last + MAX_BYTES
            while b[end] & 0xC0 == 0x80:
                end -= 1
        ends.append(end)
        last = end
    return ends


def _key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _bits(keys: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(keys), ">u8")[::2] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


class Encoder:
    """Ids of texts, with a memory of words, and texts of ids."""

    def __init__(self, content: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        if size > 0x10000:
            raise ValueError("the vocabulary has more than 65536 ids")
        if self.ids_of(" a \n\tb ") != self.ids_of("a") + self.ids_of("b"):
            raise ValueError("the vocabulary keeps white space, so chunks cannot be joined at it")
        self.mark = self.ids_of(_MARK)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab(True)
        names = [b""] * size
        for token, i in tokens.items():
            names[i] = token.encode()
        self.plain = self.tokenizer.decoder is None  # then tokens are joined by spaces
        self.names, self.numbers = _Table([x + b" " for x in names]), _Table([b"%d " % i for i in range(size)])

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not remembered."""
        mark, out, some = _MARK.encode(), {}, list(words)
        everything = b" ".join(some)
        if len(self.mark) != 1:
            some = []
        elif mark in everything or any(s in everything for s in self.special):
            some = [w for w in some if mark not in w and not any(s in w for s in self.special)]
        if len(some) < len(words):
            for w in words.difference(some):
                out[w] = np.array(self.ids_of(w.decode()), np.uint16).tobytes()
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            ids = np.array(self.ids_of(f" {_MARK} ".join(w.decode() for w in part)), np.uint16)
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            if len(ends) != len(part):
                raise RuntimeError("the mark between words was merged away")
            lo = 0
            for w, hi in zip(part, ends, strict=True):
                out[w] = ids[lo:hi].tobytes()
                lo = hi + 1
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 16-bit numbers."""
        own = set(words)
        fresh = own.difference(self.memo)
        if not fresh:
            return [self.memo[w] for w in words]
        learned = {w: self.older[w] for w in self.older.keys() & fresh}
        learned |= self._fresh(fresh.difference(learned))
        if len(self.memo) + len(learned) > MEMO // 2:
            self.older, self.memo = self.memo, {w: self.memo[w] for w in own.difference(fresh)}
        memo = self.memo
        memo.update(learned)
        out = [memo[w] for w in words]
        for w in [w for w in fresh if len(w) > LONG_WORD]:
            del memo[w]
        return out

    def encode(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(self.words(text.split())), np.uint16)

    def piece(self, text: bytes) -> tuple:
        """(ids, head, tail, n_head, n_tail): the words that touch the ends and their numbers of ids; one without white space is all head, and n_tail is -1."""
        words = text.split()
        found = self.words(words)
        ids = b"".join(found)
        if len(words) == 1 and len(words[0]) == len(text):
            return ids, text, b"", len(ids) // 2, -1
        first = bool(words) and text[:1] not in _WHITE_SET
        last = bool(words) and text[-1:] not in _WHITE_SET
        return ids, words[0] if first else b"", words[-1] if last else b"", len(found[0]) // 2 if first else 0, len(found[-1]) // 2 if last else 0

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, special tokens kept, in UTF-8."""
        if not self.plain:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        return b"".join(self.names.joined(ids))[:-1]

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, and hashes of their decimal list and of the decoded text."""

        def sha(parts) -> str:
            h, held = hashlib.sha256(), b""
            for part in parts:
                h.update(held)
                held = part
            h.update(held[:-1])
            return h.hexdigest()

        text = sha(self.names.joined(ids)) if self.plain else hashlib.sha256(self.decode(ids)).hexdigest()
        return len(ids), sha(self.numbers.joined(ids)), text


_WHITE_SET = {bytes([c]) for c in _WHITE}


class _Table:
    """Byte strings by number, strung together for arrays of numbers."""

    def __init__(self, values: list[bytes]) -> None:
        self.size = np.array([len(v) for v in values], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray):
        for at in range(0, len(ids), 1 << 14):
            part = ids[at : at + (1 << 14)]
            size = self.size[part]
            ends = np.cumsum(size)
            yield self.flat[np.repeat(self.start[part] - ends + size, size) + np.arange(ends[-1])].tobytes()


def _encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = Encoder(content)
    return _loaded[key]


def joined(encoder: Encoder, pieces) -> np.ndarray:
    """Ids of a text from its pieces in order, as ``Encoder.piece`` gives them, with every join repaired."""
    out: list[bytes] = []
    text, ids, parts = b"", b"", 0  # the open window before the next white space: its text and the ids that its parts gave

    def settle() -> None:
        nonlocal ids
        if parts > 1:
            again = b"".join(encoder.words([text]))
            if again != ids:
                ids = again
        out.append(ids)

    for own, head, tail, n_head, n_tail in pieces:
        if head:
            text, ids, parts = text + head, ids + own[: 2 * n_head], parts + 1
        if n_tail < 0:
            continue
        settle()
        out.append(own[2 * n_head : len(own) - 2 * n_tail])
        text, ids, parts = tail, own[len(own) - 2 * n_tail :] if n_tail else b"", int(bool(tail))
    settle()
    return np.frombuffer(b"".join(out), np.uint16)


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(key, bit), written: keys of chunks that ``docs`` (text as binary) hold twice or more, and their place in the filter."""

    def run(batches):
        for batch in batches:
            keys: list[bytes] = []
            for t in batch.column(0):
                text, at = t.as_py() or b"", 0
                for end in cuts(text):
                    keys.append(_key(text[at:end]))
                    at = end
                if len(keys) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(_bits(keys))], ["key", "bit"])
                    keys = []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(_bits(keys))], ["key", "bit"])

    found = docs.select("text").mapInArrow(tidy(run), "key binary, bit long")
    return materialise(found.groupBy("key", "bit").agg(F.count("*").alias("n")).filter("n > 1").select("key", "bit"), "shared-chunks")


def chunk_filter(shared: DataFrame) -> np.ndarray:
    """The bits of all shared keys: at most ``2 ** FILTER_BITS`` of them, whatever the number of keys."""
    rows = shared.groupBy(F.shiftright("bit", _BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << _BUCKET_BITS) - 1)).alias("bits")).collect()
    out = np.zeros((1 << (FILTER_BITS - _BUCKET_BITS), 1 << (_BUCKET_BITS - 3)), np.uint8)
    for r in rows:
        out[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


_PIECE = "row long, pos int, key binary, own binary, head binary, tail binary, n_head int, n_tail int"
_DONE, _PART, _REFERENCE, _TEXT = range(4)


def _second_pass(docs: DataFrame, content: str, known, finish: Callable, names: list[str], schema: str) -> DataFrame:
    """Rows of four kinds from ``docs`` (doc_id, row, text): finished texts, encoded pieces, references, and texts of shared chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, bits, sent = _encoder(content), known.value, set()
        blank_piece, blank_end = (None,) * 6, (None,) * len(names)

        def is_known(keys: list[bytes]) -> np.ndarray:
            at = _bits(keys)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            rows, size = [], 0
            for doc, row, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, pieces, lo, run_from = t or b"", [], 0, 0
                ends = cuts(text)
                chunks = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                keys = [_key(c) for c in chunks]
                hits = is_known(keys) if keys else []
                for c, k, hit, end in zip(chunks, keys, hits, ends, strict=True):
                    if run_from < lo and (hit or end - run_from > MAX_BYTES):
                        pieces.append((None, text[run_from:lo]))
                        run_from = lo
                    if hit:
                        pieces.append((k, c))
                        run_from = end
                    lo = end
                if run_from < lo:
                    pieces.append((None, text[run_from:lo]))
                if not any(k for k, _ in pieces):
                    ids = encoder.encode(text) if len(pieces) <= 1 else joined(encoder, (encoder.piece(c) for _, c in pieces))
                    rows.append((_DONE, doc, row, None, *blank_piece, *finish(encoder, ids)))
                    size += 200
                else:
                    for pos, (k, c) in enumerate(pieces):
                        if k is None:
                            rows.append((_PART, doc, row, pos, None, *encoder.piece(c), *blank_end))
                            size += 2 * len(c)
                            continue
                        rows.append((_REFERENCE, doc, row, pos, k, None, None, None, None, None, *blank_end))
                        if k not in sent:
                            sent.add(k)
                            rows.append((_TEXT, None, None, None, k, c, None, None, None, None, *blank_end))
                            size += len(c)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)

    full = f"kind byte, doc_id {kind}, {_PIECE}, {schema}"
    types, columns = _arrow(docs.sparkSession, full)
    return docs.mapInArrow(tidy(run), full)


def _arrow(spark: SparkSession, schema: str) -> tuple[list, list[str]]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]


def _encoded_once(texts: DataFrame, content: str) -> DataFrame:
    """Each key's piece from (key, own), where ``own`` is the chunk's text and keys may come several times; dealt by key."""

    def run(batches):
        encoder, done = _encoder(content), set()
        for batch in batches:
            rows = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k not in done:
                    done.add(k)
                    rows.append((k, *encoder.piece(c)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)

    schema = "key binary, own binary, head binary, tail binary, n_head int, n_tail int"
    types, columns = _arrow(texts.sparkSession, schema)
    return texts.repartition("key").mapInArrow(tidy(run), schema)


def encode(docs: DataFrame, path: str | None = None, finish: Callable | None = None, schema: str = "ids array<int>") -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text). ``finish`` makes other columns of a text's encoder and ids, as ``schema`` names them."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path or default_vocabulary(), encoding="utf-8") as f:  # under 5 MB, read by the driver
        content = f.read()
    finish = finish or (lambda encoder, ids: (ids.tolist(),))
    _, names = _arrow(spark, schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))

    shared = shared_chunks(texts)
    known = spark.sparkContext.broadcast(chunk_filter(shared))
    discard(shared)
    found = materialise(_second_pass(texts, content, known, finish, names, schema), "encoded")
    chunks = materialise(_encoded_once(found.filter(F.col("kind") == _TEXT).select("key", "own"), content), "encoded-chunks")
    piece = ["own", "head", "tail", "n_head", "n_tail"]
    references = found.filter(F.col("kind") == _REFERENCE).select("doc_id", "row", "pos", "key").join(chunks, "key").select("doc_id", "row", "pos", *piece)
    pieces = references.unionByName(found.filter(F.col("kind") == _PART).select("doc_id", "row", "pos", *piece))
    laid = pieces.repartition("row").sortWithinPartitions("row", "pos")

    def assemble(batches):
        encoder, now, held, out = _encoder(content), None, [], []

        def end() -> None:
            out.append((now[1], *finish(encoder, joined(encoder, held))))

        for batch in batches:
            for doc, row, _, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != row:
                    if now is not None:
                        end()
                    now, held = (row, doc), []
                held.append(own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)
                out = []
        if now is not None:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)

    full = f"doc_id {kind}, {schema}"
    types, columns = _arrow(spark, full)
    done = found.filter(F.col("kind") == _DONE).select("doc_id", *names)
    return done.unionByName(laid.mapInArrow(tidy(assemble), full))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        content = f.read()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = _encoder(content)
        for batch in batches:
            texts = [encoder.decode(np.array(ids or [], np.uint16)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, text string")


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, finish=lambda encoder, ids: encoder.digests(ids), schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
