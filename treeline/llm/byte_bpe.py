"""Byte-level BPE by corpus-level merge replay.

1. Each block of texts becomes one list of its distinct words and, for each text, the numbers of its words in that list.
2. The blocks' lists are dealt by word, so that each distinct word of the corpus is in one place. The words of a place are
   laid out as one array of tokens; an inverted index maps the rank of each mergeable pair to the positions where it stands;
   merges are applied in rank order to all words at once, and each application touches only the two neighbouring pairs.
3. Each block gets its words' ids back, packed, and spells out its texts' ids from the numbers.
Blocks are buckets of a staged table, so only distinct words of blocks are shuffled, never texts or their tokens; a
frequent word is one row a block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Blocks, block_ids, staged, table, unstage
from ._words import field, slices, trim

#: Bytes of text after which a block is closed, rows of words that are replayed side by side, and words whose ids a task keeps (more cost time only).
BLOCK_BYTES, REPLAY_ROWS, KEPT_WORDS = 32 << 20, 1 << 17, 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


def _alone(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word by itself: the lowest-ranked pair, leftmost first, until none is left, from a heap of pairs."""
    size, get = len(word), ranks.get
    end = list(range(1, size + 1))  # of the part that starts there; 0: no part starts there
    before = list(range(-1, size - 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= size or end[j] != stop:  # what stood there has changed
            continue
        end[i], end[j] = stop, 0
        if stop < size:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Merges:
    """The mergeable pairs of a vocabulary: left id * size + right id to the id (and rank) of what they spell."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        get = self.pairs.get
        self.first = np.array([[get(x * self.size + y, -1) for y in self.single.tolist()] for x in self.single.tolist()], np.int64)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): token ids of all words in a row, and the n + 1 offsets of each word's.

        A word in which a merge opens a pair of lower rank than the one being replayed is encoded by itself, as the
        order of merges differs from the ranks there.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.int32), begin
        size, get = self.size, self.pairs.get
        rank = np.full(len(data), -1, np.int64)
        rank[:-1] = self.first[data[:-1], data[1:]]
        last = begin[1:][np.diff(begin) > 0] - 1
        rank[last] = -1
        after_, before_ = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after_[last] = -1
        before_[begin[:-1][np.diff(begin) > 0]] = -1
        token, after, before = self.single[data].tolist(), after_.tolist(), before_.tolist()
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[places], prepend=-1))
        index = dict(zip(rank[places[cuts]].tolist(), (x.tolist() for x in np.split(places, cuts[1:])), strict=True)) if len(places) else {}
        heap, listed = sorted(index), index.get
        #: What the pair that starts at each position spells now; entries of the index that it no longer bears out are stale.
        pair = rank.tolist()
        odd = []
        while heap:
            now = heapq.heappop(heap)
            found = index.pop(now)
            found.sort()
            for i in found:
                if pair[i] != now:
                    continue
                j, h = after[i], before[i]
                token[i], token[j], pair[j] = now, -1, -1
                k = after[i] = after[j]
                new = -1
                if k >= 0:
                    before[k] = i
                    new = get(now * size + token[k], -1)
                pair[i] = new
                if new >= 0:
                    at = listed(new)
                    if at is not None:
                        at.append(i)
                    elif new < now:
                        odd.append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(heap, new)
                if h >= 0:
                    new = pair[h] = get(token[h] * size + now, -1)
                    if new >= 0:
                        at = listed(new)
                        if at is not None:
                            at.append(h)
                        elif new < now:
                            odd.append(i)
                        else:
                            index[new] = [h]
                            heapq.heappush(heap, new)
        ids = np.array(token, np.int64)
        alive = ids >= 0
        offsets = np.concatenate([[0], np.cumsum(alive)])[begin]
        ids = ids[alive].astype(np.int32)
        if odd:
            parts = np.split(ids, offsets[1:-1])
            for w in set((np.searchsorted(begin, odd, "right") - 1).tolist()):
                parts[w] = np.array(_alone(words[w], self.ranks), np.int32)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets


class Codec:
    """The vocabulary of a worker: merges, and decoding of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if pieces else np.zeros(0, np.int64)
        self.spelled = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        shift = np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.spelled[shift + np.arange(ends[-1])].tobytes()


_codecs: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    """The worker's own codec of a vocabulary that the driver has sent along."""
    if name not in _codecs:
        _codecs[name] = Codec(load_ranks(SparkFiles.get(name)))
    return _codecs[name]


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**31 as their first bytes, then their second bytes and so on, which packs far better."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _sent(docs: DataFrame, path: str) -> str:
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _splitter(pattern: str, columns: list[str]):
    """Blocks of rows (block, row, refs, words): `columns` of a row, its text's words as numbers in the block's list, and that list in a row of its own."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = regex.compile(pattern).findall
        ids, size = block_ids(TaskContext.get().partitionId()), 0
        block, numbers, kind = next(ids), {}, None

        def listed() -> pa.RecordBatch:
            words = pa.array([[w.encode() for w in numbers]], pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, kind), pa.nulls(1, pa.binary()), words], names=["block", "row", "refs", "words"])

        for whole in batches:
            for batch in slices(whole, "row.text"):
                row = batch.column("row")
                row = pa.StructArray.from_arrays([row.field(c) for c in columns], fields=[row.type.field(c) for c in columns])
                kind, refs = row.type, []
                for text in field(batch, "row.text").to_pylist():
                    words = found(text or "")
                    for word in set(words).difference(numbers):
                        numbers[word] = len(numbers)
                    refs.append(_planes(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                    size += len(text or "")
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), row, pa.array(refs, pa.binary()), pa.nulls(n, pa.list_(pa.binary()))], names=["block", "row", "refs", "words"])
                if size >= BLOCK_BYTES:
                    yield listed()
                    block, numbers, size = next(ids), {}, 0
        if kind is not None and size:
            yield listed()

    return split


_PACKED = "block long, words int, packed binary, bytes long"


def _replayer(name: str):
    """Rows (block, number, word) to packed rows (_PACKED): of some words of a block the steps between their numbers, how many ids each has, and the ids."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known, held = _codec(name).merges, {}, []

        def flush() -> pa.RecordBatch:
            nonlocal known
            rows = pa.Table.from_batches(held)
            words = rows.column("word").to_pylist()
            if len(known) > KEPT_WORDS:
                known = {}
            new = list(set(words).difference(known))
            ids, at = merges.replay(new)
            raw, at = ids.astype("<i4").tobytes(), at.tolist()
            known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(new, at[:-1], at[1:], strict=True))
            blocks, numbers = rows.column("block").to_numpy(), rows.column("number").to_numpy()
            order = np.lexsort((numbers, blocks))
            found = [known[words[i]] for i in order.tolist()]
            counts, numbers, blocks = np.array([len(x) >> 2 for x in found]), numbers[order], blocks[order]
            cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
            ends, packed, sizes = np.append(cuts[1:], len(blocks)), [], []
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                ids = np.frombuffer(b"".join(found[a:b]), "<i4")
                data = _planes(np.concatenate([np.diff(numbers[a:b], prepend=0), counts[a:b], ids]))
                packed.append(pa.compress(data, codec="zstd", asbytes=True))
                sizes.append(len(data))
            return pa.RecordBatch.from_arrays([pa.array(blocks[cuts]), pa.array(ends - cuts, pa.int32()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], names=["block", "words", "packed", "bytes"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= REPLAY_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return replay


def _unpacked(rows: pa.Table) -> list[bytes]:
    """The ids of a block's words by number."""
    of: list[bytes] = [b""] * sum(rows.column("words").to_pylist())
    for n, packed, size in zip(*(rows.column(c).to_pylist() for c in ("words", "packed", "bytes")), strict=True):
        all_ = _from_planes(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True))
        numbers, ends, raw = np.cumsum(all_[:n]).tolist(), (4 * np.cumsum(all_[n : 2 * n], dtype=np.int64)).tolist(), all_[2 * n :].tobytes()
        for number, a, b in zip(numbers, [0, *ends], ends, strict=False):
            of[number] = raw[a:b]
    return of


def _spelled(docs: DataFrame, path: str, pattern: str, columns: list[str], use, fields: T.StructType) -> DataFrame:
    """use(words, rows, refs) of each block: ids of its words (bytes by number), rows with `columns`, and each row's numbers."""
    name = _sent(docs, path)
    packed = docs.select(F.struct(*dict.fromkeys([*columns, "text"])).alias("row"))
    row = T.StructType([packed.schema["row"].dataType[c] for c in columns])
    schema = T.StructType().add("block", "long").add("row", row).add("refs", "binary").add("words", T.ArrayType(T.BinaryType()))
    split = packed.mapInArrow(_splitter(pattern, columns), schema)
    blocks = Blocks(split, "refs")
    words = blocks.rows.where("words is not null").select("block", F.posexplode("words").alias("number", "word"))
    back = words.repartition("word").mapInArrow(_replayer(name), _PACKED)

    def spell(rows: pa.Table, ids: pa.Table) -> pa.Table:
        rows = rows.filter(rows.column("refs").is_valid())
        trim()
        return use(_unpacked(ids), rows.column("row"), [_from_planes(r) for r in rows.column("refs").to_pylist()])

    out = staged(blocks.grouped("row", "refs").cogroup(back.groupBy("block")).applyInArrow(spell, fields), "spelled")
    blocks.close()
    unstage(blocks.rows)
    return out


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with a column `ids` (array<int>) of each whole text; null counts as empty. path: a file of ranks on the driver."""
    docs = docs.drop("ids")
    fields = T.StructType().add("row", docs.schema).add("ids", T.ArrayType(T.IntegerType()))

    def use(of, rows, refs) -> pa.Table:
        ids = [np.frombuffer(b"".join(map(of.__getitem__, r.tolist())), np.int32) for r in refs]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
        return pa.table({"row": rows, "ids": lists})

    return _spelled(docs, path, pattern, docs.columns, use, fields).select("row.*", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with a column `bytes` of what its `ids` spell; null ids give null."""
    name = _sent(encoded, path)
    fields = T.StructType(encoded.drop("bytes").schema.fields).add("bytes", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            out = [None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("bytes", pa.array(out, pa.binary()))

    return encoded.drop("bytes").mapInArrow(run, fields)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: every whole text is encoded and its ids decoded again.

    Null counts as empty: no tokens, digests of the empty string. Rows are independent: repeated and null ids stay as they
    are. What ids spell, in decimal and decoded, is worked out once for each distinct word of a block.
    """
    name = path.rsplit("/", 1)[-1]
    fields = T.StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def use(of, rows, refs) -> pa.Table:
        codec = _codec(name)
        ids = [np.frombuffer(raw, np.int32) for raw in of]
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        ends = np.concatenate([[0], np.cumsum(codec.sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        spelled = codec.decode(flat)
        back = [spelled[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        decimal = ["".join([f"{i} " for i in x.tolist()]).encode() for x in ids]
        n, coded, decoded = [], [], []
        for r in refs:
            numbers = r.tolist()
            n.append(int(counts[r].sum()))
            coded.append(hashlib.sha256(b"".join(map(decimal.__getitem__, numbers))[:-1]).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(back.__getitem__, numbers))).hexdigest())
        ids_ = pc.struct_field(rows.combine_chunks(), "doc_id") if rows.length() else pa.array([], pa.int64())
        return pa.table({"doc_id": ids_, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _spelled(docs, path, pattern, ["doc_id"], use, fields)


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), *vocabulary())
