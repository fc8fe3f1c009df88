"""Token counts of whole texts from pieces counted once per distinct pre-token.

The tokenizer never merges across the borders of its pre-tokens, so a text has
as many tokens as its pre-tokens have pieces. Documents are gathered in blocks;
a block lists its distinct pre-tokens once, dealt into buckets by their hash,
and the frequencies of each of its documents by place in that list. A bucket
meets the lists of all blocks and counts the pieces of each pre-token once; the
counts go back to the blocks by place and are summed over the frequencies. So
what is shuffled are the distinct pre-tokens of each block and the packed
frequencies: a pre-token found in every document crosses once per block, and no
ids are built anywhere.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text, texts
from jobweave.llm.tokens import ByteTokenizer
from jobweave.sources.files import StagedFolder

#: A block ends at so many documents or characters; one longer text is a block of its own.
BLOCK_DOCS = 4096
BLOCK_CHARS = 1 << 23
#: Pre-tokens and bytes of one row of a block's list.
LIST_ROWS = 1024
LIST_BYTES = 1 << 16
LIMIT = 512
#: Code points whose classes `regex` and `tokenizers` are tested to agree on; other texts
#: are cut by `tokenizers` itself.
AGREED = r"\x00-՗Ḁ-ỿ‐-‧‰-⁞₠-₽←-⋿ぁ-ゖ一-龥"
SCHEMA = "block bigint, bucket int, first int, docs binary, tokens binary"


class PreTokens:
    """Cuts a text into pre-tokens, and counts the pieces of single ones."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        self.tokenizer = ByteTokenizer.shared(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.doubtful = regex.compile(f"[^{AGREED}]")
        special = self.tokenizer.special
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def cut(self, text: str) -> list[str]:
        if self.doubtful.search(text):
            cut = self.tokenizer.exact.pre_tokenizer.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in cut]
        return self.pattern.findall(text)

    def frequencies(self, text: str) -> tuple[Counter[str], int]:
        """(pre-tokens, special tokens); a special token's string is one token and cuts its surroundings."""
        if self.special is None or not self.special.search(text):
            return Counter(self.cut(text)), 0
        found: Counter[str] = Counter()
        parts = self.special.split(text)
        for part in parts:
            found.update(self.cut(part))
        return found, len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        encoded = self.tokenizer.exact.encode_batch(tokens, add_special_tokens=False)
        return [len(e.ids) for e in encoded]


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte by byte and compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_list(tokens: list[bytes]) -> bytes:
    lengths = np.array([len(t) for t in tokens], "<u4").tobytes()
    return struct.pack("<I", len(tokens)) + zstandard.ZstdCompressor(level=3).compress(lengths + b"".join(tokens))


def unpack_list(data: bytes) -> list[str]:
    count = struct.unpack_from("<I", data)[0]
    plain = zstandard.ZstdDecompressor().decompress(data[4:])
    ends = 4 * count + np.frombuffer(plain, "<u4", count).cumsum(dtype=np.int64)
    starts = [4 * count, *ends[:-1].tolist()]
    return [plain[a:b].decode("utf-8") for a, b in zip(starts, ends.tolist())]


class Block:
    """Documents on their way to being packed: their frequencies by place in one shared list."""

    def __init__(self) -> None:
        self.places: defaultdict[str, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.special: list[int] = []
        self.seen: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str, cutter: PreTokens) -> None:
        found, special = cutter.frequencies(text)
        places = self.places
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode("utf-8")))
        self.special.append(special)
        self.seen.append(np.array([places[t] for t in found], np.int64))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.chars >= BLOCK_CHARS

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        """The list's rows, bucket by bucket, then the row of the documents."""
        tokens = [t.encode("utf-8") for t in self.places]
        dealt = [xxhash.xxh3_64_intdigest(t) % buckets for t in tokens]
        order = sorted(range(len(tokens)), key=lambda i: (dealt[i], tokens[i]))
        place = np.empty(len(tokens), np.int64)
        place[order] = np.arange(len(tokens))
        first, held, size = 0, [], 0
        for number, i in enumerate(order):
            if held and (dealt[i] != dealt[order[first]] or len(held) == LIST_ROWS or size > LIST_BYTES):
                yield block, dealt[order[first]], first, None, pack_list(held)
                first, held, size = number, [], 0
            held.append(tokens[i])
            size += len(tokens[i])
        if held:
            yield block, dealt[order[first]], first, None, pack_list(held)
        yield block, None, None, self.packed(place), None

    def packed(self, place: np.ndarray) -> bytes:
        steps, times = [], []
        for seen, often in zip(self.seen, self.times):
            at = place[seen]
            order = np.argsort(at)
            steps.append(np.diff(at[order], prepend=0))
            times.append(often[order])
        parts = [
            np.array([i is not None for i in self.ids], np.uint32),
            *_halves(np.array([i or 0 for i in self.ids], np.int64)),
            *_halves(np.array(self.sizes, np.int64)),
            np.array(self.special),
            np.array([len(s) for s in self.seen]),
            np.concatenate(steps),
            np.concatenate(times),
        ]
        data = [pack(p) for p in parts]
        return struct.pack(f"<{len(data)}I", *map(len, data)) + b"".join(data)


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = values.view(np.uint64)
    return plain & np.uint64(0xFFFFFFFF), plain >> np.uint64(32)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))).view(np.int64)


def summed(data: bytes, pieces: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(ids, sizes, token counts) of a packed block whose pre-tokens have so many pieces."""
    sizes = struct.unpack_from("<9I", data)
    ends = 36 + np.cumsum(sizes)
    parts = [unpack(data[end - size : end]) for size, end in zip(sizes, ends)]
    known, id_low, id_high, size_low, size_high, special, counted, steps, times = parts
    after = np.cumsum(counted, dtype=np.int64)
    before = after - counted
    at = np.cumsum(steps, dtype=np.int64)
    # Places are steps within a document, so each one starts from the sum before it.
    at -= np.repeat(np.concatenate([[0], at])[before], counted)
    total = np.concatenate([[0], np.cumsum(pieces[at] * times.astype(np.int64))])
    ids = [i if k else None for i, k in zip(_joined(id_low, id_high).tolist(), known.tolist())]
    return ids, _joined(size_low, size_high), total[after] - total[before] + special


def _listed(path: str, buckets: int):
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["block", "bucket", "first", "docs", "tokens"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path)
        number, block = TaskContext.get().partitionId() << 32, Block()
        for ids, values in texts(batches):
            for doc_id, text in zip(ids.to_pylist(), values):
                block.add(doc_id, text, cutter)
                if block.full():
                    yield batch(list(block.rows(number, buckets)))
                    number, block = number + 1, Block()
        if block.ids:
            yield batch(list(block.rows(number, buckets)))

    return run


def _counted(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path)
        bucket, known = None, {}
        for batch in batches:
            found = []
            for own, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if own != bucket:
                    bucket, known = own, {}
                tokens = unpack_list(data)
                fresh = [t for t in tokens if t not in known]
                known.update(zip(fresh, cutter.pieces(fresh)))
                found.append(pack(np.array([known[t] for t in tokens])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["block", "first", "data"]
            )

    return run


def _summed(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("first").to_pylist(), table.column("data").to_pylist()), key=lambda r: r[0])
    # The documents of a block come as place -1.
    (_, docs), lists = rows[0], rows[1:]
    pieces = np.concatenate([unpack(d) for _, d in lists] or [np.zeros(0, np.uint32)]).astype(np.int64)
    ids, sizes, counts = summed(docs, pieces)
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": sizes, "n_tokens": counts})


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row: what the byte-level tokenizer gives its whole text.

    The string of a special token inside a text is that one token; none is
    added. A null or empty text has no bytes and no tokens. Repeated rows and
    null ids are counted each time; an empty table gives no row; other columns
    are not read, whatever their names. Memory per task: one block of documents
    with its distinct pre-tokens, or the distinct pre-tokens of one bucket, of
    which there are four per shuffle partition.
    """
    spark = docs.sparkSession
    path = tokenizer_path or ByteTokenizer.default_path()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = id_and_text(docs, id_col, text_col).mapInArrow(_listed(path, 4 * partitions), SCHEMA)
    # Staged whole by each task, so both readings below see the same blocks.
    blocks, _ = StagedFolder(spark, "token-blocks").write(listed, "blocks")
    lists = blocks.filter("bucket IS NOT NULL").select("block", "bucket", "first", "tokens")
    dealt = lists.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    pieces = dealt.mapInArrow(_counted(path), "block bigint, first int, data binary")
    packed = blocks.filter("bucket IS NULL").select("block", F.lit(-1).alias("first"), F.col("docs").alias("data"))
    counted = pieces.unionAll(packed).groupBy("block").applyInArrow(
        _summed, "id bigint, n_bytes bigint, n_tokens bigint"
    )
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
