"""Byte-fallback BPE segmentation with seeded merge-dropout, and its exact inverse.

Merges are taken from an agenda, best rank first and leftmost among equals. A
candidate merge is a left end, a split and a right end in a unit; each candidate
of each occurrence of a unit has a draw of its own, and is skipped for good if
that falls below the dropout rate, a multiple of 1/65536. The draws come from a
counter-based generator keyed by the seed and the document's id, dealt out in the
order of the text, so a text is cut the same way on every attempt. The texts of a
batch are cut together: a unit with a set of skipped candidates once, and all such
cases side by side. Which texts share a batch does not choose a cut.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import id_and_text, slices
from jobweave.llm.piecetables import PieceTables, runs

BLANK = "▁"
DROPOUT = 0.1
SEED = 11
#: Units longer than this are cut one by one.
LONG = 64
#: Characters of the texts that are cut together.
TOGETHER = 2_000_000
#: Candidates of a listed unit, whose numbers are single bytes.
MOST = 256
#: Stands for a literal blank mark, which merges with nothing; no text holds it.
MARK = "\ud800"
#: No merge of the model crosses from other characters to a blank, so units are cut alone.
_UNIT = re.compile(r" *[^ ]+| +")


class _Hashed:
    """The skipped candidates of a unit too long to list them: a keyed hash of each decides."""

    def __init__(self, key: bytes, below: int) -> None:
        self.key, self.below = key, below

    def __contains__(self, candidate: tuple[int, int, int]) -> bool:
        return xxhash.xxh3_64_intdigest(b"%s %d %d %d" % (self.key, *candidate)) >> 48 < self.below


def _cases(units: np.ndarray, owner: np.ndarray, skipped: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A number for each occurrence of a unit, the same only for those of one unit with the same skips.

    Occurrences with more than four skips have one each.
    """
    key = units << 36
    if len(owner):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        nth = np.arange(len(owner)) - np.repeat(starts, np.diff(starts, append=len(owner)))
        key[owner[starts]] += np.add.reduceat(np.where(nth < 4, skipped + 1 << 9 * np.minimum(nth, 3), 0), starts)
    crowded = np.flatnonzero(times > 4)
    key[crowded] = -1 - crowded
    return key


class Segmenter:
    """The pieces of a SentencePiece BPE model with byte fallback."""

    _loaded: dict[tuple, Segmenter] = {}

    def __init__(self, path: str, dropout: float, seed: int, together: int = TOGETHER) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if size > 1 << 16:
            raise ValueError("ids are held in two bytes; the model has more pieces")
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.ids = {model.id_to_piece(i): i for i in range(size) if not special[i]}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [0] * 256
        self.pieces = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[value] = i
                self.pieces[i] = bytes([value])
            elif not special[i]:
                self.pieces[i] = model.id_to_piece(i).replace(BLANK, " ").encode("utf-8")
        self.tables = PieceTables(self.ids, self.rank, size, self.bytes)
        self.cut_below = round(dropout * 65536)
        self.seed, self.together = seed, together

    @staticmethod
    def default_path() -> str:
        import public_tokenizers

        return public_tokenizers.path("piece_bpe_32k.model")

    @classmethod
    def shared(cls, *settings) -> Segmenter:
        if settings not in cls._loaded:
            cls._loaded[settings] = cls(*settings)
        return cls._loaded[settings]

    def candidates(self, unit: str) -> bytes | None:
        """(left, split, end), three bytes each, of every merge that some order of merges could propose.

        None if the unit is too long or they are too many to be numbered by a byte.
        """
        if not self.cut_below:
            return b""
        if len(unit) > LONG:
            return None
        merges, _ = self.tables.candidates([unit])
        return merges.tobytes() if len(merges) <= MOST else None

    def cut(self, unit: str, skipped=()) -> bytes:
        """Ids of one unit, two bytes each: characters merged by the agenda, the unknown as bytes."""
        text = list(unit.replace(BLANK, MARK).replace(" ", BLANK))
        size = len(text)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        rank = self.rank.get
        push, pop = heapq.heappush, heapq.heappop
        agenda: list[tuple[float, int, int, str]] = []
        for left, both in enumerate(map(add, text, text[1:])):
            worth = rank(both)
            if worth is not None and (left, left + 1, left + 2) not in skipped:
                agenda.append((worth, left, left + 1, both))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = pop(agenda)
            # Stale unless both neighbours are still what they were.
            if after[left] != right or text[left] + text[right] != both:
                continue
            text[left], text[right] = both, ""
            following = after[left] = after[right]
            after[right] = -1
            if following < size:
                before[following] = left
                more = both + text[following]
                worth = rank(more)
                if worth is not None and (left, following, left + len(more)) not in skipped:
                    push(agenda, (worth, left, following, more))
            first = before[left]
            if first >= 0:
                more = text[first] + both
                worth = rank(more)
                if worth is not None and (first, left, first + len(more)) not in skipped:
                    push(agenda, (worth, first, left, more))
        pieces = list(filter(None, text))
        found = list(map(self.ids.get, pieces))
        if None in found:
            found = [i for p, known in zip(pieces, found) for i in ([known] if known is not None else self.spelled(p))]
        return array("H", found).tobytes()

    def spelled(self, piece: str) -> list[int]:
        return [self.bytes[b] for b in piece.replace(MARK, BLANK).encode("utf-8")]

    def encode(self, text: str, doc_id: int | None = 0) -> bytes:
        """Ids of a whole text, four bytes each; the id and the seed choose the draws."""
        return self.encode_all([text], [doc_id])[0]

    def encode_all(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes | None]:
        """Ids of each text, as ``encode`` gives them; null texts have none."""
        out: list[bytes | None] = []
        start = chars = 0
        for stop, text in enumerate(texts, 1):
            chars += len(text or "")
            if chars >= self.together or stop == len(texts):
                out += self._encode_some(texts[start:stop], doc_ids[start:stop])
                start, chars = stop, 0
        return out

    def _encode_some(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes | None]:
        keys = [b"%d %s" % (self.seed, str(doc_id).encode()) for doc_id in doc_ids]
        cut_up = [_UNIT.findall(" " + text) if text else [] for text in texts]
        stops = np.cumsum([0, *map(len, cut_up)])
        every = list(chain.from_iterable(cut_up))
        number = {unit: i for i, unit in enumerate(dict.fromkeys(every))}
        units = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        # Tables take the short units; the others keep their numbers.
        known = [unit if len(unit) <= LONG else "" for unit in number]
        merges, counts = self.tables.candidates(known if self.cut_below else [""] * len(known))
        first = np.cumsum(counts) - counts
        apart = (counts > MOST) | ~np.fromiter(map(bool, known), bool, len(known))
        counts[apart] = 0

        owner, skipped = self._skipped(counts[units], stops, keys)
        times = np.bincount(owner, minlength=len(units))
        tabled, single = np.flatnonzero(~apart[units]), np.flatnonzero(apart[units])
        _, sources, case = np.unique(_cases(units, owner, skipped, times)[tabled], return_index=True, return_inverse=True)
        sources = tabled[sources]
        rows = runs((np.cumsum(times) - times)[sources], times[sources])
        barred = merges[first[units[owner[rows]]] + skipped[rows]]
        ids, begin, many = self.tables.cut(known, units[sources], times[sources], barred)
        pool, begins, sizes, held = [ids], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), len(ids)
        begins[tabled], sizes[tabled] = begin[case], many[case]
        for i, doc in zip(single.tolist(), (np.searchsorted(stops, single, side="right") - 1).tolist()):
            hashed = _Hashed(b"%s %d" % (keys[doc], i - stops[doc]), self.cut_below) if self.cut_below else ()
            pool.append(np.frombuffer(self.cut(every[i], hashed), np.uint16))
            begins[i], sizes[i] = held, len(pool[-1])
            held += len(pool[-1])
        raw = np.concatenate(pool)[runs(begins, sizes)].astype("<u4").tobytes()
        ends = (4 * np.append(0, np.cumsum(sizes))[stops]).tolist()
        return [None if text is None else raw[a:b] for text, a, b in zip(texts, ends, ends[1:])]

    def _skipped(self, sizes: np.ndarray, stops: Sequence[int], keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(unit, number) of every skipped candidate: a draw for each candidate of a document, in order."""
        ends = np.append(0, np.cumsum(sizes))
        found = [np.zeros(0, np.int64)]
        for key, start, stop in zip(keys, ends[stops[:-1]].tolist(), ends[stops[1:]].tolist()):
            source = np.random.Philox(key=xxhash.xxh3_128_intdigest(key))
            draws = source.random_raw((stop - start) // 4 + 1).astype("<u8", copy=False).view("<u2")[: stop - start]
            found.append(start + np.flatnonzero(draws < self.cut_below))
        at = np.concatenate(found)
        owner = np.searchsorted(ends[1:], at, side="right")
        return owner, at - ends[owner]

    def skips(self, listed: list[bytes], key: bytes) -> list[bytes]:
        """The numbers of the skipped candidates of each unit of one document."""
        sizes = np.fromiter(map(len, listed), np.int64, len(listed)) // 3
        owner, numbers = self._skipped(sizes, np.array([0, len(listed)]), [key])
        raw = numbers.astype(np.uint8).tobytes()
        upto = np.searchsorted(owner, np.arange(len(listed)), side="right").tolist()
        return [raw[a:b] for a, b in zip([0, *upto], upto)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids from ``encode``: the joined bytes without the leading blank."""
        raw = b"".join(map(self.pieces.__getitem__, ids))
        return raw.decode("utf-8", "replace")[1:]

    def decoded(self, ids: bytes | None) -> str | None:
        return None if ids is None else self.decode(np.frombuffer(ids, "<u4").tolist())


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str | None = None,
    dropout: float = DROPOUT,
    seed: int = SEED,
) -> DataFrame:
    """(id_col, ids) of every row; ``ids`` are four bytes each, least significant first.

    The seed, the id and the place of a unit choose its segmentation, anew for
    each occurrence; ``dropout`` 0 gives the model's own. A null text gives null
    ids, an empty text none. Repeated rows are cut alike; an empty table gives
    an empty result; other columns are not read. Memory per task: a batch of
    texts and the arrays of ``TOGETHER`` of their characters, or of one text that is longer.
    """
    settings = (model_path or Segmenter.default_path(), dropout, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.shared(*settings)
        for batch in slices(batches):
            raw = segmenter.encode_all(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, "id bigint, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """(id_col, ids_col, text) of every encoded row; null ids give a null text."""
    path = model_path or Segmenter.default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.shared(path, 0.0, 0)
        for batch in batches:
            plain = list(map(segmenter.decoded, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plain, pa.string())], ["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    decoded = rows.mapInArrow(run, "id bigint, ids binary, text string")
    return decoded.withColumnsRenamed({"id": id_col, "ids": ids_col})


def with_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, text, ids, decoded) of every row: each text beside its ids and what they decode to.

    One task encodes and decodes a batch, so neither texts nor ids are moved to
    meet each other. Options and edge cases are those of :func:`encode`.
    """
    settings = (
        options.get("model_path") or Segmenter.default_path(),
        options.get("dropout", DROPOUT),
        options.get("seed", SEED),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.shared(*settings)
        for batch in slices(batches):
            raw = segmenter.encode_all(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            plain = [segmenter.decoded(r) for r in raw]
            columns = [*batch.columns, pa.array(raw, pa.binary()), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text", "ids", "decoded"])

    rows = id_and_text(docs, id_col, text_col)
    found = rows.mapInArrow(run, "id bigint, text string, ids binary, decoded string")
    return found.withColumnRenamed("id", id_col)
