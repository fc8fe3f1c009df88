"""Merges of many short units at once: a model's pieces as tables, units as rows of arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

#: Widths of the arrays that units share; longer units do not come here.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64)
#: Rows of one array.
ROWS = 8192
NEVER = np.iinfo(np.int32).max


def runs(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Indexes of runs laid end to end, each from its first index on."""
    return np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)


def code_points(units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all units, and the length of each."""
    return np.frombuffer("".join(units).encode("utf-32-le"), "<u4"), np.fromiter(map(len, units), np.int64, len(units))


class Lookup:
    """Numbers by key, -1 for keys without one: a key stands at its hash or in a slot soon after it."""

    def __init__(self, found: Mapping[int, int]) -> None:
        keys = np.fromiter(found.keys(), np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        bits = max(4, (2 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        slots = self.slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]], self.values[slots[free]] = keys[free], values[free]
            rest = self.keys[slots] != keys
            keys, values, slots = keys[rest], values[rest], slots[rest] + 1 & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self.slots(keys)
        held = self.keys[slots]
        out = self.values[slots]
        rest = np.flatnonzero(held != keys)
        out[rest] = -1
        rest = rest[held[rest] >= 0]
        slots = slots[rest]
        while len(rest):
            slots = slots + 1 & self.mask
            held = self.keys[slots]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slots[hit]]
            more = ~hit & (held >= 0)
            rest, slots = rest[more], slots[more]
        return out


class PieceTables:
    """The pieces of a model by their characters, and by the two parts that merge into them."""

    def __init__(self, ids: Mapping[str, int], rank: Mapping[str, float], size: int, bytes_: Sequence[int]) -> None:
        singles = sorted({c for piece in ids for c in piece})
        parts = {c: ids.get(c, size + i) for i, c in enumerate(singles)} | ids
        #: Stands for a character of no piece, which merges with nothing.
        self.none = size + len(singles)
        self.many, self.size, self.bytes = self.none + 1, size, np.array(bytes_, np.uint16)
        self.of_char = np.full(0x110000, self.none, np.int32)
        self.of_char[list(map(ord, singles))] = [parts[c] for c in singles]
        # Units hold blanks as they are; a literal mark is no blank.
        self.of_char[ord(" ")], self.of_char[ord("▁")] = self.of_char[ord("▁")], self.none
        self.worth = np.full(self.many, NEVER, np.int32)
        self.worth[list(map(ids.get, rank))] = np.unique(list(rank.values()), return_inverse=True)[1]

        pairs, steps, nodes, splits = {}, {}, {c: parts[c] for c in singles}, [[] for _ in range(size)]
        self.longest = max(map(len, ids))
        for piece, i in ids.items():
            at = nodes[piece[0]]
            for k in range(1, len(piece)):
                left, right = parts.get(piece[:k]), parts.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.many + right] = i
                    splits[i].append(k)
                at = steps.setdefault(at * self.many + parts[piece[k]], self.many + len(steps))
            nodes[piece] = at
        self.pairs, self.steps = Lookup(pairs), Lookup(steps)
        self.piece_at = np.full(self.many + len(steps), -1, np.int32)
        for piece, i in ids.items():
            if len(piece) > 1:
                self.piece_at[nodes[piece]] = i
        self.n_splits = np.array(list(map(len, splits)), np.int64)
        self.first_split = np.cumsum(self.n_splits) - self.n_splits
        self.splits = np.array([k for found in splits for k in found], np.int64)

    def candidates(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(left, split, end) of every possible merge of all units, and their number in each unit.

        In a unit they stand by falling left, rising split and falling end.
        """
        codes, lengths = code_points(units)
        chars = self.of_char[codes]
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(units)), lengths)
        end = (starts + lengths)[owner]
        at = np.arange(len(chars))
        node, keys = chars.astype(np.int64), []
        for size in range(2, self.longest + 1):
            inside = at + size <= end[at]
            at, node = at[inside], node[inside]
            node = self.steps.get(node * self.many + chars[at + size - 1])
            at, node = at[node >= 0], node[node >= 0].astype(np.int64)
            if not len(at):
                break
            piece = self.piece_at[node]
            found = np.flatnonzero(piece >= 0)
            piece, place = piece[found], at[found]
            times = self.n_splits[piece]
            split = self.splits[runs(self.first_split[piece], times)]
            unit, left = owner[place], place - starts[owner[place]]
            head = np.repeat((unit << 7 | 127 - left) << 14 | 127 - left - size, times)
            keys.append(head | np.repeat(left, times) + split << 7)
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        merges = np.stack([127 - (key >> 14 & 127), key >> 7 & 127, 127 - (key & 127)], 1).astype(np.uint8)
        return merges, np.bincount(key >> 21, minlength=len(units))

    def cut(self, units: Sequence[str], unit: np.ndarray, times: np.ndarray, skipped: np.ndarray):
        """(ids, first, many): the ids of cases; a case's are ``many`` from ``first`` on.

        A case is the number of a unit and how many rows it has in ``skipped``, where the (left, split, end)
        of the merges stand that are never made, case by case.
        """
        codes, lengths = code_points(units)
        starts = np.cumsum(lengths) - lengths
        lengths, starts, first_skipped = lengths[unit], starts[unit], np.cumsum(times) - times
        classes, parts, order = np.searchsorted(WIDTHS, lengths), [], []
        many = np.zeros(len(unit), np.int64)
        for k, width in enumerate(WIDTHS):
            mine = np.flatnonzero(classes == k)
            for some in (mine[i : i + ROWS] for i in range(0, len(mine), ROWS)):
                inside = np.arange(width) < lengths[some][:, None]
                own = np.zeros(inside.shape, np.uint32)
                own[inside] = codes[runs(starts[some], lengths[some])]
                barred = skipped[runs(first_skipped[some], times[some])]
                ids, many[some] = self._cut(own, inside, lengths[some], times[some], barred)
                parts.append(ids)
                order.append(some)
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        first = np.zeros(len(unit), np.int64)
        first[order] = np.cumsum(many[order]) - many[order]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), first, many

    def _cut(self, codes, inside, lengths, sizes, skipped) -> tuple[np.ndarray, np.ndarray]:
        many, width = codes.shape
        part = np.where(inside, self.of_char[codes], self.none).ravel()
        left, split, end = skipped.astype(np.int64).T
        barred = np.sort(np.repeat(np.arange(many), sizes) << 21 | left << 14 | split << 7 | end)
        barred = np.append(barred, np.iinfo(np.int64).max)

        def merged(row, left, split, end, first, second):
            """The piece of two parts side by side and its worth, NEVER if it is none or is skipped."""
            piece = self.pairs.get(first.astype(np.int64) * self.many + second)
            worth = self.worth[piece]
            ask = np.flatnonzero((piece >= 0) & (sizes[row] > 0))
            key = row[ask] << 21 | left[ask] << 14 | split[ask] << 7 | end[ask]
            worth[ask[barred[np.searchsorted(barred, key)] == key]] = NEVER
            worth[piece < 0] = NEVER
            return piece, worth

        place = np.tile(np.arange(width), (many, 1)).ravel()
        after, before = place + 1, place - 1
        standing = inside.ravel().copy()
        result, worth = np.zeros(many * width, np.int32), np.full(many * width, NEVER, np.int32)
        at = np.flatnonzero(place + 1 < np.repeat(lengths, width))
        result[at], worth[at] = merged(at // width, place[at], place[at] + 1, place[at] + 2, part[at], part[at + 1])
        rows, left_worth = np.arange(many), worth.reshape(many, width)
        while True:
            # The best merge of each row, leftmost among equals; rows without one are done.
            left = left_worth.argmin(1)
            on = left_worth[np.arange(len(rows)), left] != NEVER
            if not on.all():
                rows, left, left_worth = rows[on], left[on], left_worth[on]
            if not len(rows):
                break
            line, base, size = np.arange(len(rows)), rows * width, lengths[rows]
            here = base + left
            gone = after[here]
            end = after[base + gone]
            part[here], after[here], standing[base + gone] = result[here], end, False
            left_worth[line, gone] = left_worth[line, left] = NEVER
            right, back = np.flatnonzero(end < size), np.flatnonzero(before[here] >= 0)
            next_, prior = base[right] + end[right], before[here[back]]
            before[next_] = left[right]
            behind = base[back] + prior
            piece, value = merged(
                np.concatenate([rows[right], rows[back]]),
                np.concatenate([left[right], prior]),
                np.concatenate([end[right], left[back]]),
                np.concatenate([after[next_], end[back]]),
                np.concatenate([part[here[right]], part[behind]]),
                np.concatenate([part[next_], part[here[back]]]),
            )
            result[np.concatenate([here[right], behind])] = piece
            left_worth[np.concatenate([right, back]), np.concatenate([left[right], prior])] = value
        found = part[standing]
        sizes = standing.reshape(many, width).sum(1)
        if (found >= self.size).any():
            return self._spelled(found, codes.ravel()[standing], sizes)
        return found.astype(np.uint16), sizes

    def _spelled(self, found, codes, sizes) -> tuple[np.ndarray, np.ndarray]:
        """Parts without an id of their own as the ids of their bytes."""
        unknown = np.flatnonzero(found >= self.size)
        raw = [chr(c).encode("utf-8") for c in codes[unknown].tolist()]
        times = np.ones(len(found), np.int64)
        times[unknown] = list(map(len, raw))
        ids = np.repeat(found, times).astype(np.uint16)
        ids[np.repeat(found >= self.size, times)] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return ids, np.bincount(owner, times, len(sizes)).astype(np.int64)
