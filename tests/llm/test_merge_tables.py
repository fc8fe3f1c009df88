"""Units of a batch are cut together, each as it is cut alone."""

from __future__ import annotations

import numpy as np
import pytest

from jobweave.llm import merges

TEXTS = [
    "The cat sat on the mat, the cat sat again and the dog  barked   at it.",
    "",
    None,
    "a literal ▁mark and ▁▁ two, naïve façade, 東京都 \U0001f600\U0001f600 and \x00 \n\n\t tabs",
    "x" * 64 + " " + "ab" * 40 + " " + "internationalization" * 3 + "    ",
    "the the the the " * 50,
    " ",
]


def plain(segmenter, text, doc_id):
    """The ids of a text, unit by unit, with the merges of each taken from an agenda."""
    key = b"%d %d" % (segmenter.seed, doc_id)
    units = merges._UNIT.findall(" " + text) if text else []
    listed = [segmenter.candidates(u) for u in units]
    out = b""
    for i, (unit, found, numbers) in enumerate(zip(units, listed, segmenter.skips([f or b"" for f in listed], key))):
        if found is None:
            skipped = merges._Hashed(b"%s %d" % (key, i), segmenter.cut_below)
        else:
            skipped = {tuple(found[3 * n : 3 * n + 3]) for n in numbers}
        out += segmenter.cut(unit, skipped)
    return np.frombuffer(out, np.uint16).tolist()


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_units_cut_together_are_cut_as_alone(dropout):
    segmenter = merges.Segmenter(merges.Segmenter.default_path(), dropout, 11)
    single = merges.Segmenter(merges.Segmenter.default_path(), dropout, 11, 1)
    ids = list(range(len(TEXTS)))
    found = segmenter.encode_all(TEXTS, ids)
    assert found == single.encode_all(TEXTS, ids)
    for text, doc_id, raw in zip(TEXTS, ids, found):
        assert (raw is None) == (text is None)
        if text is not None:
            assert np.frombuffer(raw, "<u4").tolist() == plain(segmenter, text, doc_id)
    assert segmenter.encode_all([], []) == []


def test_candidates_are_all_pairs_of_parts_that_make_a_piece():
    segmenter = merges.Segmenter(merges.Segmenter.default_path(), 0.1, 11)
    for unit in (" nation", "  the", "naïve▁the", "東京都", " x", "y"):
        text = unit.replace("▁", merges.MARK).replace(" ", "▁")
        part = lambda a, b: b == a + 1 or text[a:b] in segmenter.ids
        size = len(text)
        want = [(a, m, b) for a in range(size) for m in range(a + 1, size) for b in range(m + 1, size + 1)
                if text[a:b] in segmenter.ids and part(a, m) and part(m, b)]
        found = np.frombuffer(segmenter.candidates(unit), np.uint8).reshape(-1, 3).tolist()
        assert found == [list(c) for c in sorted(want, key=lambda c: (-c[0], c[1], -c[2]))]


def test_short_units_are_not_cut_one_by_one(monkeypatch):
    segmenter = merges.Segmenter(merges.Segmenter.default_path(), 0.1, 11)
    cut = []
    monkeypatch.setattr(merges.Segmenter, "cut", lambda self, unit, skipped=(): cut.append(unit) or b"")
    segmenter.encode("one two three, and the next ones " * 40, 3)
    assert cut == []
