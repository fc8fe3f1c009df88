"""Runs of repeated words against every lag of every document."""

import hashlib
import random

import pytest

from jobweave.llm import periodic, queries
from llm_cases import ODD

FOLDER = "/root/testdata/sf0.001"


def brute_runs(words):
    found, n = [], len(words)
    for lag in range(1, n // 2 + 1):
        i = 0
        while i + lag < n:
            start = i
            while i + lag < n and words[i] == words[i + lag]:
                i += 1
            length = i - start + lag
            if length >= max(12, 2 * lag):
                seen = words[start : start + length]
                if all(seen[:-p] != seen[p:] for p in range(1, lag)):
                    found.append((start, length, lag))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    drop = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def built(rng):
    """Words of repeated units, cut short and disturbed here and there."""
    words = []
    while len(words) < rng.choice([60, 200, 500]):
        unit = [str(rng.randrange(rng.choice([2, 4, 50]))) for _ in range(rng.randrange(1, 60))]
        words += unit * rng.choice([1, 2, 3, 5]) + unit[: rng.randrange(len(unit) + 1)]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "z"
    return words


def test_runs_are_those_of_all_lags():
    rng = random.Random(3)
    cases = [[str(rng.randrange(k)) for _ in range(n)] for k in (1, 2, 3, 30) for n in (0, 11, 12, 13, 40, 90)]
    for words in cases + [built(rng) for _ in range(80)]:
        found = periodic.runs(words)
        assert [tuple(r) for r in found.tolist()] == brute_runs(words)
        assert periodic.collapsed(words, found) == brute_collapsed(words, brute_runs(words))


@pytest.mark.parametrize("pairs", [1, 7, 100])
def test_furthest_covered_table_holds_between_blocks_of_pairs(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    rng = random.Random(pairs)
    for words in [["a"] * 150, *(built(rng) for _ in range(10))]:
        assert [tuple(r) for r in periodic.runs(words).tolist()] == brute_runs(words)


def test_repeated_seeds_are_not_extended_again():
    index = periodic.GramIndex(periodic.numbered(["a"] * 5000), 1250)
    for size, step, low, high in ((6, 1, 1, 12), (6, 6, 12, 24), (192, 192, 384, 768)):
        pairs = sum(len(a) for a, _ in periodic.seeds(index, size, step, low, high))
        assert pairs <= 5000 // step * (high - low)
        extended = sum(len(s) for s in periodic.stretches(index, size, step, low, high))
        assert extended == high - low


def test_very_long_text_that_repeats():
    words = [str(i % 30011) for i in range(120_000)]
    assert periodic.runs(words).tolist() == [[0, 120_000, 30011]]
    assert periodic.runs(["a", "b"] * 100_000).tolist() == [[0, 200_000, 2]]


def test_query_on_whole_documents(spark):
    plain = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    assert set(got) == set(plain)
    planted = 0
    for doc_id, text in plain.items():
        words = queries.planted_period(doc_id, periodic.WORD.findall(text or ""))
        if len(words) > 1500:
            found = [tuple(r) for r in periodic.runs(words).tolist()]
        else:
            found = brute_runs(words)
        planted += words != periodic.WORD.findall(text or "") and bool(found)
        row = got[doc_id]
        assert row.n_runs == len(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, found).encode()).hexdigest()
    assert planted


def test_odd_rows(documents):
    rows = ODD + [(9, "\x0b a\x0c" * 13), (10, "la " * 30000)]
    found = periodic.find_runs(documents(rows))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    kept = {(r.doc_id, r.n_words): (len(r.runs), r.collapsed) for r in found.collect()}
    assert found.count() == len(rows)
    assert kept[1, 0] == kept[2, 0] == kept[3, 0] == (0, "")
    assert kept[9, 13] == (1, "a") and kept[10, 30000] == (1, "la")
    assert periodic.find_runs(documents(ODD).limit(0)).isEmpty()
    assert queries.planted_period(None, ["a"]) == ["a"]
