import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from fixtures import edge_documents, edge_rows, empty_documents
from tokenizers import Tokenizer

from spendlens.llm.encoding import public_path
from spendlens.llm.packing import _spans, pack, sweep

PATH = public_path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Sequences that best fit needs when it takes the longest piece first."""
    gaps, count = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at == len(gaps):
            count += 1
            insort(gaps, capacity - length)
        else:
            insort(gaps, gaps.pop(at) - length)
    return count


def checked_plan(lengths, capacity):
    counts = Counter(lengths)
    plan, sequences = sweep(counts, capacity)
    plan.sort()
    places = defaultdict(list)
    for n, (length, rank, first, offset) in enumerate(plan):
        following = plan[n + 1][1] if n + 1 < len(plan) and plan[n + 1][0] == length else counts[length]
        for i in range(following - rank):
            places[first + i].append((offset, length))
    assert sum(map(len, places.values())) == len(lengths)
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == sequences
    return sequences


def test_plans_are_gapless_and_as_good_as_one_by_one():
    rnd = random.Random(5)
    for trial in range(60):
        capacity = rnd.choice([1, 7, 64, 2048])
        top = rnd.choice([1, capacity, max(1, capacity // 3)])
        lengths = [rnd.randint(1, top) for _ in range(rnd.randint(0, 800))]
        assert checked_plan(lengths, capacity) == one_by_one(lengths, capacity)


def test_runs_of_equal_lengths():
    assert checked_plan([5] * 1000, 10) == 500
    assert checked_plan([7] * 10 + [3] * 10, 10) == 10
    assert checked_plan([1] * 25, 10) == 3


def test_spans_cut_only_long_documents():
    assert _spans(5, 10) == [(0, 5)]
    assert _spans(10, 10) == [(0, 10)]
    assert _spans(23, 10) == [(0, 3), (3, 10), (13, 10)]
    assert _spans(20, 10) == [(0, 10), (10, 10)]


def test_documents_with_edge_cases(spark):
    tokenizer, capacity = Tokenizer.from_file(PATH), 256
    found = [r.asDict() for r in pack(edge_documents(spark), PATH, capacity).collect()]
    expected = []
    for doc, text, *_ in edge_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        expected += [
            (doc, n, start, length, crc32(np.array(ids[start : start + length], "<u4").tobytes()))
            for n, (start, length) in enumerate(_spans(len(ids), capacity))
        ]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found], key=repr) == sorted(expected, key=repr)
    filled = defaultdict(list)
    for r in found:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]]
        assert sum(n for _, n in pieces) <= capacity
    assert len(filled) == one_by_one([r["length"] for r in found], capacity)


def test_no_documents(spark):
    assert pack(empty_documents(spark), PATH).count() == 0
