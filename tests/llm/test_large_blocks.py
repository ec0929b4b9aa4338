"""Blocks of op4 that are too large for one task: parted to an end, with the result of settle() and bounded frames."""

import random

import pandas as pd
import pytest

from textloom.llm import suffix_dedup as sd


def block_of(r, size):
    """Entries of one core, whose contexts are made of few pieces, so that they share much at all offsets."""
    core = bytes(r.choice(b"abc") for _ in range(sd.SIZE - sd.REACH))
    pieces = [bytes(r.choice(b"xyz") for _ in range(r.randint(3, 60))) for _ in range(3)]
    long = lambda: b"".join(r.choice(pieces) for _ in range(90))[: r.choice([sd.REACH, sd.REACH, sd.REACH, r.randint(0, sd.REACH)])]
    seen = {(core + long(), long()) for _ in range(size)}
    return sorted((right, left, i, -i, 1 + (i % 40 == 0), len(left), len(right)) for i, (right, left) in enumerate(sorted(seen)))


@pytest.mark.parametrize("large", [20_000, 3])
def test_large_block_is_settled_as_a_small_one(spark, large):
    block = block_of(random.Random(21), 700)
    lcp = [0, *[sd.common(a[0], b[0]) for a, b in zip(block, block[1:], strict=False)]]
    lcp[0] = sd.SIZE
    want = sorted(sd.settle(block, lcp))
    rows = [((left[::-1] + right).decode(), [len(left)], [c1], [c2], [n], [l], [r], [len(block)]) for right, left, c1, c2, n, l, r in block]
    texts = spark.createDataFrame(rows, "text string, pos array<bigint>, c1 array<bigint>, c2 array<bigint>, n array<bigint>, l array<int>, r array<int>, kinds array<bigint>")
    entries = spark.createDataFrame([e[2:] for e in block], "c1 bigint, c2 bigint, n bigint, l int, r int")
    got = sorted(tuple(x) for x in sd.counted_spans(texts, entries, large).collect())
    assert 50 < len(want) < len(block) and got == want


def test_a_text_with_many_entries_gives_bounded_frames():
    """Before, a batch became one frame of 201 rows for each entry, 400 texts' together."""
    r = random.Random(22)
    text = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    at = list(range(sd.REACH, 29_000, 10))
    lists = {c: [pd.Series(v).to_numpy()] for c, v in {"pos": at, "c1": at, "c2": at, "n": [1] * len(at), "l": [sd.REACH] * len(at), "r": [sd.SIZE] * len(at), "kinds": [99] * len(at)}.items()}
    sizes = [len(f) for f in sd.first_nodes(iter([pd.DataFrame({"text": [text]} | lists)]))]
    assert max(sizes) <= sd.NODE_ROWS and sum(sizes) == 9 * len(at)


@pytest.mark.parametrize("width, new", [(sd.REACH, sd.WIDTHS[0]), *zip(sd.WIDTHS, sd.WIDTHS[1:], strict=False)])
def test_narrower_nodes_have_all_offsets(width, new):
    got = {d for x in sd.narrower((0, 0, 7, 1, 2, b"a" * width, b"b" * width), width, new) for d in range(x[2], x[2] + new + 1)}
    assert got == set(range(7, 7 + width + 1))
