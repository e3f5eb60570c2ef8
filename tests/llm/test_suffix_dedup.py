import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from planwright.llm import anchors as an
from planwright.llm import suffix_dedup as sx
from planwright.llm.suffix_sort import Scratch, repeated_starts, suffix_order


def test_order_and_prefixes_are_those_of_plain_sorting():
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
        body = [rng.randint(1, k) for _ in range(n)]
        s = (body * 3 if rng.random() < 0.3 else body) + [0]
        for scratch in (None, Scratch(0)):
            order, lcp = suffix_order(np.array(s, np.uint16), 250, scratch)
            expected = sorted(range(len(s)), key=lambda i: s[i:])
            assert order.tolist() == expected
            common = lambda a, b: next(c for c in range(len(s)) if a + c >= len(s) or b + c >= len(s) or s[a + c] != s[b + c])
            assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(expected, expected[1:])]


def test_order_over_large_alphabets_and_short_caps():
    """Names by the thousand, so that buckets leave the queue together, on every level."""
    rng = random.Random(12)
    for trial in range(60):
        n, k, cap = rng.randint(1, 700), rng.choice([2, 30, 200, 5000]), rng.choice([2, 3, 10, 254])
        s = [rng.randint(1, k) for _ in range(n)]
        s = (s + s[: n // 2] + s[n // 3 :] if trial % 2 else s) + [0]
        order, lcp = suffix_order(np.array(s), cap, Scratch(0) if trial % 3 else None)
        key = lambda i: s[i : i + cap]  # noqa: E731, B023
        assert sorted(order.tolist()) == list(range(len(s))) and [key(i) for i in order] == sorted(map(key, order))
        common = lambda a, b: next((c for c in range(cap) if a + c >= len(s) or b + c >= len(s) or s[a + c] != s[b + c]), cap)  # noqa: E731, B023
        assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(order, order[1:])]


def test_the_recursion_goes_deep_on_prose(sf_dir):
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist() if t]
    scratch = Scratch(1 << 20)
    body = np.frombuffer(b"\0".join(texts)[: 1 << 20], np.uint8).astype(np.uint16) + 2
    order, lcp = suffix_order(np.append(body, 0), 200, scratch)
    assert scratch.depth >= 3 and scratch.files > 5
    at = np.random.default_rng(0).choice(len(body) - 1, 3000, replace=False) + 1
    raw = body.astype(">u2").tobytes() + b"\0\0"
    for i in at.tolist():
        a, b = (raw[2 * o :][:400] for o in order[i - 1 : i + 1])
        n = min(next((c for c in range(0, 400, 2) if a[c : c + 2] != b[c : c + 2]), 400), 400) // 2
        assert a <= b and lcp[i] == n


def test_pieces_split_by_halves_keep_equal_windows_together():
    rng = random.Random(4)
    length, gram = 40, 8
    block = bytes(rng.choice(b"abcd") for _ in range(40))
    pieces = []
    for i in range(12):
        left, right = (bytes(rng.choice(b"xy") for _ in range(60)) for _ in range(2))
        cut = rng.randint(0, 30)
        text = left + block[:cut] + block[cut:] + right
        place = 60 + 16  # the gram lies inside the block
        pieces.append((0, i, text[place + gram - length : place + length], length - gram))
    open_ = [(i, a, place, 0, length - gram + 1, part) for a, i, part, place in pieces]
    windows = Counter(p[w : w + length] for _, _, p, _ in pieces for w in range(len(p) - length + 1))
    while any(h - low > 1 for *_, low, h, _ in open_):
        open_ = [(i, a, p, low, h, part) for i, a0, p0, low0, h0, part0 in open_ for key, a, p, low, h, part in ((x if h0 - low0 > 1 else (0, a0, p0, low0, h0, part0)) for x in (sx.halves(a0, p0, low0, h0, part0, length) if h0 - low0 > 1 else [None]))]
    assert Counter(part for *_, part in open_) == windows  # every window once, by itself
    keys = {}
    for a, i, part, place in pieces:
        for key, begin, *_, sub in sx.halves(a, place, 0, length - gram + 1, part, length):
            keys.setdefault(key, []).append(sub)
    by_window = {}
    for key, subs in keys.items():
        for sub in subs:
            for w in range(len(sub) - length + 1):
                by_window.setdefault(sub[w : w + length], set()).add(key)
    assert all(len(v) == 1 for v in by_window.values())


@pytest.mark.parametrize("memory", [0, 1 << 30])
def test_repeated_starts(memory):
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcd") for _ in range(300))
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) + base[rng.randint(0, 200) :][: rng.randint(0, 100)] for _ in range(rng.randint(1, 8))]
        m = rng.choice([4, 20, 50])
        c = Counter(p[i : i + m] for p in parts for i in range(len(p) - m + 1))
        assert [x.tolist() for x in repeated_starts(parts, m, memory)] == [[i for i in range(len(p) - m + 1) if c[p[i : i + m]] > 1] for p in parts]


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = random.Random(9)
    block = bytes(rng.choice(b"abc ") for _ in range(700))
    texts = [bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 300))) + block + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 300))) for _ in range(5)]
    texts += [b"", b"q" * 199, b"q" * 900]
    for size in (1 << 20, 1024):
        monkeypatch.setattr(an, "BLOCK", size)
        text, g, _, a, b = an.anchors(texts, 200, 64)
        window = {}
        for t, h, x, y in zip(text, g, a, b):
            for s in range(x, y + 1):
                assert (t, s) not in window
                window[t, s] = h
        assert set(window) == {(t, s) for t, x in enumerate(texts) for s in range(len(x) - 199)}
        by_content = {}
        for (t, s), h in window.items():
            by_content.setdefault(texts[t][s : s + 200], set()).add(h)
        assert all(len(v) == 1 for v in by_content.values())


def brute(rows, length):
    c = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        c.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if c[b[s : s + length]] > 1:
                cover[s] += 1
                cover[s + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_same_as_brute_force(corpus, docs, clashing, monkeypatch):
    rows = [(r[0], r[1]) for r in corpus]
    expected = brute(rows, 200)
    assert sum(r[2] > 0 for r in expected) > 10
    assert result(sx.suffix_dedup(docs)) == expected
    monkeypatch.setattr(sx, "SHARD_BYTES", 2000)
    assert result(sx.suffix_dedup(clashing)) == expected
    assert result(sx.suffix_dedup(docs, length=90)) == brute(rows, 90)


def test_empty(nothing):
    assert sx.suffix_dedup(nothing).count() == 0


def test_a_line_in_very_many_texts(spark, monkeypatch):
    """One anchor, each time in other surroundings: split until no shard is large."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, longer = noise(150), noise(215)
    rows = [(i, noise(220) + (line if i % 3 else longer) + noise(rng.randint(0, 220))) for i in range(600)]
    monkeypatch.setattr(sx, "SHARD_BYTES", 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 200)
    assert sum(r[2] > 0 for r in expected) >= 190
    assert result(sx.suffix_dedup(df)) == expected


def test_many_equal_rows(spark):
    from pyspark.sql import functions as F

    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    for ident in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        rows = spark.range(20_000).select(ident.alias("doc_id"), F.lit(text).alias("text"))
        assert sx.suffix_dedup(rows).agg(F.count("*"), F.min("n_removed"), F.max("n_spans")).first() == (20_000, 500, 1)
