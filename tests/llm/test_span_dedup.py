import random
import zlib

from pyspark.sql import functions as F

from planwright.llm import span_dedup as sd


def crc(t):
    return zlib.crc32(t.encode()) & 0x7FFFFFFF


def brute(rows, min_units, min_words):
    """Spans as tuples of their words; what a later one covers goes."""
    occurrences, parts = {}, {}
    for i, t in rows:
        if not t:
            continue
        pieces, counts = sd.units(t)
        assert not pieces or "".join(pieces) == t
        parts[i, t] = pieces
        keys = [[w.strip(" \t\n\x0b\x0c\r").encode().lower() for w in sd._WORD.findall(p)] for p in pieces]
        assert [len(k) for k in keys] == counts.tolist()
        for a in range(len(pieces)):
            words, b = 0, a
            while b < len(pieces) and (b - a < min_units or words < min_words):
                words += counts[b]
                b += 1
            if b - a >= min_units and words >= min_words:
                key = tuple(w for k in keys[a:b] for w in k)
                occurrences.setdefault(key, set()).add((-1 if i is None else i, crc(t), a, b, t))
    gone = {}
    for found in occurrences.values():
        first = min(found)[:3]
        for i, c, a, b, t in found:
            if (i, c, a) != first:
                gone.setdefault((i, t), set()).update(range(a, b))
    out = []
    for i, t in rows:
        dead = gone.get((-1 if i is None else i, t), set())
        if t:
            pieces = parts[i, t]
            out.append((i, len(pieces), len(dead), "".join(p for j, p in enumerate(pieces) if j not in dead) if dead else t))
        else:
            out.append((i, 0, 0, t))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_units", "n_removed", "text").collect()), key=repr)


def test_same_as_brute_force(corpus, docs, clashing):
    rows = [(r[0], r[1]) for r in corpus]
    assert result(sd.span_dedup(docs)) == brute(rows, 2, 25)
    assert sum(r[2] > 0 for r in brute(rows, 2, 25)) > 5
    assert result(sd.span_dedup(clashing, min_units=3, min_words=12)) == brute(rows, 3, 12)
    assert set(clashing.columns) <= set(sd.span_dedup(clashing).columns)


def test_planted_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    for passage in (make(60) + ".", " ".join(make(10).capitalize() + "." for _ in range(6))):
        rows = [(i, make(30) + ". " + make(20) + ".\n" + (passage + "\n" if i % 2 else "") + make(25) + ".") for i in range(10)]
        got = {r.doc_id: r for r in sd.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, t in rows:
            removed = i % 2 == 1 and i != 1  # spans of it stay in the first
            assert (got[i].n_removed > 0) == removed
            assert removed or got[i].text == t
            assert not removed or len(got[i].text) <= len(t) - 0.8 * len(passage)


def test_units_of_odd_texts():
    for t in ("a", "x" * 1000, "one two " * 200, "  Ende. Neu! Was?\nJa。はい", ". . .", "a.b c.d", "日本語のテキスト。" * 9 + " end", "\u00a0x y"):
        pieces, counts = sd.units(t)
        assert "".join(pieces) == t and sum(counts) == len(sd._WORD.findall(t))
        assert counts.max(initial=0) <= sd.LONGEST
    assert [len(x) for x in sd.units(" \n \n")] == [0, 0]


def test_pieces_do_not_depend_on_the_texts_beside(corpus):
    texts = [(t or "").encode() for _, t, *_ in corpus]
    every = sd.pieces(texts)
    start, end, h1, h2 = every.spans(2, 12)
    for i, t in enumerate(texts):
        alone = sd.pieces([t])
        lo, hi = every.first[i : i + 2]
        own = (start >= lo) & (start < hi)
        for a, b in zip((start[own] - lo, end[own] - lo, h1[own], h2[own]), alone.spans(2, 12)):
            assert a.tolist() == b.tolist()


def test_result_names_and_values_of_the_input_stay(docs):
    mine = docs.withColumn("n_units", F.lit(-7)).withColumn("N_REMOVED", F.lit("mine"))
    out = sd.span_dedup(mine)
    assert out.columns == [*mine.columns, "n_units_", "n_removed_"]
    assert out.select("n_units", "N_REMOVED").distinct().collect() == [(-7, "mine")]
    assert sorted(map(tuple, out.select("doc_id", "n_units_", "n_removed_", "text").collect()), key=repr) == result(sd.span_dedup(docs))


def test_many_rows_of_one_id(spark, corpus):
    """Equal rows, and different texts under one id or under none."""
    texts = [t for _, t, *_ in corpus if t][:60]
    for ident in ("null", "5"):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(f"cast({ident} as long) as doc_id", "text")
        expected = brute([(None if ident == "null" else 5, t) for t in texts], 2, 25)
        assert result(sd.span_dedup(rows)) == expected
    same = spark.range(20_000).selectExpr("cast(7 as long) as doc_id").withColumn("text", F.lit(texts[0]))
    assert sd.span_dedup(same).agg(F.sum("n_removed"), F.count("*")).first() == (0, 20_000)


def test_empty(nothing):
    assert sd.span_dedup(nothing).count() == 0


def test_shared_runs_go_wherever_they_begin(spark):
    """Runs of 51 words and more after differing numbers of words, in mid-sentence, with and without spaces."""
    rng = random.Random(9)
    make = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    rows, runs = [], 40
    for k in range(runs):
        shared = make(51 + k % 30)
        for side in range(2):
            begin, end = make(rng.randrange(1, 40)), make(rng.randrange(1, 40))
            if side and k % 2:
                begin[rng.randrange(len(begin))] += "."
            rows.append((2 * k + side, " ".join([*begin, *shared, *end])))
    han = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(80))
    rows += [(1000, "一丁" + han), (1001, "七万丈三上下" + han + "不与丐")]
    got = {r.doc_id: r for r in sd.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert (got[i].n_removed > 0) == (i % 2 == 1)
        assert i % 2 or got[i].text == t
