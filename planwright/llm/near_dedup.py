"""Near-duplicate grouping by MinHash and a multi-index Hamming join.

A document is the set of its word shingles; equal sets are one class. A class has a signature of
``SYMBOLS`` MinHash values of ``b`` = 16 bits, cut into ``CHUNKS`` chunks. If two signatures differ
in at most D symbols, some chunk of theirs differs in at most D // CHUNKS symbols (pigeonhole), so
a class is indexed under each chunk with every choice of that many symbols left out: all pairs
within distance D meet under some key. D is the distance that a pair at the similarity threshold
exceeds with probability below ``MISS``.

Pairs are not emitted from a key's group. A group is one unit if it has at most ``BLOCK`` classes; a
larger one is dealt into blocks of about that size by a hash, each a unit. In a unit distances are
computed in place, a pair counts only under the first key it shares, and only units with a pair
within D go on - with the full shingle sets of the classes concerned - to a second step, which
confirms links exactly and returns a spanning forest of them. Then the large groups that are not one
component yet are looked at once more: those outside a group's largest component meet its blocks and
each other, two blocks to a unit; or, if that were more rows, all meet under keys of a second level,
which name some symbols of another chunk as well (pigeonhole again: some of the other chunks differs
in at most D // (CHUNKS - 1) symbols). So a class is in some 90 units a key at most, on average, a large
group of near copies does not cost the square of its size, and no group is held in one task.

Defined results: null text, or text without words, is an empty set, linked with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle; a null id sorts above every
number when the smallest id of a group is taken; repeated rows are one class; rows that share an id
but not the text are told apart by the text; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm.common import documents, importable, shuffle_parts, written
from planwright.llm.components import components
from planwright.llm.exact_dedup import screened
from planwright.llm.tokens import mix, raw, small, word_hashes

SYMBOLS, CHUNKS, MISS, BLOCK = 64, 16, 1e-6, 512
WIDE = SYMBOLS // CHUNKS
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)


def distance_bound(similarity: float) -> int:
    """Smallest D with P(more than D of SYMBOLS MinHash values differ) <= MISS at ``similarity``."""
    p, tail = 1 - similarity, 0.0
    for d in range(SYMBOLS, -1, -1):
        tail += comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
        if tail > MISS:
            return d
    return 0


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, size * int(_ODD[-1]) % (1 << 64), np.uint64)
    for i in range(size):
        out = mix(out + words[i : n - size + 1 + i] * _ODD[i % 4] + np.uint64(i)) if i % 4 == 3 else out + words[i : n - size + 1 + i] * _ODD[i % 4] + np.uint64(i)
    return mix(out)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, 16 bits each, of nonempty sets: one row for each."""
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    begin = 0
    while begin < len(sets):
        end, n = begin, 0
        while end < len(sets) and (n < 1 << 18 or end == begin):
            n += len(sets[end])
            end += 1
        own = sets[begin:end]
        x, starts = np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1]
        for i, seed in enumerate(_SEEDS):
            low = np.minimum.reduceat(x * seed, starts)
            out[begin:end, i] = (mix(low) >> np.uint64(48)).astype(np.uint16)
        begin = end
    return out


def index_keys(sig: np.ndarray, errors: int) -> np.ndarray:
    """Keys of each signature: a chunk with ``errors`` of its symbols left out, every choice."""
    out = []
    chunks = sig.reshape(len(sig), CHUNKS, WIDE).astype(np.uint64)
    for c in range(CHUNKS):
        for o, kept in enumerate(combinations(range(WIDE), WIDE - errors)):
            code = np.zeros(len(sig), np.uint64)
            for i in kept:
                code = code << np.uint64(16) | chunks[:, c, i]
            out.append(mix(mix(code) + np.uint64((c * 64 + o + 1) * int(_ODD[1]) % (1 << 64))))
    return np.stack(out, axis=1) if out else np.zeros((len(sig), 0), np.uint64)


def second_count(bound: int) -> int:
    """Keys of the second level that a class has under one of the first."""
    return (CHUNKS - 1) * comb(WIDE, bound // (CHUNKS - 1))


def second_keys(sig: np.ndarray, key: np.ndarray, index: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Under a key of the first level: for each other chunk, with every choice of the symbols that
    may differ left out, a key and its number (index * 256 + number)."""
    errors = bound // (CHUNKS - 1)
    chunks, own = sig.reshape(len(sig), CHUNKS, WIDE).astype(np.uint64), index // comb(WIDE, bound // CHUNKS)
    keys, numbers = [], []
    for c in range(CHUNKS):
        for o, kept in enumerate(combinations(range(WIDE), WIDE - errors)):
            code = np.zeros(len(sig), np.uint64)
            for i in kept:
                code = code << np.uint64(16) | chunks[:, c, i]
            number = c * comb(WIDE, errors) + o
            keys.append(mix(mix(code + np.uint64(number * int(_ODD[2]) % (1 << 64))) + key))
            numbers.append(np.where(own == c, -1, index * 256 + number))
    return np.stack(keys, axis=1), np.stack(numbers, axis=1)


def first_key(equal: np.ndarray, errors: int, but: np.ndarray | None = None) -> np.ndarray:
    """Of pairs, given which symbols are equal, the number of the first key they share (or -1);
    ``but``: a chunk for each pair that does not count."""
    e = equal.reshape(len(equal), CHUNKS, WIDE)
    hits = np.stack([e[:, :, list(kept)].all(axis=2) for kept in combinations(range(WIDE), WIDE - errors)], axis=2)
    if but is not None:
        hits[np.arange(len(equal)), but] = False
    hits = hits.reshape(len(equal), CHUNKS * comb(WIDE, errors))
    return np.where(hits.any(axis=1), hits.argmax(axis=1), -1)


def claimed(equal: np.ndarray, index: np.ndarray, bound: int, deep: bool) -> np.ndarray:
    """Whether the key of that number is the first that a pair shares, on both levels."""
    errors = bound // CHUNKS
    if not deep:
        return first_key(equal, errors) == index
    first, second = index // 256, index % 256
    return (first_key(equal, errors) == first) & (first_key(equal, bound // (CHUNKS - 1), first // comb(WIDE, errors)) == second)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Groups of consecutive rows with equal first ``keys`` columns, of sorted input: slices."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            now = tuple(c[lo] for c in cols)
            if now != last and held:
                yield held
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield held


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` (id, text, th) -> id, th, n (size of the set), k1, k2 (its 128-bit hash), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [np.unique(shingles(word_hashes(t), k)) for t in raw(batch.column(1))]
            some = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            for i, s in zip(some, signature([sets[i] for i in some])):
                sig[i] = s.tobytes()
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sig, pa.binary())], names=["id", "th", "n", "k1", "k2", "sig"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th long, n long, k1 long, k2 long, sig binary")


def _members(classes: DataFrame, errors: int) -> DataFrame:
    """(key, index, cls): the classes of each key that two or more share."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            found = index_keys(sig, errors)
            n = found.shape[1]
            yield _spread(found.ravel(), np.tile(np.arange(n, dtype=np.int32), len(sig)), np.repeat(b.column(0).to_numpy(), n))

    return _shared(classes.select("cls", "sig").mapInArrow(keys, _SPREAD))


def _second_members(members: DataFrame, classes: DataFrame, bound: int) -> DataFrame:
    """``members`` (key, index, cls) under keys of the second level."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            found, number = second_keys(sig, b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), bound)
            ok = number.ravel() >= 0
            yield _spread(found.ravel()[ok], number.ravel()[ok].astype(np.int32), np.repeat(b.column(2).to_numpy(), found.shape[1])[ok])

    met = members.join(classes.select("cls", "sig").hint("merge"), "cls").select("key", "index", "cls", "sig")
    return _shared(met.mapInArrow(keys, _SPREAD))


_SPREAD = "at long, key long, index int, cls long, c int"


def _spread(key: np.ndarray, index: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch for ``_shared``. Classes that meet under a key in the batch are known to share
    it: they go on under a number that only spreads them (c = 0), and one row tells the others of
    the key (c = 2). A class that is alone has c = 1, and no key beside ``at``."""
    order = np.argsort(key, kind="stable")
    key, index, cls = key[order], index[order], cls[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(key) else np.zeros(0, bool)
    local, own = np.flatnonzero(many), np.flatnonzero(new)
    pick = np.r_[own, local]
    at = np.r_[key[own], mix(cls[local].view(np.uint64) + key[local])]
    c = np.r_[np.where(many[own], 2, 1), np.zeros(len(local), np.int64)].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(key[pick].view(np.int64), mask=c > 0), pa.array(index[pick].astype(np.int32)), pa.array(cls[pick]), pa.array(c)], names=["at", "key", "index", "cls", "c"])


def _shared(rows: DataFrame) -> DataFrame:
    """(key, index, cls) of the rows of ``_spread`` whose key another one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(at: np.ndarray, cols: list[np.ndarray], pick: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at[pick]), pa.array(cols[0][pick]), pa.array(cols[1][pick])], names=["key", "index", "cls"])

        last: list[np.ndarray] | None = None  # the last row so far, if nobody is known to have its key
        before: int | None = None
        for b in batches:
            known = b.column(4).to_numpy() == 0
            if known.any():
                own = b.filter(pa.array(known))
                yield pa.RecordBatch.from_arrays([own.column(i) for i in (1, 2, 3)], names=["key", "index", "cls"])
                b = b.filter(pa.array(~known))
            if not b.num_rows:
                continue
            at, c = b.column(0).to_numpy(), b.column(4).to_numpy()
            cols = [b.column(2).to_numpy(), b.column(3).to_numpy()]
            same = np.r_[before is not None and before == at[0], at[1:] == at[:-1]]
            if last is not None and same[0]:
                yield some(*last, np.array([0]))
            stays = same.copy()
            stays[:-1] |= same[1:]
            pick = np.flatnonzero(stays & (c == 1))
            if len(pick):
                yield some(at, cols, pick)
            # The last row waits for the next batch, unless it is decided or only a witness.
            last = (at[-1:], [x[-1:] for x in cols]) if not same[-1] and c[-1] == 1 else None
            before = int(at[-1])

    keyed = rows.repartition(shuffle_parts(rows.sparkSession), "at").sortWithinPartitions("at")
    return keyed.mapInArrow(run, "key long, index int, cls long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of rows (key, i, j, index, side, cls, comp, sig), sorted by unit: the columns as arrays and
    where units begin and end; a unit that a batch cuts comes with the next one."""

    def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
        sig = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        return [*(b.column(c).to_numpy() for c in range(7)), sig]

    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = arrays(b)
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        key, i, j = cols[:3]
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1]
        if len(cuts) > 1:
            yield *[c[: cuts[-1]] for c in cols], cuts
        held = [c[cuts[-1] :] for c in cols]
    if held is not None:
        yield *held, np.array([0, len(held[0])])


def _near_pairs(sig: np.ndarray, comp: np.ndarray, side: np.ndarray, index: int, bound: int, deep: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit, of different components, within the bound, whose first shared key is this one."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    out_a, out_b = [], []
    for a0 in range(0, len(left), 64):
        a = left[a0 : a0 + 64]
        if len(a) * len(right) <= 1024:
            far = (sig[a][:, None, :] != sig[right][None, :, :]).sum(axis=2)
        else:
            far = np.zeros((len(a), len(right)), np.uint8)
            for s in range(SYMBOLS):
                far += sig[a, s][:, None] != sig[right, s][None, :]
        x, y = np.nonzero(far <= bound)
        x, y = a[x], right[y]
        ok = (x < y) & (comp[x] != comp[y])
        x, y = x[ok], y[ok]
        if len(x):
            first = np.concatenate([claimed(sig[x[c : c + 65536]] == sig[y[c : c + 65536]], np.full(len(x[c : c + 65536]), index), bound, deep) for c in range(0, len(x), 65536)])
            out_a.append(x[first])
            out_b.append(y[first])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _links(cls: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs across the sides (or within one) with similarity >= num / den,
    on top of the components there are."""
    n = len(cls)
    root = np.unique(comp, return_index=True)[1][np.unique(comp, return_inverse=True)[1]].tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [i for i in range(n) if side[i] == 0], [i for i in range(n) if side[i] == 1]
    across = bool(right)
    sizes = np.array([len(s) for s in sets])
    out = []

    def link(a: int, b: int) -> None:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            out.append((int(cls[a]), int(cls[b])))

    if n <= 12:
        for a, b in ((a, b) for a in left for b in right) if across else combinations(left, 2):
            small, large = min(sizes[a], sizes[b]), max(sizes[a], sizes[b])
            if find(a) != find(b) and small * den >= num * large:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if den * both >= num * (sizes[a] + sizes[b] - both):
                    link(a, b)
        return out
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(where) > 1  # what only one of them holds adds nothing to an intersection
    keep = shared[where]
    where, owner = (np.cumsum(shared) - 1)[where[keep]], owner[keep]
    rows, cols = (np.array(left), np.array(right)) if across else (np.array(left), np.array(left))
    both = np.zeros((len(rows), len(cols)), np.float32)
    at_row, at_col = np.full(n, -1), np.full(n, -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    sort = np.argsort(where, kind="stable")
    where, owner = where[sort], owner[sort]
    width = 4096
    total = int(shared.sum())
    cuts = np.searchsorted(where, np.arange(0, total + width, width))
    for lo, hi, c in zip(cuts[:-1], cuts[1:], range(0, total + width, width)):
        w, o = where[lo:hi] - c, owner[lo:hi]
        a, b = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        m = at_row[o] >= 0
        a[at_row[o[m]], w[m]] = 1
        m = at_col[o] >= 0
        b[at_col[o[m]], w[m]] = 1
        both += a @ b.T
    x, y = np.nonzero(den * both.astype(np.int64) >= num * (sizes[rows][:, None] + sizes[cols][None, :] - both.astype(np.int64)))
    for a, b in zip(rows[x].tolist(), cols[y].tolist()):
        if a != b:
            link(a, b)
    return out


def near_links(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links that span every group of classes with similarity >= num / den.
    ``docs``: id, text, th; ``classes``: cls, sig, and id and th of one row with that set."""
    bound = distance_bound(num / den)
    if bound // CHUNKS >= WIDE or bound // (CHUNKS - 1) >= WIDE:
        raise ValueError("a similarity this low needs a longer signature")
    members = written(_members(classes, bound // CHUNKS), "members")
    return _linked(docs, classes, members, False, k, num, den, bound)


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame, deep: bool, k: int, num: int, den: int, bound: int) -> DataFrame:
    """Links among the classes that share a key of ``members`` (key, index, cls)."""

    def compare(units: DataFrame) -> DataFrame:
        return written(_compared(docs, classes, units, deep, k, num, den, bound), "links")

    large = written(members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "large")
    if large.isEmpty():
        return compare(_alone(members, F.lit(0)))
    sized = written(members.join(large, "key", "left"), "sized")
    links = compare(_alone(sized, F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "cls"), F.ceil(F.col("n") / BLOCK))).cast("int")))
    groups = components(links).withColumnRenamed("node", "cls")
    met = sized.filter("n is not null").join(groups, "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    # Keys that hold one component have nothing more to tell; of the others, the members of the most
    # frequent component need to meet the rest of them only.
    per = met.groupBy("key", "comp").agg(F.count("*").alias("c"))
    per = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("m"), F.sum("c").alias("n")).filter("n > m")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    per = written(per.select("key", "main", F.col("n"), blocks(F.col("m")).alias("bm"), blocks(F.col("n") - F.col("m")).alias("bt"), (F.col("n") - F.col("m")).alias("t")), "parted")
    if per.isEmpty():
        return links
    cost = (F.col("n") - F.col("t")) * F.col("bt") + F.col("t") * (F.col("bm") + F.col("bt"))
    far = F.lit(False) if deep else cost > F.col("n") * second_count(bound)
    rest = written(met.select("key", "index", "cls", "comp").join(per.filter(~far), "key"), "rest")
    links = links.unionByName(compare(_paired(rest)))
    if not (wide := per.filter(far)).isEmpty():
        wide = met.select("key", "index", "cls").join(wide.select("key"), "key", "left_semi")
        second = written(_second_members(wide, classes, bound), "members")
        links = links.unionByName(_linked(docs, classes, second, True, k, num, den, bound))
    return links


def _alone(members: DataFrame, block: Column) -> DataFrame:
    """Units (key, i, j) of one block each: key, index, i, j, cls, comp, side."""
    return members.select("key", "index", block.alias("i"), F.lit(0).alias("j"), "cls", F.col("cls").alias("comp"), F.lit(0).alias("side"))


def _paired(members: DataFrame) -> DataFrame:
    """Units of the members (key, index, cls, comp, main, bm, bt) of keys with a main component in bm
    blocks and others in bt: each block of the main one with each of the others, and the others'
    blocks with themselves and each other (i < 0)."""
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("key", "cls"), F.when(is_main, F.col("bm")).otherwise(F.col("bt"))).cast("int")
    met = members.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    with_others = F.transform(upto(F.col("bt")), lambda b: place(F.col("own"), b, F.lit(0)))
    with_main = F.transform(upto(F.col("bm")), lambda b: place(b, F.col("own"), F.lit(1)))
    among = F.transform(upto(F.col("bt")), lambda b: place(-1 - F.least(b, F.col("own")), F.greatest(b, F.col("own")), F.col("own") > b))
    # Mostly the others are one block, and a member of the main component is in one unit.
    one = is_main & (F.col("bt") == 1)
    single = met.filter(one).select("key", "index", F.col("own").alias("i"), F.lit(0).alias("j"), "cls", "comp", F.lit(0).alias("side"))
    met = met.filter(~one).withColumn("at", F.explode(F.when(is_main, with_others).otherwise(F.concat(with_main, among))))
    return single.unionByName(met.select("key", "index", "at.i", "at.j", "cls", "comp", "at.side"))


def _compared(docs: DataFrame, classes: DataFrame, units: DataFrame, deep: bool, k: int, num: int, den: int, bound: int) -> DataFrame:
    """Links that ``units`` confirm on full sets."""
    spark = docs.sparkSession
    units = units.join(classes.select("cls", "sig").hint("merge"), "cls")
    units = units.select("key", "i", "j", "index", "side", "cls", "comp", "sig").repartition(shuffle_parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cls")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "i", "j", "cls", "comp", "side"]
        for key, i, j, index, side, cls, comp, sig, cuts in _whole_groups(batches):
            picked = []
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]  # most units are one pair: all of a batch at once
            two = two[comp[two] != comp[two + 1]]
            for at in range(0, len(two), 16_384):
                x = two[at : at + 16_384]
                equal = sig[x] == sig[x + 1]
                x, equal = x[(~equal).sum(axis=1) <= bound], equal[(~equal).sum(axis=1) <= bound]
                x = x[claimed(equal, index[x], bound, deep)]
                picked += [x, x + 1]
            for g in np.flatnonzero(sizes > 2):
                lo, hi = cuts[g], cuts[g + 1]
                a, b = _near_pairs(sig[lo:hi], comp[lo:hi], side[lo:hi], int(index[lo]), bound, deep)
                if len(a):
                    picked.append(lo + np.union1d(a, b))
            if picked:
                pick = np.sort(np.concatenate(picked))
                yield pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in (key, i, j, cls, comp, side)], names=names)

    found = written(units.mapInArrow(near, "key long, i int, j int, cls long, comp long, side int"), "units")
    # The texts of the classes concerned, and of no others, move once.
    wanted = written(classes.join(found.select("cls").distinct(), "cls", "left_semi").select("cls", "id", "th", _digest("id", "th")), "wanted")
    texts = docs.withColumn("digest", _digest("id", "th"))
    texts = screened(texts, wanted.select("digest").distinct()).join(wanted.select("digest", "cls").hint("merge"), "digest").select("cls", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found_sets = [np.unique(shingles(word_hashes(t), k)).tobytes() for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found_sets, pa.binary())], names=["cls", "set"])

    full = found.join(texts.dropDuplicates(["cls"]).mapInArrow(sets, "cls long, set binary").hint("merge"), "cls")
    full = full.select("key", "i", "j", "side", "cls", "comp", "set").repartition(shuffle_parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cls")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            t = pa.Table.from_batches(run)
            links = _links(t.column(4).to_numpy(), t.column(5).to_numpy(), [np.frombuffer(s, np.uint64) for s in t.column(6).to_pylist()], t.column(3).to_numpy(), num, den)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return full.mapInArrow(confirm, "a long, b long").distinct()


def _digest(*cols: str):
    return F.unhex(F.md5(F.concat_ws("|", *cols))).alias("digest")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For each row: id, th (hash of the text), n (size of its set), component_id (smallest id of its
    group; its own if the set is empty), chosen (whether id and th are those of the group's first
    row, nulls last, or the set is empty)."""
    importable(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = written(set_rows(own, k), "sets")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    some = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min(place).alias("one"), F.first("sig").alias("sig"))
    some = some.select("k1", "k2", "one", "one.id", "one.th", "sig")
    classes = written(some.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links = near_links(own, classes, k, num, den)
    groups = components(links)
    member = classes.select("cls", "k1", "k2", "one").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    member = member.withColumn("component", F.coalesce("component", "cls"))
    smallest = member.groupBy("component").agg(F.min("one").alias("least"))
    member = written(member.join(smallest, "component").select("k1", "k2", "least"), "groups")
    out = rows.select("id", "th", "n", "k1", "k2").join(member, ["k1", "k2"], "left")
    empty = F.col("n") == 0
    return out.select("id", "th", "n", F.when(empty, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), (empty | place.eqNullSafe(F.col("least"))).alias("chosen"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For each row: id, n_shingles, component_id (smallest id of its group), kept."""
    out = near_rows(docs, id_col, text_col, k, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each group of near copies the first
    by id (then by hash of the text); of rows that repeat id and text one; rows without words all,
    but for repeats."""
    chosen = near_rows(docs, id_col, text_col, k, num, den).filter("chosen").groupBy("id", "th").agg(F.count("*").alias("copies"))
    chosen = written(chosen, "chosen")
    names = docs.columns
    own = docs.toDF(*[f"c{j}" for j in range(len(names))])
    ident, th = f"c{names.index(id_col)}", F.xxhash64(F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit("")))

    def those(wanted: DataFrame) -> DataFrame:
        return own.join(wanted.select("id", "th").hint("merge"), F.col(ident).eqNullSafe(F.col("id")) & (th == F.col("th")), "left_semi")

    out, repeated = those(chosen.filter("copies = 1")), chosen.filter("copies > 1")
    if not repeated.isEmpty():
        # Copies meet where they are read: a row that a third of the table repeats is one row a task.
        again = those(repeated).withColumn("th", th).groupBy(ident, "th").agg(*[F.first(c).alias(c) for c in own.columns if c != ident])
        out = out.unionByName(again.select(*own.columns))
    return out.toDF(*names)


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), k=4)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
