"""SimHash near-duplicates: fingerprints, and a binary trie self-join within an error budget.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``words`` words,
repeats included, joined by a space (fewer words: the whole sequence), XXH64 of their
UTF-8 with seed 42; a bit is 1 if set in more than half of the hashes. Without a word
the fingerprint is zero.

The self-join works on distinct fingerprints. Of ``BLOCKS`` blocks of bits, two fingerprints that differ in at
most ``budget`` bits have one with at most budget // BLOCKS differing bits: none for a budget of 3, one for 4 to 7. So
each fingerprint is dealt to a group for each block's value without any choice of that many of its bits (4 groups,
or 64). Groups over ``GROUP`` rows are dealt once more in the same way by the remaining bits, which is as exact.
Budgets above 3 find nearer misses at a price: their groups are larger, and so is the work in them. Within a group, fingerprints in order form a binary
trie; node pairs are traversed together from the root, differing bits add up, and a pair
is pruned when they exceed the budget. The traversal runs over all groups of a task
at once, level by level, in bounded chunks; passes with smaller budgets first let later passes
prune node pairs that are already in one component, so a clump of near copies does not
cost the square of its size in output: a group emits a spanning forest only, with few links
at any one node. Forests of all groups meet in ``connected_components``.

Tasks read their rows in order of group and flush at the border between groups, so a task's memory follows the
largest group, not its share of the rows; the number of tasks follows the number of rows.

Sketches (``similarity`` given) are wide fingerprints for a similarity below what 64 bits can tell: the distinct shingles of
a text, ``SKETCH`` bits from remixed XXH64 hashes. Texts whose shingle sets are s alike (intersection by union) have a cosine of
2s / (1 + s), and each bit differs with probability arccos(cosine) / pi. The budget is the number of differing
bits that a pair of the wanted similarity exceeds in one case of twenty: at 0.8 that is 92 of 512, where pairs
0.7 alike pass in a quarter of cases and pairs 0.6 alike in fewer than one of a hundred. Groups are samples of bits: as many
bits as leave some 16 sketches a group, and as many samples as let a pair of the wanted similarity meet
in ``MEET`` of cases, whatever the number of texts; the trie join within groups is the same.

Defined results: null, empty and wordless texts have fingerprint zero and link with each other; a
component's id is the smallest doc_id in it (nulls do not count; null if there is no
other); repeated rows are documents of one component; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import PART_BYTES
from strandlake.operators.graph import connected_components
from strandlake.plans.shared import discard, written

SHINGLE = 3
BUDGET = 3
SEED = 42
BLOCKS = 4
GROUP = 200_000
GROUP_WIDE = 5_000
FLUSH = 100_000
ROW_BYTES = 48
SKETCH = 512
MEET = 0.97
CHUNK = 400_000
FAN = 32
SLICE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    shingles = [b" ".join(tokens)] if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    hashes = [digest(s, SEED) for s in shingles]
    for at in range(0, len(hashes), SLICE):
        part = np.array(hashes[at : at + SLICE], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(text: Column, words: int = SHINGLE) -> Column:
    """Fingerprints as signed 64-bit integers."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        made = np.fromiter((fingerprint(t, words) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(made.view(np.int64))

    return run(text)


def sketch(text: str | None, words: int, bits: int = SKETCH) -> bytes:
    """The wide fingerprint of one text's distinct shingles, zero without a word."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return bytes(bits // 8)
    shingles = {b" ".join(tokens)} if len(tokens) < words else set(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts, lanes = np.zeros(bits, np.int64), np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # as many rows as a byte can count
        part = hashes[at : at + 255, None] + lanes
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def sketches(text: Column, words: int) -> Column:
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, words) for t in texts])

    return run(text)


def differing(similarity: float) -> float:
    """The probability that a bit of two sketches differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sketch_budget(similarity: float, bits: int = SKETCH) -> int:
    """Differing bits that a pair of this similarity stays within in 19 of 20 cases."""
    p = differing(similarity)
    return math.ceil(bits * p + 1.645 * math.sqrt(bits * p * (1 - p)))


def samples(n: int, similarity: float, bits: int = SKETCH, seed: int = SEED) -> list[np.ndarray]:
    """The positions of bits that make up a group's key, for each way of dealing ``n`` sketches."""
    wide = min(max(6, math.ceil(math.log2(max(n, 2))) - 4), 60)
    ways = math.ceil(math.log(1 - MEET) / math.log1p(-((1 - differing(similarity)) ** wide)))
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, wide, replace=False)) for _ in range(ways)]


def _joined(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the ends of pairs in ``lab``, which holds each element's least known member."""
    while len(a):
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab[:] = up


def trie_components(keys: np.ndarray, fps: np.ndarray, budget: int) -> np.ndarray:
    """Labels of components within each key's group; inputs in order of (key, fingerprint).

    Fingerprints are 64-bit numbers, or rows of such words. A label is the position of the component's first element.
    """
    fps = fps if fps.ndim == 2 else fps[:, None]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1]).any(axis=1)] if len(fps) else np.zeros(0, bool)
    if not fresh.all():  # equal ones stand for each other
        at = np.flatnonzero(fresh)
        return at[trie_components(keys[at], fps[at], budget)][np.cumsum(fresh) - 1]
    n = len(fps)
    lab = np.arange(n)
    if n < 2:
        return lab
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[first[1:], n]
    wide = last - first > 1
    first, last = first[wide], last[wide]
    for allowed in sorted({1, budget // 2, budget} - {0}):
        change = np.r_[0, np.cumsum(lab[1:] != lab[:-1])]
        zero = np.zeros(len(first), np.int16)
        stack = [(0, first, last, first, last, zero)]
        while stack:
            depth, al, ah, bl, bh, diff = stack.pop()
            while len(al):
                settled = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (lab[al] == lab[bl])
                single = (ah - al == 1) & (bh - bl == 1)
                leaf = single & ~settled & (al != bl)
                if leaf.any():
                    x, y = al[leaf], bl[leaf]
                    near = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1, dtype=np.int32) <= allowed
                    _joined(lab, x[near], y[near])
                go = ~settled & ~single
                if depth == 64 * fps.shape[1] or not go.any():
                    break
                al, ah, bl, bh, diff = al[go], ah[go], bl[go], bh[go], diff[go]
                if len(al) > CHUNK:
                    half = len(al) // 2
                    stack.append((depth, al[half:], ah[half:], bl[half:], bh[half:], diff[half:]))
                    al, ah, bl, bh, diff = al[:half], ah[:half], bl[:half], bh[:half], diff[:half]
                word, shift = fps[:, depth >> 6], np.uint64(63 - (depth & 63))
                am, bm = _middle(word, al, ah, shift), _middle(word, bl, bh, shift)
                own = al == bl
                more = diff + 1
                ways = (  # children taken together: equal bits cost nothing, different bits one
                    (al, am, bl, bm, diff, None),
                    (am, ah, bm, bh, diff, None),
                    (al, am, bm, bh, more, None),
                    (am, ah, bl, bm, more, ~own),
                )
                kept = []
                for p, q, r, s, d, only in ways:
                    ok = (q > p) & (s > r) & (d <= allowed)
                    if only is not None:
                        ok &= only
                    kept.append((p[ok], q[ok], r[ok], s[ok], d[ok]))
                al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*kept, strict=True))
                depth += 1
    return lab


def _middle(fps: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Where the bit at ``shift`` turns 1 within ranges that agree above it, by bisection."""
    one, lo, hi = np.uint64(1), low.copy(), high.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) >> 1, len(fps) - 1)
        up = (fps[mid] >> shift) & one == 0
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``FLUSH`` rows, from batches in order of key."""
    got, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        got.append(batch)
        n += batch.num_rows
        if n >= FLUSH:
            table = pa.Table.from_batches(got)
            cut = int(np.searchsorted(table["key"].to_numpy(), batch["key"][-1].as_py(), side="left"))
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).combine_chunks()  # let go of what has been handed out
                got, n = rest.to_batches(), rest.num_rows
    if got:
        yield pa.Table.from_batches(got)


def _forest(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each group's components; nodes are the fingerprints, or named by a column node."""
    for table in _whole_groups(batches):
        key = table["key"].to_numpy()
        if pa.types.is_binary(table["fp"].type):
            rows = table["fp"].to_pylist()
            fp = np.frombuffer(b"".join(rows), ">u8").reshape(len(rows), -1).astype(np.uint64)
            node = table["node"].to_numpy()
        else:
            node = table["fp"].to_numpy()
            fp = node.view(np.uint64)[:, None]
        order = np.lexsort((*fp.T[::-1], key))
        key, fp, node = key[order], fp[order], node[order]
        lab = trie_components(key, fp, budget)
        member = np.argsort(lab, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(lab[member]) != 0])
        size = np.diff(np.r_[start, len(lab)])
        rank = np.arange(len(lab)) - np.repeat(start, size)
        parent = member[np.repeat(start, size) + rank // FAN]  # a tree of FAN children, so no node is a hub
        child = rank > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[member][child]), pa.array(node[parent][child])], ["src", "dst"])


def masks(bits: list[int], budget: int, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of which any two fingerprints within the budget agree on at least one.

    With m blocks of ``bits`` some block has at most budget // m differing bits; each mask is a block
    without that many of its bits. (Budgets below m take budget + 1 whole blocks.)
    """
    m = min(blocks, budget + 1)
    out = []
    for i in range(m):
        block = bits[len(bits) * i // m : len(bits) * (i + 1) // m]
        for gone in combinations(block, budget // m):
            out.append(_signed(sum(1 << b for b in block if b not in gone)))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, *, budget: int = BUDGET, group: int | None = None) -> DataFrame:
    """Forest edges (src, dst) that join the distinct values of column fp within the budget."""
    group = group or (GROUP if budget < BLOCKS else GROUP_WIDE)
    first = masks(list(range(64)), budget)
    finer = [masks([b for b in range(64) if not used >> b & 1], budget) for used in first]

    def key(*before: Column) -> Column:
        return F.xxhash64(*before, F.col("m"), F.col("fp").bitwiseAND(F.col("m")))

    count = fps.count()
    rows = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in first])).alias("at", "m")).select("fp", "at", key().alias("key"))
    hot = written(rows.groupBy("key", "at").count().where(F.col("count") > group).select("key", "at"), "hot-blocks")
    out = rows.select("key", "fp")
    if hot.limit(1).count():
        again = F.explode(F.get(F.array(*[F.array(*[F.lit(m) for m in ms]) for ms in finer]), F.col("at")))
        dealt = rows.join(hot, ["key", "at"]).select("key", "fp", again.alias("m"))
        cold = rows.join(hot, ["key", "at"], "left_anti").select("key", "fp")
        out = cold.unionAll(dealt.select(key(F.col("key")).alias("key"), "fp"))
    return _joined_groups(out, count * len(first), budget)


def _joined_groups(rows: DataFrame, n: int, budget: int, bytes_of: int = ROW_BYTES) -> DataFrame:
    """Forest edges of all groups of ``rows`` (key, fp and maybe node), of which there are about ``n``."""
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(own, n * bytes_of // PART_BYTES)
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda b: _forest(b, budget), "src long, dst long")


def _keys(rows: DataFrame, ways: list[np.ndarray], extra: str = "") -> DataFrame:
    """``rows`` (node, fp and columns of ``extra``) for each way of dealing: key is a hash of the way, the sampled bits and ``was``."""
    more = extra.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), axis=1)
            keys = np.empty((len(fp), len(ways)), np.uint64)
            for i, at in enumerate(ways):
                packed = np.packbits(bits[:, at], axis=1).astype(np.uint64)
                keys[:, i] = packed @ (np.uint64(1) << (8 * np.arange(packed.shape[1], dtype=np.uint64)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * len(ways), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("node", "fp", *more)], lists], ["node", "fp", *more, "keys"])

    kinds = dict(rows.dtypes)
    made = rows.select("node", "fp", *more).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("node", "fp", *more)) + ", keys array<long>")
    made = made.select("node", "fp", *more, F.posexplode("keys").alias("way", "bits"))
    return made.select("node", "fp", F.xxhash64("way", "bits", *more).alias("key"))


def sketch_links(distinct: DataFrame, *, similarity: float, group: int = GROUP_WIDE) -> DataFrame:
    """Forest edges (src, dst) between the nodes of ``distinct`` (node, fp) whose sketches are within the budget.

    A group above ``group`` rows is dealt once more by other samples of bits.
    """
    count, budget = distinct.count(), sketch_budget(similarity)
    ways = samples(count, similarity)
    rows = _keys(distinct, ways)
    sizes = written(rows.groupBy("key").count().where(F.col("count") > group), "hot-groups")
    most = sizes.agg(F.max("count").alias("n")).first()["n"]
    if most:
        finer = samples(most, similarity, seed=SEED + 1)
        cold = rows.join(sizes.select("key"), "key", "left_anti").select("key", "node", "fp")
        hot = rows.join(sizes.select("key"), "key", "left_semi").select("node", "fp", F.col("key").alias("was"))
        rows = cold.unionAll(_keys(hot, finer, "was").select("key", "node", "fp"))
    return _joined_groups(rows.select("key", "node", "fp"), count * len(ways), budget, SKETCH // 8 + 32)


def components(docs: DataFrame, *, words: int = SHINGLE, budget: int = BUDGET, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id), a row for each document; root stands for the component.

    Links are fingerprints within ``budget`` bits or, with ``similarity``, sketches of texts about as alike.
    """
    if similarity is None:
        made = written(docs.select("doc_id", fingerprints(F.col("text"), words).alias("fp")), "fingerprints")
        distinct = written(made.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp")), "distinct-fps")
        forest = written(links(distinct.select("fp"), budget=budget), "forest")
    else:
        made = written(docs.select("doc_id", sketches(F.col("text"), words).alias("fp")), "sketches")
        distinct = written(made.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "distinct-sketches")
        forest = written(sketch_links(distinct.select("node", "fp"), similarity=similarity), "forest")
    found = connected_components(forest)
    named = distinct.join(found, "node").select("node", "first", "component")
    named = written(named, "named")
    least = written(named.groupBy("component").agg(F.min("first").alias("least")), "least")
    linked = written(named.join(least, "component").select("node", "component", "least"), "linked")
    found = F.col("component").isNotNull()
    of_fp = distinct.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("root"), F.when(found, F.col("least")).otherwise(F.col("first")).alias("component_id"))
    of_fp = written(of_fp, "of-fp")
    discard(distinct, forest, named, least, linked)
    return made.join(of_fp, "fp").select("doc_id", "fp", "root", "component_id")


def dedup(docs: DataFrame, *, words: int = SHINGLE, budget: int = BUDGET, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id.

    Texts are shuffled once, by doc_id. Only where a kept doc_id stands on
    more than one row, kept or not, or is null, are texts looked at again to keep one row.
    """
    known = written(components(docs, words=words, budget=budget, similarity=similarity), "components")
    rows_of = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_kept")).where("_kept")
    seen = written(rows_of.select("doc_id", ((F.col("n") > 1) | F.col("doc_id").isNull()).alias("_many")), "kept-ids")
    once = docs.join(seen.where(~F.col("_many")).select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    many = seen.where("_many")
    if not many.limit(1).count():
        return once
    # All rows of an id in question: one row of each component that the id names.
    odd = docs.join(many.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    odd = odd.withColumn("_fp", fingerprints(F.col("text"), words) if similarity is None else sketches(F.col("text"), words))
    keep = known.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("fp").alias("_fp"), F.col("component_id").alias("_id"), F.col("root").alias("_root")).distinct()
    odd = odd.join(keep, (odd["_fp"] == keep["_fp"]) & odd["doc_id"].eqNullSafe(keep["_id"])).drop(keep["_fp"])
    return once.unionByName(odd.dropDuplicates(["_root"]).select(docs.columns))
