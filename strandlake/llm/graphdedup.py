"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label are compared by cosine in double precision. Steps:

1. Vectors that are null, zero or have null or non-finite components link with nothing.
   Equal vectors of a label become one class with a weight, so a very common vector is one node.
2. Centroids are fitted for each label on a bounded sample (``SAMPLE`` classes in all; spherical
   k-means, about ``SHARD`` vectors a centroid, at least 8 sampled vectors for each). Every class
   is dealt to the shards of its ``overlap`` nearest centroids. Shards above ``SPLIT`` get centroids of their own, fitted to a
   sample of each, level by level, so shards stay small whatever the number of vectors; a tight clump is not
   divided. A shard above ``SHARD_MOST`` is split
   into blocks, and all pairs of its blocks become shards, so none of its pairs is lost.
3. Each shard's graph: candidates by exact similarity within the shard, then robust pruning: a
   neighbour is dropped when a nearer kept neighbour is closer to it by the factor alpha.
4. Adjacency lists of a class from all its shards are united; the ``LIST`` nearest stay.
5. Each shard is searched with the united lists, for all its vectors as queries: a greedy
   beam search from the query's own node and the medoids of all connected parts of the graph, which
   expands its range: all nodes within the threshold are expanded until no new one turns up. A bounded
   set of the shard's queries is compared exactly; below ``recall`` the whole shard is, in blocks.
6. Found pairs are verified by the exact cosine, counted once (in the least shard that both
   share), and each shard emits link counts and a spanning forest, not pairs. The range then goes on across shards: from a
   query over its near neighbours to what these list, where query and listed vector share no shard, by joins
   on the united lists, until no new link turns up.
7. The recall is audited: a bounded set of classes is compared with all, in blocks. Below
   ``recall`` the overlap and beam double and the graph is built again. Both audits average the recall of
   queries, each weighted by 1 / (1 + its near classes), so that a clump counts about as much as a pair.

Classes are named by a 64-bit hash of label and vector; should two share one, all are named anew with another seed.

Defined results: a null label or a vector that cannot be compared gives n_links 0 and its own
component; repeated rows are vectors of one class, linked with each other; a null
vec_id counts as a vector but names no component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import drawn, uniform
from strandlake.operators.graph import connected_components
from strandlake.plans.shared import discard, written

THRESHOLD = 0.93
SAMPLE = 20_000
SHARD = 1500
SHARD_MOST = 4096
SPLIT = 6000
SPLIT_SAMPLE = 4096
LEVELS = 4
TASK_ROWS = 200_000
LIST = 48
OVERLAP = 2
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BACK = 4
BEAM = 16
FAN = 32
PAIRS = 50_000
AUDIT = 256
RECALL = 0.95


def comparable(vector: Column, label: Column) -> Column:
    """Whether a vector can link: labelled, finite, without nulls and not zero."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def fit_centroids(classes: DataFrame, *, sample: int = SAMPLE, shard: int = SHARD) -> dict:
    """{(label, dimension): centroids}, from at most ``sample`` classes with the least hashes."""
    counts = classes.groupBy("label", "dim").count()
    some = drawn(classes.select("label", "dim", "vec", "cid"), "centroids", sample, "cid").toPandas()
    sizes = {}
    if len(some):
        keys = classes.sparkSession.createDataFrame(some[["label", "dim"]].drop_duplicates())
        sizes = {(r["label"], r["dim"]): r["count"] for r in counts.join(F.broadcast(keys), ["label", "dim"], "left_semi").collect()}
    out, rng = {}, np.random.default_rng(5)
    for key, rows in some.groupby(["label", "dim"]):
        x = _unit(rows["vec"])
        k = int(max(1, min(-(-sizes[key] // shard), len(x) // 8)))
        out[key] = _means(x, k, rng)
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(6 if k > 1 else 1):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def _dealt(classes: DataFrame, centroids: dict, overlap: int, number: str) -> DataFrame:
    """A row for each class and shard: (label, dim, cid, vec, weight, shards, shard)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            shards = np.empty(len(part), dtype=object)
            for key, at in part.groupby(["label", "dim"]).indices.items():
                c = centroids.get(key)
                if c is None or len(c) == 1:
                    for i in at:
                        shards[i] = [0]
                else:
                    m = min(overlap, len(c))
                    near = np.sort(np.argpartition(-(_unit(part["vec"].iloc[at]) @ c.T), m - 1, axis=1)[:, :m], axis=1)
                    for i, row in zip(at, near, strict=True):
                        shards[i] = row.tolist()
            part["shards"] = shards
            yield part[["label", "dim", "cid", "vec", "weight", "shards"]]

    dealt = classes.mapInPandas(run, f"label long, dim int, cid long, vec {number}, weight long, shards array<long>")
    rows = dealt.withColumn("shard", F.explode("shards"))
    if not any(len(c) > 1 for c in centroids.values()) and classes.limit(SPLIT + 1).count() <= SPLIT:
        return rows
    fine = _refined(written(rows.drop("shards"), "dealt"), overlap, number)
    if fine is None:
        return rows
    of = fine.groupBy("cid").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    return fine.join(of, "cid").select("label", "dim", "cid", "vec", "weight", "shards", "shard")


def _refined(rows: DataFrame, overlap: int, number: str) -> DataFrame | None:
    """``rows`` with shards above ``SPLIT`` divided by centroids of their own; None where no shard is.

    Centroids are not collected: each shard's row of them is sorted in front of the shard's vectors.
    """
    keys, changed = ["label", "dim", "shard"], False
    for level in range(LEVELS):
        big = rows.groupBy(*keys).count().where(F.col("count") > SPLIT)
        ways = F.least(F.ceil(F.col("count") / SHARD), F.lit(SPLIT_SAMPLE // 8)).cast("int")
        big = written(big.select(*keys, ways.alias("ways"), F.col("count").alias("n")), "big-shards")
        if not big.limit(1).count():
            break

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            x, k = _unit(part["vec"]), int(part["ways"].iloc[0])
            mean = x.mean(axis=0)
            tight = float(mean @ mean) >= 0.9  # most pairs are near each other: a clump is compared whole
            k = min(k, len(x) // 8)
            first = part[[*keys]].iloc[:1].assign(n=part["n"].iloc[0])
            made = [_means(x, k, np.random.default_rng(5)).tobytes()] if k > 1 and not tight else []
            return first.iloc[: len(made)].assign(centroids=pd.Series(made, index=first.index[: len(made)], dtype=object))

        share = F.least(F.lit(1.0), F.col("ways") * 8 / F.col("n"))
        some = rows.join(big, keys).where(uniform(f"split{level}", "cid") < share)
        made = some.groupBy(*keys).applyInPandas(fit, "label long, dim int, shard long, n long, centroids binary")
        made = written(made, "split-centroids")
        if not made.limit(1).count():
            break
        salts = F.ceil(F.col("n") / TASK_ROWS).cast("int")
        zero = F.lit(0).cast("long")  # nulls would turn pandas' integers into floats
        heads = made.select(*keys, zero.alias("cid"), zero.alias("weight"), "centroids", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        whole = rows.join(made.select(*keys, salts.alias("salts")), keys)
        whole = whole.withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int")).drop("salts")
        both = whole.unionByName(heads, allowMissingColumns=True)
        both = both.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt", F.col("centroids").isNull())

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, c = None, np.zeros((1, 1))
            for part in parts:
                part["to"] = None
                for key, at in part.groupby([*keys, "salt"]).indices.items():
                    if part["centroids"].iloc[at[0]] is not None:
                        held, c, at = key, np.frombuffer(part["centroids"].iloc[at[0]]).reshape(-1, key[1]), at[1:]
                    assert key == held
                    if len(at):
                        m = max(1, min(overlap, len(c) // 4))  # children must be smaller than their shard
                        near = np.argpartition(-(_unit(part["vec"].iloc[at]) @ c.T), m - 1, axis=1)[:, :m]
                        part.iloc[at, part.columns.get_loc("to")] = pd.Series(near.tolist(), index=part.index[at])
                part = part[part["centroids"].isna()]
                yield part[["label", "dim", "cid", "vec", "weight", "shard", "to"]]

        split = both.mapInPandas(deal, f"label long, dim int, cid long, vec {number}, weight long, shard long, to array<int>")
        split = split.withColumn("to", F.explode("to")).withColumn("shard", F.xxhash64("shard", "to").bitwiseAND(F.lit((1 << 62) - 1))).drop("to")
        rest = rows.join(made.select(*keys), keys, "left_anti").select(split.columns)
        after = written(split.unionByName(rest), "refined")
        discard(rows)
        rows, changed = after, True
    # A class may come to one shard by two ways.
    return rows.dropDuplicates(["cid", "shard"]) if changed else None


def _blocked(rows: DataFrame) -> DataFrame:
    """Shards of bounded size: (…, part), where a part is a shard or a pair of its blocks.

    With b blocks, a class of block i goes to the parts (i, j) and (j, i) of all j; ``home`` is the part (i, i).
    """
    blocks = rows.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("b")).where("b > 1")
    blocks = written(blocks, "hot-shards")
    if not blocks.limit(1).count():
        return rows.withColumn("part", F.lit("0-0")).withColumn("block", F.lit(0))
    out = rows.join(blocks, ["label", "dim", "shard"], "left").withColumn("b", F.coalesce("b", F.lit(1)))
    # Halves of SHARD_MOST for pairs of blocks keep a part within SHARD_MOST.
    out = out.withColumn("b", F.when(F.col("b") > 1, F.col("b") * 2).otherwise(1)).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("b") - 1))
    out = out.withColumn("_o", other)
    return out.withColumn("part", F.concat_ws("-", F.least("block", "_o"), F.greatest("block", "_o"))).drop("b", "_o")


def robust_prune(x: np.ndarray, *, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour lists (n, degree), -1 where there is none: nearest first, occluded ones dropped.

    A candidate v of p goes when a kept neighbour u has alpha * distance(u, v) <= distance(p, v).
    """
    n = len(x)
    k = min(candidates, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int32)
    out = np.full((n, degree), -1, np.int32)
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        sim = x[lo:hi] @ x.T
        sim[np.arange(hi - lo), np.arange(lo, hi)] = -2
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(sim, cand, axis=1)
        order = np.argsort(-near, axis=1)
        cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
        away = np.sqrt(np.maximum(0, 2 - 2 * near))
        alive = np.ones(cand.shape, bool)
        rows = np.arange(hi - lo)
        for slot in range(min(degree, k)):
            pick = np.argmax(alive, axis=1)
            has = alive[rows, pick]
            if not has.any():
                break
            chosen = cand[rows, pick]
            out[lo:hi, slot] = np.where(has, chosen, -1)
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", x[chosen], x[cand])))
            alive &= ~((alpha * between <= away) & has[:, None])
            alive[rows, pick] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def with_back_edges(lists: np.ndarray, fan: int = BACK) -> np.ndarray:
    """The lists and an edge to each node from its nearest one, so that no node is without a way in.

    The many nodes of one hub hang from it as a tree: a node gets ``fan`` such edges as hub and ``fan`` as branch.
    """
    n = len(lists)
    a = np.flatnonzero(lists[:, 0] >= 0)
    b = lists[a, 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    first = np.searchsorted(b, b)
    rank = np.arange(len(b)) - first
    up = np.where(rank < fan, b, a[np.where(rank < fan, 0, first + rank // fan - 1)]) if len(a) else b
    back = np.full((n, 2 * fan), -1, lists.dtype)
    back[up, np.where(rank < fan, 0, fan) + rank % fan] = a
    for slot in range(lists.shape[1]):
        back[back == lists[:, slot, None]] = -1
    return np.concatenate([lists, back], axis=1)


def part_medoids(x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """The medoid of each connected part of the graph."""
    lab = np.arange(len(x))
    a, slot = np.nonzero(lists >= 0)
    _merge(lab, a, lists[a, slot])
    order = np.argsort(lab, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(lab[order])) + 1)
    return np.array([p[medoid(x[p])] for p in parts])


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    x = _unit(rows["vec"]).astype(np.float32)
    ids = rows["cid"].to_numpy()
    lists = robust_prune(x)
    near = []
    for v, r in zip(x, lists, strict=True):
        r = r[r >= 0]
        near.append([{"cos": float(c), "id": int(i)} for c, i in zip(x[r] @ v, ids[r], strict=True)])
    return pd.DataFrame({"cid": ids, "near": near})


def _united(graph: DataFrame, threshold: float) -> DataFrame:
    """(cid, near, close): the ``LIST`` nearest of a class's lists from all its shards, and the ``BACK`` nearest within the threshold."""
    all_ = F.sort_array(F.flatten(F.collect_list("near")), asc=False)
    rows = graph.groupBy("cid").agg(all_.alias("all"))
    ids = lambda spans: F.array_distinct(F.transform(spans, lambda s: s["id"]))
    return rows.select("cid", F.slice(ids(F.col("all")), 1, LIST).alias("near"), F.slice(ids(F.filter("all", lambda s: s["cos"] >= threshold - 1e-5)), 1, BACK).alias("close"))


def _across(parts: DataFrame, united: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links of classes without a common shard, found by following near neighbours' lists across shards."""
    member = written(parts.select("cid", "shards").dropDuplicates(["cid"]), "members")
    of = lambda name: member.select(F.col("cid").alias(name), F.col("shards").alias(f"{name}_in"))
    lists = united.select(F.col("cid").alias("v"), F.explode("near").alias("w"))
    vec = classes.select("cid", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    cosine = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (norm(F.col("x")) * norm(F.col("y")))
    edges = united.select(F.col("cid").alias("q"), F.explode("close").alias("v"))
    links = None
    while True:
        # Only a neighbour that lies in another shard too can list vectors from beyond.
        away = edges.join(of("q"), "q").join(of("v"), "v").where(F.size(F.array_except("v_in", "q_in")) > 0).select("q", "q_in", "v")
        pairs = away.join(lists, "v").join(of("w"), "w").where((F.col("q") != F.col("w")) & ~F.arrays_overlap("q_in", "w_in"))
        pairs = pairs.select(F.least("q", "w").alias("a"), F.greatest("q", "w").alias("b")).distinct()
        pairs = pairs if links is None else pairs.join(links, ["a", "b"], "left_anti")
        near = pairs.join(vec.select(F.col("cid").alias("a"), F.col("vec").alias("x")), "a").join(vec.select(F.col("cid").alias("b"), F.col("vec").alias("y")), "b")
        fresh = written(near.where(cosine >= threshold).select("a", "b"), "links-across")
        if not fresh.limit(1).count():
            return fresh if links is None else links
        links = fresh if links is None else written(links.unionAll(fresh), "links-across")
        edges = fresh.select(F.col("a").alias("q"), F.col("b").alias("v")).unionAll(fresh.select("b", "a"))


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Matrix (query, node): the nodes with cosine >= threshold that the search meets.

    All queries advance together; ``seen`` marks what each has met. A query starts at its own node and at
    the medoids of all connected parts, of which the nearest fill the beam.
    """
    n, q = len(x), len(queries)
    lists = with_back_edges(lists)
    starts = part_medoids(x, lists)
    seen = np.zeros((q, n), bool)
    found = np.zeros((q, n), bool)
    best = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf)
    done = np.zeros((q, beam), bool)
    each = np.arange(q)
    near = x[queries] @ x[starts].T
    seen[:, starts], found[:, starts] = True, near >= threshold
    seen[each, queries], found[each, queries] = True, True
    near[starts[None, :] == queries[:, None]] = -np.inf
    width = min(beam - 1, len(starts))
    top = np.argsort(-near, axis=1)[:, :width]
    best[:, 0], score[:, 0] = queries, np.einsum("nd,nd->n", x[queries], x[queries])
    score[:, 1 : width + 1] = np.take_along_axis(near, top, axis=1)
    best[:, 1 : width + 1] = np.where(score[:, 1 : width + 1] > -np.inf, starts[top], -1)
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active] | (best[active] < 0), -np.inf, score[active])
        slot = np.argmax(open_, axis=1)
        going = open_[np.arange(len(active)), slot] > -np.inf
        active, slot = active[going], slot[going]
        if not len(active):
            break
        done[active, slot] = True
        near = lists[best[active, slot]]
        ok = near >= 0
        ok &= ~seen[active[:, None], np.where(ok, near, 0)]
        at, col = np.nonzero(ok)
        node = near[at, col]
        seen[active[at], node] = True
        got = np.full(near.shape, -np.inf)
        got[at, col] = np.einsum("nd,nd->n", x[queries[active[at]]], x[node])
        found[active[at], node] = got[at, col] >= threshold
        ids = np.concatenate([best[active], np.where(ok, near, -1)], axis=1)
        sc = np.concatenate([score[active], got], axis=1)
        dn = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        top = np.argpartition(-sc, beam - 1, axis=1)[:, :beam]
        best[active], score[active], done[active] = (np.take_along_axis(v, top, axis=1) for v in (ids, sc, dn))
    pending = [np.flatnonzero(found)]
    while pending:  # the range: every node inside is expanded, a bounded number of pairs at a time
        pairs = pending.pop()
        if len(pairs) > PAIRS:
            pending.append(pairs[PAIRS:])
            pairs = pairs[:PAIRS]
        near = lists[pairs % n]
        src = np.repeat(pairs // n, near.shape[1])
        dst = near.ravel()
        ok = (dst >= 0) & ~seen[src, np.maximum(dst, 0)]
        new = np.unique(src[ok] * n + dst[ok])
        src, dst = new // n, new % n
        seen[src, dst] = True
        close = np.einsum("nd,nd->n", x[queries[src]], x[dst]) >= threshold
        found[src[close], dst[close]] = True
        if close.any():
            pending.append(new[close])
    return found


def _merge(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        la, lb = lab[a], lab[b]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while (lab[lab] != lab).any():
            lab[:] = lab[lab]
        apart = lab[a] != lab[b]
        a, b = a[apart], b[apart]


def _evenly(recall: np.ndarray, kin: np.ndarray) -> float:
    """The mean of queries' recall, where the members of a clump together weigh about as much as a pair's."""
    has = kin > 0
    return float(np.average(recall[has], weights=1 / (1 + kin[has]))) if has.any() else 1.0


def _whole(x: np.ndarray, found: np.ndarray, threshold: float, recall: float, most: int) -> np.ndarray:
    """``found``, or where ``most`` evenly spaced queries show less than ``recall``, the exact matrix in blocks."""
    n = len(x)
    asked = np.unique(np.linspace(0, n - 1, min(n, most)).astype(np.int64))
    true = x[asked] @ x.T >= threshold
    true[np.arange(len(asked)), asked] = False
    kin = true.sum(axis=1)
    got = _evenly((true & found[asked]).sum(axis=1) / np.maximum(kin, 1), kin)
    if got < recall:
        for lo in range(0, n, 512):
            found[lo : lo + 512] = x[lo : lo + 512] @ x.T >= threshold
        np.fill_diagonal(found, False)
    return found


def _search(rows: pd.DataFrame, threshold: float, beam: int, recall: float = RECALL, audit: int = AUDIT) -> pd.DataFrame:
    rows = rows.sort_values("cid", kind="stable").reset_index(drop=True)
    x = _unit(rows["vec"])
    ids = rows["cid"].to_numpy()
    n = len(ids)
    known = [np.searchsorted(ids, v) for v in rows["near"]]
    lists = [p[(p < n)][ids[np.minimum(p, n - 1)][p < n] == np.asarray(v)[p < n]] if len(v) else p for p, v in zip(known, rows["near"], strict=True)]
    wide = max(1, max(map(len, lists)))
    table = np.full((n, wide), -1, np.int64)
    for i, p in enumerate(lists):
        table[i, : len(p)] = p
    found = range_search(x, table, np.arange(n), threshold - 1e-9, beam)
    np.fill_diagonal(found, False)
    found |= found.T
    found = _whole(x, found, threshold - 1e-9, recall, audit)
    a, b = np.nonzero(np.triu(found))
    close = np.empty(len(a), bool)
    for lo in range(0, len(a), 200_000):
        close[lo : lo + 200_000] = np.einsum("nd,nd->n", x[a[lo : lo + 200_000]], x[b[lo : lo + 200_000]]) >= threshold
    a, b = a[close], b[close]
    lab = np.arange(n)
    _merge(lab, a, b)
    # A pair counts in the least shard that both ends share, and there in the part of their blocks.
    here, part = rows["shard"].iloc[0], rows["part"].iloc[0]
    first = [np.array(s) for s in rows["shards"]]
    width = max(map(len, first))
    shards = np.full((n, width), -1)
    for i, s in enumerate(first):
        shards[i, : len(s)] = s
    less = np.zeros(len(a), bool)
    for lo in range(0, len(a), 200_000):
        s, t = shards[a[lo : lo + 200_000]], shards[b[lo : lo + 200_000]]
        common = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] >= 0) & (s[:, :, None] < here)
        less[lo : lo + 200_000] = common.any(axis=(1, 2))
    block = rows["block"].to_numpy()
    low, high = map(int, part.split("-"))
    in_part = (np.minimum(block[a], block[b]) == low) & (np.maximum(block[a], block[b]) == high)
    count = ~less & in_part
    weight = rows["weight"].to_numpy()
    links = np.zeros(n, np.int64)
    np.add.at(links, a[count], weight[b[count]])
    np.add.at(links, b[count], weight[a[count]])
    member = np.argsort(lab, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(lab[member]) != 0])
    size = np.diff(np.r_[start, n])
    rank = np.arange(n) - np.repeat(start, size)
    parent = np.empty(n, np.int64)
    parent[member] = ids[member[np.repeat(start, size) + rank // FAN]]
    out = pd.DataFrame({"cid": ids, "links": links, "parent": parent})
    return out[(out["links"] > 0) | (out["parent"] != out["cid"])]


def _audit(classes: DataFrame, counted: DataFrame, threshold: float, most: int) -> float:
    """Recall of the ``most`` classes of least hash, each compared with every class in blocks."""
    asked = drawn(classes.select("label", "dim", "vec", "cid"), "audit", most, "cid").toPandas()
    if not len(asked):
        return 1.0
    groups = {key: (_unit(g["vec"]), g["cid"].to_numpy()) for key, g in asked.groupby(["label", "dim"])}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, at in part.groupby(["label", "dim"]).indices.items():
                if key in groups:
                    x, ids = groups[key]
                    rows = part.iloc[at]
                    near = x @ _unit(rows["vec"]).T >= threshold
                    near &= ids[:, None] != rows["cid"].to_numpy()[None, :]
                    yield pd.DataFrame({"cid": ids, "true": near @ rows["weight"].to_numpy(), "kin": near.sum(axis=1)})

    exact = classes.select("label", "dim", "vec", "cid", "weight").mapInPandas(run, "cid long, true long, kin long").groupBy("cid").agg(F.sum("true").alias("true"), F.sum("kin").alias("kin"))
    both = exact.where("kin > 0").join(counted, "cid", "left").select("kin", (F.least(F.coalesce("links", F.lit(0)), F.col("true")) / F.col("true")).alias("recall")).toPandas()
    return _evenly(both["recall"].to_numpy(float), both["kin"].to_numpy())


def near_components(vectors: DataFrame, *, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM, recall: float = RECALL, audit: int = AUDIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall), a row for each vector."""
    number = dict(vectors.dtypes)["embedding"]
    one_zero = F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v))
    rows = vectors.select("vec_id", one_zero.alias("vec"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"))
    able = comparable(F.col("vec"), F.col("label"))
    keyed = rows.withColumn("able", able)
    classes = keyed.where("able").groupBy("label", "dim", "vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    plain, seed = classes, 0
    while True:
        cid = F.xxhash64(F.lit(seed), "label", "vec")
        classes = written(plain.withColumn("cid", cid), "classes")
        if not classes.groupBy("cid").count().where("count > 1").limit(1).count():
            break
        discard(classes)
        seed += 1
    centroids = fit_centroids(classes)
    while True:
        parts = written(_blocked(_dealt(classes.select("label", "dim", "cid", "vec", "weight"), centroids, overlap, number)), "parts")
        keys = ["label", "dim", "shard", "part"]
        graph = parts.groupBy(*keys).applyInPandas(_build, "cid long, near array<struct<cos:float,id:long>>")
        united = written(_united(graph, threshold), "graph")
        whole = parts.join(united.select("cid", "near"), "cid")
        width = beam
        found = written(whole.groupBy(*keys).applyInPandas(lambda g: _search(g, threshold, width, recall, audit), "cid long, links long, parent long"), "found")
        many = any(len(c) > 1 for c in centroids.values()) or parts.where(F.size("shards") > 1).limit(1).count()
        if many:
            beyond = _across(parts, united, classes, threshold)
            weight = lambda me, other: classes.select(F.col("cid").alias(other), "weight").join(beyond, other).select(F.col(me).alias("cid"), F.col("weight").alias("links"), F.col(other).alias("parent"))
            found = written(found.unionAll(weight("a", "b")).unionAll(weight("b", "a")), "found-all")
        counted = written(found.groupBy("cid").agg(F.sum("links").alias("links")), "counted")
        got = _audit(classes, counted, threshold, audit)
        most = max((len(c) for c in centroids.values()), default=1)
        if got >= recall or overlap >= most:
            break
        discard(parts, united, found, counted)
        overlap, beam = overlap * 2, beam * 2
    comps = connected_components(found.where("cid != parent"), "cid", "parent")
    named = written(classes.join(comps, classes["cid"] == comps["node"]).select("cid", "first", "component"), "named")
    least = written(named.groupBy("component").agg(F.min("first").alias("least")), "least")
    of = named.join(least, "component").select("cid", "least")
    info = classes.join(of, "cid", "left").join(counted, "cid", "left")
    info = info.select("label", "vec", "cid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    info = written(info.select("cid", "n_links", "component_id"), "info")
    ids = keyed.select("vec_id", F.when(F.col("able"), cid).alias("cid"))
    ids = written(ids, "ids")
    linked = ids.where("cid is not null").join(info, "cid").select("vec_id", "n_links", "component_id")
    alone = ids.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(got)).alias("recall"))
