"""Embedding near-dedup by a pivot-permutation index.

Vectors are scaled to length one. A vector is described by the permutation of the reference
points (pivots): the ``prefix`` nearest, nearest first. Vectors whose cosine reaches the
threshold rank the pivots nearly alike.

Index: an inverted list per pivot holds the vectors that have it among their ``near`` nearest,
as (id, permutation). Retrieval: a list's members are candidates for each other if they share at
least ``shared`` pivots, counted through the lists of the other pivots within the list, and if
this list's pivot is the one both rank highest (smallest sum of ranks, then smallest number), so
each pair comes up in one list only. Only ids and permutations are in the lists. What a list
returns is the candidates' connected groups, a row per member, never pairs; the groups then
fetch their vectors, and every pair of a group is verified by its cosine in double precision.

Pivots: from a bounded sample (``SAMPLE`` vectors with the smallest content hash), apart from each
other (cosine below ``APART``), as two pivots in one tight group would order that group's vectors
by noise; random directions fill up to the number wanted, four times the square root of the
table's size and ``PIVOTS`` at least. So lists grow with the square root only, unless vectors
truly crowd. Every vector is indexed.

Bit-equal vectors are one node with a weight. A list above ``block`` members is dealt into
pairs of blocks, so a crowd's pairs are counted in bounded pieces.

Defined results: a vector that is null, empty, zero or holds null or non-finite components
links with nothing and is its own component; vectors of unequal length never link; rows with
equal vec_id are one node for components (their links add up); a null vec_id has no component
of its own, so component_id is null if it links with nothing, and kept is then false; extra
columns are ignored; an empty table gives an empty result. Equal distances order pivots by number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.shared import apart, components, join_hot, materialize, stars

COSINE, PREFIX, NEAR, SHARED = 0.95, 10, 6, 3
SAMPLE, APART, PIVOTS, SEED = 2048, 0.5, 1024, 20240607
#: Groups up to this size are worked on together, row against row.
FEW = 32


def unit(vector: np.ndarray) -> np.ndarray | None:
    """The vector in double precision at length one, or None if it can't link."""
    v = np.asarray(vector, np.float64)
    if not v.size or not np.isfinite(v).all() or not (top := np.abs(v).max()):
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def choose_pivots(sample: list[np.ndarray], count: int) -> dict[int, np.ndarray]:
    """Pivots by vector length: apart from each other, filled up with random directions."""
    chosen: dict[int, list[np.ndarray]] = {}
    for v in sample:
        u = unit(v)
        if u is None:
            continue
        have = chosen.setdefault(len(u), [])
        if len(have) < count and (not have or (np.stack(have) @ u).max() < APART):
            have.append(u)
    return {dim: filled(dim, count, have) for dim, have in chosen.items()}


def filled(dim: int, count: int, have=()) -> np.ndarray:
    rest = np.random.default_rng((SEED, dim)).standard_normal((count - len(have), dim))
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    return np.concatenate([np.stack(have), rest]) if len(have) else rest


def _matrix(column: pa.Array, rows: np.ndarray, dim: int, kind=np.float64) -> np.ndarray:
    starts = column.offsets.to_numpy()[rows]
    values = column.values.to_numpy(zero_copy_only=False)
    return values[starts[:, None] + np.arange(dim)].astype(kind)


def _units(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    x = _matrix(column, rows, dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first."""
    scores = -(x @ pivots.T)
    if prefix >= scores.shape[1]:
        return np.argsort(scores, axis=1, kind="stable")
    # Everything up to the prefix-th smallest score, then in order; ties beyond it go to the smaller number.
    edge = np.partition(scores, prefix - 1, axis=1)[:, prefix - 1 : prefix]
    out = np.empty((len(x), prefix), np.int64)
    for i in range(len(x)):
        at = np.flatnonzero(scores[i] <= edge[i])
        out[i] = at[np.argsort(scores[i, at], kind="stable")[:prefix]]
    return out


def describe(pivots, count: int, prefix: int):
    """Worker: (id, w, v) to (id, w, v, dim, perm)."""

    def run(batches):
        known = dict(pivots.value)
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                p = known[dim] if dim in known else known.setdefault(int(dim), filled(int(dim), count))
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    perm = permutations(_units(column, part, int(dim)), p, prefix).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * perm.shape[1]), pa.array(perm.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(part)).columns, pa.array(np.full(len(part), dim, np.int32)), lists], ["id", "w", "v", "dim", "perm"])

    return run


def best_common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of permutations row by row: how many pivots are shared, and the shared one of the smallest rank sum, then number."""
    n, best = np.zeros(len(a), np.int64), np.full(len(a), -1, np.int64)
    k = a.shape[1]
    ranks = (np.arange(k)[:, None] + np.arange(k)[None, :]) << 40
    for at in range(0, len(a), 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        equal = x[:, :, None] == y[:, None, :]
        n[at : at + len(x)] = equal.sum((1, 2))
        least = np.where(equal, ranks + x[:, :, None], np.int64(1) << 60).min((1, 2))
        best[at : at + len(x)] = np.where(least < np.int64(1) << 60, least & ((1 << 40) - 1), -1)
    return n, best


def sharing(perms: np.ndarray, pivot: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of a list's members that share at least ``shared`` pivots, the list's own included."""
    m, k = perms.shape
    order = np.argsort(perms.ravel(), kind="stable")
    value, row = perms.ravel()[order], order // k
    value, row = value[value != pivot], row[value != pivot]
    if not len(value):
        return (np.zeros(0, np.int64),) * 2 if shared > 1 else np.triu_indices(m, 1)
    cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    sizes = np.diff(np.append(cut, len(value)))
    if shared > 1 and (sizes.astype(float) ** 2).sum() <= 2.0 * m * m:  # few meet in the other pivots' lists: count there
        codes = []
        for shift in range(1, int(sizes.max())):
            same = value[shift:] == value[:-shift]
            codes.append(row[:-shift][same] * m + row[shift:][same])
        code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
        code = code[n >= shared - 1]
        return code // m, code % m
    column = np.repeat(np.arange(len(cut)), sizes)
    hot = np.zeros((m, len(cut)), np.float32)
    hot[row, column] = 1
    return np.nonzero(np.triu(hot @ hot.T >= shared - 1, 1))


def _by_group(run_group, keys: int):
    """Worker over rows sorted by their first ``keys`` columns: run_group gets whole groups, as one batch and the groups' starts."""

    def flush(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        k = np.stack([rows.column(c).to_numpy() for c in range(keys)])
        cut = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(0)]))
        yield from run_group(rows, k, cut)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in range(keys)])
            last = np.flatnonzero((k != k[:, -1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0  # rows from here on may go on in the next batch
            if held and (cut or any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(keys))):
                yield from flush([*held, batch.slice(0, cut)] if cut else held)
                held = []
            elif cut:
                yield from flush([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return run


def _retrieve(shared: int):
    """Worker: the lists' rows (dim, pivot, bi, bj, mine, id, perm) to candidate groups (dim, pivot, bi, bj, root, mine, id)."""

    def groups(rows, key, cut):
        mine, ids, perms = rows.column(4).to_numpy(zero_copy_only=False).astype(bool), rows.column(5).to_numpy(), rows.column(6)
        ends = np.append(cut[1:], rows.num_rows)
        width = np.diff(perms.offsets.to_numpy())
        out = []
        for a, b in zip(cut, ends):
            if b - a < 2:
                continue
            dim, pivot, bi, bj = key[:, a]
            p = _matrix(perms, np.arange(a, b), int(width[a]), np.int64)
            i, j = sharing(p, int(pivot), shared)
            if bi != bj:
                over = mine[a + i] != mine[a + j]
                i, j = i[over], j[over]
            own = best_common(p[i], p[j])[1] == pivot
            i, j = i[own], j[own]
            if not len(i):
                continue
            member = np.unique(np.concatenate([i, j]))
            child, top = stars(i, j)
            root = member.copy()
            root[np.searchsorted(member, child)] = top
            out.append((np.repeat(key[:, a : a + 1], len(member), 1), ids[a + root], mine[a + member], ids[a + member]))
        if out:
            k = np.concatenate([o[0] for o in out], 1)
            columns = [pa.array(k[0].astype(np.int32)), pa.array(k[1].astype(np.int32)), pa.array(k[2].astype(np.int32)), pa.array(k[3].astype(np.int32))]
            columns += [pa.array(np.concatenate([o[c] for o in out])) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "pivot", "bi", "bj", "root", "mine", "id"])

    return _by_group(groups, 4)


def _verify(threshold: float):
    """Worker: groups' rows (dim, pivot, bi, bj, root, mine, id, w, perm, v) to (id, links, root)."""

    def confirmed(i, j, perms, pivot, cross, mine, ids):
        keep = ids[i] != ids[j]
        if cross is not None:
            keep &= ~cross[i] | (mine[i] != mine[j])
        i, j = i[keep], j[keep]
        keep = best_common(perms[i], perms[j])[1] == pivot[i]
        return i[keep], j[keep]

    def groups(rows, key, cut):
        mine, ids, w = rows.column(5).to_numpy(zero_copy_only=False).astype(bool), rows.column(6).to_numpy(), rows.column(7).to_numpy()
        perm, column = rows.column(8), rows.column(9)
        size = np.diff(np.append(cut, rows.num_rows))
        label, pivot, cross = np.repeat(np.arange(len(cut)), size), key[1], key[2] != key[3]
        found = []
        for dim in np.unique(key[0]):
            here = np.flatnonzero(key[0] == dim)
            x = _units(column, here, int(dim))
            width = int(np.diff(perm.offsets.to_numpy())[here[0]])
            perms = _matrix(perm, here, width, np.int64)
            g, small = label[here], (size <= FEW)[label[here]]
            pick = np.flatnonzero(small)
            for shift in range(1, FEW):
                if shift >= len(pick):
                    break
                same = np.flatnonzero(g[pick[shift:]] == g[pick[:-shift]])
                if not len(same):
                    break
                i, j = pick[same], pick[same + shift]
                hit = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = confirmed(i[hit], j[hit], perms, pivot[here], cross[here], mine[here], ids[here])
                found.append((here[i], here[j]))
            for big in np.unique(g[~small]):
                at = np.flatnonzero(g == big)
                i, j = np.nonzero(np.triu(x[at] @ x[at].T >= threshold, 1))
                i, j = confirmed(at[i], at[j], perms, pivot[here], cross[here], mine[here], ids[here])
                found.append((here[i], here[j]))
        i, j = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (0, 1))
        if len(i):
            nodes, at = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([w[j], w[i]]), len(nodes)).astype(np.int64)
            root = nodes.copy()
            child, top = stars(ids[i], ids[j])
            root[np.searchsorted(nodes, child)] = top
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n), pa.array(root)], ["id", "links", "root"])

    return _by_group(groups, 5)


def nearest_pivots(nodes: DataFrame, count: int):
    sample = nodes.select("v", F.xxhash64("v").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).collect()
    return choose_pivots([np.array(r["v"], np.float64) for r in sample], count)


def _nodes(rows: DataFrame) -> DataFrame:
    """(id, c, vec, w, v): bit-equal vectors as one. Only vectors whose content may repeat move."""
    counts = materialize(rows.filter("ok").groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("c").alias("key")), "repeated")
    once, rest = apart(rows.filter("ok").select("vec_id", "v", "c", F.xxhash64("c").alias("key")), "key", counts)
    rest = rest.groupBy("c").agg(F.min("vec_id").alias("vec"), F.count("*").alias("w"), F.min_by("v", F.coalesce("vec_id", F.lit(2**63 - 1))).alias("v"))
    nodes = once.select("c", F.col("vec_id").alias("vec"), F.lit(1).cast("long").alias("w"), "v").union(rest.select("c", "vec", "w", "v"))
    return materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")


def candidates(described: DataFrame, near: int = NEAR, shared: int = SHARED, block: int = 1024) -> DataFrame:
    """(dim, pivot, bi, bj, root, mine, id): the members of each candidate group of each inverted list."""
    lists = described.select("id", "dim", "perm", F.explode(F.slice("perm", 1, near)).alias("pivot"))
    many = materialize(lists.groupBy("dim", "pivot").agg(F.count("*").alias("n")).filter("n > 1"), "lists")  # a row per pivot: four times the square root of the vectors
    dealt = (
        lists.join(F.broadcast(many), ["dim", "pivot"])
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "pivot", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") < F.col("other")).alias("mine"), "id", "perm")
    )
    by = ["dim", "pivot", "bi", "bj"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_retrieve(shared), "dim int, pivot int, bi int, bj int, root long, mine boolean, id long")


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, prefix: int = PREFIX, near: int = NEAR, shared: int = SHARED, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding)."""
    v = F.col("embedding").cast("array<double>") if dict(vectors.dtypes).get("embedding", "") != "array<float>" else F.col("embedding")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.select("vec_id", "v", F.coalesce(F.col("v").isNotNull() & finite, F.lit(False)).alias("ok"))
    # -0.0 and 0.0 have equal cosines; adding 0.0 makes them equal as content, too.
    content = F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0).cast("float")).cast("string"))), 256)
    rows = materialize(rows.withColumn("c", F.when(F.col("ok"), content)), "rows")
    nodes = _nodes(rows)
    count = int(max(PIVOTS, 2 ** np.ceil(np.log2(4 * max(1, nodes.count()) ** 0.5))))
    pivots = vectors.sparkSession.sparkContext.broadcast(nearest_pivots(nodes, count))  # 4 * sqrt(vectors) rows, or PIVOTS
    described = materialize(nodes.select("id", "w", "v").mapInArrow(describe(pivots, count, prefix), nodes.select("id", "w", "v").schema.add("dim", "integer").add("perm", T.ArrayType(T.IntegerType()))), "permutations")
    groups = materialize(candidates(described, near, shared, block), "groups")
    # Each vector that is in a group goes to its groups; the others stay.
    members = apart(described.select("id", "w", "perm", "v"), "id", groups.select("id"))[1]
    by = ["dim", "pivot", "bi", "bj", "root"]
    found = groups.join(members, "id").select(*by, "mine", "id", "w", "perm", "v")
    found = materialize(found.repartition(*by).sortWithinPartitions(*by).mapInArrow(_verify(threshold), "id long, links long, root long"), "links")

    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("id", "c", "vec", "w").join(linked, "id", "left").join(roots, F.col("id") == F.col("node"), "left").select("c", "vec", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("top"))
    tops = placed.groupBy("top").agg(F.min("vec").alias("component")).withColumnRenamed("top", "t")
    placed = materialize(placed.join(tops, F.col("top") == F.col("t")).select("c", "component", "w", (F.col("links") + F.col("w") - 1).alias("links")), "placed")
    total = placed.agg(F.sum("w")).first()[0] or 0
    out = join_hot(rows.filter("ok").select("vec_id", "c"), placed, ["c"], "w", total).select("vec_id", "component", "links")
    out = out.unionByName(rows.filter("not ok").select("vec_id", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("links")))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id <= coalesce(c.m, vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""
