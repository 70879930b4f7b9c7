"""Centroid clustering of integer vectors, each vector's nearest centroid found in a vantage-point tree.

A round builds a vantage-point tree over the centroids and broadcasts it. An inner node holds one centroid, its
vantage point, and two subtrees, the nearer and the farther half of the other centroids, each with the least and
greatest distance from the vantage point; a leaf holds up to LEAF centroids. Every vector searches best first: of the
subtrees it has not entered it takes the one with the smallest lower bound (triangle inequality), until that bound is
greater than the distance found. The bound is inclusive: a subtree whose bound equals that distance is entered, so no
centroid that ties is missed, and bounds are lowered by a margin for floating-point roots. Distances to vantage points
and leaf centroids are squared sums of integers, compared exactly; the smaller number wins a tie. The vectors of an
Arrow batch search side by side, each with its own frontier.

What a round needs of all vectors are k sums and counts: every task adds its own and Spark sums the tasks' rows. The
driver and each broadcast hold k vectors; k times the number of components may be at most CENTROID_NUMBERS. The kept
vectors are written once as integers and read by every round.

Defined results: a vector is kept if it has exactly ``dims`` components, none null, infinite, NaN or beyond 2^27 in
magnitude once scaled (its distances would not fit into a long); others get no row. Rows that repeat a vec_id are
vectors of their own; a null vec_id hashes as "1:" and is returned as null. With fewer kept vectors than k every one
is a centroid; equal hashes go by the components. Sums over all distances that do not fit into a long are null. A table
without kept vectors gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import stored

DIMS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
LEAF = 4
LIMIT = 2**27
CENTROID_NUMBERS = 2**22
ROWS = 2048


class Tree:
    """A vantage-point tree over integer centroids, as arrays."""

    def __init__(self, centroids, leaf: int = LEAF):
        import numpy as np

        if leaf < 2:
            raise ValueError(f"a leaf holds at least two centroids, got {leaf}")
        self.points = np.asarray(centroids, np.int64)
        self.leaf = leaf
        self.vantage, self.children, self.ranges, self.members = [], [], [], []
        self._node(np.arange(len(self.points)))
        self.vantage = np.array(self.vantage, np.int64)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)
        self.ranges = np.array(self.ranges, np.float64).reshape(-1, 2, 2)
        self.members = np.array(self.members, np.int64).reshape(-1, leaf)

    def _node(self, ids) -> int:
        """Adds the subtree of ``ids``, in preorder; the number of its top."""
        import numpy as np

        here = len(self.vantage)
        self.vantage.append(-1)
        self.children.append((-1, -1))
        self.ranges.append(((0, 0), (0, 0)))
        self.members.append([ids[0]] * self.leaf)
        if len(ids) <= self.leaf:
            self.members[here] = [*ids, *[ids[0]] * (self.leaf - len(ids))]
            return here
        # the centroid farthest from the first one spreads the others most
        spread = self.points[ids] - self.points[ids[0]]
        top = int(np.argmax((spread * spread).sum(axis=1)))
        point, rest = ids[top], np.delete(ids, top)
        apart = self.points[rest] - self.points[point]
        distance = np.sqrt((apart * apart).sum(axis=1).astype(np.float64))
        order = np.argsort(distance, kind="stable")
        near, far = np.array_split(order, 2)
        self.vantage[here] = point
        self.ranges[here] = tuple((distance[half].min(), distance[half].max()) for half in (near, far))
        self.children[here] = (self._node(rest[near]), self._node(rest[far]))
        return here

    def nearest(self, vectors):
        """For each row the number of its nearest centroid, the squared distance, and how many distances were computed."""
        import numpy as np

        n = len(vectors)
        best = np.full(n, np.iinfo(np.int64).max, np.int64)
        chosen = np.zeros(n, np.int64)
        computed = np.zeros(n, np.int64)
        bounds = np.zeros((n, 1))
        nodes = np.zeros((n, 1), np.int64)
        active = np.arange(n)

        def offer(rows, ids):
            apart = vectors[rows] - self.points[ids]
            d = np.einsum("ij,ij->i", apart, apart)
            better = (d < best[rows]) | ((d == best[rows]) & (ids < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = d[better], ids[better]
            computed[rows] += 1
            return d

        while len(active):
            at = bounds.argmin(axis=1)
            line = np.arange(len(active))
            # inclusive: a bound equal to the best distance is followed
            open_ = bounds[line, at] <= np.sqrt(best[active].astype(np.float64))
            active, bounds, nodes, at = active[open_], bounds[open_], nodes[open_], at[open_]
            line = line[: len(active)]
            node = nodes[line, at]
            bounds[line, at] = np.inf
            inner = self.vantage[node] >= 0
            for k in range(self.leaf):
                ids = self.members[node[~inner], k]
                new = ids != self.members[node[~inner], 0] if k else np.ones(len(ids), bool)
                offer(active[~inner][new], ids[new])
            more = np.full((len(active), 2), np.inf)
            below = np.zeros((len(active), 2), np.int64)
            if inner.any():
                top = node[inner]
                d = np.sqrt(offer(active[inner], self.vantage[top]).astype(np.float64))[:, None]
                low, high = self.ranges[top, :, 0], self.ranges[top, :, 1]
                bound = np.maximum(np.maximum(low - d, d - high), 0)
                more[inner] = np.maximum(bound - 1e-9 * (d + high), 0)
                below[inner] = self.children[top]
            bounds, nodes = np.hstack([bounds, more]), np.hstack([nodes, below])
            if bounds.shape[1] > 64:  # entered subtrees leave the frontier
                keep = np.argsort(bounds, axis=1, kind="stable")[:, : max(1, int(np.isfinite(bounds).sum(axis=1).max(initial=0)))]
                bounds, nodes = np.take_along_axis(bounds, keep, 1), np.take_along_axis(nodes, keep, 1)
        return chosen, best, computed


def kept_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as integers, of the vectors that are kept."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    fits = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < LIMIT)
    sound = (F.size("embedding") == dims) & F.forall("embedding", fits)
    return embeddings.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose ids hash lowest; each task sends at most k."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r["v"] for r in vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def _matrix(column):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.int64).reshape(len(column), -1)


def _sums(vectors: DataFrame, tree) -> DataFrame:
    """cluster, n, total (array) of each task's vectors."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(len(tree.value.points), np.int64)
        totals = np.zeros(tree.value.points.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _matrix(batch.column("v").slice(at, ROWS))
                chosen = tree.value.nearest(rows)[0]
                np.add.at(totals, chosen, rows)
                counts += np.bincount(chosen, minlength=len(counts))
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(counts[full]), pa.array(list(totals[full]), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"],
        )

    return vectors.select("v").mapInArrow(run, "cluster long, n long, total array<long>")


def _next(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the exact floor of its vectors' mean; one without vectors stays."""
    tree = vectors.sparkSession.sparkContext.broadcast(Tree(centroids))
    exact = _sums(vectors, tree).select("cluster", "n", F.posexplode("total").alias("place", "x"))
    sums = exact.groupBy("cluster", "place").agg(
        F.sum(F.col("n").cast("decimal(28,0)")).alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x")
    )
    out = [list(c) for c in centroids]
    for r in sums.collect():  # k times the number of components
        out[r["cluster"]][r["place"]] = int(r["x"]) // int(r["n"])
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, n_computed (distances computed for the vector)."""
    tree = vectors.sparkSession.sparkContext.broadcast(Tree(centroids))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                chosen, best, computed = tree.value.nearest(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(chosen.astype("int32")), pa.array(best), pa.array(computed)],
                    names=["vec_id", "cluster", "distance", "n_computed"],
                )

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long, n_computed long")


def clusters(
    embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_computed of every kept vector."""
    if k * dims > CENTROID_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} components are more than {CENTROID_NUMBERS} numbers")
    vectors = stored(kept_vectors(embeddings, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_computed long"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = _next(vectors, centroids)
    found = stored(assigned(vectors, centroids), "assigned")

    whole = lambda c: c.cast("decimal(28,0)")
    per_cluster = [(r["cluster"], r["d"]) for r in found.groupBy("cluster").agg(F.sum(whole(F.col("distance"))).alias("d")).collect()]
    long = lambda x: F.lit(int(x) if x < 2**63 else None).cast("long")
    inertia = long(sum(d for _, d in per_cluster))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    # k rows, which the joins' size check lets Spark broadcast
    facts = vectors.sparkSession.range(1).select(
        F.inline(F.array(*[
            F.struct(F.lit(c).cast("int").alias("cluster"), long(d).alias("cluster_inertia"), F.lit(digest(c)).alias("centroid_sha256"))
            for c, d in per_cluster
        ]))
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256", "n_computed"
    )
