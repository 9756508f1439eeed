"""The most similar vectors of every vector, by a hierarchical k-means tree.

Problem 1.  The tree is fitted on a bounded sample, its leaves are refined over
that sample, and every vector is assigned to the leaf nearest to it.  A query
walks the tree best bin first: a priority queue holds the nodes that were seen,
leaves by the distance of their centre, inner nodes by that distance less REACH
times the radius of what lies below, and gives the leaves in the order they are
visited.  ``Tree.walk`` keeps the queues of many queries at once, neighbours in
leaf order mostly, and opens inner nodes as long as they come before leaves that
are still due; ``Tree.best_bin_first`` is the same queue for a single query.  How
many leaves are visited is calibrated: for about PROBES vectors the exact
neighbours are found by a full pass over all vectors, and the visits are
widened until TARGET of those neighbours lie in visited leaves.

Vectors are packed into blocks in leaf order.  A block first asks itself: its
own vectors visit the leaves it holds, which gives every query a floor below
which nothing counts.  Then each query goes to the blocks that hold its other
leaves, once to each, with its floor and the leaves it visits there, and is
compared with those leaves alone.  No step depends on the number of vectors:
leaves hold about LEAF vectors, blocks MOST_ROWS at most; where the tree is as
large as it may be (MOST_LEAVES), fuller leaves are split inside their blocks
and a query takes only the parts that come before the last leaf it visits.

Equal vectors are searched once.  Of each class of equal vectors only the k + 1
smallest ids can be anyone's neighbours, as the others come after them.

Defined results: vectors that are null, have a null, infinite or missing value,
another length than asked, or only zeros are not usable; repeated rows count
once, of several vectors of one id the one of least hash; fewer than k others give all of them; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normloom.runtime import written

#: Vectors of a leaf, leaves of the tree at most; vectors the tree is fitted on at least, and those for each leaf.
LEAF, MOST_LEAVES = 96, 16_384
SAMPLE, SAMPLE_A_LEAF = 32_768, 16
#: Children of a node at most; rounds of k-means for each node and for all leaves together.
BRANCHES, ROUNDS, REFINED = 32, 8, 1
#: Share of a node's radius by which it comes earlier in the queue.
REACH = 0.5
#: Vectors of the calibration, and the share of their true neighbours that visited leaves must hold.
PROBES, TARGET = 512, 0.995
#: Vectors of a block at most, and blocks that small tables should have; queries that one task asks of a block.
MOST_ROWS, LEAST_BLOCKS, MOST_ASKED = 16_384, 8, 65_536
#: Queries that walk together; rounding is to DIGITS, errors of single precision stay below SLACK.
CHUNK, DIGITS, SLACK = 1_024, 6, 4e-6
#: Numbers of a dense table, pairs of a query and a leaf, and hits that a worker holds at once; rows in double precision, queues; bytes of a batch;
#: rows of a row group where each has up to some megabytes.
CELLS, VISITED, HITS, DOUBLES, QUEUES, BATCH, GROUP = 1 << 20, 1 << 19, 1 << 18, 1 << 14, 1 << 16, 8 << 20, 8


def _means(x: np.ndarray, near: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The mean of the rows near each centre; centres without rows stay."""
    order = np.argsort(near, kind="stable")
    used, count = np.unique(near, return_counts=True)
    sums, out = np.zeros((len(used), x.shape[1])), centres.copy()
    for a in range(0, len(x), DOUBLES):
        rows = order[a : a + DOUBLES]
        some, first = np.unique(near[rows], return_index=True)
        sums[np.searchsorted(used, some)] += np.add.reduceat(x[rows].astype(np.float64), first, axis=0)
    out[used] = sums / count[:, None]
    return out.astype(np.float32)


def _squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * (q @ c.T), 0)


class Tree:
    """Centres and parents of all nodes, parents first; the leaves in order from left to right."""

    def __init__(self, centres: np.ndarray, parents: np.ndarray, levels: np.ndarray):
        self.centres, self.parents, self.levels = centres.astype(np.float32), parents, levels
        order, stack, kids = [], [0], [[] for _ in parents]
        for node, parent in enumerate(parents.tolist()):
            if node:
                kids[parent].append(node)
        while stack:
            node = stack.pop()
            if not kids[node]:
                order.append(node)
            stack += kids[node][::-1]
        self.kids = [np.array(k, np.int64) for k in kids]
        self.leaves = np.array(order)
        self.leaf_of = np.full(len(parents), -1)
        self.leaf_of[self.leaves] = np.arange(len(order))
        self._reach()

    def _reach(self) -> None:
        """How much earlier than its distance says a node comes: a share of the mean distance of its leaves."""
        sums, count = np.zeros(len(self.parents)), np.zeros(len(self.parents))
        node = above = self.leaves
        while (above != 0).any():
            node, above = node[above != 0], self.parents[above[above != 0]]
            far = np.sqrt(((self.centres[node] - self.centres[above]) ** 2).sum(1))
            sums += np.bincount(above, far, len(sums))
            count += np.bincount(above, minlength=len(sums))
        self.reach = (REACH * sums / np.maximum(count, 1)).astype(np.float32)
        self.squares = (self.centres * self.centres).sum(1)

    def keys(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The places of nodes in the queues of queries."""
        d = q @ self.centres[nodes].T
        d *= -2
        d += self.squares[nodes]
        d += np.einsum("ij,ij->i", q, q)[:, None]
        np.maximum(d, 0, out=d)
        return np.sqrt(d, out=d) - self.reach[nodes]

    def leaf_keys(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf the largest key on the leaf's path: leaves are visited in this order."""
        d = self.keys(q, np.arange(len(self.parents)))
        d[:, 0] = -np.inf
        for level in range(1, int(self.levels.max()) + 1):
            at = np.flatnonzero(self.levels == level)
            d[:, at] = np.maximum(d[:, at], d[:, self.parents[at]])
        return d[:, self.leaves]

    def best_bin_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves of one query in the order a priority queue gives them."""
        queue = [(-np.inf, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                yield int(self.leaf_of[node])
            elif len(kids := self.kids[node]):
                for kid, key in zip(kids.tolist(), self.keys(q[None], kids)[0].tolist(), strict=True):
                    heapq.heappush(queue, (key, kid))

    def walk(self, q: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that each query's queue gives first, (queries, visits), and their places in it; -1 where there are no more.

        ``closed`` and ``known`` are the queues of all queries: places of inner nodes that are not open, and of leaves.
        A leaf is given once no inner node comes before it.  So in each round the nodes that come before the last leaf
        due to some query are opened; while too few leaves are known, as many of the first nodes as should hold them.
        A node that only other queries need moves nothing, as what lies below never comes before it.
        """
        if len(self.parents) == 1:
            return np.zeros((len(q), 1), np.int64), np.zeros((len(q), 1), np.float32)
        closed, known = np.full((len(q), 1), -np.inf, np.float32), np.zeros((len(q), 0), np.float32)
        nodes, leaves = np.zeros(1, np.int64), np.zeros(0, np.int64)
        while len(nodes):
            if len(leaves) >= visits:
                due = np.partition(known, visits - 1, axis=1)[:, visits - 1]
            else:
                more = min((visits - len(leaves)) // BRANCHES, len(nodes) - 1)
                due = np.nextafter(np.partition(closed, more, axis=1)[:, more], np.float32(np.inf))
            opened = (closed < due[:, None]).any(0)
            if not opened.any():
                break
            kids = [self.kids[node] for node in nodes[opened].tolist()]
            new = np.concatenate(kids)
            place = np.maximum(self.keys(q, new), np.repeat(closed[:, opened], [len(k) for k in kids], axis=1))
            leaf = self.leaf_of[new] >= 0
            known, leaves = np.concatenate([known, place[:, leaf]], 1), np.concatenate([leaves, self.leaf_of[new[leaf]]])
            closed, nodes = np.concatenate([closed[:, ~opened], place[:, ~leaf]], 1), np.concatenate([nodes[~opened], new[~leaf]])
        some = min(visits, len(leaves))
        best = np.argpartition(known, some - 1, axis=1)[:, :some]
        return leaves[best], np.take_along_axis(known, best, 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the first its queue gives.

        Vectors in any order share few nodes, so a node is opened for those alone whose leaf so far doesn't come before it.
        """
        out = np.zeros(len(x), np.int64)
        if len(self.parents) > 1:
            for part in _chunks(len(x), most=QUEUES):
                out[part] = self._first_leaf(x[part])
        return out

    def _first_leaf(self, x: np.ndarray) -> np.ndarray:
        out, best = np.zeros(len(x), np.int64), np.full(len(x), -np.inf, np.float32)
        # Down by the first child of each node: a leaf that is early at least.
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            key = self.keys(x[rows], self.kids[node])
            first = key.argmin(1)
            best[rows] = np.maximum(best[rows], key[np.arange(len(rows)), first])
            for at in np.unique(first).tolist():
                kid, mine = int(self.kids[node][at]), rows[first == at]
                if self.leaf_of[kid] < 0:
                    stack.append((kid, mine))
                else:
                    out[mine] = self.leaf_of[kid]
        # Then every node that comes before the leaf found so far.
        stack = [(0, np.arange(len(x)), np.full(len(x), -np.inf, np.float32))]
        while stack:
            node, rows, above = stack.pop()
            due = above < best[rows]
            if not due.any():
                continue
            rows, kids = rows[due], self.kids[node]
            key, leaf = np.maximum(self.keys(x[rows], kids), above[due, None]), self.leaf_of[kids]
            if (leaf >= 0).any():
                near = key[:, leaf >= 0]
                at = near.argmin(1)
                near = near[np.arange(len(rows)), at]
                better = near < best[rows]
                best[rows[better]], out[rows[better]] = near[better], leaf[leaf >= 0][at[better]]
            for i in np.flatnonzero(leaf < 0).tolist():
                due = key[:, i] < best[rows]
                if due.any():
                    stack.append((int(kids[i]), rows[due], key[due, i]))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        c = _means(x, near, c)
    return c, near


def fit(x: np.ndarray, leaf: int, seed: int = 7) -> Tree:
    """A tree whose leaves hold about ``leaf`` of the sample's vectors; with none, a single leaf."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    centres, parents, levels = [x.mean(0) if len(x) else np.zeros(width)], [0], [0]
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if len(rows) <= 1.5 * leaf:
            continue
        # As few levels as can be, and on each about the same number of children.
        want = len(rows) / leaf
        k = max(2, round(want ** (1 / max(1, np.ceil(np.log(want) / np.log(BRANCHES))))))
        c, near = _kmeans(x[rows], k, rng)
        used = np.unique(near)
        if len(used) < 2:
            continue
        for i in used:
            centres.append(c[i])
            parents.append(node)
            levels.append(levels[node] + 1)
            stack.append((len(parents) - 1, rows[near == i]))
    tree = Tree(np.array(centres), np.array(parents), np.array(levels))
    for _ in range(REFINED if len(tree.leaves) > 1 else 0):
        tree.centres[tree.leaves] = _means(x, tree.assign(x), tree.centres[tree.leaves])
        tree._reach()
    return tree


def _unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _singles(raw: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in single precision."""
    out = np.empty(raw.shape, np.float32)
    for a in range(0, len(raw), DOUBLES):
        out[a : a + DOUBLES] = _unit(raw[a : a + DOUBLES])
    return out


def _chunks(n: int, width: int = 1, cells: int | None = None, most: int | None = None) -> Iterator[slice]:
    """Rows whose table of ``width`` columns holds ``cells`` numbers at most."""
    step = max(1, min(most or CHUNK, (cells or CELLS) // max(1, width)))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


class Block:
    """Vectors in leaf order, cut into parts: of each part its leaf, its centre and where it begins.  A fuller leaf has several."""

    FIELDS = ("cids", "vs", "leaves", "centres", "starts")

    def __init__(self, row, width: int, prefix: str = ""):
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.cids, self.leaves, self.starts = get("cids", np.int64), get("leaves", np.int64), get("starts", np.int64)
        self.raw, self.centres = get("vs", np.float32).reshape(-1, width), get("centres", np.float32).reshape(-1, width)
        self.units = _unit(self.raw)
        self.singles = self.units.astype(np.float32)

    @staticmethod
    def packed(cids: np.ndarray, raw: np.ndarray, leaves: np.ndarray, tree: Tree, leaf: int) -> dict[str, bytes]:
        order = np.argsort(leaves, kind="stable")
        cids, raw, leaves = cids[order], raw[order], leaves[order]
        x = _unit(raw).astype(np.float32)
        names, first, count = np.unique(leaves, return_index=True, return_counts=True)
        part_leaf, part_centre, starts, place = [], [], [], np.arange(len(x))
        for name, a, n in zip(names.tolist(), first.tolist(), count.tolist(), strict=True):
            if n <= 2 * leaf:
                parts = [(tree.centres[tree.leaves[name]], np.arange(n))]
            else:
                c, near = _kmeans(x[a : a + n], -(-n // leaf), np.random.default_rng(name))
                parts = [(c[i], np.flatnonzero(near == i)) for i in np.unique(near)]
            at = a
            for centre, rows in parts:
                part_leaf.append(name)
                part_centre.append(centre)
                starts.append(at)
                place[at : at + len(rows)] = a + rows
                at += len(rows)
        starts.append(len(x))
        return {"cids": cids[place].tobytes(), "vs": raw[place].tobytes(), "leaves": np.array(part_leaf, np.int64).tobytes(), "centres": np.array(part_centre, np.float32).tobytes(), "starts": np.array(starts, np.int64).tobytes()}

    def part_of_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.leaves)), np.diff(self.starts))

    def search(self, q: np.ndarray, floor: np.ndarray, cut: np.ndarray, asked: list[tuple[int, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Of each query (unit, double) its k first rows by rounded similarity and id in the asked leaves and not below its floor.

        No other row of the block can be among a query's k first: equal vectors come after the least of their ids.

        ``asked`` has leaves with the queries that visit them.  Of a leaf in several parts a query takes those
        before its cut.  Returns query, row and rounded similarity, and how many pairs were compared.
        """
        single, least, found, held, most, pairs = q.astype(np.float32), floor.astype(np.float32) - np.float32(SLACK), [], 0, HITS, 0
        lo, hi = np.searchsorted(self.leaves, [a for a, _ in asked]), np.searchsorted(self.leaves, [a for a, _ in asked], "right")
        for (_, queries), a, b in zip(asked, lo.tolist(), hi.tolist(), strict=True):
            for part in range(a, b):
                at = queries
                if b - a > 1:
                    at = at[np.sqrt(_squares(single[at], self.centres[part : part + 1]))[:, 0] <= cut[at]]
                begin, end = self.starts[part], self.starts[part + 1]
                for piece in _chunks(len(at), end - begin):
                    mine = at[piece]
                    s = single[mine] @ self.singles[begin:end].T
                    pairs += s.size
                    row, col = np.nonzero(s >= least[mine][:, None])
                    found.append((mine[row], begin + col, s[row, col]))
                    held += len(row)
                    if held > most:
                        row, col, sim = self._first(q, found, k)
                        # What is left can't grow beyond k hits of a query; the k-th is a floor for what follows.
                        full = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                        least[row[full]] = np.maximum(least[row[full]], (sim[full] - 10.0**-DIGITS).astype(np.float32) - np.float32(SLACK))
                        found, held, most = [(row, col, sim.astype(np.float32))], len(row), max(HITS, 2 * len(row))
        return *self._first(q, found, k), pairs

    def _first(self, q: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query's hits the k first by rounded similarity and id: query, row and similarity, in this order."""
        row, col, near = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        found.clear()
        # Hits surely below the k-th best need no double precision.
        order = np.lexsort((-near, row))
        row, col, near = row[order], col[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
        edge = np.full(len(q), -np.inf, np.float32)
        edge[row[place == k - 1]] = near[place == k - 1] - np.float32(10.0**-DIGITS + 2 * SLACK)
        kept = near >= edge[row]
        row, col = row[kept], col[kept]
        sim = self._rounded(q, row, col)
        order = np.lexsort((self.cids[col], -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
        return row[kept], col[kept], sim[kept]

    def _rounded(self, q: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The rounded similarities of pairs of a query and a row, in double precision."""
        out = np.empty(len(row))
        for part in _chunks(len(row), most=DOUBLES):
            out[part] = np.einsum("ij,ij->i", q[row[part]], self.units[col[part]])
        return np.round(out, DIGITS)

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the k best of all rows, ties in and near the rounding included: query, row and similarity."""
        found = []
        for part in _chunks(len(q), len(self.singles)):
            s = q[part].astype(np.float32) @ self.singles.T
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -2, np.float32)
            row, col = np.nonzero(s >= least[:, None] - np.float32(SLACK))
            found.append((row + part.start, col))
        row, col = (np.concatenate(x) for x in zip(*found, strict=True))
        return row, col, self._rounded(q, row, col)

    def floors(self, k: int) -> np.ndarray:
        """For each row the k-th best similarity within its own part, itself included; -2 where the part has fewer."""
        out = np.full(len(self.cids), -2.0)
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if b - a >= k:
                for piece in _chunks(b - a, b - a):
                    s = self.singles[a:b][piece] @ self.singles[a:b].T
                    out[a:b][piece] = np.partition(s, b - a - k, axis=1)[:, b - a - k]
        return out


def _grouped(leaf: np.ndarray, query: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Leaves with the queries that visit them, from pairs."""
    order = np.argsort(leaf, kind="stable")
    leaf, query = leaf[order], query[order]
    first = np.flatnonzero(np.diff(leaf, prepend=-1))
    return [(int(leaf[a]), query[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(leaf)], strict=True)]


def hashed_rows(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v, x, y): vectors with two independent hashes."""
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("array<float>").alias("v"))
    return rows.select("id", "v", F.xxhash64("v").alias("x"), F.xxhash64(F.lit(7), "v").alias("y"))


def usable(vectors: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(id, v, x, y): the vectors that can be compared."""
    # The sum of squares is null, infinite or not a number if some value is, and 0 if all are.
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return hashed_rows(vectors, key, column).filter((F.size("v") == width) & (squares > 0) & (squares < float("inf")))


def _sampled(reps: DataFrame, salt: int, most: int, n: int, width: int) -> np.ndarray:
    """About ``most`` of n vectors, chosen by the hash of their ids."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"v": [np.array(batch["v"].tolist(), np.float32).tobytes()]})

    # As bytes: without Arrow each number of an array would be an object of the driver.
    share = min(1.0, most / max(n, 1))
    chosen = reps.filter(F.pmod(F.xxhash64(F.lit(salt), "cid"), F.lit(1 << 30)) < share * (1 << 30)).select("v")
    return np.frombuffer(b"".join(r[0] for r in chosen.mapInPandas(joined, "v binary").collect()), np.float32).reshape(-1, width)


_PACK = "block long, cids binary, vs binary, leaves binary, centres binary, starts binary"
#: What a block's own search gives: its hits (target -1), and the queries for each other block with their leaves.
_ASKED = "target long, n long, pairs long, a binary, b binary, s binary, vs binary, floors binary, cuts binary, leaves binary, counts binary, queries binary"


def neighbours(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 10, width: int = 64, target: float = TARGET, sample: int = SAMPLE, leaf: int = LEAF, most_leaves: int = MOST_LEAVES, most_rows: int = MOST_ROWS, measured: dict | None = None) -> DataFrame:
    """(id, neighbour, rank, similarity): the k most similar others of every usable vector.

    ``measured`` receives the number of distinct vectors, leaves and visits, the pairs compared and their share.
    """
    spark = vectors.sparkSession
    # Hashes alone find the classes; of each class one vector is moved.
    hashed = usable(vectors, key, column, width).select("id", F.struct("x", "y").alias("h")).groupBy("id").agg(F.min("h").alias("h")).select("id", "h.x", "h.y")
    hashed = written(hashed, "hashed")
    first = Window.partitionBy("x", "y").orderBy("id")
    low = hashed.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    classes = written(low.groupBy("x", "y").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("x", "y", F.col("ids")[0].alias("cid"), "ids"), "classes")
    reps = hashed_rows(vectors, key, column).dropDuplicates(["id", "x", "y"]).join(classes.select(F.col("cid").alias("id"), "x", "y"), ["id", "x", "y"])
    reps = written(reps.select(F.col("id").alias("cid"), "v"), "reps")
    n = classes.count()

    leaves = int(min(most_leaves, max(1, -(-n // leaf))))
    fitted = _singles(_sampled(reps, 1, max(sample, SAMPLE_A_LEAF * leaves), n, width))
    tree = fit(fitted, max(1, -(-len(fitted) // leaves)))
    del fitted
    shared = spark.sparkContext.broadcast(tree)
    size = int(min(most_rows // 2, max(512, -(-n // LEAST_BLOCKS))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.array(batch["v"].tolist(), np.float32)
                yield pd.DataFrame({"leaf": shared.value.assign(_singles(raw)), "cid": batch["cid"], "v": [r.tobytes() for r in raw]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts)
            raw = np.frombuffer(b"".join(rows["v"]), np.float32).reshape(-1, width)
            return pd.DataFrame([{"block": number, **Block.packed(rows["cid"].to_numpy(np.int64), raw, rows["leaf"].to_numpy(np.int64), shared.value, leaf)}])

        number, kept, count = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            while len(batch):
                part, batch = batch.iloc[: most_rows - count], batch.iloc[most_rows - count :]
                kept.append(part)
                count += len(part)
                if count == most_rows:
                    yield block(kept)
                    number, kept, count = number + 1, [], 0
        if kept:
            yield block(kept)

    # Written, as a partitioning by ranges reads its input twice.
    assigned = written(reps.mapInPandas(assign, "leaf long, cid long, v binary"), "assigned")
    ordered = assigned.repartitionByRange(max(1, -(-n // size)), "leaf", "cid").sortWithinPartitions("leaf", "cid")
    blocks = written(ordered.mapInPandas(pack, _PACK), "blocks", GROUP)
    visits = _calibrated(blocks, reps, shared, k, width, target, n)
    # A row for each leaf and block that holds some of it: leaves and blocks in number, whatever the vectors.
    holds = blocks.mapInPandas(_held, "block long, leaf long").toPandas().sort_values(["leaf", "block"])
    where = spark.sparkContext.broadcast((holds["leaf"].to_numpy(np.int64), holds["block"].to_numpy(np.int64)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, homes = where.value
        for batch in batches:
            for row in batch.to_dict("records"):
                own = Block(row, width)
                parts, floors = own.part_of_rows(), own.floors(k + 1)
                for mine in _chunks(len(own.cids), visits, VISITED, most_rows):
                    yield from _batches(piece(row["block"], own, parts, floors, mine, held, homes))

    def piece(block: int, own: Block, parts: np.ndarray, floors: np.ndarray, rows: slice, held: np.ndarray, homes: np.ndarray) -> Iterator[dict]:
        """What some rows of a block find in it, and what they ask of others."""
        tree, cids, raw, singles, units, floor = shared.value, own.cids[rows], own.raw[rows], own.singles[rows], own.units[rows], floors[rows]
        cut, leaf_of, query_of = np.zeros(len(cids), np.float32), [], []
        for part in _chunks(len(cids), len(tree.parents)):
            leaf, far = tree.walk(singles[part], visits)
            cut[part] = np.where(leaf >= 0, far, -np.inf).max(1)
            # The part a query lies in is asked in any case.
            home = np.sqrt(((singles[part] - own.centres[parts[rows][part]]) ** 2).sum(1))
            cut[part] = np.maximum(cut[part], home + np.float32(SLACK))
            q, at = np.nonzero(leaf >= 0)
            leaf_of.append(leaf[q, at].astype(np.int32))
            query_of.append((q + part.start).astype(np.int32))
        leaf_of, query_of = np.concatenate(leaf_of), np.concatenate(query_of)
        here = np.isin(leaf_of, own.leaves)
        a, b, s, pairs = own.search(units, floor, cut, _grouped(leaf_of[here], query_of[here]), k + 1)
        yield _row(-1, pairs=pairs, a=cids[a], b=own.cids[b], s=s)
        full = np.flatnonzero(np.arange(len(a)) - np.searchsorted(a, a) == k)
        floor[a[full]] = np.maximum(floor[a[full]], s[full] - 10.0**-DIGITS)
        # Leaves are looked up block by block, so a leaf of several blocks is asked in each.
        lo, hi = np.searchsorted(held, leaf_of), np.searchsorted(held, leaf_of, "right")
        pair = np.repeat(np.arange(len(leaf_of), dtype=np.int32), hi - lo)
        home = homes[np.repeat(lo, hi - lo) + np.arange(len(pair)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            if home[order[x]] != block:
                these = pair[order[x:y]]
                asked, at = np.unique(query_of[these], return_inverse=True)
                groups = _grouped(leaf_of[these], at)
                yield _row(
                    int(home[order[x]]), n=len(asked), a=cids[asked], vs=raw[asked], floors=floor[asked].astype(np.float32), cuts=cut[asked],
                    leaves=np.array([g[0] for g in groups], np.int64), counts=np.array([len(g[1]) for g in groups], np.int64), queries=np.concatenate([g[1] for g in groups]).astype(np.uint16),
                )

    asked = written(blocks.mapInPandas(ask, _ASKED), "asked", GROUP)
    # Blocks that many ask are shown to several tasks. A row for each block goes to all executors, so what is asked moves once.
    loads = asked.filter("target >= 0").groupBy("target").agg(F.ceil(F.sum("n") / MOST_ASKED).alias("tasks"))
    left = asked.filter("target >= 0").join(F.broadcast(loads), "target").withColumn("task", F.pmod(F.xxhash64("a"), F.col("tasks")))
    right = blocks.withColumnRenamed("block", "target").join(F.broadcast(loads), "target").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
    right = right.select(F.col("target").alias("x_target"), F.col("task").alias("x_task"), *[F.col(c).alias(f"x_{c}") for c in Block.FIELDS])

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        block, out, pairs = Block(x.iloc[0], width, "x_"), [], 0
        for row in q.to_dict("records"):
            get = lambda name, kind, r=row: np.frombuffer(r[name], kind)
            ends = np.cumsum(get("counts", np.int64))
            groups = [(int(name), part.astype(np.int64)) for name, part in zip(get("leaves", np.int64), np.split(get("queries", np.uint16), ends[:-1]), strict=True)]
            at, col, sim, some = block.search(_unit(get("vs", np.float32).reshape(-1, width)), get("floors", np.float32), get("cuts", np.float32), groups, k + 1)
            out.append((get("a", np.int64)[at], block.cids[col], sim))
            pairs += some
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"cid": a, "other": b, "s": s, "pairs": np.where(np.arange(len(a)) == 0, pairs, 0)})

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a, b, s = (np.frombuffer(row[c], t) for c, t in (("a", np.int64), ("b", np.int64), ("s", np.float64)))
                yield pd.DataFrame({"cid": a, "other": b, "s": s, "pairs": np.where(np.arange(len(a)) == 0, row["pairs"], 0)})

    shape = "cid long, other long, s double, pairs long"
    met = left.groupBy("target", "task").cogroup(right.groupBy("x_target", "x_task")).applyInPandas(search, shape)
    met = asked.filter("target < 0").select("pairs", "a", "b", "s").mapInPandas(unpack, shape).unionByName(met)
    if measured is not None:
        met = written(met, "met")
        pairs = met.agg(F.sum("pairs")).first()[0] or 0
        measured |= {"vectors": n, "leaves": len(tree.leaves), "visits": visits, "pairs": pairs, "share": pairs / max(n * n, 1)}
    several = classes.filter(F.size("ids") > 1).select(F.col("cid").alias("other"), "ids")
    every = met.drop("pairs").join(several, "other", "left").select("cid", "s", F.explode(F.coalesce("ids", F.array("other"))).alias("id"))
    rank = Window.partitionBy("cid").orderBy(F.col("s").desc(), "id")
    best = every.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1)
    lists = best.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("r", "id", "s"))).alias("best"))
    members = hashed.join(classes.select("x", "y", "cid"), ["x", "y"]).select("id", "cid")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    out = members.join(lists, "cid").select("id", F.posexplode(others).alias("at", "b"))
    return out.select("id", F.col("b.id").alias("neighbour"), (F.col("at") + 1).alias("rank"), F.col("b.s").alias("similarity"))


def _row(target: int, n: int = 0, pairs: int = 0, **arrays: np.ndarray) -> dict:
    return {"target": target, "n": n, "pairs": pairs, **{k: v.tobytes() for k, v in arrays.items()}}


def _batches(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Rows of _ASKED, in batches of about BATCH bytes."""
    fields, kept, size = [f.split()[0] for f in _ASKED.split(", ")], [], 0
    frame = lambda: pd.DataFrame({f: [r.get(f) for r in kept] for f in fields})
    for row in rows:
        kept.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size >= BATCH:
            yield frame()
            kept, size = [], 0
    if kept:
        yield frame()


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            yield pd.DataFrame({"block": row.block, "leaf": np.unique(np.frombuffer(row.leaves, np.int64))})


def _calibrated(blocks: DataFrame, reps: DataFrame, shared, k: int, width: int, target: float, n: int) -> int:
    """How many leaves a query visits, so that they hold ``target`` of the true neighbours of the probes."""
    probes = _sampled(reps, 3, PROBES, n, width)
    if not len(probes):
        return 1
    q = _unit(probes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x = Block(row, width)
                a, b, s = x.best(q, k + 1)
                part = x.part_of_rows()[b]
                # A part of a leaf comes at its own distance, if that is farther than the leaf's place.
                far = np.sqrt(((q[a] - x.centres[part]) ** 2).sum(1)) * (np.bincount(x.leaves)[x.leaves[part]] > 1)
                yield pd.DataFrame({"probe": a, "leaf": x.leaves[part], "far": far, "cid": x.cids[b], "s": s})

    top = Window.partitionBy("probe").orderBy(F.col("s").desc(), "cid")
    true = blocks.mapInPandas(scan, "probe long, leaf long, far double, cid long, s double").withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1).select("probe", "leaf", "far").toPandas()
    keys = np.concatenate([shared.value.leaf_keys(q[part].astype(np.float32)) for part in _chunks(len(q), len(shared.value.parents))])
    probe, leaf, far, ranks = true["probe"].to_numpy(), true["leaf"].to_numpy(), true["far"].to_numpy(), []
    for part in _chunks(len(true), keys.shape[1]):
        own = keys[probe[part]]
        inside = own <= keys[probe[part], leaf[part]][:, None]
        ranks.append(np.maximum(inside.sum(1), np.minimum((own < far[part][:, None]).sum(1) + 1, keys.shape[1])))
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))])


def found(vectors: DataFrame) -> DataFrame:
    """p1_found: (vec_id_a, vec_id_b), each pair once."""
    n = neighbours(vectors)
    return n.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()
