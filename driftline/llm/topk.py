"""Exact top-k inner-product search by no-random-access aggregation (NRA).

Vectors are turned into whole numbers, floor(scale * x). In a block of candidates
every component is a list sorted by value. Lists are read in order, from both ends
at once, STEPS rounds to the middle, and a candidate's score gathers what was read
of it. What is unread of a list lies between its two frontiers, so after each round
every score has a lower and an upper bound. Reading stops for a query when at most
a few candidates have an upper bound that reaches the k-th best lower bound; their
scores are resolved by the components that they lack. No component of any other
candidate is read further.

Both ends are read since weights have both signs: lists are shared by all queries
of a block, and the frontiers close in on the middle from above and below. On
components without structure most of each list has to be read before bounds part
(about three quarters at 64 normal components); ``nra`` returns how many were.

Whole numbers below LARGE are held as doubles, in which all sums stay exact;
vectors with larger components are searched in Python's whole numbers. A score
that 64 bits do not hold is an error.

Queries and candidates are dealt into blocks of bounded size and every pair of a
query block and a candidate block is one task's group; a vector is copied once for
each block of the other kind, so blocks are as large as a task can hold. The best k
of each query and block are merged by a top-k with pre-aggregation. Nothing is
broadcast.

Defined cases: vectors that are null, or hold a null or a component that is not
finite, take no part, nor do rows without an id; vectors of another length than
the query's do not meet it; rows of equal id and vector count once; rows with the
query's id are not its candidates; ties go to the smaller id; with fewer than k
candidates all are returned; other input columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a block (few candidates: at least the first, so that all tasks have some), and queries of a block.
CANDIDATES, QUERIES = (1 << 12, 1 << 16), 1 << 13
#: Rounds from the ends of a list to its middle, those after which bounds are compared, and scores held at a time.
STEPS, COMPARED, CELLS = 12, (3, 6, 8, 9, 10, 11), 1 << 21
#: Components up to here multiply and add up within the 53 bits of a double, for up to 8,192 of them.
LARGE = 1 << 20


def whole_numbers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, or as Python's whole numbers where one of them is too large for exact sums."""
    out = np.floor(flat * float(scale))
    if not len(out) or np.abs(out).max() <= LARGE:
        return out
    return np.array([int(x) * scale if abs(x) > 1 << 53 else int(np.floor(x * scale)) for x in flat.tolist()], object)


def nra(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Ids and scores of each query's best k among ``x`` (ties: smaller id), its own id left out, and how many components were read in all."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(x, axis=0, kind="stable")
    read = 0
    together = max(16, CELLS // max(1, len(x)))
    for lo in range(0, len(queries), together):
        got, n = _together(queries[lo : lo + together], query_ids[lo : lo + together], x, ids, k, order)
        found += got
        read += n
    return found, read


def _together(queries, query_ids, x, ids, k, order):
    n, d = x.shape
    live = np.arange(len(queries))
    gathered = np.zeros((len(live), n), x.dtype)
    lacking = np.ones((n, d), bool)
    found: list = [None] * len(queries)
    few, done, read, column = max(2 * k, n // 64), 0, 0, np.arange(d)
    step = max(1, -(-n // (2 * STEPS)))
    for turn in range(1, n + 1):
        low, high = done, min(done + step, (n + 1) // 2)
        rows = np.concatenate([order[low:high], order[max(n - high, high) : n - low]])
        fresh = np.zeros((n, d), x.dtype)  # what this round reads; nothing elsewhere
        fresh[rows, column] = x[rows, column]
        lacking[rows, column] = False
        gathered += queries[live] @ fresh.T
        read += rows.size * len(live)
        done = high
        own = query_ids[live][:, None] == ids[None, :]
        if 2 * done >= n:
            for c, q in enumerate(live):
                found[q] = _best(gathered[c], ids, np.flatnonzero(~own[c]), k)
            break
        if turn not in COMPARED or n <= k:
            continue
        bottom, top = x[order[done, column], column], x[order[n - 1 - done, column], column]
        ends = queries[live] * bottom, queries[live] * top  # an unread component lies between, for either sign
        open_ = lacking.astype(x.dtype).T
        lower, upper = (np.where(own, -np.inf, gathered + f(*ends) @ open_) for f in (np.minimum, np.maximum))
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        reach = upper >= kth[:, None]
        stop = reach.sum(1) <= few
        for c in np.flatnonzero(stop):
            at = np.flatnonzero(reach[c])
            read += int(lacking[at].sum())
            score = gathered[c].copy()
            score[at] += np.where(lacking[at], x[at], 0) @ queries[live[c]]
            found[live[c]] = _best(score, ids, at, k)
        live, gathered = live[~stop], gathered[~stop]
        if not len(live):
            break
    return found, read


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    own = score[at]
    if len(at) > k:
        cut = np.partition(own, len(own) - k)[len(own) - k]
        at, own = at[own >= cut], own[own >= cut]
    best = np.lexsort((ids[at], -own))[:k]
    return ids[at][best], own[best]


def _searched(k: int, scale: int):
    def group(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy()
        ids = table.column("id").to_numpy()
        lists = table.column("v").combine_chunks()
        width = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy().astype(np.float64)
        starts = np.cumsum(width) - width
        found: list[list] = [[], [], []]
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            raw = flat[(starts[rows][:, None] + np.arange(w)).ravel()].reshape(len(rows), w)
            large = (np.abs(raw) * scale > LARGE).any(1) if w else np.zeros(len(rows), bool)
            for big in (False, True):
                for other in (False, True):
                    q, c = rows[ask[rows] & (large == big)], rows[~ask[rows] & (large == other)]
                    if not len(q) or not len(c):
                        continue
                    kind = object if big or other else float
                    vectors = [whole_numbers(raw[np.searchsorted(rows, r)].ravel(), scale).reshape(len(r), w).astype(kind) for r in (q, c)]
                    for name, (best, score) in zip(ids[q], nra(vectors[0], ids[q], vectors[1], ids[c], k)[0]):
                        if any(abs(s) >= 1 << 63 for s in score.tolist()):
                            raise ValueError(f"the score of vector {name} and another one does not fit 64 bits")
                        found[0].append(np.full(len(best), name))
                        found[1].append(best)
                        found[2].append(np.array([int(s) for s in score.tolist()], np.int64))
        made = [np.concatenate(x) if x else np.zeros(0) for x in found]
        return pa.table([pa.array(x.astype(np.int64)) for x in made], ["query_id", "vec_id", "score"])

    return group


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row for which ``is_query`` holds."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(whole)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask")).distinct()
    size = rows.agg(F.count("*").alias("n"), F.count_if("ask").alias("asks")).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least, most = CANDIDATES
    c_blocks, q_blocks = -(-max(size["n"], 1) // min(max(size["n"] // tasks, least), most)), -(-max(size["asks"], 1) // QUERIES)
    block = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(block(c_blocks, 1).alias("c"), all_of(q_blocks).alias("q"), F.lit(False).alias("ask"), "id", "v")
    asking = rows.filter("ask").select(all_of(c_blocks).alias("c"), block(q_blocks, 2).alias("q"), "ask", "id", "v")
    found = candidates.unionByName(asking).groupBy("c", "q").applyInArrow(_searched(k, scale), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
