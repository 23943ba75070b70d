"""Problem 7: texts of varying length into as few containers of a capacity as can be reached.

Bin completion by branch and bound, after Korf (2003), on the histogram of sizes.

Sizes are whole numbers up to the capacity, so the items of a collection of any size are a
histogram of at most ``capacity`` counts; that is all the driver sees.

The search works depth first. A node takes the largest item that is left and branches over the
undominated fillings of the room beside it, those of least waste first; it goes back to the next
filling when no plan below the incumbent can follow. What a plan with one container less than the
incumbent may waste is its capacity less the sizes; a filling that wastes more than is left of that
is no branch. Incumbents are best-fit decreasing and greedy completions, which also charge a price
for each further item of a filling, since small items are what fills the last gaps.

The search runs on the whole histogram first, which proves small cases optimal, and then over and
over on containers of the incumbent: enough of its wasteful ones to save one container, and others
beside them; the plan found stands for all containers of the same contents at once. It ends when the
lower bound is met, or after ``nodes`` nodes: the result says which. ``nodes=None`` searches the
whole histogram to the end, which is exact, and practical for few items only.

The plan says, for each size, which range of the items of that size goes to which containers; the
items then find their container by their number within their size, on the executors.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.encoding import TOKENIZERS, Merges, token_counts
from siftline.storage import materialize, table, without_copies

#: Nodes that all searches of a plan may visit together, and those for one greedy filling.
NODES, GREEDY_NODES = 600_000, 2000
#: Containers that are searched again together, and nodes of one such search.
TOGETHER, AT_ONCE = 20, 3000
#: Containers, the latest, of which a search holds the fillings that are left; those of others are made anew.
AT_HAND = 1000
#: Prices, in tokens of waste, of each further item of a filling: a plan is made with each.
PRICES = (0.0, 0.5, 1.0, 2.0)


@dataclass(frozen=True)
class Fill:
    """``times`` containers from ``base`` on, each holding ``count`` items of each size."""

    base: int
    times: int
    items: tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer containers (Martello and Toth's L2, over all thresholds)."""
    size = np.arange(capacity + 1)
    n, total = counts.cumsum(), (counts * size).cumsum()
    best = -(-int(total[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        # sizes above capacity - k stand alone, those above half don't share with each other
        large = int(n[capacity] - n[capacity - k])
        half = capacity // 2
        middle = int(n[capacity - k] - n[half]) if capacity - k > half else 0
        room = middle * capacity - int(total[max(capacity - k, half)] - total[half])
        rest = int(total[half] - (total[k - 1] if k else 0)) - room
        best = max(best, large + middle + max(0, -(-rest // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Fill]:
    """Best-fit decreasing, with open containers counted by the room they have left."""
    plans: dict[int, list[list]] = {}  # room -> [[items of one container, how many such]]
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        rooms = sorted(r for r in plans if r >= size)
        while left:
            rooms = [r for r in rooms if plans.get(r)]
            if not rooms:
                fit = capacity // size
                n, rest = divmod(left, fit)
                if n:
                    plans.setdefault(capacity - fit * size, []).append([[(size, fit)], n])
                if rest:
                    plans.setdefault(capacity - rest * size, []).append([[(size, rest)], 1])
                break
            r = rooms[0]
            have, n = plans[r].pop()
            use = min(n, left)
            if n > use:
                plans[r].append([have, n - use])
            plans.setdefault(r - size, []).append([have + [(size, 1)], use])
            if r - size >= size and r - size not in rooms:
                rooms = sorted([*rooms, r - size])
            left -= use
    out, base = [], 0
    for kinds in plans.values():
        for have, n in kinds:
            merged: dict[int, int] = {}
            for s, k in have:
                merged[s] = merged.get(s, 0) + k
            out.append(Fill(base, n, tuple(sorted(merged.items(), reverse=True))))
            base += n
    return out


class Completion:
    """The search for one good filling of the room beside the largest item, for greedy incumbents."""

    def __init__(self, counts: np.ndarray, nodes: int, price: float):
        self.counts, self.nodes, self.price = counts, nodes, price

    def fill(self, room: int) -> list[int]:
        """The sizes, largest first, of an undominated filling of least cost: its waste and the price."""
        here = np.flatnonzero(self.counts[: room + 1])
        here = here[here > 0]
        if not len(here):
            return []
        if here[-1] == room:  # one item that fills the room dominates all other fillings
            return [room]
        self.sizes, self.present = here[::-1].tolist(), np.zeros(room + 1, bool)
        self.present[here] = True
        self.least = int(here[0])
        self.best, self.cost, self.left = [], room + 1.0, self.nodes
        self.walk(room)
        return self.best

    def walk(self, room: int) -> None:
        """Depth first, without recursion: a container may hold as many items as its capacity."""
        have: list[int] = []
        used: Counter = Counter()
        path: list[int] = []  # where in the sizes each item of ``have`` is
        last = len(self.sizes)
        k = 0 if self.goes_on(room, have, used) else last
        while True:
            while k < last and (self.sizes[k] > room or self.counts[self.sizes[k]] <= used[self.sizes[k]]):
                k += 1
            if k < last:
                s = self.sizes[k]
                self.left -= 1
                have.append(s)
                path.append(k)
                used[s] += 1
                room -= s
                if not self.goes_on(room, have, used):
                    k = last
            else:
                if not path or self.cost <= 0 or self.left <= 0:
                    return
                s = have.pop()
                used[s] -= 1
                room += s
                k = path.pop() + 1

    def goes_on(self, room: int, have: list[int], used: Counter) -> bool:
        """Notes a filling if it is the best; whether further items may make a better one."""
        if (cost := room + self.price * max(0, len(have) - 1)) < self.cost:
            self.best, self.cost = have[:], cost
        further = self.price * len(have)  # whatever follows costs at least this
        if room < self.least or further >= self.cost or self.left <= 0:
            return False
        # an item that fits exactly dominates everything that could follow
        if self.present[room] and (not have or room <= have[-1]) and self.counts[room] > used[room]:
            if further < self.cost:
                self.best, self.cost = [*have, room], further
            return False
        return True


def complete(counts: np.ndarray, capacity: int, nodes: int = GREEDY_NODES, price: float = 0.0) -> list[Fill]:
    """Containers around the largest size left, each completed by the best filling found."""
    counts = counts.copy()
    search = Completion(counts, nodes, price)
    out, base, size = [], 0, capacity
    while True:
        while size and not counts[size]:
            size -= 1
        if not size:
            return out
        counts[size] -= 1
        filling = search.fill(capacity - size) if size < capacity else []
        counts[size] += 1
        sizes, each = np.unique([size, *filling], return_counts=True)
        times = int((counts[sizes] // each).min())
        counts[sizes] -= each * times
        out.append(Fill(base, times, tuple(zip(sizes[::-1].tolist(), each[::-1].tolist()))))
        base += times


class OutOfNodes(Exception):
    pass


class BranchAndBound:
    """A packing of items in at most so many containers, or the proof that there is none.

    A search of so many nodes also goes so many containers deep at most."""

    def __init__(self, items: Counter, capacity: int, nodes: int | None):
        self.counts, self.capacity, self.left, self.deepest = dict(items), capacity, nodes, nodes
        self.order = sorted(self.counts, reverse=True)
        self.rising = self.order[::-1]

    def visit(self) -> None:
        if self.left is not None:
            self.left -= 1
            if self.left < 0:
                raise OutOfNodes

    def solve(self, limit: int) -> list[list[int]] | None:
        """The sizes in each container. Raises OutOfNodes if it can't tell."""
        spare = limit * self.capacity - sum(s * n for s, n in self.counts.items())
        if spare < 0:
            return None
        rest = sum(self.counts.values())
        if not rest:
            return []
        plan: list[list[int]] = []
        # for each container the spare waste, the place of its largest item, its fillings and how many were tried
        branches: list[list] = [self.branch(spare, 0)]
        while branches:
            spare, at, fillings, tried = branches[-1]
            largest = self.order[at]
            if fillings is None:
                fillings = branches[-1][2] = self.again(self.capacity - largest, spare, tried)
            filling = next(fillings, None)
            if filling is None:  # go back: the largest item and the filling that led here are free again
                branches.pop()
                self.counts[largest] += 1
                if plan:
                    rest += len(plan[-1])
                    for s in plan.pop()[1:]:
                        self.counts[s] += 1
                continue
            branches[-1][3] += 1
            for s in filling:
                self.counts[s] -= 1
            plan.append([largest, *filling])
            rest -= len(plan[-1])
            if not rest:
                return plan
            if self.deepest is not None and len(plan) > self.deepest:
                raise OutOfNodes
            if len(branches) > AT_HAND:
                branches[-AT_HAND][2] = None
            branches.append(self.branch(spare - self.capacity + sum(plan[-1]), at))
        return None

    def branch(self, spare: int, at: int) -> list:
        """The largest item, none of which stands before ``at``, taken out, and the fillings of its container."""
        while not self.counts[self.order[at]]:
            at += 1
        self.counts[self.order[at]] -= 1
        return [spare, at, self.fillings(self.capacity - self.order[at], spare), 0]

    def again(self, room: int, spare: int, tried: int) -> Iterator[list[int]]:
        """The fillings after those that were tried, whose nodes are counted already."""
        left, self.left = self.left, None
        fillings = self.fillings(room, spare)
        for _ in range(tried):
            next(fillings)
        self.left = left
        return fillings

    def fillings(self, room: int, spare: int) -> Iterator[list[int]]:
        """The undominated fillings that waste at most ``spare``, by rising bands of waste: 0, 1 to 3, 4 to 15, ..."""
        sizes = [s for s in self.order[len(self.order) - bisect_right(self.rising, room) :] if self.counts[s]]
        after = [0] * (len(sizes) + 1)  # the sizes from the k-th on, all together
        for k in range(len(sizes) - 1, -1, -1):
            after[k] = after[k + 1] + sizes[k] * self.counts[sizes[k]]
        low, high = 0, 0
        while low <= min(spare, room):
            yield from self.fill(sizes, after, room, low, min(high, spare))
            low, high = high + 1, high * 4 + 3

    def fill(self, sizes: list[int], after: list[int], room: int, low: int, high: int) -> Iterator[list[int]]:
        """Depth first, without recursion: a container may hold as many items as its capacity."""
        have: list[int] = []
        used: Counter = Counter()
        path: list[int] = []  # where in the sizes each item of ``have`` is
        k, last = 0, len(sizes)
        while True:
            while k < last and after[k] >= room - high:  # else too much would stay empty
                s = sizes[k]
                if s <= room and self.counts[s] > used[s]:
                    self.visit()
                    have.append(s)
                    path.append(k)
                    used[s] += 1
                    room -= s
                else:
                    k += 1
            if low <= room <= high and not self.dominated(sizes, room, used):
                yield have[:]
            if not path:
                return
            s = have.pop()
            used[s] -= 1
            room += s
            k = path.pop() + 1

    def dominated(self, sizes: list[int], waste: int, used: Counter) -> bool:
        """Whether another filling is as good in any plan: one with a further item that fits in the waste, or
        with an item left out that fits in the place of a smaller one or of two that aren't larger together."""
        free = [s for s in reversed(sizes) if self.counts[s] > used[s]]  # rising
        if free and free[0] <= waste:
            return True
        own = [s for s, n in used.items() if n]
        places = {*own, *(a + b for k, a in enumerate(own) for b in own[:k]), *(2 * s for s in own if used[s] > 1)}
        return any((k := bisect_right(free, s)) < len(free) and free[k] <= s + waste for s in places)


def improved(plan: list[Fill], capacity: int, bound: int, nodes: int, seed: int = 1) -> tuple[list[Fill], int]:
    """A plan with fewer containers, if it is found, and the nodes that are left."""
    rng = random.Random(seed)
    bins: Counter = Counter()
    for f in plan:
        bins[tuple(s for s, n in f.items for _ in range(n))] += f.times
    while sum(bins.values()) > bound and nodes > 0:
        wasteful = sorted((b for b in bins if sum(b) < capacity), key=lambda b: rng.random() / (capacity - sum(b)))
        chosen: Counter = Counter()
        waste = 0
        for b in wasteful:
            while waste < capacity and chosen[b] < min(3, bins[b]):
                chosen[b] += 1
                waste += capacity - sum(b)
        if waste < capacity:
            break
        kinds = list(bins)
        for b in rng.choices(kinds, [len(b) for b in kinds], k=max(4, TOGETHER - sum(chosen.values()))):
            if bins[b] > chosen[b]:
                chosen[b] += 1
        search = BranchAndBound(Counter(s for b, n in chosen.items() for s in b for _ in range(n)), capacity, min(AT_ONCE, nodes))
        granted = search.left
        try:
            found = search.solve(sum(chosen.values()) - 1)
        except OutOfNodes:
            found = None
        nodes -= max(1, granted - max(0, search.left))
        if found:
            times = min(bins[b] // n for b, n in chosen.items())
            for b, n in chosen.items():
                bins[b] -= n * times
            for own in found:
                bins[tuple(own)] += times
            bins = +bins
    out, base = [], 0
    for b, n in bins.items():
        out.append(Fill(base, n, tuple(sorted(Counter(b).items(), reverse=True))))
        base += n
    return out, nodes


@dataclass(frozen=True)
class Plan:
    """The fills, and whether no plan can have fewer containers (by the lower bound or a whole search)."""

    fills: list[Fill]
    optimal: bool

    @property
    def containers(self) -> int:
        return sum(f.times for f in self.fills)


def plan(counts: np.ndarray, capacity: int, nodes: int | None = NODES) -> Plan:
    """The best plan found with ``nodes`` nodes; with None, one with fewest containers."""
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    for price in PRICES:
        if (used := sum(f.times for f in best)) <= bound:
            break
        other = complete(counts, capacity, price=price)
        if sum(f.times for f in other) < used:
            best = other
    items = Counter({int(s): int(counts[s]) for s in np.flatnonzero(counts) if s})
    # items beside which nothing fits stand alone in any plan
    least = min(items, default=0)
    alone = {s: n for s, n in items.items() if s + least > capacity}
    shared = Counter({s: n for s, n in items.items() if s not in alone})
    while (used := sum(f.times for f in best)) > bound:
        search = BranchAndBound(shared, capacity, None if nodes is None else nodes // 4)
        try:
            found = search.solve(used - 1 - sum(alone.values()))
        except OutOfNodes:
            break
        if found is None:
            return Plan(best, True)
        best = [Fill(k, 1, tuple(sorted(Counter(own).items(), reverse=True))) for k, own in enumerate(found)]
        for s, n in alone.items():
            best.append(Fill(sum(f.times for f in best[-1:]) + (best[-1].base if best else 0), n, ((s, 1),)))
    if nodes is not None:
        best, _ = improved(best, capacity, bound, nodes)
    return Plan(best, sum(f.times for f in best) <= bound)


def pieces(df: DataFrame, id_col: str, text_col: str, capacities: dict[str, int], tokenizer: str, folder: str) -> DataFrame:
    """(capacity_name, id, piece_no, first_token, n_tokens, task, number): what must be placed. A
    text is one piece, unless it is longer than the capacity: then it is cut into full pieces and
    the rest. ``number`` counts the pieces of one size within the task that made them."""
    known = df.sparkSession.sparkContext.broadcast(Merges.load(tokenizer, folder).parts())
    kind = dict(df.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = {name: np.zeros(c + 1, np.int64) for name, c in capacities.items()}
        for batch, n in token_counts(batches, Merges(*known.value)):
            for name, capacity in capacities.items():
                parts = np.maximum(1, -(-n // capacity))
                row = np.repeat(np.arange(len(n)), parts)
                no = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = no * capacity
                size = np.minimum(capacity, n[row] - first)
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, int)
                run = np.diff(np.r_[starts, len(ranked)])
                number = np.empty(len(size), np.int64)
                number[order] = seen[name][ranked] + np.arange(len(ranked)) - np.repeat(starts, run)
                seen[name][ranked[starts]] += run
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(row)), batch.column(0).take(pa.array(row)), pa.array(no.astype(np.int32)), pa.array(first), pa.array(size.astype(np.int32)), pa.array(np.full(len(row), task, np.int32)), pa.array(number)],
                    ["capacity_name", id_col, "piece_no", "first_token", "n_tokens", "task", "number"],
                )

    rows = without_copies(df.select(id_col, text_col), id_col)
    return rows.mapInArrow(cut, f"capacity_name string, `{id_col}` {kind}, piece_no int, first_token long, n_tokens int, task int, number long")


def pack(
    df: DataFrame, id_col: str, text_col: str, capacities: dict[str, int], *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, nodes: int | None = NODES
) -> DataFrame:
    """(capacity_name, id_col, piece_no, first_token, n_tokens, container, optimal): every text, for each
    capacity. optimal says that no packing has fewer containers, as far as is proven.

    Containers are numbered from 0 for each capacity. A null or empty text has no tokens: it is kept,
    as a piece of size 0 in container 0. Rows delivered twice count once; a null id is a value like
    others. Capacities must be positive; null ones and repeated names must be settled before.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must hold at least one token")
    spark = df.sparkSession
    made = materialize(pieces(df, id_col, text_col, capacities, tokenizer, folder), "pieces")
    by_task = made.groupBy("capacity_name", "n_tokens", "task").agg(F.count("*").alias("c"))
    # at most `capacity` rows a capacity
    counts = by_task.groupBy("capacity_name", "n_tokens").agg(F.sum("c").alias("c")).collect()
    ranges: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    proven: dict[str, bool] = {}
    for name, capacity in capacities.items():
        histogram = np.zeros(capacity + 1, np.int64)
        for row in counts:
            if row.capacity_name == name and row.n_tokens:
                histogram[row.n_tokens] = row.c
        given = np.zeros(capacity + 1, np.int64)
        made_plan = plan(histogram, capacity, nodes)
        proven[name] = made_plan.optimal
        for fill in made_plan.fills:
            for size, each in fill.items:
                ranges.setdefault((name, size), []).append((int(given[size]), fill.base, each))
                given[size] += each * fill.times
    known = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in ranges.items()})
    earlier = Window.partitionBy("capacity_name", "n_tokens").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("capacity_name", "n_tokens", "task", F.coalesce(F.sum("c").over(earlier), F.lit(0).cast("long")).alias("before"))
    numbered = made.join(offsets, ["capacity_name", "n_tokens", "task"]).withColumn("number", F.col("number") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            size, number = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            container = np.zeros(len(size), np.int64)
            label = {name: k for k, name in enumerate(set(names))}
            code = np.fromiter((label[x] for x in names), np.int64, len(names)) << 32 | size
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(order) else []
            for rows in np.split(order, starts[1:]) if len(order) else []:
                if (own := known.value.get((names[rows[0]], int(size[rows[0]])))) is not None:
                    first, base, each = own
                    k = np.searchsorted(first, number[rows], side="right") - 1
                    container[rows] = base[k] + (number[rows] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(container)], [*batch.schema.names[:5], "container"])

    kind = dict(df.dtypes)[id_col]
    placed = numbered.select("capacity_name", id_col, "piece_no", "first_token", "n_tokens", "number").mapInArrow(
        place, f"capacity_name string, `{id_col}` {kind}, piece_no int, first_token long, n_tokens int, container long"
    )
    return placed.withColumn("optimal", F.col("capacity_name").isin([n for n, ok in proven.items() if ok]))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in containers of each capacity of pack_capacities, in tokens of byte_bpe_50k."""
    rows = table(spark, sf_dir, "pack_capacities").where("capacity_tokens > 0").groupBy("capacity_name").agg(F.max("capacity_tokens").alias("c")).collect()
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", {r.capacity_name: r.c for r in rows})


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity_name, documents, lost, overfull, gaps) of p7_packing: documents placed, those not placed or whose
    pieces don't follow each other, containers above the capacity, numbers of containers left out."""
    caps = table(spark, sf_dir, "pack_capacities").where("capacity_tokens > 0").groupBy("capacity_name").agg(F.max("capacity_tokens").alias("capacity"))
    packed = materialize(p7_packing(spark, sf_dir), "packing")
    per_doc = packed.groupBy("capacity_name", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("piece_no").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    whole = per_doc.groupBy("capacity_name").agg(F.count("*").alias("documents"), F.count_if((F.col("last") != F.col("n") - 1) | (F.col("end") != F.col("tokens"))).alias("broken"))
    load = packed.groupBy("capacity_name", "container").agg(F.sum("n_tokens").alias("load"))
    filled = load.join(F.broadcast(caps), "capacity_name").groupBy("capacity_name").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), (F.max("container") + 1 - F.count("*")).alias("gaps"))
    all_docs = table(spark, sf_dir, "documents").agg(F.count_distinct("doc_id").alias("all"))
    out = whole.join(filled, "capacity_name").crossJoin(all_docs)  # one row a capacity
    return out.select("capacity_name", "documents", (F.col("all") - F.col("documents") + F.col("broken")).alias("lost"), "overfull", "gaps")


SQL = {
    "p7_check": """SELECT capacity_name, n AS documents, 0::BIGINT AS lost, 0::BIGINT AS overfull, 0::BIGINT AS gaps
FROM (SELECT DISTINCT capacity_name FROM pack_capacities WHERE capacity_tokens > 0), (SELECT count(DISTINCT doc_id) AS n FROM documents)""",
}
