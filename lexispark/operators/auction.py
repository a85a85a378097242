"""One-to-one matching of the largest value, however large a component of eligible pairs is: regions, prices, joins.

Left nodes pay prices for right ones. Nodes lie in regions of a bounded number of edges. In a round every region that has an open left node finds it
the cheapest way at the prices given: along a path that moves the region's own partners, to a free node, to a node that another region holds (for its
price and a small increment), or to a left node that rather stays single. What the regions pay meets in one aggregation where the highest price for a node wins; who lost is
open again in the next round, in regions whose borders have moved. Where open nodes remain after some rounds, all prices rise at once by the length of the
cheapest path from each node to a free one or to staying single: the regions find these lengths together, each over its own edges to the end, until none falls.
So prices need not climb by increments. They only rise, nodes without a partner keep price 0, and nobody could gain more than the increment by
another partner: the matching is within one increment a left node of the best one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import settled

#: edges of one region, what one task holds (or those of one node, if it has more)
REGION_EDGES = 200_000
#: rounds between two rises of all prices
ROUNDS = 6
_FINE = 64
_STATE = ["item", "price", "owner", "value"]


class Region:
    """Left nodes of one region with their edges; ``price``, ``owner`` (place of a left node, -1 if none of these has it) of the right ones."""

    def __init__(self, edges: list[list[tuple[int, float]]], price: list[float], owner: list[int], held: list[bool], step: float):
        self.edges, self.price, self.owner, self.held, self.step = edges, price, owner, held, step
        self.partner = [-1] * len(edges)
        for item, b in enumerate(owner):
            if b >= 0:
                self.partner[b] = item
        self.touched: set[int] = set()
        self.single: list[int] = []
        self.worth = [dict(e) for e in edges]

    def gain(self, b: int) -> float:
        """What a left node gains at the present prices."""
        if self.partner[b] >= 0:
            return self.worth[b][self.partner[b]] - self.price[self.partner[b]]
        return max(0.0, max((v - self.price[i] for i, v in self.edges[b]), default=0.0))

    def place(self, start: int) -> None:
        """The cheapest way for an open left node, and the prices that make it the best one for all who move."""
        gains = {start: self.gain(start)}
        at = {start: 0.0}
        came: dict[int, int] = {}
        dist: dict[int, float] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        row, low = start, 0.0
        best, last = float("inf"), -1
        end = -1
        while True:
            if low + gains[row] < best:
                best, last = low + gains[row], row
            for item, value in self.edges[row]:
                if item not in done:
                    reach = low + max(0.0, gains[row] - value + self.price[item])
                    if reach < dist.get(item, float("inf")):
                        dist[item], came[item] = reach, row
                        heapq.heappush(heap, (reach, item))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                low = best
                break
            low, item = heapq.heappop(heap)
            if self.owner[item] < 0:
                end = item
                break
            done[item] = low
            row = self.owner[item]
            gains[row], at[row] = self.gain(row), low
        for item, d in done.items():
            self.price[item] += low - d
            self.touched.add(item)
        if end < 0:
            end, self.partner[last] = self.partner[last], -1
            self.single.append(last)
            if last == start:
                return
        elif self.held[end]:
            self.price[end] += self.step
            self.held[end] = False
        while True:
            b = came[end]
            self.touched.add(end)
            self.owner[end], self.partner[b], end = b, end, self.partner[b]
            if b == start:
                return


def _cogroup(bids: pd.DataFrame, items: pd.DataFrame):
    bids, items = bids.sort_values("bidder", ignore_index=True), items.sort_values("item", ignore_index=True)
    place = {x: i for i, x in enumerate(items["item"])}
    seat = {x: i for i, x in enumerate(bids["bidder"])}
    owner = [-1 if pd.isna(o) else seat.get(int(o), -1) for o in items["owner"]]
    return bids, items, place, owner


def _round(step: float):
    def run(bids: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        bids, items, place, owner = _cogroup(bids, items)
        edges = [[(place[x], float(v)) for x, v in zip(row, value, strict=True)] for row, value in zip(bids["items"], bids["values"], strict=True)]
        held = [b < 0 and not pd.isna(o) for b, o in zip(owner, items["owner"], strict=True)]
        region = Region(edges, items["price"].astype(float).tolist(), owner, held, step)
        for b in np.flatnonzero(bids["open"].to_numpy(bool)).tolist():
            region.place(b)
        names, at = bids["bidder"].to_numpy(), items["item"].to_numpy()
        rows = [(int(at[i]), region.price[i], int(names[region.owner[i]]), region.worth[region.owner[i]][i]) for i in sorted(region.touched)]
        rows += [(None, None, int(names[b]), None) for b in region.single]
        return pd.DataFrame({c: pd.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(_STATE, ("Int64", "Float64", "Int64", "Float64"), strict=True))})

    return run


def _shorter(bids: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    """Lengths of the cheapest ways from the region's own partners that have become shorter."""
    bids, items, place, owner = _cogroup(bids, items)
    d, price = items["d"].to_numpy(float, copy=True), items["price"].to_numpy(float)
    mine = np.flatnonzero(np.array(owner, int) >= 0)
    empty = pd.DataFrame({"item": np.zeros(0, "int64"), "d": np.zeros(0)})
    if not len(mine):
        return empty
    gain = items["value"].to_numpy(float) - price
    to, slack, starts = [], [], []
    for i in mine:
        b = owner[i]
        starts.append(len(to))
        for x, v in zip(bids["items"].iat[b], bids["values"].iat[b], strict=True):
            to.append(place[x])
            slack.append(max(0.0, gain[i] - v + price[place[x]]))
    to, slack, before = np.array(to), np.array(slack), d[mine]
    while True:
        new = np.minimum(d[mine], np.minimum.reduceat(slack + d[to], starts))
        if not (new < d[mine] - 1e-12).any():
            break
        d[mine] = new
    less = d[mine] < before - 1e-12
    return pd.DataFrame({"item": items["item"].to_numpy()[mine[less]], "d": d[mine[less]]}) if less.any() else empty


class _Regions:
    """Left nodes with their edges, dealt to regions along a line in two ways that differ by half a region."""

    def __init__(self, edges: DataFrame, at: str, most: int):
        rows = edges.groupBy(F.col("left").alias("bidder")).agg(F.collect_list(F.struct(F.col("right").alias("i"), F.col("value").alias("v"))).alias("e"), F.min(at).alias("at"))
        rows = rows.select("bidder", F.col("e.i").alias("items"), F.col("e.v").alias("values"), F.floor(F.col("at") * _FINE).cast("long").alias("b"), F.size("e").alias("n"))
        rows = settled(rows)
        # a bucket of very many edges is cut by a hash, so that every cell is far smaller than a region
        large = rows.groupBy("b").agg(F.sum("n").alias("edges")).select("b", F.ceil(F.col("edges") / (most / 8)).cast("long").alias("cuts"))
        celled = rows.join(large, "b").withColumn("c", F.pmod(F.xxhash64("bidder"), F.col("cuts"))).drop("cuts")
        cells = celled.groupBy("b", "c").agg(F.sum("n").alias("edges"))
        before = Window.orderBy("b", "c").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
        starts = cells.select("b", "c", F.coalesce(F.sum("edges").over(before), F.lit(0)).alias("start"))
        region = lambda shift: F.floor((F.col("start") + shift) / most).cast("long")
        self.rows = settled(celled.join(starts, ["b", "c"]).select("bidder", "items", "values", region(0).alias("r0"), region(most // 2).alias("r1")))
        self.names = settled(self.rows.select("bidder", "r0", "r1"))
        self.items = [settled(self.rows.select(F.col(r).alias("region"), F.explode("items").alias("item")).distinct()) for r in ("r0", "r1")]

    def _met(self, turn: int, state: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        """Left nodes and right nodes of every region, the latter with their state."""
        own = self.rows.withColumnRenamed(f"r{turn % 2}", "region").select("region", "bidder", "items", "values")
        return own, self.items[turn % 2].join(state, "item").select("region", *_STATE, *more)

    def round(self, turn: int, state: DataFrame, open_: DataFrame, step: float) -> DataFrame:
        """What the regions with open left nodes pay: item, price, owner, value; without an item: a left node that stays single."""
        live = open_.select(F.col(f"r{turn % 2}").alias("region")).distinct()
        own, items = self._met(turn, state)
        own = own.join(live, "region", "left_semi").join(open_.select("bidder", F.lit(True).alias("o")), "bidder", "left").withColumn("open", F.coalesce("o", F.lit(False))).drop("o")
        items = items.join(live, "region", "left_semi")
        return settled(own.groupBy("region").cogroup(items.groupBy("region")).applyInPandas(_round(step), "item long, price double, owner long, value double"))

    def risen(self, state: DataFrame) -> DataFrame:
        """The state with every price raised by the length of the cheapest way out: to a free right node, or a left one that stays single."""
        way = settled(state.withColumn("d", F.when(F.col("owner").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("value") - F.col("price")))))
        turn = 0
        while True:
            own, items = self._met(turn, way, "d")
            less = settled(own.groupBy("region").cogroup(items.groupBy("region")).applyInPandas(_shorter, "item long, d double"))
            if turn and not less.head(1):
                return way.select("item", (F.col("price") + F.col("d")).alias("price"), "owner", "value")
            way = settled(way.join(less.withColumnRenamed("d", "n"), "item", "left").withColumn("d", F.coalesce("n", "d")).drop("n"))
            turn += 1


def auction_matching(edges: DataFrame, slack: float = 1e-4, alone: float | None = None, at: str | None = None, most: int = REGION_EDGES) -> DataFrame:
    """left, right, cost of a one-to-one matching of (nearly) the most pairs and the least sum of costs, however large a component is.

    ``edges``: left, right (long numbers), cost from 0, one row a pair. To stay single costs ``alone``, a thousand times the largest cost (or 1) if not given: a
    pair more is worth that much. The sum of costs, with ``alone`` for each single left node, is within ``slack`` a left node of the least one. ``at``: a column with the
    left node's place on a line, if left nodes near each other share partners; regions are cut along it (else by the cheapest partner). No edges: no rows.
    """
    if alone is None:
        alone = 1000.0 * max(1.0, edges.agg(F.max("cost")).first()[0] or 0.0)
    place = F.col(at) if at else F.pmod(F.xxhash64(F.min_by("right", F.struct("cost", "right")).over(Window.partitionBy("left"))), F.lit(1 << 20)) / _FINE
    e = settled(edges.select("left", "right", "cost", (F.lit(alone) - F.col("cost")).alias("value"), place.alias("at")))
    regions = _Regions(e, "at", most)
    state = settled(e.select(F.col("right").alias("item")).distinct().select("item", F.lit(0.0).alias("price"), F.lit(None).cast("long").alias("owner"), F.lit(None).cast("double").alias("value")))
    single = None
    turn = 0
    while True:
        open_ = regions.names.join(state.select(F.col("owner").alias("bidder")), "bidder", "left_anti")
        open_ = settled(open_ if single is None else open_.join(single, "bidder", "left_anti"))
        if not open_.head(1):
            break
        if turn and turn % ROUNDS == 0:
            state = settled(regions.risen(state))
        got = regions.round(turn, state, open_, slack)
        # a region may hand on a node at its old price: what is new comes before what was
        paid = state.withColumn("new", F.lit(0)).unionByName(got.where("item is not null").withColumn("new", F.lit(1)))
        state = settled(paid.groupBy("item").agg(F.max(F.struct("price", "new", "owner", "value")).alias("s")).select("item", "s.price", "s.owner", "s.value"))
        out = got.where("item is null").select(F.col("owner").alias("bidder"))
        single = out if single is None else single.union(out)
        turn += 1
    pairs = state.where("owner is not null").select(F.col("owner").alias("left"), F.col("item").alias("right"))
    return pairs.join(e.select("left", "right", "cost"), ["left", "right"])
