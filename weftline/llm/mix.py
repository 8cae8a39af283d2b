"""Problem 7: mixing sources to target weights.

Method: hierarchical budgeting over the tree domain - language - source. The weight of a source is spread over its leaves
(one for each language) in proportion to their tokens; a node's weight is the sum below it. The budget goes down the tree:
children get it by weight, a child gets no more than all below it can give within max_repeats, and what it can't use goes to
its siblings by weight; only what all siblings can't use reaches the ancestors. Each leaf then takes its quota as whole
epochs and, of one more epoch in a seeded order, the prefix of documents whose tokens come nearest to the rest.

The order of an epoch is that of a seeded hash. Its high bits cut a leaf into buckets whose sums (one small row per bucket)
place the end of the prefix; only the bucket that holds the end is ordered row by row. So a leaf with a third of all
rows is never in one task.

Sources without a target, null sources, null and empty texts take no part. A target whose source has no token is short
from the start, and its share goes to its siblings first. Without a given budget it is the largest at which no source that is
there falls short, so each meets its (so adjusted) share to within half a document per leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.session import cut

#: Rows of the table of targets, and leaves of the tree (targets times languages): parameters, checked.
MOST_TARGETS, MOST_LEAVES = 10_000, 100_000
BUCKET_BITS = 12


@dataclass
class Node:
    name: str
    weight: float = 0.0
    room: float = 0.0
    quota: float = 0.0
    kids: dict[str, Node] = field(default_factory=dict)


def water_fill(budget: float, weights: list[float], rooms: list[float]) -> list[float]:
    """Split budget by weights with no more than its room for each; a part without weight gets what the others can't use
    only once those are full."""
    out = [0.0] * len(weights)
    for use in (weights, [r if w <= 0 else 0.0 for w, r in zip(weights, rooms)]):
        open_ = {i for i, w in enumerate(use) if w > 0 and rooms[i] > out[i]}
        left = budget - sum(out)
        while open_ and left > 1e-9:
            total = sum(use[i] for i in open_)
            full = {i for i in open_ if out[i] + left * use[i] / total >= rooms[i]}
            if not full:
                for i in open_:
                    out[i] += left * use[i] / total
                break
            for i in full:
                out[i] = rooms[i]
            open_ -= full
            # those still open start again from what is left after the full ones
            left = budget - sum(out[i] for i in range(len(out)) if i not in open_)
            for i in open_:
                out[i] = 0.0
    return out


def spread(node: Node, budget: float) -> None:
    node.quota = budget
    kids = [node.kids[k] for k in sorted(node.kids)]
    for kid, part in zip(kids, water_fill(budget, [k.weight for k in kids], [k.room for k in kids])):
        spread(kid, part)


def tree(leaves: list[tuple[str, str, float]], targets: dict[str, tuple[float, int]], mark: str = "_") -> Node:
    """leaves: (source, language, tokens). The domain of a source is its name up to the mark."""
    have: dict[str, float] = {}
    for s, _, n in leaves:
        have[s] = have.get(s, 0.0) + n
    root = Node("")
    rows = [(s, lang, n, targets[s][0] * n / have[s]) for s, lang, n in leaves] + [(s, "", 0.0, w) for s, (w, _) in targets.items() if not have.get(s)]
    for s, lang, n, w in rows:
        room = n * targets[s][1]
        node = root
        for step in (s.split(mark)[0], lang, s):
            node.weight += w
            node.room += room
            node = node.kids.setdefault(step, Node(step))
        node.weight += w
        node.room += room
    return root


def _leaves(root: Node):
    return [(src.name, lang.name, src) for dom in root.kids.values() for lang in dom.kids.values() for src in lang.kids.values()]


def feasible(root: Node) -> float:
    """The largest budget at which no leaf that has tokens would need more than its room."""
    real = {id(n): n.room for _, _, n in _leaves(root)}

    def roomy(node: Node) -> float:
        if not node.kids:
            node.room = 1e18 if real.get(id(node), 0.0) > 0 else 0.0
        else:
            node.room = sum(roomy(k) for k in node.kids.values())
        return node.room

    def restore(node: Node) -> float:
        node.room = sum(restore(k) for k in node.kids.values()) if node.kids else real.get(id(node), 0.0)
        return node.room

    roomy(root)
    spread(root, 1.0)
    best = min((real[id(n)] / n.quota for _, _, n in _leaves(root) if n.quota > 1e-12), default=0.0)
    restore(root)
    return best


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source to (share, max_repeats). Null sources and shares or repeats that are not positive are left out; a source that
    is listed twice has the sum of its shares and the smaller max_repeats."""
    rows = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out: dict[str, tuple[float, int]] = {}
    for s, w, k in rows:
        if s is not None and w is not None and w > 0 and k is not None and k > 0:
            old = out.get(s, (0.0, k))
            out[s] = (old[0] + w, min(old[1], k))
    return out


class Mix:
    def __init__(self, docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 1, vocab: str = tokens.VOCAB, id_col: str = "doc_id", text_col: str = "text", mark: str = "_"):
        self.id_col, self.spark = id_col, docs.sparkSession
        self.targets = targets_of(targets)
        sized = tokens.measured(docs.select(id_col, "source", "lang", text_col), id_col, text_col, ("source", "lang"), vocab)
        self.sized = cut(sized.select(F.col(id_col).alias("doc"), "source", F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_tokens").alias("n")).filter("source IS NOT NULL AND n > 0"), "sized")
        use = self.sized.filter(F.col("source").isin(*self.targets)) if self.targets else self.sized.limit(0)
        rows = use.groupBy("source", "lang").agg(F.sum("n").alias("n")).limit(MOST_LEAVES + 1).collect()
        if len(rows) > MOST_LEAVES:
            raise ValueError(f"more than {MOST_LEAVES} leaves")
        have = [(r.source, r.lang, float(r.n)) for r in rows]
        self.root = tree(have, self.targets, mark)
        self.budget = feasible(self.root) if budget is None else min(float(budget), self.root.room)
        spread(self.root, self.budget)
        size = {(s, lang): int(n) for s, lang, n in have}
        quota = []
        for s, lang, node in _leaves(self.root):
            if (s, lang) in size:
                q, n, most = round(node.quota), size[s, lang], self.targets[s][1]
                whole = min(q // n, most)
                quota.append((s, lang, int(whole), int(q - whole * n) if whole < most else 0))
        self.quota = self.spark.createDataFrame(quota, "source string, lang string, epochs int, rest long")
        self.use, self.seed = use, seed

    def selection(self) -> DataFrame:
        """(id, source, lang, n_tokens, times): how often each chosen document is used, from 1 to max_repeats."""
        at = F.xxhash64(F.lit(self.seed), F.col("epochs") + 1, "doc")
        rows = self.use.join(F.broadcast(self.quota), ["source", "lang"]).withColumn("at", at).withColumn("bucket", F.shiftrightunsigned("at", 64 - BUCKET_BITS))
        leaf = Window.partitionBy("source", "lang")
        sums = rows.filter("rest > 0").groupBy("source", "lang", "rest", "bucket").agg(F.sum("n").alias("n"))
        upto = sums.withColumn("before", F.sum("n").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
        ends = upto.filter("before <= rest AND rest < before + n").select("source", "lang", F.col("bucket").alias("last"), "before")
        placed = rows.join(F.broadcast(ends), ["source", "lang"], "left")
        sure = placed.withColumn("times", F.expr("epochs + CASE WHEN rest > 0 AND bucket < last THEN 1 ELSE 0 END"))
        w = leaf.orderBy("at", "doc").rowsBetween(Window.unboundedPreceding, -1)
        edge = sure.filter("rest > 0 AND bucket = last").withColumn("upto", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        edge = edge.withColumn("times", F.expr("epochs + CASE WHEN 2 * upto + n <= 2 * rest THEN 1 ELSE 0 END"))
        cols = [F.col("doc").alias(self.id_col), "source", "lang", F.col("n").alias("n_tokens"), F.col("times").cast("int").alias("times")]
        rest = sure.filter("NOT (rest > 0 AND bucket <=> last)").select(*cols)
        return rest.unionByName(edge.select(*cols)).filter("times > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, planned_share, actual_share, tokens, documents, most_times): one row for each target and
        each source of the documents, what it was to give and what it really gives."""
        planned: dict[str, float] = {}
        for s, _, node in _leaves(self.root):
            planned[s] = planned.get(s, 0.0) + node.quota
        want = self.spark.createDataFrame([(s, w, planned.get(s, 0.0) / max(self.budget, 1e-9)) for s, (w, _) in self.targets.items()], "source string, target_share double, planned_share double")
        got = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_times"))
        total = got.agg(F.sum("tokens")).scalar()
        every = self.sized.select("source").distinct().join(want, "source", "full").join(got, "source", "left")
        n = F.coalesce("tokens", F.lit(0))
        return every.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.round(F.coalesce("planned_share", F.lit(0.0)), 6).alias("planned_share"), F.round(F.coalesce(n / F.nullif(total, F.lit(0)), F.lit(0.0)), 6).alias("actual_share"), n.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_times", F.lit(0)).alias("most_times"))
