"""A decision tree that can be checked: exact Gini splits of whole-number columns, and the tree as a SQL expression.

The library's learners bin their columns and hand back an object. This one tries every value of every column as a
cut and gives a tree that is a text, so that SQL can both find the same splits and apply them. Level by level: the
rows are counted by (node, column, value), combined before the shuffle; running totals along the values give both sides of each cut;
the best cut of each node goes to the driver (at most 2 ** depth of them). A missing value counts as below all cuts. Columns drawn per tree may
be given as a share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import draw
from riskloom.model.estimators import LABEL
from riskloom.operators.ordered import running_total


@dataclass
class Node:
    rows: int
    risky: int
    column: str | None = None
    cut: int | None = None
    below: Node | None = field(default=None, repr=False)
    above: Node | None = field(default=None, repr=False)

    def sql(self, leaf) -> str:
        """CASE expression; `leaf` gives the text of a leaf."""
        if self.column is None:
            return leaf(self)
        return f"CASE WHEN `{self.column}` > {self.cut} THEN {self.above.sql(leaf)} ELSE {self.below.sql(leaf)} END"


def probability_sql(tree: Node) -> str:
    """Share of risk rows in the leaf that a row falls in."""
    return tree.sql(lambda leaf: f"{leaf.risky}D / {leaf.rows}D")


def drawn_columns(df: DataFrame, columns: list[str], share: float, seed: int) -> list[str]:
    """The columns a tree may use: this share of them, at least one, by a draw of their names."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    order = names.orderBy(draw("name", seed), "name").limit(max(1, round(share * len(columns)))).collect()
    return [c for c in columns if c in {r["name"] for r in order}]


def best_splits(rows: DataFrame, columns: list[str], label: str = LABEL, node: str = "node") -> DataFrame:
    """Per node: rows, risky, column, cut, and the rows and risky below the cut; no column where none parts the rows.

    The best cut has the largest (sum over both sides of (risky ** 2 + normal ** 2) / rows); among equals the first
    column by name, then the lowest value.
    """
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("value")) for c in columns])).alias("at")
    long = rows.select(node, F.col(label).cast("long").alias("risky"), value).select(node, "risky", "at.*")
    counts = long.groupBy(node, "column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("risky").alias("k"))
    totals = rows.groupBy(node).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("risky"))
    below = running_total(counts, [node, "column"], ["value"], {"rows_below": "n", "risky_below": "k"})

    def purity(n, k):
        return (k * k + (n - k) * (n - k)) / n

    cuts = below.join(totals, node).where("value is not null and rows_below < rows")
    left = purity(F.col("rows_below").cast("double"), F.col("risky_below"))
    score = left + purity((F.col("rows") - F.col("rows_below")).cast("double"), F.col("risky") - F.col("risky_below"))
    place = F.struct(-score, F.col("column"), F.col("value"))
    best = cuts.groupBy(node).agg(F.min_by(F.struct("column", F.col("value").alias("cut"), "rows_below", "risky_below"), place).alias("best"))
    return totals.join(best, node, "left").select(node, "rows", "risky", "best.*")


def grow(table: DataFrame, columns: list[str], depth: int, label: str = LABEL) -> Node:
    """The tree of at most `depth` cuts on a path; pure nodes and such that no column parts are leaves.

    `table` is read once per level: pass a stored one.
    """
    whole = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    root = Node(*whole)
    open_nodes = {1: root} if root.rows else {}
    for _ in range(depth):
        if not open_nodes:
            break
        number = root.sql(lambda leaf: str(next((n for n, at in open_nodes.items() if at is leaf), 0)))
        rows = table.withColumn("node", F.expr(number).cast("long")).where("node > 0")
        found = {r["node"]: r for r in best_splits(rows, columns, label).collect()}
        following = {}
        for number, at in open_nodes.items():
            split = found[number]
            if split["column"] is None or at.risky in (0, at.rows):
                continue
            at.column, at.cut = split["column"], split["cut"]
            at.below = Node(split["rows_below"], split["risky_below"])
            at.above = Node(at.rows - at.below.rows, at.risky - at.below.risky)
            following |= {2 * number: at.below, 2 * number + 1: at.above}
        open_nodes = following
    return root


def predict_probability(tree: Node, df: DataFrame, key: str = "rowkey") -> DataFrame:
    """Key and probability of the risk class."""
    return df.select(key, F.expr(probability_sql(tree)).alias("probability"))
