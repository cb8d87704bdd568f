"""Passes after linking: confidence by path, unmatched HTTP, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from structgraph.functions import paths as P
from structgraph.registries import CATEGORY, KIND

TARGETS = 3


def downgrade(nodes: DataFrame) -> DataFrame:
    """Nodes on paths that aren't critical become weak; routes are exempt."""
    return nodes.withColumn("confidence", F.when(P.noncritical(F.col("qname")), F.lit(0)).otherwise(F.col("confidence")))


def demote_unmatched(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes and endpoints in no HTTP link are medium at best."""
    linked = edges.where(F.col("category") == CATEGORY["http_calls"]).select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    http = F.col("kind").isin(KIND["route"], KIND["endpoint"]) & F.col("linked").isNull() & (F.col("confidence") > 0)
    return nodes.join(linked, "id", "left").withColumn("confidence", F.when(http, F.lit(1)).otherwise(F.col("confidence"))).drop("linked")


def test_edges(nodes: DataFrame, targets: int = TARGETS) -> DataFrame:
    """From a test module to modules with its name without the affix: of those with the longest common
    package the first ``targets`` (by ord, then id).

    Modules stand under every package around them, and of each package and
    name only the first are kept; a test looks its own packages up.  So no
    test meets all modules of its name.
    """
    own = nodes.where(F.col("kind") == KIND["module"]).select("id", "qname", "ord", F.element_at(F.split("qname", "::"), -1).alias("tail"))
    tests = own.where(P.is_test(F.col("qname"))).withColumn("name", P.strip_test_affix(F.col("tail"))).where("name <> '' and name <> tail")
    around = F.expr("transform(sequence(0, size(parents)), n -> slice(parents, 1, n))")
    inside = lambda df, *columns: df.withColumn("parents", P.parents(F.col("qname"))).select(*columns, F.explode(around).alias("package"))
    a = inside(tests, F.col("id").alias("src"), F.col("name").alias("tail"))
    asked = own.join(tests.select(F.col("name").alias("tail")).distinct(), "tail", "left_semi")
    b = inside(asked, F.col("id").alias("dst"), F.col("ord").alias("o"), "tail")
    # one more, should the test be among them
    first = b.withColumn("k", F.row_number().over(W.partitionBy("tail", "package").orderBy("o", "dst"))).where(f"k <= {targets + 1}").drop("k")
    met = a.join(first, ["tail", "package"]).where("src <> dst").withColumn("shared", F.size("package"))
    best = met.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("shared"), "o", "dst"))).withColumn("most", F.max("shared").over(W.partitionBy("src")))
    return best.where(f"shared = most AND k <= {targets}").select("src", "dst", F.lit(CATEGORY["tests"]).alias("category"), F.lit(2).alias("confidence"))
