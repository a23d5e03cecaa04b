"""Models on profiles with MLlib: two-stage clustering, cluster samplers with a classifier, PCA, real-versus-made tests."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.operators.blocks import similar_sums
from loadscape.operators.graph import cut
from loadscape.operators.matching import k_medoids
from loadscape.operators.samplers import spread_join
from loadscape.operators.statistics import roc_auc


def pre_clustering(df: DataFrame, key: str, vals: str, many: int, few: int, seed: int = 1) -> DataFrame:
    """(key, cluster): k-means into ``many``, then k-medoids of the ``many`` centres into ``few``; labels are handed down."""
    v = df.withColumn("_v", array_to_vector(vals))
    model = KMeans(k=many, seed=seed, featuresCol="_v", predictionCol="_c").fit(v)
    centres = df.sparkSession.createDataFrame([(0, i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "g int, _c int, v array<double>")
    named = k_medoids(centres, "g", "_c", "v", few).select("_c", F.col("medoid").alias("cluster"))
    return model.transform(v).select(key, "_c").join(F.broadcast(named), "_c").select(key, "cluster")


def classified_sampler(train: DataFrame, queries: DataFrame, key: str, vals: str, info: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """(test, pick, p): training profiles are clustered; a forest predicts a query's cluster from its attributes; the
    predicted probability of a cluster is shared by its members."""
    v = train.withColumn("_v", array_to_vector(vals))
    clusters = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(v).transform(v)
    features = array_to_vector(F.array(*[F.col(c).cast("double") for c in info]))
    forest = RandomForestClassifier(labelCol="_c", featuresCol="_x", seed=seed, numTrees=20).fit(clusters.withColumn("_x", features))
    found = forest.transform(queries.withColumn("_x", features)).select(F.col(key).alias("test"), F.posexplode(vector_to_array("probability")).alias("_c", "p")).where("p > 0")
    sizes = clusters.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    return spread_join(found.join(F.broadcast(sizes), "_c"), clusters.select("_c", F.col(key).alias("pick")), ["_c"]).select("test", "pick", (F.col("p") / F.col("_n")).alias("p"))


def pca(df: DataFrame, vals: str, k: int) -> DataFrame:
    """Adds ``components``: the first k principal components."""
    v = df.withColumn("_v", array_to_vector(vals))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("components", vector_to_array("_p")).drop("_v", "_p")


def real_or_made(real: DataFrame, made: DataFrame, vals: str) -> DataFrame:
    """One row: how well a logistic regression tells made from real profiles (0.5: not at all), on a third held out."""
    both = real.select(vals, F.lit(1.0).alias("y")).union(made.select(vals, F.lit(0.0).alias("y")))
    both = both.withColumn("_v", array_to_vector(vals)).withColumn("_h", F.pmod(F.xxhash64(vals), F.lit(3)))
    model = LogisticRegression(featuresCol="_v", labelCol="y", maxIter=20, regParam=0.01).fit(both.where("_h > 0"))
    scored = model.transform(both.where("_h = 0")).select(vector_to_array("probability")[1].alias("s"), F.col("y").cast("int").alias("y"))
    return roc_auc(scored, "s", "y")


def validated_tree(train: DataFrame, held: DataFrame, info: Sequence[str], label: str, depths: Sequence[int], seed: int = 1):
    """The decision tree whose depth has the least log loss on held-out rows; (model, loss)."""
    features = array_to_vector(F.array(*[F.col(c).cast("double") for c in info]))
    train, held = train.withColumn("_x", features).cache(), held.withColumn("_x", features).cache()
    best = None
    for depth in depths:
        model = DecisionTreeClassifier(labelCol=label, featuresCol="_x", maxDepth=depth, seed=seed).fit(train)
        p = F.get(vector_to_array("probability"), F.col(label).cast("int"))
        loss = model.transform(held).agg(F.avg(-F.ln(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-12))))).first()[0]
        if best is None or loss < best[1]:
            best = model, loss
    train.unpersist()
    held.unpersist()
    return best


@dataclass
class Node:
    """A node of a tree: class counts of the training rows in it, its leaf numbers, and its children if it has any."""

    counts: np.ndarray
    leaves: list[int]
    children: tuple[Node, Node] | tuple[()] = ()

    def risk(self, total: float) -> float:
        """Gini impurity times the share of all rows."""
        n = self.counts.sum()
        return float((1 - ((self.counts / n) ** 2).sum()) * n / total) if n else 0.0


def ends(root: Node, cut: frozenset[int]) -> list[Node]:
    """The leaves of the tree once the nodes in ``cut`` (by id) have lost what is below them."""
    if not root.children or id(root) in cut:
        return [root]
    return [e for child in root.children for e in ends(child, cut)]


def pruning_sequence(root: Node) -> list[tuple[float, frozenset[int]]]:
    """(alpha, nodes that are cut) of the subtrees that are best at some price alpha of a leaf, the whole tree first.

    Each step cuts the nodes below which a leaf saves least; those that save equally go together.
    """
    total = float(root.counts.sum()) or 1.0
    found, cut, alpha = [(0.0, frozenset())], frozenset(), 0.0

    def links(node: Node) -> Iterator[tuple[float, Node]]:
        if node.children and id(node) not in cut:
            below = ends(node, cut)
            yield (node.risk(total) - sum(e.risk(total) for e in below)) / (len(below) - 1), node
            for child in node.children:
                yield from links(child)

    while weakest := [*links(root)]:
        least = min(g for g, _ in weakest)
        alpha = max(alpha, least)
        cut = cut | {id(node) for g, node in weakest if g <= least + 1e-12}
        if found and alpha <= found[-1][0] + 1e-12:
            found[-1] = alpha, cut
        else:
            found.append((alpha, cut))
    return found


def pruned_tree(train: DataFrame, held: DataFrame, info: Sequence[str], label: str, depth: int = 8, seed: int = 1):
    """(model, root, steps, best): a tree grown to ``depth`` and pruned at the price of a leaf that does best on held-out rows.

    steps are (alpha, leaves, log loss, nodes cut) of the weakest-link sequence, best the place of the least loss (of equal
    ones the smaller tree). Rows are counted by leaf and label once, for training and held-out rows; what comes to the
    driver is one number for each of these, and every subtree is judged from them. Labels are 0, 1, ...; null labels are
    left out.
    """
    features = array_to_vector(F.array(*[F.col(c).cast("double") for c in info]))
    rows = [d.where(F.col(label).isNotNull()).withColumn("_x", features) for d in (train, held)]
    model = DecisionTreeClassifier(labelCol=label, featuresCol="_x", maxDepth=depth, seed=seed, minInfoGain=0.0).fit(rows[0]).setLeafCol("_leaf")
    counted = [{(int(a), int(b)): n for a, b, n in model.transform(d).groupBy("_leaf", label).count().collect()} for d in rows]
    classes = 1 + max((b for c in counted for _, b in c), default=0)
    numbers = itertools.count()

    def read(node) -> Node:
        if node.subtreeDepth() == 0:
            leaf = next(numbers)
            return Node(np.array([counted[0].get((leaf, c), 0) for c in range(classes)], float), [leaf])
        a, b = read(node.leftChild()), read(node.rightChild())
        return Node(a.counts + b.counts, a.leaves + b.leaves, (a, b))

    root = read(model._java_obj.rootNode())
    size = max(1, sum(counted[1].values()))

    def loss(cut: frozenset[int]) -> float:
        total = 0.0
        for end in ends(root, cut):
            p = np.maximum(end.counts / max(1.0, end.counts.sum()), 1e-12)
            total -= sum(counted[1].get((leaf, c), 0) * np.log(p[c]) for leaf in end.leaves for c in range(classes))
        return float(total / size)

    steps = [(alpha, len(ends(root, cut)), loss(cut), cut) for alpha, cut in pruning_sequence(root)]
    best = min(range(len(steps)), key=lambda i: (steps[i][2], -i))
    return model, root, steps, best


def power_iteration(pairs: DataFrame, k: int, scale: float) -> DataFrame:
    """(id, cluster): power iteration clustering of distances (i, j, d), as similarities exp(-d / scale)."""
    edges = pairs.select(F.col("i").cast("long").alias("src"), F.col("j").cast("long").alias("dst"), F.exp(-F.col("d") / scale).alias("weight"))
    return PowerIterationClustering(k=k, maxIter=20, weightCol="weight").assignClusters(edges)


def power_iteration_within(df: DataFrame, group: str, key: str, vals: str, k: int, scale: float, rounds: int = 20) -> DataFrame:
    """(id, cluster): as ``power_iteration`` of all pairs of a group, without a row for any pair.

    Each round multiplies the values with the similarities, which are measured again where two blocks of rows meet, and
    divides by a row's own sum of them; rounds end once the change of values hardly changes, as MLlib's do. Starts are decided
    by the key, so reruns agree. Rows without a neighbour are in no cluster, as without a pair.
    """
    rows = df.select(F.col(group).alias("_group"), F.col(key).cast("long").alias("id"), F.col(vals).alias("_vals")).where("_group is not null and id is not null")
    start = F.pmod(F.xxhash64(F.lit("power"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1
    now, last, count = rows.select("id", start.alias("_x")), None, 1
    norm = now.agg(F.sum(F.abs("_x"))).first()[0]
    if not norm:
        return rows.select("id", F.lit(None).cast("int").alias("cluster")).limit(0)
    now = now.withColumn("_x", F.col("_x") / norm)
    for _ in range(rounds):
        met = similar_sums(rows.join(now, "id"), "_group", "id", "_vals", "_x", scale).where("degree > 0")
        after = cut(met.join(now, "id").select("id", (F.col("total") / F.col("degree")).alias("_raw"), "_x"))
        count, norm = after.agg(F.count(F.lit(1)), F.sum(F.abs("_raw"))).first()
        if not norm:
            break
        after = after.select("id", (F.col("_raw") / norm).alias("_now"), "_x")
        moved = after.agg(F.sum(F.abs(F.col("_now") - F.col("_x")))).first()[0]
        now = after.select("id", F.col("_now").alias("_x"))
        if last is not None and abs(moved - last) <= max(1e-5 / count, 1e-8):
            break
        last = moved
    # values add up to one: by their number, so that what k-means takes for no move does not hang on how many there are
    v = now.withColumn("_v", array_to_vector(F.array(F.col("_x") * count)))
    return KMeans(k=k, seed=0, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).select("id", "cluster")
