"""Quality scores by a sparse rule ensemble that ends as one Spark column expression.

1. Statistics of every whole text, by Spark's own functions in one pass: lengths, shares of capitals, digits and marks, share of
   distinct words and lines, words that repeat the one before.
2. Shallow trees over the statistics of the labelled rows; every path from a root is a rule, a conjunction of bounds.
3. A lasso-penalised logistic regression over the rules keeps few of them.
4. The rules left, with their weights, are compiled into one column: score = 1 / (1 + exp(-(bias + sum of weights that hold))).

Trees and regression are Spark's own and train on all labelled rows given. A row is labelled by the largest of its labels, should
it have several; null labels are none. Labels, lang, source and doc_id are no inputs. Null and empty texts have the statistics of
a text without words and are scored like any other. If the labels have one class only, or there are none, the score is their
share (0.5 without any). Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm import tables

TREES, DEPTH, LEAF, SEED = 12, 4, 20, 17
PENALTY = 0.0005


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one double column for each statistic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\s]+"), lambda word: word != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    without = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    cut = docs.select(F.col("doc_id").cast("long"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    chars, n_words, n_lines = F.length("text"), F.size("words"), F.size("lines")
    repeats = F.size(F.filter(F.arrays_zip(F.slice("words", 1, F.greatest(n_words - 1, F.lit(0))).alias("a"), F.slice("words", 2, F.greatest(n_words - 1, F.lit(0))).alias("b")), lambda pair: pair["a"] == pair["b"]))
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return cut.select(
        "doc_id",
        F.log1p(n_words.cast("double")).alias("words"),
        share(chars, n_words).alias("chars_per_word"),
        share(n_words, n_lines).alias("words_per_line"),
        share(F.size(F.array_distinct("words")), n_words).alias("distinct_words"),
        share(F.size(F.array_distinct("lines")), n_lines).alias("distinct_lines"),
        share(repeats, n_words).alias("repeated_words"),
        share(chars - without(r"\p{Lu}+"), chars).alias("capitals"),
        share(chars - without(r"[0-9]+"), chars).alias("digits"),
        share(chars - without(r"[^\p{L}\p{N}\s]+"), chars).alias("marks"),
        share(chars - without(r"[^\p{L}\p{N}\s.,;:'\"?()-]+"), chars).alias("odd_marks"),
    )


Rule = tuple[tuple[str, bool, float], ...]


def _paths(node, names: list[str], so_far: Rule = ()) -> set[Rule]:
    """Rules on the way to every node below the root. A bound is (statistic, whether at most, threshold)."""
    if node.numDescendants() == 0:
        return {so_far} if so_far else set()
    split = node.split()
    name, limit = names[split.featureIndex()], split.threshold()
    found = {so_far} if so_far else set()
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        found |= _paths(child, names, (*[b for b in so_far if b[:2] != (name, low)], (name, low, limit)))
    return found


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(name) <= limit if low else F.col(name) > limit for name, low, limit in rule])


def fit(labelled: DataFrame) -> Column:
    """The score as an expression over the statistics. `labelled` has the statistics and a column label (0 or 1)."""
    names = [name for name in labelled.columns if name not in ("doc_id", "label")]
    count, positive = labelled.agg(F.count("*"), F.sum("label")).first()
    if not count or positive in (0, count):
        return F.lit(positive / count if count else 0.5).cast("double")
    rows = labelled.select(F.col("label").cast("double"), *names, array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, maxBins=64, seed=SEED).fit(rows)
    rules = sorted(set().union(*[_paths(tree._call_java("rootNode"), names) for tree in forest.trees]))
    if not rules:
        return F.lit(positive / count).cast("double")
    held = rows.select("label", array_to_vector(F.array(*[_holds(rule).cast("double") for rule in rules])).alias("features"))
    model = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=100).fit(held)
    kept = [(rule, weight) for rule, weight in zip(rules, model.coefficients.toArray().tolist(), strict=True) if weight]
    total = reduce(lambda a, b: a + b, [F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in kept], F.lit(float(model.intercept)))
    return 1 / (1 + F.exp(-total))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; rows with crc32(doc_id) mod 4 = 2 are held out of the fit."""
    stats = tables.stored(statistics(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    marked = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    labelled = tables.stored(stats.where(~held_out).join(marked, "doc_id"))
    scored = stats.select("doc_id", held_out.alias("held_out"), fit(labelled).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
