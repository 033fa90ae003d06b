"""Learning from up and down ratings."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import vocabulary as V
from lodestack.functions.text import cosine
from lodestack.sources.store import TableStore
from lodestack.storage import settled


def label_gate(feedback: DataFrame) -> DataFrame:
    """One row: n_up, n_down, n_labels, ready. Other labels don't count."""
    counts = feedback.agg(F.count_if(F.col("label") == "up").alias("n_up"), F.count_if(F.col("label") == "down").alias("n_down"))
    total = F.col("n_up") + F.col("n_down")
    ready = (total >= V.LABELS_NEEDED) & (F.col("n_up") >= V.LABELS_OF_EACH) & (F.col("n_down") >= V.LABELS_OF_EACH)
    return counts.select("n_up", "n_down", total.alias("n_labels"), ready.alias("ready"))


#: Most ratings that a model is fitted on, and most postings scored in one request; the newest count.
EXAMPLES_MOST = TARGETS_MOST = 2_000
MODEL = "labels bigint, fitted_on bigint, n_up bigint, n_down bigint, intercept double, weights array<double>"


def fit(examples: DataFrame) -> DataFrame | None:
    """One row of MODEL: an L2-regularised logistic regression on ``examples`` (vec, label and, if there are many, posting_id), or None if the labels aren't enough.

    ``labels`` is a digest of the ratings it was fitted on.
    """
    if "posting_id" in examples.columns:
        examples = examples.where(F.col("label").isin("up", "down")).orderBy(F.desc("posting_id")).limit(EXAMPLES_MOST)
    rows = settled(examples.where(F.col("label").isin("up", "down") & F.col("vec").isNotNull()).select("vec", "label"))
    gate = label_gate(rows).first()
    if not gate["ready"]:
        return None
    features = rows.select(array_to_vector("vec").alias("features"), F.when(F.col("label") == "up", 1.0).otherwise(0.0).alias("label"))
    model = LogisticRegression(regParam=1.0 / gate["n_labels"], elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9).fit(features)
    made = (digest_of(rows), gate["n_labels"], gate["n_up"], gate["n_down"], float(model.intercept), [float(x) for x in model.coefficients])
    return rows.sparkSession.createDataFrame([made], MODEL)


def digest_of(examples: DataFrame) -> int:
    """A number that tells one set of ratings from another, whatever their order."""
    return examples.where(F.col("label").isin("up", "down") & F.col("vec").isNotNull()).agg(F.coalesce(F.bit_xor(F.xxhash64("vec", "label")), F.lit(0)) + F.count("*")).first()[0]


def apply_model(model: DataFrame, targets: DataFrame) -> DataFrame:
    """posting_id, probability (0 to 100), n_up and n_down of ``targets`` (posting_id, vec), by expressions over the stored weights."""
    rows = targets.where("vec is not null").select("posting_id", "vec").crossJoin(F.broadcast(model.select("intercept", "weights", "n_up", "n_down")))  # one row
    score = 1 / (1 + F.exp(-(F.col("intercept") + cosine(F.col("vec"), F.col("weights")))))
    return rows.select("posting_id", F.bround(score * 100).cast("int").alias("probability"), "n_up", "n_down")


def learned_match(examples: DataFrame, targets: DataFrame) -> DataFrame | None:
    """:func:`apply_model` of a model fitted on ``examples``, or None if their labels aren't enough."""
    model = fit(examples)
    return None if model is None else apply_model(model, targets)


def stored_model(store: TableStore, examples: DataFrame) -> DataFrame | None:
    """The model of these ratings, from the table ``learned_model`` as long as they are the same; else fitted anew and stored."""
    change = store.change()
    rows = settled(examples)
    if change.exists("learned_model"):
        held = change.read("learned_model", MODEL)
        newest = rows.where(F.col("label").isin("up", "down")).orderBy(F.desc("posting_id")).limit(EXAMPLES_MOST) if "posting_id" in rows.columns else rows
        if held.first()["labels"] == digest_of(newest):
            return held
    model = fit(rows)
    if model is not None:
        change.write("learned_model", settled(model)).commit()
    return model


def training_set(feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """posting_id, vec and label of the rated postings that have a vector (``feedback``: posting_id, label)."""
    return feedback.where(F.col("label").isin("up", "down")).join(vectors.select("posting_id", "vec"), "posting_id").select("posting_id", "vec", "label")
