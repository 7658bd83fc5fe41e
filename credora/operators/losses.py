"""Losses and score blending as single aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credora.functions.ieee import sigmoid


def _prob(score: str, from_logits: bool, eps: float):
    p = sigmoid(F.col(score)) if from_logits else F.col(score).cast("double")
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def weighted_bce(df: DataFrame, label: str = "loan_status", score: str = "score",
                 pos_weight: float = 6.04, eps: float = 1e-8, from_logits: bool = False
                 ) -> DataFrame:
    """mean(-(y * w * ln p + (1 - y) * ln(1 - p))), p clipped to [eps, 1 - eps].

    ``from_logits=True`` applies the sigmoid first; feeding probabilities with
    ``from_logits=True`` reproduces the reference's double sigmoid (Q8)."""
    p, y = _prob(score, from_logits, eps), F.col(label).cast("double")
    loss = -(y * F.log(p) * pos_weight + (1 - y) * F.log(1 - p))
    return df.agg(F.avg(loss).alias("loss"))


def focal_loss(df: DataFrame, label: str = "loan_status", score: str = "score",
               alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-8,
               from_logits: bool = False) -> DataFrame:
    """mean(-a * (1 - q)^gamma * ln q), q the probability given to the row's own class and a
    its class weight (alpha for class 1, 1 - alpha for class 0)."""
    positive = F.col(label) == 1
    prob = _prob(score, from_logits, eps)
    rows = df.select(F.when(positive, prob).otherwise(1 - prob).alias("q"),
                     F.when(positive, alpha).otherwise(1 - alpha).alias("a"))
    return rows.agg(F.avg(-F.col("a") * F.pow(1 - F.col("q"), gamma) * F.ln("q")).alias("loss"))


def soft_vote(df: DataFrame, score_cols: list[str], name: str = "score_mean") -> DataFrame:
    return df.withColumn(name, sum(F.col(c) for c in score_cols) / len(score_cols))
