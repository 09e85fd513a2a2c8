"""Analytics over training logs and model outputs, as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def perplexity(losses: DataFrame, loss: str = "loss", tokens: str | None = None) -> DataFrame:
    """Unweighted mean of batch losses, its perplexity and bits a token, rounded; nulls without batches."""
    counted = F.coalesce(F.sum(tokens), F.lit(0)) if tokens else F.count(loss)
    out = losses.agg(F.avg(loss).alias("m"), counted.alias("tokens_scored"))
    return out.select(F.round("m", 4).alias("loss"), F.round(F.exp("m"), 2).alias("perplexity"), "tokens_scored", F.round(F.col("m") / math.log(2), 4).alias("bits_per_token"))


def loss_watchdog(losses: DataFrame, factor: float = 3.0, step: str = "step", loss: str = "loss", run: str = "run", history: int = 50) -> DataFrame:
    """Status of each step: non_finite, spike (above ``factor`` times the mean of up to ``history`` steps before) or ok."""
    before = Window.partitionBy(run).orderBy(step).rowsBetween(-history, -1)
    mean = F.avg(loss).over(before)
    finite = ~(F.isnan(loss) | (F.abs(F.col(loss)) == float("inf")))
    return losses.withColumn("baseline", mean).withColumn("status", F.when(~finite, "non_finite").when(F.col(loss) > F.col("baseline") * factor, "spike").otherwise("ok"))


def lr_at(step: Column, peak: float, low: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then cosine decay."""
    progress = (step - warmup) / max(1, total - warmup)
    decayed = low + (peak - low) * 0.5 * (1.0 + F.cos(progress * math.pi))
    return F.when(step < warmup, (step + 1) * peak / warmup).when(step >= total, low).otherwise(decayed)


def filter_top_k(logits: Column, k: int | None) -> Column:
    """Logits with those below the k-th largest set to null; ties at it survive."""
    if not k or k <= 0:
        return logits
    least = F.try_element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda x: F.when(x >= least, x))


def filter_top_p(rows: DataFrame, p: float, row: str = "row", token: str = "token", logit: str = "logit") -> DataFrame:
    """``rows`` (one a token) with kept: the smallest head whose probability reaches ``p``, the likeliest always."""
    every = Window.partitionBy(row)
    down = every.orderBy(F.desc(logit), token)
    weighed = rows.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(every)))
    chance = weighed.withColumn("_p", F.col("_e") / F.sum("_e").over(every))
    head = chance.withColumns({"_before": F.sum("_p").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_p"), "_rank": F.row_number().over(down)})
    return head.withColumn("kept", (F.col("_before") < p) | (F.col("_rank") == 1)).drop("_e", "_p", "_before", "_rank")


def repetition_penalty(rows: DataFrame, seen: DataFrame, penalty: float, row: str = "row", token: str = "token", logit: str = "logit") -> DataFrame:
    """Logits of seen tokens divided by the penalty, or multiplied if they are negative."""
    marked = rows.join(seen.select(row, token).distinct().withColumn("_seen", F.lit(True)), [row, token], "left")
    value = F.when(F.col("_seen") & (F.col(logit) > 0), F.col(logit) / penalty).when(F.col("_seen"), F.col(logit) * penalty).otherwise(F.col(logit))
    return marked.withColumn(logit, value).drop("_seen")


def choose(rows: DataFrame, temperature: float = 0.0, seed: int = 0, row: str = "row", token: str = "token", logit: str = "logit") -> DataFrame:
    """One token a row: the likeliest at temperature 0, else drawn by Gumbel noise hashed from the seed."""
    score = F.col(logit).cast("double")
    if temperature > 0:
        u = (F.pmod(F.xxhash64(F.lit(seed), row, token), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        score = score / temperature - F.log(-F.log(u))
    best = rows.withColumn("_score", score).groupBy(row).agg(F.max(F.struct(F.col("_score"), (-F.col(token)).alias("_t"))).alias("b"))
    return best.select(row, (-F.col("b._t")).alias(token))


def sequence_logprob(tokens: DataFrame, seq: str = "seq", label: str = "label", logprob: str = "logprob") -> DataFrame:
    """Sum over supervised positions."""
    return tokens.groupBy(seq).agg(F.sum(F.when(F.col(label) != -100, F.col(logprob)).otherwise(0.0)).alias("logprob"))


def dpo_metrics(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """Loss, accuracy, margin and rewards of policy_chosen, policy_rejected, ref_chosen, ref_rejected."""
    z = (F.col("policy_chosen") - F.col("policy_rejected")) - (F.col("ref_chosen") - F.col("ref_rejected"))
    soft = F.greatest(-z * beta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z * beta)))
    return pairs.agg(
        F.avg(soft).alias("loss"),
        F.avg((z > 0).cast("double")).alias("accuracy"),
        F.avg(z).alias("margin"),
        F.avg((F.col("policy_chosen") - F.col("ref_chosen")) * beta).alias("chosen_reward"),
        F.avg((F.col("policy_rejected") - F.col("ref_rejected")) * beta).alias("rejected_reward"),
    )
