"""Corpus mix, folder advice and model planning as relational arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The corpus mix, the model ladder, throughputs by device name in order of search, micro-batches.
MIX = (("fineweb-edu", 0.55, "prose"), ("starcoder", 0.25, "code"), ("wikipedia", 0.08, "prose"), ("stackexchange", 0.07, "prose"), ("openwebmath", 0.05, "prose"))
TOKEN_BUDGET = 7_000_000_000
LADDER = (
    ("nano", 6, 256, 4, 2, 704, 512),
    ("micro", 8, 384, 6, 2, 1024, 512),
    ("mini", 10, 512, 8, 2, 1408, 1024),
    ("small", 12, 768, 12, 4, 2048, 1024),
    ("base", 26, 1024, 16, 4, 2816, 2048),
    ("large", 24, 1536, 16, 4, 4096, 2048),
    ("xl", 24, 2048, 16, 8, 5632, 2048),
)
PEAK_BF16 = (("5090", 209.0), ("4090", 165.2), ("4080", 97.5), ("4070", 58.0), ("4060", 30.0), ("3090", 71.0), ("3080", 59.5), ("3070", 40.6), ("3060", 25.6), ("A100", 312.0), ("H100", 989.0), ("H200", 989.0), ("L40", 181.0), ("A6000", 155.0), ("V100", 125.0), ("T4", 65.0))
FALLBACK_PEAK = (("cuda", 30.0), ("mps", 7.0), ("cpu", 0.4))
MICRO_BATCHES = (64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1)
BYTES_PER_PARAM, SAFETY_MARGIN, TOKENS_PER_PARAM, STEP_TOKENS, MAX_HOURS, CHARS_PER_TOKEN = 16, 0.80, 21, 524_288, 72.0, 3.8


def mix_targets(spark: SparkSession, mix=MIX, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Tokens of each source; shares must sum to one."""
    if abs(sum(m[1] for m in mix) - 1.0) > 1e-9:
        raise ValueError("the shares do not sum to one")
    rows = spark.createDataFrame(list(mix), "source string, share double, kind string")
    return rows.withColumn("target_tokens", F.floor(F.col("share") * budget))


def resolve(name: str, names) -> str:
    if name not in names:
        raise KeyError(f"unknown name {name!r}; known: {', '.join(names)}")
    return name


def assess(rows: DataFrame, characters: str = "characters", params: str = "params") -> DataFrame:
    """How far a corpus goes for a model: estimated and wanted tokens, share, verdict."""
    tokens = F.floor(F.col(characters) / CHARS_PER_TOKEN)
    wanted = F.col(params) * TOKENS_PER_PARAM
    share = F.when(wanted > 0, tokens / wanted).otherwise(0.0)
    verdict = F.when(share >= 1.0, "enough").when(share >= 0.10, "blend").when(tokens >= 100_000, "fine_tune").otherwise("too_small")
    return rows.withColumns({"estimated_tokens": tokens, "tokens_wanted": wanted, "share_of_budget": F.round(share, 4), "verdict": verdict})


def n_params(vocab: Column, layers: Column, wide: Column, heads: Column, kv_heads: Column, hidden: Column, tied: bool = True) -> Column:
    head = F.floor(wide / heads)
    layer = wide * wide * 2 + wide * kv_heads * head * 2 + wide * hidden * 3 + wide * 2
    return vocab * wide * (1 if tied else 2) + layers * layer + wide


def ladder(spark: SparkSession, vocab_size: int = 32_768) -> DataFrame:
    """The rungs with their parameters."""
    names = "preset string, n_layers long, d_model long, n_heads long, n_kv_heads long, ffn_hidden long, context_len long, rung int"
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(LADDER)], names)
    c = F.col
    return rows.withColumns({"vocab_size": F.lit(vocab_size).cast("long")}).withColumn("params", n_params(c("vocab_size"), c("n_layers"), c("d_model"), c("n_heads"), c("n_kv_heads"), c("ffn_hidden")))


def memory_gb(params: Column, micro: Column, context: Column, vocab: Column, wide: Column, layers: Column, bf16: Column) -> Column:
    tokens = micro * context
    logits = tokens * vocab * F.when(bf16, 6).otherwise(8)
    activations = tokens * wide * layers * F.when(bf16, 2).otherwise(4) * 2.5
    return (params * BYTES_PER_PARAM + logits + activations) / float(1 << 30)


def peak_for(devices: DataFrame, name: str = "name", kind: str = "kind", peak: str = "peak_tflops") -> DataFrame:
    """``devices`` with peak (of the first table entry that the name holds, if unknown) and effective_peak."""
    found = F.lit(None).cast("double")
    for key, value in reversed(PEAK_BF16):
        found = F.when(F.contains(F.lower(name), F.lit(key.lower())), value).otherwise(found)
    assumed = F.lit(1.0)
    for key, value in FALLBACK_PEAK:
        assumed = F.when(F.col(kind) == key, value).otherwise(assumed)
    known = F.coalesce(F.col(peak), found)
    return devices.withColumns({"peak": known, "effective_peak": F.coalesce(known, assumed)})


def hours_to_train(params: Column, tokens: Column, peak: Column, mfu: float) -> Column:
    return params.cast("double") * 6 * tokens / (peak * 1e12 * mfu) / 3600


def recommend(devices: DataFrame, max_hours: float = MAX_HOURS, mfu: float = 0.35, vocab_size: int = 32_768, preset: str | None = None, context_len: int = 0) -> DataFrame:
    """The largest rung that fits each device's memory and the hours, else the smallest; with batch and schedule.

    Another ``context_len`` than the rung's (0: the rung's) keeps rung, micro-batch and steps; the accumulation is derived
    again, so that a step is a whole number of micro-batches, and the memory with it.

    Devices times seven rungs times twelve micro-batches, all of which are fixed small lists exploded in place.
    """
    c = F.col
    rungs = ladder(devices.sparkSession, vocab_size)
    if preset:
        rungs = rungs.filter(c("preset") == resolve(preset, [r[0] for r in LADDER]))
    rows = peak_for(devices).join(F.broadcast(rungs.withColumn("_one", F.lit(1))), F.lit(1) == c("_one")).drop("_one")
    need = lambda mb: memory_gb(c("params"), mb, c("context_len"), c("vocab_size"), c("d_model"), c("n_layers"), c("supports_bf16"))
    usable = c("memory_gb") * SAFETY_MARGIN
    fitting = F.filter(F.array(*map(F.lit, MICRO_BATCHES)), lambda mb: need(mb) <= usable)
    rows = rows.withColumn("fits", F.coalesce(F.try_element_at(fitting, F.lit(1)), F.lit(0)))
    hours = hours_to_train(c("params"), c("params") * TOKENS_PER_PARAM, c("effective_peak"), mfu)
    good = (c("fits") > 0) & (F.lit(preset is not None) | (hours <= max_hours))
    rows = rows.withColumn("good", good)
    order = Window.partitionBy("device_id").orderBy(F.desc("good"), F.when(c("good"), -c("rung")).otherwise(c("rung")))
    best = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    best = best.withColumn("micro_batch", F.greatest(c("fits"), F.lit(1)))
    each = c("micro_batch") * c("context_len")
    best = best.withColumn("grad_accum", F.greatest(F.lit(1), F.bround(F.lit(STEP_TOKENS) / each).cast("long")))
    best = best.withColumn("tokens_per_step", each * c("grad_accum"))
    best = best.withColumn("total_steps", F.greatest(F.lit(100), F.floor(c("params") * TOKENS_PER_PARAM / c("tokens_per_step"))))
    tokens = c("total_steps") * c("tokens_per_step")
    best = best.withColumn("hours", hours_to_train(c("params"), tokens, c("effective_peak"), mfu))
    if preset:
        cut = F.when(c("hours") > max_hours, F.greatest(F.lit(100), F.floor(c("total_steps") * max_hours / c("hours")))).otherwise(c("total_steps"))
        best = best.withColumn("total_steps", cut).withColumn("hours", hours_to_train(c("params"), tokens, c("effective_peak"), mfu))
    best = best.withColumn("warmup_steps", F.greatest(F.lit(10), F.least(F.lit(500), F.floor(c("total_steps") / 25))))
    if context_len:
        micro = c("micro_batch") * F.lit(context_len)
        again = F.greatest(F.lit(1), F.bround(c("tokens_per_step") / micro).cast("long"))
        best = best.withColumns({"grad_accum": again, "tokens_per_step": micro * again, "context_len": F.lit(context_len).cast("long")})
    warning = F.when(~c("good"), F.when(c("fits") == 0, "out_of_memory").otherwise("too_slow"))
    keep = ["device_id", "preset", "params", "context_len", "micro_batch", "grad_accum", "tokens_per_step", "total_steps", "warmup_steps"]
    return best.select(*keep, F.round("hours", 3).alias("hours"), F.round(need(c("micro_batch")), 3).alias("memory_gb"), warning.alias("warning"))
