"""The library's queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.session import modest_batches, shared_dir, stored, table
from ..operators import bpe, chat, dedupe, metrics, planner, post, quality, tokens
from ..sources import jsonl, sinks
from . import corpus

#: Queries whose results SQL cannot express; the tests named hold them against brute force.
NO_SQL = {"bpe_merges": "tests/test_bpe.py", "bpe_ids": "tests/test_bpe.py"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` as corpus rows: every fourth counts as code."""
    modest_batches(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "doc_id", "text", "source")
    return docs.withColumn("kind", F.when(F.col("doc_id") % 4 == 0, "code").otherwise("prose"))


@query
def normalise(spark, d):
    out = documents(spark, d).select("doc_id", t.normalise(F.col("text")).alias("text"))
    return out.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def word_stats(spark, d):
    return documents(spark, d).select("doc_id", t.bound(t.words(F.col("text")), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words"), F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"))).alias("s")).select("doc_id", "s.*")


@query
def line_stats(spark, d):
    return documents(spark, d).select("doc_id", t.bound(t.lines(F.col("text")), lambda x: F.struct(F.size(x).alias("lines"), F.array_max(F.transform(x, F.length)).alias("longest"), F.round(quality.repetition_ratio(x), 6).alias("repetition"))).alias("s")).select("doc_id", "s.*")


@query
def prose_reject(spark, d):
    return documents(spark, d).select("doc_id", quality.prose_reject_reason(F.col("text")).alias("reason"))


@query
def code_reject(spark, d):
    return documents(spark, d).select("doc_id", quality.code_reject_reason(F.col("text")).alias("reason"))


@query
def filter_report(spark, d):
    return quality.filter_report(quality.normalise_and_judge(documents(spark, d)))


@query
def exact_dedupe(spark, d):
    return dedupe.drop_exact_duplicates(documents(spark, d)).select("doc_id")


@query
def shingles(spark, d):
    h = documents(spark, d).select("doc_id", dedupe.shingle_hashes(F.col("text")).alias("h"))
    return h.select("doc_id", F.size("h").alias("n"), F.array_min("h").alias("least"), F.array_max("h").alias("most"), F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _shingled(spark, d):
    return documents(spark, d).select("ord", F.lit(0).cast("long").alias("window"), dedupe.shingle_hashes(F.col("text")).alias("hashes"))


@query
def minhash_signatures(spark, d):
    out = _shingled(spark, d).select("ord", dedupe.minhash(F.col("hashes")).alias("s"))
    return out.select(F.col("ord").alias("doc_id"), F.md5(F.array_join(F.col("s").cast("array<string>"), ",").cast("binary")).alias("digest"))


@query
def lsh_candidates(spark, d):
    signed = _shingled(spark, d).select("ord", "window", dedupe.minhash(F.col("hashes")).alias("sig"))
    return dedupe.lsh_candidates(signed)


@query
def near_dup_verified(spark, d):
    shingled = stored(_shingled(spark, d), "shingles")
    pairs = dedupe.lsh_candidates(shingled.select("ord", "window", dedupe.minhash(F.col("hashes")).alias("sig")))
    return dedupe.verify(pairs, shingled).filter("jaccard >= 0.8").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def near_dup_clusters(spark, d):
    docs = documents(spark, d).select("ord", "text", F.lit(0).cast("long").alias("window"))
    return dedupe.near_duplicates(docs).select(F.col("ord").alias("doc_id"), F.col("root").alias("cluster"))


@query
def windowed_near_dedupe(spark, d):
    return dedupe.windowed_near_dedupe(documents(spark, d), window=50_000).select("doc_id")


@query
def dedupe_stream(spark, d):
    return dedupe.dedupe_stream(documents(spark, d), num_perm=128, bands=16, check=False).select("doc_id")


@query
def corpus_survivors(spark, d):
    return corpus.survivors(corpus.build(documents(spark, d), window=None)).select("doc_id", "source", "chars")


@query
def corpus_manifest(spark, d):
    return corpus.manifest(corpus.build(documents(spark, d), window=None, complete=True), docs_per_shard=100)


@query
def corpus_per_source(spark, d):
    return corpus.counts_by(corpus.build(documents(spark, d), window=None), "source")


@query
def shuffle_order(spark, d):
    rows = documents(spark, d).select("doc_id", corpus.shuffle_key(F.col("doc_id"), 7).alias("key"))
    return dedupe.numbered(rows, ["key", "doc_id"]).select("doc_id", F.col("rn").cast("long").alias("place"))


@query
def limit_per_source(spark, d):
    """The raw limit counts rows before empty texts are dropped."""
    rows = chat.ranked(documents(spark, d).select("doc_id", "source", "text"), "source", "doc_id").filter("rank <= 20")
    return rows.filter(F.col("text") != "").select("doc_id", "source")


def conversations(spark, d):
    return chat.collect_messages(table(spark, d, "conversations")).withColumn("messages", chat.adapt_messages(F.col("messages")))


@query
def chat_messages(spark, d):
    ms = conversations(spark, d).filter(F.col("messages").isNotNull())
    return ms.select("conv_id", F.size("messages").alias("turns"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").cast("binary")).alias("digest"))


@query
def conversation_reject(spark, d):
    ms = conversations(spark, d)
    return ms.select("conv_id", F.when(F.col("messages").isNull(), "unadaptable").otherwise(chat.conversation_reject_reason(F.col("messages"))).alias("reason"))


@query
def chat_render(spark, d):
    ms = conversations(spark, d).filter(F.col("messages").isNotNull())
    out = ms.select("conv_id", chat.render(F.col("messages")).alias("r"))
    return out.select("conv_id", F.length("r").alias("chars"), F.md5(F.col("r").cast("binary")).alias("digest"))


@query
def prompt_keys(spark, d):
    ms = conversations(spark, d).filter(F.col("messages").isNotNull())
    return ms.select("conv_id", chat.prompt_key(chat.first_user(F.col("messages"))).alias("key"))


@query
def preference_reject(spark, d):
    """Pairs made from conversations: the first user turn, its first and its last assistant turn."""
    ms = conversations(spark, d)
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    chosen, rejected = F.array(F.try_element_at(said, F.lit(1))), F.array(F.try_element_at(said, F.lit(-1)))
    pair = chat.adapt_preference_messages(chat.first_user(F.col("messages")), chosen, rejected)
    return ms.select("conv_id", F.when(F.size(said) < 1, F.lit("empty")).otherwise(chat.preference_reject_reason(pair)).alias("reason"))


def _mix(spark, d):
    ms = conversations(spark, d)
    names = [n for n, _ in chat.SFT_SHARES]
    source = F.element_at(F.array(*map(F.lit, names)), (F.col("conv_id") % 3 + 1).cast("int"))
    reason = F.when(F.col("messages").isNull(), "unadaptable").otherwise(chat.conversation_reject_reason(F.col("messages")))
    items = ms.select(F.col("conv_id").alias("ord"), source.alias("source"), chat.prompt_key(chat.first_user(F.col("messages"))).alias("key"), reason.alias("reason"))
    return chat.collect_mix(items, chat.SFT_SHARES, 50_000)


@query
def mix_collect(spark, d):
    return _mix(spark, d).select("source", F.col("ord").alias("conv_id"))


@query
def train_val_split(spark, d):
    items = table(spark, d, "conversations").select("conv_id").distinct()
    return chat.train_val_split(items, ["conv_id"], 0.05).select("conv_id", "is_val")



def _byte_stream(spark, d):
    return documents(spark, d).select("ord", F.concat(tokens.byte_stream(F.col("text")), F.array(F.lit(tokens.EOS))).alias("ids"))


@query
def val_budget_split(spark, d):
    out = tokens.val_budget_split(_byte_stream(spark, d), 100_000)
    return out.select(F.col("ord").alias("doc_id"), F.col("start").cast("long").alias("start"), "is_val")


@query
def pack_windows(spark, d):
    out = tokens.pack_windows(_byte_stream(spark, d), 1024)
    s = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"))
    return out.select(F.col("win").cast("long").alias("win"), s("x").alias("x"), s("y").alias("y"))


def _examples(spark, d):
    ms = conversations(spark, d).filter(F.col("messages").isNotNull())
    return tokens.encode_conversation(ms, tokens.byte_ids)


@query
def loss_mask(spark, d):
    out = _examples(spark, d)
    return out.select("conv_id", F.size("ids").alias("n"), F.size(F.filter("labels", lambda x: x != tokens.IGNORE)).alias("supervised"), F.md5(F.array_join(F.col("labels").cast("array<string>"), ",").cast("binary")).alias("labels"))


@query
def pad_collate(spark, d):
    rows = tokens.usable_examples(_examples(spark, d), 20_000).select(F.col("conv_id").alias("ord"), "ids", "labels")
    out = tokens.pad_collate(rows, 8)
    s = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"))
    return out.select(F.col("ord").alias("conv_id"), F.col("batch").cast("long").alias("batch"), F.size("x").alias("width"), s("x").alias("x"), s("y").alias("y"))


def _pairs(spark, d):
    """Conversations with an answer as pairs: the first user turn, its first and its last assistant turn."""
    ms = conversations(spark, d).filter(F.col("messages").isNotNull())
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    pairs = ms.filter(F.size(said) > 0).select(F.col("conv_id").alias("ord"), chat.first_user(F.col("messages")).alias("prompt"), F.element_at(said, 1)["content"].alias("chosen"), F.element_at(said, -1)["content"].alias("rejected"))
    return tokens.encode_pairs(pairs.filter("prompt IS NOT NULL"), tokens.byte_ids, 1_800)


def _digest(name):
    return F.md5(F.array_join(F.col(name).cast("array<string>"), ",").cast("binary")).alias(name)


@query
def preference_encode(spark, d):
    return _pairs(spark, d).select(F.col("ord").alias("conv_id"), *[_digest(f"{s}_{c}") for s in ("chosen", "rejected") for c in ("ids", "labels")])


@query
def pair_collate(spark, d):
    out = tokens.pair_collate(_pairs(spark, d), 8)
    return out.select(F.col("ord").alias("conv_id"), F.col("batch").cast("long").alias("batch"), *[_digest(f"{s}_{c}") for s in ("chosen", "rejected") for c in ("x", "y")])


@query
def adapt_sharegpt(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value"))).alias("c"))
    ms = turns.select("conv_id", chat.adapt_sharegpt(F.col("c")).alias("m")).filter(F.col("m").isNotNull())
    return ms.select("conv_id", F.size("m").alias("turns"), F.md5(F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").cast("binary")).alias("digest"))


def raw_conversations(spark, d) -> DataFrame:
    """(ord, adapter, row): conversations as raw rows of three formats; each eleventh has a wrong shape, each thirteenth lacks something."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    last = lambda role, place: F.try_element_at(F.filter("turns", lambda x: x["role"] == role), F.lit(place))["text"]
    role = lambda x, i: F.when((F.col("conv_id") % 13 == 0) & (i == 0), "wizard").otherwise(x["role"])
    spoken = F.transform("turns", lambda x, i: F.struct(role(x, i).alias("from"), x["text"].alias("value")))
    written = F.transform("turns", lambda x, i: F.struct(role(x, i).alias("role"), x["text"].alias("content")))
    kind, wrong = F.col("conv_id") % 3, F.col("conv_id") % 11 == 0
    made = (
        F.when(wrong & (kind == 2), F.lit("[1, 2]"))
        .when(wrong, F.concat(F.lit('{"conversations": 7, "messages": ["'), F.col("conv_id").cast("string"), F.lit('"]}')))
        .when(kind == 0, F.to_json(F.struct(spoken.alias("conversations"))))
        .when(kind == 1, F.to_json(F.struct(written.alias("messages"))))
        .otherwise(F.to_json(F.struct(last("user", 1).alias("instruction"), F.when(F.col("conv_id") % 13 > 0, last("assistant", -1)).alias("output"))))
    )
    adapter = F.element_at(F.array(*map(F.lit, ("sharegpt", "messages", "instruct_pair"))), (kind + 1).cast("int"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return rows.select(F.col("conv_id").alias("ord"), adapter.alias("adapter"), F.parse_json(made).alias("row"))


@query
def post_statuses(spark, d):
    rows, out = stored(raw_conversations(spark, d), "raw"), None
    for name in post.ADAPTERS["sft"]:
        own = post.convert(rows.filter(F.col("adapter") == name), "sft", name).select(F.col("ord").alias("conv_id"), F.lit(name).alias("adapter"), "status")
        out = own if out is None else out.unionByName(own)
    return out


@query
def compression_ratio(spark, d):
    return tokens.compression_ratio(documents(spark, d).withColumn("ids", tokens.byte_stream(F.col("text")))).select(F.round("chars_per_token", 6).alias("chars_per_token"))


def _bpe(spark, d) -> bpe.Model:
    return tokens.train_bpe(table(spark, d, "documents"), 4_096)


@query
def bpe_merges(spark, d):
    """The merges learned from all documents, tokens in hexadecimal digits."""
    return _bpe(spark, d).frame(spark)


@query
def bpe_ids(spark, d):
    """Every document encoded by a model of all documents, and whether decoding gives its text again."""
    model = _bpe(spark, d)
    rows = stored(bpe.encode(table(spark, d, "documents").select("doc_id", "text"), model), "ids")
    same = bpe.decode(F.col("ids"), model) == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.size("ids").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"), same.alias("round_trip"))


@query
def shard_round_trip(spark, d):
    """All documents written as compressed shards in the shared folder and read again."""
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sinks.write_shards(documents(spark, d), folder, max_docs=2_000)
    rows = jsonl.read_shards(spark, folder)
    return rows.select(F.regexp_extract("file", r"[^/]+$", 0).alias("file"), "line", F.md5("text").alias("digest"), "source", "kind")


@query
def mix_targets(spark, d):
    return planner.mix_targets(spark).select("source", "share", "target_tokens")


@query
def assess(spark, d):
    rows = documents(spark, d).groupBy("source").agg(F.sum(F.length("text")).alias("characters")).withColumn("params", F.lit(12_815_616).cast("long"))
    return planner.assess(rows).select("source", "characters", "estimated_tokens", "tokens_wanted", "share_of_budget", "verdict")


@query
def model_ladder(spark, d):
    return planner.ladder(spark).select("preset", "params", "context_len")


def _devices(spark, d):
    """Suppliers as devices: memory by key, names from the throughput table."""
    names = [k for k, _ in planner.PEAK_BF16] + ["plain", "laptop"]
    key = F.col("s_suppkey").cast("long")
    s = table(spark, d, "supplier")
    kind = F.element_at(F.array(F.lit("cuda"), F.lit("mps"), F.lit("cpu")), (key % 3 + 1).cast("int"))
    return s.select(key.alias("device_id"), F.concat(F.lit("dev "), F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))).alias("name"), kind.alias("kind"), (key % 97 + 3).cast("double").alias("memory_gb"), (key % 2 == 0).alias("supports_bf16"), F.lit(None).cast("double").alias("peak_tflops"))


@query
def peak_for(spark, d):
    return planner.peak_for(_devices(spark, d)).select("device_id", "name", "peak", "effective_peak")


@query
def plan_recommend(spark, d):
    return planner.recommend(_devices(spark, d)).select("device_id", "preset", "params", "micro_batch", "grad_accum", "tokens_per_step", "total_steps", "warmup_steps", "warning")


@query
def plan_with_context(spark, d):
    return planner.recommend(_devices(spark, d), context_len=4096).select("device_id", "preset", "context_len", "micro_batch", "grad_accum", "tokens_per_step", "total_steps")


@query
def lr_schedule(spark, d):
    return spark.range(0, 1001).select(F.col("id").alias("step"), F.round(metrics.lr_at(F.col("id"), 6e-4, 6e-5, 100, 1000) * 1e6, 6).alias("lr_e6"))


@query
def loss_watchdog(spark, d):
    """Order prices in cents as losses, one run a customer: whole numbers, so means are exact in any order."""
    cents = F.round(F.col("o_totalprice").cast("double") * 100)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), cents.alias("loss"))
    return metrics.loss_watchdog(rows).select("run", "step", "status", "baseline")


@query
def perplexity(spark, d):
    return metrics.perplexity(table(spark, d, "events").select((F.col("value").cast("double") / 100).alias("loss")))


def _logits(spark, d):
    """Embeddings stand in for logits."""
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


@query
def top_k(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", metrics.filter_top_k(F.col("embedding"), 8).alias("k"))
    return v.select("vec_id", F.array_join(F.filter(F.transform("k", lambda x, i: F.when(x.isNotNull(), i)), lambda x: x.isNotNull()).cast("array<string>"), ",").alias("kept"))


@query
def top_p(spark, d):
    kept = metrics.filter_top_p(_logits(spark, d), 0.5).filter("kept")
    return kept.groupBy(F.col("row").alias("vec_id")).agg(F.count("*").alias("n"), F.max("token").alias("last"))


@query
def repetition_penalty(spark, d):
    rows = _logits(spark, d)
    seen = rows.filter("(row + token) % 7 = 0")
    return metrics.repetition_penalty(rows, seen, 1.1).select(F.col("row").alias("vec_id"), "token", F.round("logit", 6).alias("logit"))


@query
def greedy_choice(spark, d):
    return metrics.choose(_logits(spark, d)).select(F.col("row").alias("vec_id"), "token")


@query
def sequence_logprob(spark, d):
    rows = _logits(spark, d).select(F.col("row").alias("seq"), F.when(F.col("token") % 3 == 0, -100).otherwise(F.col("token")).alias("label"), (-F.abs("logit")).alias("logprob"))
    return metrics.sequence_logprob(rows).select("seq", F.round("logprob", 6).alias("logprob"))


@query
def dpo_metrics(spark, d):
    v = table(spark, d, "embeddings")
    e = lambda i: F.element_at("embedding", i).cast("double") * 10
    out = metrics.dpo_metrics(v.select(e(1).alias("policy_chosen"), e(2).alias("policy_rejected"), e(3).alias("ref_chosen"), e(4).alias("ref_rejected")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query
def classify_paths(spark, d):
    from ..sources.folder import classify

    return table(spark, d, "pages").select("page_id", classify(F.regexp_replace("url", r"[?#].*$", F.lit(""))).alias("kind"))
