"""Conversations and preference pairs: adapters, rules, rendering, prompt deduplication, mixing, splitting.

Messages are arrays of struct<role, content>; everything about one conversation is an expression over its array, so
only collecting turns and comparing prompts across conversations shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .dedupe import numbered

#: Fixed values.
ROLE_ALIASES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant", "chatgpt": "assistant", "bot": "assistant", "system": "system"}
BAD_PREFIXES = ("i'm sorry, but i can", "i cannot fulfill", "i can't fulfill", "as an ai language model", "as an ai assistant, i", "i'm just an ai")
SPECIAL_TOKENS = ("<|pad|>", "<|bos|>", "<|eos|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>")
SFT_SHARES = (("openhermes", 0.45), ("tulu", 0.25), ("magicoder", 0.30))
DPO_SHARES = (("ultrafeedback", 0.75), ("orca-dpo", 0.25))

MESSAGES = "array<struct<role: string, content: string>>"


def message(role, content) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def collect_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages) from one row a turn."""
    made = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(conv).agg(F.transform(made, lambda x: message(x["role"], x["content"])).alias("messages"))


def truthy(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def known_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.coalesce(role, F.lit(""))))


def adapt_turns(turns: Column, role: str = "role", content: str = "content") -> Column:
    """Messages with known roles and cleaned text; null for no turns, or if any turn has an unknown role or no text."""

    def checked(ms):
        return F.when((F.size(ms) > 0) & ~F.exists(ms, lambda m: m["role"].isNull() | (m["content"] == "")), ms)

    return t.bound(F.transform(turns, lambda x: message(known_role(x[role]), t.clean(x[content]))), checked)


def adapt_sharegpt(conversations: Column, conversation: Column | None = None) -> Column:
    turns = conversations if conversation is None else F.when(F.size(conversations) > 0, conversations).otherwise(conversation)
    return adapt_turns(turns, "from", "value")


def adapt_messages(messages: Column) -> Column:
    return adapt_turns(messages)


def adapt_instruct_pair(prompts: list[Column], answers: list[Column], context: Column | None = None) -> Column:
    """A user and an assistant turn from the first filled fields; context follows the prompt after a blank line."""
    more = F.lit("") if context is None else t.clean(context)

    def pair(x):
        asked = F.when(x["c"] != "", F.concat(x["p"], F.lit("\n\n"), x["c"])).otherwise(x["p"])
        return F.when((x["p"] != "") & (x["a"] != ""), F.array(message(F.lit("user"), asked), message(F.lit("assistant"), x["a"])))

    return t.bound(F.struct(t.clean(truthy(*prompts)).alias("p"), t.clean(truthy(*answers)).alias("a"), more.alias("c")), pair)


def _pair(prompt: Column, chosen: Column, rejected: Column) -> Column:
    made = F.struct(prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))
    return t.bound(made, lambda x: F.when((x["prompt"] != "") & (x["chosen"] != "") & (x["rejected"] != ""), x))


def adapt_preference_messages(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """The last assistant turn of either list; without a prompt, the first user turn of the chosen one."""
    of = lambda turns, role: F.filter(turns, lambda x: F.lower(x["role"]) == role)
    last = lambda turns: t.clean(F.try_element_at(of(turns, "assistant"), F.lit(-1))["content"])
    asked = truthy(t.clean(prompt), t.clean(F.try_element_at(of(chosen, "user"), F.lit(1))["content"]))
    return F.when(chosen.isNotNull() & rejected.isNotNull(), _pair(F.coalesce(asked, F.lit("")), last(chosen), last(rejected)))


def adapt_preference_flat(prompts: list[Column], chosen: list[Column], rejected: list[Column]) -> Column:
    return _pair(t.clean(truthy(*prompts)), t.clean(truthy(*chosen)), t.clean(truthy(*rejected)))


def is_refusal(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 40))
    out = F.lit(False)
    for prefix in BAD_PREFIXES:
        out = out | head.startswith(prefix)
    return out


def conversation_reject_reason(messages: Column, min_answer_chars: int = 20, max_chars: int = 24_000) -> Column:
    """The first rule a conversation breaks, or null."""

    def rules(ms):
        roles = F.transform(ms, lambda m: m["role"])
        body = F.filter(roles, lambda r: r != "system")
        doubled = F.zip_with(F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0))), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), lambda a, b: a == b)
        total = F.aggregate(ms, F.lit(0).cast("long"), lambda s, m: s + F.length(m["content"]))
        bad = F.transform(ms, lambda m: F.when(m["role"] == "assistant", F.when(F.length(m["content"]) < min_answer_chars, "answer_too_short").when(is_refusal(m["content"]), "refusal_or_meta")))
        return (
            F.when(F.coalesce(F.size(ms), F.lit(0)) < 1, "empty")
            .when(F.element_at(ms, -1)["role"] != "assistant", "does_not_end_with_assistant")
            .when(~F.exists(roles, lambda r: r == "user"), "no_user_turn")
            .when(F.size(F.filter(roles, lambda r: r == "system")) > 1, "multiple_system_turns")
            .when(F.exists(F.slice(roles, F.lit(2), F.size(roles)), lambda r: r == "system"), "system_turn_out_of_place")
            .when(F.exists(doubled, lambda x: x), "roles_do_not_alternate")
            .when(total > max_chars, "too_long")
            .otherwise(F.try_element_at(F.filter(bad, lambda x: x.isNotNull()), F.lit(1)))
        )

    return t.bound(messages, rules)


def preference_reject_reason(pair: Column, min_chars: int = 20, min_prompt_chars: int = 10, max_chars: int = 12_000) -> Column:
    """The first rule a struct of prompt, chosen and rejected breaks, or null."""

    def rules(p):
        return (
            F.when(p.isNull(), "empty")
            .when(t.strip(p["chosen"]) == t.strip(p["rejected"]), "identical_responses")
            .when(F.length(p["prompt"]) < min_prompt_chars, "prompt_too_short")
            .when(F.length(p["chosen"]) < min_chars, "chosen_too_short")
            .when(F.length(p["rejected"]) < min_chars, "rejected_too_short")
            .when(F.length(p["prompt"]) + F.greatest(F.length(p["chosen"]), F.length(p["rejected"])) > max_chars, "too_long")
            .when(is_refusal(p["chosen"]), "chosen_is_a_refusal")
        )

    return t.bound(pair, rules)


def prompt_key(prompt: Column) -> Column:
    """Digest of a prompt, whatever its case and spacing."""
    return F.sha2(t.strip(F.regexp_replace(F.lower(prompt), rf"[{t.SPACE}]+", F.lit(" "))), 256)


def first_user(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"], F.lit(""))


def render(messages: Column, add_generation_prompt: bool = False) -> Column:
    """The chat template; an unknown role is an error."""
    roles = F.create_map(*[F.lit(x) for r in ("system", "user", "assistant") for x in (r, f"<|{r}|>")])
    token = lambda m: F.coalesce(F.try_element_at(roles, m["role"]), F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(m["role"], F.lit("null")))).cast("string"))
    body = F.array_join(F.transform(messages, lambda m: F.concat(token(m), m["content"], F.lit("<|end|>"))), "")
    return F.concat(F.lit("<|bos|>"), body, F.lit("<|assistant|>" if add_generation_prompt else ""))


def collect_mix(items: DataFrame, shares, target: int, read_multiplier: float = 2.5, source: str = "source", order: str = "ord", key: str = "key", reason: str = "reason", only: str | None = None) -> DataFrame:
    """Items of a mix of sources, prompts unique: source, ord, key and the source's place in the mix, sorted by place and ord.

    Sources are visited in the mix's order. Each reads ``read_multiplier`` times its share of ``target`` rows, drops
    what has a reason, keeps the first row of each prompt that no earlier source has taken, and takes its share. Only
    prompts taken before the cut count as seen, hence the fold; the sources are few and declared.
    """
    chosen = [(only, 1.0)] if only else list(shares)
    taken = None
    for place, (name, share) in enumerate(chosen):
        want = int(target * share)
        rows = items.filter(F.col(source) == name).select(source, order, key, reason)
        rows = numbered(rows, [order]).filter(F.col("rn") < int(want * read_multiplier)).drop("rn").filter(F.col(reason).isNull())
        first = rows.groupBy(key).agg(F.min(order).alias(order))
        if taken is not None:
            first = first.join(taken.select(key), key, "left_anti")
        got = numbered(first, [order]).filter(F.col("rn") < want).select(F.lit(name).alias(source), order, key, F.lit(place).alias("place"))
        taken = got if taken is None else taken.unionByName(got)
    return taken.orderBy("place", order)


def train_val_split(items: DataFrame, order, val_fraction: float) -> DataFrame:
    """``items`` with is_val: the head of the order, at least one row."""
    n = items.count()
    n_val = max(1, math.floor(n * val_fraction)) if n else 0
    return numbered(items, order).withColumn("is_val", F.col("rn") < n_val).drop("rn")


def ranked(items: DataFrame, by: str, order: str) -> DataFrame:
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
