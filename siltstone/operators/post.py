"""Post-training sets from raw rows of unknown schema: adapters by name, typed errors, and a mix with its report.

Raw rows are VARIANT values, one a row of a source, whatever their fields and types. An adapter maps such a value to an item
(messages, or a preference pair) or to a problem: ``adapter_error`` where the row has another shape than the adapter
reads (it is no object, turns are no list of objects), ``unadaptable`` where something it needs is missing or empty. What
is left goes through the rules of ``chat``.

``collect`` reads each source once: the judged rows are stored, and all that follows (unique prompts, the source's share,
the report) reads their narrow columns. A source that fails leaves nothing but its error in the report.

Defined results: a field counts as missing if it is null, empty, zero or false; texts of other types are empty; rows are
ordered by ``ord``; equal orders are not allowed; an empty source collects nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.session import forgotten, stored
from . import chat
from .dedupe import numbered

ERROR, MISSING, KEPT = "adapter_error", "unadaptable", "kept"


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, F.lit(f"$.{name}"), "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _string(v: Column) -> Column:
    """The cleaned string in a variant; empty for all other values."""
    return F.when(_is(v, "STRING"), t.clean(F.try_variant_get(v, F.lit("$"), "string"))).otherwise(F.lit(""))


def _list(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, F.lit("$"), "array<variant>"))


def _filled(v: Column) -> Column:
    """Whether a field's value counts: neither null nor empty, zero or false."""
    number = F.try_variant_get(v, F.lit("$"), "double")
    return (
        F.when(v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True)), False)
        .when(_is(v, "STRING"), F.try_variant_get(v, F.lit("$"), "string") != "")
        .when(_is(v, "ARRAY"), F.size(_list(v)) > 0)
        .when(_is(v, "OBJECT"), F.schema_of_variant(v) != "OBJECT<>")
        .otherwise(F.coalesce(number != 0, F.lit(True)))
    )


def _first(v: Column, *names: str) -> Column:
    """The first field that counts."""
    return F.coalesce(*[F.when(_filled(_field(v, n)), _field(v, n)) for n in names])


def _made(item: Column, problem: Column) -> Column:
    return F.struct(F.when(problem.isNull(), item).alias("item"), problem.alias("problem"))


def _turns(turns: Column, role: str, content: str) -> Column:
    """Messages of a list of objects; the first turn that is not as it should be tells the problem."""

    def read(e):
        name, said = chat.known_role(F.try_variant_get(e, F.lit(f"$.{role}"), "string")), _string(_field(e, content))
        problem = F.when(~_is(e, "OBJECT"), ERROR).when(name.isNull() | (said == ""), MISSING)
        return F.struct(problem.alias("problem"), chat.message(name, said).alias("message"))

    def checked(made):
        wrong = F.try_element_at(F.filter(F.transform(made, lambda x: x["problem"]), lambda p: p.isNotNull()), F.lit(1))
        return _made(F.transform(made, lambda x: x["message"]), F.when(turns.isNull(), MISSING).when(made.isNull(), ERROR).otherwise(wrong))

    return t.bound(F.transform(_list(turns), read), checked)


def sharegpt(row: Column) -> Column:
    return t.bound(_first(row, "conversations", "conversation"), lambda v: _turns(v, "from", "value"))


def messages(row: Column) -> Column:
    return t.bound(_first(row, "messages"), lambda v: _turns(v, "role", "content"))


def instruct_pair(row: Column) -> Column:
    asked, said = _string(_first(row, "problem", "instruction", "question")), _string(_first(row, "solution", "output", "response", "answer"))

    def pair(x):
        whole = F.when(x["more"] != "", F.concat(x["asked"], F.lit("\n\n"), x["more"])).otherwise(x["asked"])
        turns = F.array(chat.message(F.lit("user"), whole), chat.message(F.lit("assistant"), x["said"]))
        return _made(turns, F.when((x["asked"] == "") | (x["said"] == ""), MISSING))

    return t.bound(F.struct(asked.alias("asked"), said.alias("said"), _string(_first(row, "input")).alias("more")), pair)


def _pair(prompt: Column, chosen: Column, rejected: Column, problem: Column) -> Column:
    made = F.struct(prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), problem.alias("problem"))

    def checked(x):
        empty = (x["prompt"] == "") | (x["chosen"] == "") | (x["rejected"] == "")
        return _made(F.struct(*[x[c].alias(c) for c in ("prompt", "chosen", "rejected")]), F.coalesce(x["problem"], F.when(empty, MISSING)))

    return t.bound(made, checked)


def _turn_of(turns: Column, role: str) -> Column:
    """The first turn of that role, or that is no object, if it comes before."""
    return F.try_element_at(F.filter(turns, lambda e: ~_is(e, "OBJECT") | (F.lower(F.try_variant_get(e, F.lit("$.role"), "string")) == role)), F.lit(1))


def preference_messages(row: Column) -> Column:
    chosen, rejected = _list(_field(row, "chosen")), _list(_field(row, "rejected"))
    own = _string(_field(row, "prompt"))
    asked = F.when(own == "", _turn_of(chosen, "user"))
    last = [_turn_of(F.reverse(c), "assistant") for c in (chosen, rejected)]
    said = lambda e: F.coalesce(F.when(_is(e, "OBJECT"), _string(_field(e, "content"))), F.lit(""))
    odd = [e.isNotNull() & ~_is(e, "OBJECT") for e in (asked, *last)]
    problem = F.when(chosen.isNull() | rejected.isNull(), MISSING).when(odd[0] | odd[1] | odd[2], ERROR)
    return _pair(F.when(own == "", said(asked)).otherwise(own), said(last[0]), said(last[1]), problem)


def preference_flat(row: Column) -> Column:
    fields = (("prompt", "question", "input"), ("chosen", "response_a"), ("rejected", "response_b"))
    return _pair(*[_string(_first(row, *names)) for names in fields], F.lit(None).cast("string"))


#: Adapters by name, for conversations and for preference pairs; ``register`` adds others.
ADAPTERS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "sft": {"sharegpt": sharegpt, "messages": messages, "instruct_pair": instruct_pair},
    "dpo": {"preference_messages": preference_messages, "preference_flat": preference_flat},
}


def register(kind: str, name: str, adapter: Callable[[Column], Column]) -> None:
    """Adds an adapter: a variant column to a struct of item and problem."""
    if name in ADAPTERS[kind]:
        raise ValueError(f"there is an adapter {name!r} already")
    ADAPTERS[kind][name] = adapter


def adapter_of(kind: str, name: str) -> Callable[[Column], Column]:
    if name not in ADAPTERS[kind]:
        raise KeyError(f"unknown adapter {name!r}; known: {', '.join(sorted(ADAPTERS[kind]))}")
    return ADAPTERS[kind][name]


@dataclass(frozen=True)
class PostSource:
    name: str
    adapter: str
    share: float


#: The default mixes.
SFT_MIX = tuple(PostSource(n, a, s) for (n, s), a in zip(chat.SFT_SHARES, ("sharegpt", "messages", "instruct_pair"), strict=True))
DPO_MIX = tuple(PostSource(n, a, s) for (n, s), a in zip(chat.DPO_SHARES, ("preference_messages", "preference_flat"), strict=True))
MIXES = {"sft": SFT_MIX, "dpo": DPO_MIX}


def chosen_sources(mix: tuple[PostSource, ...], only: str | None = None) -> list[PostSource]:
    """The sources of a mix, whose shares must sum to 1; or one of them, with all of the target."""
    if abs(sum(s.share for s in mix) - 1) > 1e-9:
        raise ValueError(f"shares sum to {sum(s.share for s in mix)}, not 1")
    if only is None:
        return list(mix)
    found = [PostSource(s.name, s.adapter, 1.0) for s in mix if s.name == only]
    if not found:
        raise KeyError(f"unknown source {only!r}; known: {', '.join(s.name for s in mix)}")
    return found


def convert(rows: DataFrame, kind: str, adapter: str, order: str = "ord", row: str = "row") -> DataFrame:
    """ord, item, status, key of raw rows (variants): the status is ``kept`` or why a row goes; key is its prompt's digest."""
    made = t.bound(F.col(row), adapter_of(kind, adapter))
    out = rows.select(F.col(order).alias("ord"), F.when(_is(F.col(row), "OBJECT"), made).alias("m"))
    item = F.col("m.item")
    reason = chat.conversation_reject_reason(item) if kind == "sft" else chat.preference_reject_reason(item)
    prompt = chat.first_user(item) if kind == "sft" else F.col("m.item.prompt")
    status = F.when(F.col("m").isNull(), ERROR).otherwise(F.coalesce("m.problem", reason, F.lit(KEPT)))
    return out.select("ord", item.alias("item"), status.alias("status"), F.when(status == KEPT, chat.prompt_key(prompt)).alias("key"))


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by ord, without a task that holds them all."""
    return numbered(rows, ["ord"]).filter(F.col("rn") < n).drop("rn")


def collect(sources: dict[str, Callable[[], DataFrame]], kind: str, target: int, mix: tuple[PostSource, ...] | None = None, only: str | None = None, read_multiplier: float = 2.5, seed: int = 0) -> tuple[DataFrame | None, dict]:
    """Items (source, ord, item, key, place) in a shuffled order of the seed, and the report; no items if every source fails.

    ``sources`` has, by name, functions that give raw rows (ord, row). Sources are visited in the mix's order. Of each, the
    first ``read_multiplier`` times its share of ``target`` rows are read, and the first of each prompt that no earlier
    source has given are taken until the share is full. The report has, for each source, what was requested and collected,
    the rows left out as duplicates, and the statuses of the rows up to the last one taken; or the error.
    """
    taken: DataFrame | None = None
    report: dict = {"per_source": {}}
    for source in chosen_sources(mix or MIXES[kind], only):
        want = int(target * source.share)
        try:
            judged = stored(convert(_first_rows(sources[source.name](), int(want * read_multiplier)), kind, source.adapter), "judged")
            narrow = judged.select("ord", "status", "key")
            first = narrow.filter(F.col("status") == KEPT).groupBy("key").agg(F.min("ord").alias("ord"))
            if taken is not None:
                first = first.join(taken.select("key"), "key", "left_anti")
            got = stored(numbered(first, ["ord"]).filter(F.col("rn") < want), "got")
            end = got.agg(F.count("*").alias("n"), F.max("ord").alias("last")).first()
            seen = narrow.filter(F.col("ord") <= end.last) if end.n >= want > 0 else narrow  # a full share ends the reading
            counts = {r.status: r["count"] for r in (seen if want > 0 else seen.limit(0)).groupBy("status").count().collect()}  # a row a status
            own = stored(judged.join(got.select("ord"), "ord", "left_semi").select(F.lit(source.name).alias("source"), "ord", "item", "key"), "taken")
            forgotten(judged, got)
        except Exception as e:
            report["per_source"][source.name] = {"error": f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"}
            continue
        report["per_source"][source.name] = {"requested": want, "collected": end.n, "cross_source_duplicates": counts.get(KEPT, 0) - end.n, "dropped_by_filter": counts}
        taken = own if taken is None else taken.unionByName(own)
    if taken is None:
        return None, report
    shuffled = F.md5(F.concat_ws(":", "source", F.col("ord").cast("string"), F.lit(str(seed))))
    return taken.withColumn("place", shuffled), report
