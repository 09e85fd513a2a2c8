import json
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chat, post
from siltstone.plans import post as line

ANSWER = "a long enough answer to keep"
TURNS = [{"from": "human", "value": "What is it?"}, {"from": "GPT", "value": ANSWER}]
MESSAGES = [{"role": "User", "content": "What  IS it?"}, {"role": "assistant", "content": ANSWER}]


def statuses(spark, kind, adapter, rows):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ord long, raw string").select("ord", F.parse_json("raw").alias("row"))
    return {r.ord: (r.status, r["item"]) for r in post.convert(df, kind, adapter).collect()}


def test_conversation_adapters(spark):
    rows = [{"conversations": TURNS}, {"conversations": [], "conversation": TURNS}, {"conversations": [{"from": "wizard", "value": "x"}, "s"]}, {"conversations": ["s", {"from": "wizard"}]}]
    rows += [{"conversations": 5}, {"conversations": 0}, {"conversations": "abc"}, {"conversations": {"a": 1}}, {"conversations": [{"from": "human", "value": 5}]}, {}, [1], "x", 3, None, {"conversations": [{"from": None, "value": "x"}]}]
    got = statuses(spark, "sft", "sharegpt", rows)
    assert [got[i][0] for i in range(len(rows))] == ["kept", "kept", "unadaptable", "adapter_error", "adapter_error", "unadaptable", "adapter_error", "adapter_error", "unadaptable", "unadaptable", "adapter_error", "adapter_error", "adapter_error", "adapter_error", "unadaptable"]
    assert [(m.role, m.content) for m in got[0][1]] == [("user", "What is it?"), ("assistant", ANSWER)] and got[2][1] is None
    got = statuses(spark, "sft", "messages", [{"messages": MESSAGES, "conversations": 5}, {"messages": [*MESSAGES, {"role": "user", "content": "x"}]}, {"messages": True}, {"messages": [[]]}])
    assert [got[i][0] for i in range(4)] == ["kept", "does_not_end_with_assistant", "adapter_error", "adapter_error"]


def test_instruct_pairs(spark):
    rows = [{"problem": "", "instruction": "ask", "solution": None, "output": ANSWER, "input": "more\r\n\n\n\nlines"}, {"question": "ask", "response": "short"}, {"problem": ["ask"], "instruction": "x", "answer": ANSWER}, {"instruction": 0, "question": "q", "answer": ANSWER}]
    got = statuses(spark, "sft", "instruct_pair", rows)
    assert [got[i][0] for i in range(4)] == ["kept", "answer_too_short", "unadaptable", "kept"]
    assert got[0][1][0].content == "ask\n\nmore\n\nlines" and got[3][1][0].content == "q"


def test_preferences(spark):
    good, bad = [{"role": "user", "content": "please tell me more"}, {"role": "Assistant", "content": ANSWER}], [{"role": "assistant", "content": "another answer that is worse"}]
    rows = [{"prompt": "", "chosen": good, "rejected": bad}, {"prompt": "say it to me now", "chosen": good, "rejected": ["s", *bad]}, {"prompt": "say it to me", "chosen": good, "rejected": [*bad, "s"]}, {"chosen": "x", "rejected": bad}]
    rows += [{"chosen": ["s", *good], "rejected": bad}, {"prompt": "p" * 12, "chosen": good, "rejected": good}, {"prompt": 7, "chosen": [], "rejected": []}]
    got = statuses(spark, "dpo", "preference_messages", rows)
    assert [got[i][0] for i in range(7)] == ["kept", "kept", "adapter_error", "unadaptable", "adapter_error", "identical_responses", "unadaptable"]
    assert got[0][1].asDict() == {"prompt": "please tell me more", "chosen": ANSWER, "rejected": "another answer that is worse"}
    got = statuses(spark, "dpo", "preference_flat", [{"question": "what is it then", "response_a": ANSWER, "rejected": "another answer that is worse"}, {"prompt": "x"}, {"prompt": "what", "chosen": ANSWER, "rejected": "another answer that is worse"}])
    assert [got[i][0] for i in range(3)] == ["kept", "unadaptable", "prompt_too_short"]


def test_registry():
    assert post.adapter_of("sft", "messages") is post.messages
    with pytest.raises(KeyError, match="known: instruct_pair, messages, sharegpt"):
        post.adapter_of("sft", "none")
    post.register("dpo", "own", post.preference_flat)
    assert post.ADAPTERS["dpo"].pop("own") and post.chosen_sources(post.SFT_MIX, "tulu")[0].share == 1
    with pytest.raises(ValueError):
        post.register("sft", "messages", post.messages)
    with pytest.raises(KeyError):
        post.chosen_sources(post.DPO_MIX, "tulu")
    with pytest.raises(ValueError, match="sum"):
        post.chosen_sources(post.SFT_MIX[:2])


def one_by_one(sources, kind, target, multiplier):
    """The mix taken row by row from (status, key, item) lists."""
    seen, out, report = set(), [], {}
    for s in post.MIXES[kind]:
        want, counts, got, again = int(target * s.share), {}, 0, 0
        for ord_, (status, key) in enumerate(sources[s.name][: int(want * multiplier)]):
            counts[status] = counts.get(status, 0) + 1
            if status != "kept":
                continue
            if key in seen:
                again += 1
                continue
            seen.add(key)
            out.append((s.name, ord_))
            got += 1
            if got >= want:
                break
        report[s.name] = {"requested": want, "collected": got, "cross_source_duplicates": again, "dropped_by_filter": counts}
    return sorted(out), report


def raw(name, asked, answer):
    if name == "openhermes":
        return {"conversations": [{"from": "human", "value": asked}, {"from": "gpt", "value": answer}]}
    if name == "tulu":
        return {"messages": [{"role": "user", "content": asked}, {"role": "assistant", "content": answer}]}
    return {"problem": asked, "solution": answer}


def test_collect_is_the_mix_taken_row_by_row(spark, tmp_path):
    texts = {}
    for k, s in enumerate(post.SFT_MIX):
        texts[s.name] = [(f"Question  number {(i * 7 + k * 3) % 40}", "no" if i % 5 == 1 else ANSWER) for i in range(60)]
        (tmp_path / f"{s.name}.jsonl").write_text("".join(json.dumps(raw(s.name, *x)) + "\n" for x in texts[s.name]))
    plain = {n: [("kept" if len(a) > 10 else "answer_too_short", re.sub(r"\s+", " ", q.lower())) for q, a in rows] for n, rows in texts.items()}
    sources = {n: lambda n=n: line.raw_rows(spark, str(tmp_path / f"{n}.jsonl")) for n in texts}
    for target in (30, 120):
        items, report = post.collect(sources, "sft", target)
        want, counted = one_by_one(plain, "sft", target, 2.5)
        assert sorted((r.source, r.ord) for r in items.collect()) == want and report["per_source"] == counted
    first, second = ([(r.source, r.ord) for r in post.collect(sources, "sft", 30, seed=s)[0].orderBy("place").collect()] for s in (0, 1))
    assert sorted(first) == sorted(second) and first != second and first != sorted(first)
    (tmp_path / "tulu.jsonl").write_text((tmp_path / "tulu.jsonl").read_text() + "{broken\n")
    args = [x for n in texts for x in ("--source", f"{n}={tmp_path}/{n}.jsonl")]
    assert line.main(["sft", *args, "--out", str(tmp_path / "out"), "--target", "40", "--val-fraction", "0.2"]) == 0
    made = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert "error" in made["per_source"]["tulu"] and made["total"] == made["train"] + made["val"] == sum(v.get("collected", 0) for v in made["per_source"].values())
    rows = [json.loads(x) for x in (tmp_path / "out" / "train.jsonl").read_text().splitlines()]
    assert len(rows) == made["train"] and all(list(r) == ["messages"] and r["messages"][1]["content"] == ANSWER for r in rows)
    assert line.main(["sft", "--only", "tulu", *args, "--out", str(tmp_path / "none")]) == 1
    assert len({chat.SFT_SHARES[0][0], *made["per_source"]}) == 3
