import json
import os

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.operators import bpe, metrics, planner, tokens
from siltstone.plans import config, corpus, stages, tokenize
from siltstone.sources import folder, jsonl, parts, sinks
from siltstone.streaming import corpus as stream

from .test_rules import GOOD


def test_bpe(spark):
    docs = spark.createDataFrame([(i, f"the river number {i} ran to the sea, Ünïcode 🙂\tx") for i in range(200)], "ord long, text string")
    tok = tokens.train_bpe(docs, 400)
    assert tok.get_vocab_size() <= 400 and [tok.token_to_id(x) for x in tokens.SPECIAL_TOKENS] == list(range(7))
    odd = spark.createDataFrame([(0, "31415926"), (1, ""), (2, "日本 \r\n\t x"), (3, None)], "ord long, text string")
    rows = {r.ord: r for r in tokens.encode(odd, tok).withColumn("back", bpe.decode(F.col("ids"), tok)).collect()}
    assert set(rows) == {0, 2} and rows[0].ids[-1] == tokens.EOS and len(rows[0].ids) == 9
    assert rows[2].back == "日本 \r\n\t x<|eos|>"
    ratio = tokens.compression_ratio(tokens.encode(docs, tok, eos=False)).first()[0]
    assert ratio > 1.2
    with pytest.raises(ValueError):
        tokens.train_bpe(docs, 70_000)


@pytest.mark.parametrize("parts", [1, 5])
def test_windows(spark, parts):
    rng = np.random.default_rng(0)
    rows = [(i, [int(x) for x in rng.integers(0, 99, n)]) for i, n in enumerate([3, 0, 10, 1, 25, 8, 4])]
    flat = [x for _, ids in rows for x in ids]
    df = spark.createDataFrame(rows, "ord long, ids array<int>").repartition(parts)
    got = {r.win: (r.x, r.y) for r in tokens.pack_windows(df, 5).collect()}
    want = {w: (flat[5 * w : 5 * w + 5], flat[5 * w + 1 : 5 * w + 6]) for w in range((len(flat) - 1) // 5)}
    assert got == want
    assert set(r.win for r in tokens.pack_windows(df, 5, most=3).collect()) == {0, 1, 2}
    for r in tokens.random_windows(df, 6, 20).collect():
        assert any(flat[a : a + 6] == r.x and flat[a + 1 : a + 7] == r.y for a in range(len(flat) - 7))
    with pytest.raises(ValueError):
        tokens.random_windows(df.limit(1), 60, 2)
    split = {r.ord: r.is_val for r in tokens.val_budget_split(df, 4).collect()}
    assert [o for o, v in sorted(split.items()) if v] == [0, 1, 2]
    assert sum(r.is_val for r in tokens.val_budget_split(df.filter("ord <> 1"), 0).collect()) == 1


def test_watchdog_and_choice(spark):
    rows = [("r", i, v) for i, v in enumerate([2.0, 2.0, 7.0, float("nan")])]
    out = metrics.loss_watchdog(spark.createDataFrame(rows, "run string, step int, loss double")).orderBy("step").collect()
    assert [r.status for r in out] == ["ok", "ok", "spike", "non_finite"]
    logits = spark.createDataFrame([(0, i, x) for i, x in enumerate([0.1, 5.0, 1.0])], "row int, token int, logit double")
    assert metrics.choose(logits).first().token == 1 and metrics.choose(logits, 2.0, 5).count() == 1
    one = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    assert abs(metrics.dpo_metrics(one).first().loss - np.log(2)) < 1e-12
    assert metrics.perplexity(spark.createDataFrame([], "loss double")).first().loss is None


def test_planner(spark):
    device = spark.createDataFrame([(1, "RTX 5090", "cuda", 32.6, True, None), (2, "box", "cpu", 16.0, False, None), (3, "tiny", "cpu", 0.1, False, None)], "device_id long, name string, kind string, memory_gb double, supports_bf16 boolean, peak_tflops double")
    rows = {r.device_id: r for r in planner.recommend(device).collect()}
    big = rows[1]
    assert (big.preset, big.params, big.micro_batch, big.total_steps) == ("base", 326_685_696, 32, 13_085) and abs(big.hours - 51.06) < 0.05
    assert rows[2].preset == "nano" and rows[3].warning == "out_of_memory"
    assert planner.recommend(device, preset="xl", max_hours=1.0).count() == 3
    with pytest.raises(KeyError, match="unknown"):
        planner.recommend(device, preset="huge")
    with pytest.raises(ValueError):
        planner.mix_targets(spark, planner.MIX[:2])


@pytest.fixture
def tree(tmp_path):
    files = {"a.md": GOOD, "_notes/b.txt": GOOD + " More of it, then.", "main.py": "x = 1\n" * 3, "photo.jpg": "x", "corrupt.txt": "a\0b", ".git/c.md": GOOD, "node_modules/d.js": GOOD, ".hidden.md": "hidden but read", "doc.pdf": "%PDF"}
    files["rows.jsonl"] = "\n".join([json.dumps({"text": GOOD}), json.dumps({"content": "short", "kind": "code"}), "{broken", "[1]", json.dumps({"text": 5}), json.dumps({"text": ""}), "", json.dumps({"text": GOOD.upper(), "kind": "song"})])
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    os.symlink(tmp_path, tmp_path / "loop")
    return tmp_path


def test_folder(spark, tree):
    rows = folder.documents(spark, str(tree)).collect()
    status = sorted((r.path, r.status) for r in rows)
    assert status == sorted(
        [("a.md", "kept"), ("_notes/b.txt", "kept"), ("main.py", "filtered_too_short"), ("photo.jpg", "skipped_unsupported"), ("corrupt.txt", "skipped_binary"), (".hidden.md", "filtered_too_short"), ("doc.pdf", "skipped_pdf_no_reader")]
        + [("rows.jsonl", s) for s in ("kept", "filtered_jsonl_row", "skipped_bad_json", "skipped_bad_json", "skipped_bad_json", "skipped_empty", "kept")]
    )
    counts = {r.status: r.documents for r in folder.counters(folder.documents(spark, str(tree), apply_filters=False)).collect()}
    assert counts["kept"] == 7
    assert len([p for p, _ in folder.walk(str(tree), True)]) == len([p for p, _ in folder.walk(str(tree))]) + 1
    with pytest.raises(FileNotFoundError):
        folder.documents(spark, str(tree / "nowhere"))


def test_jsonl_shards_and_manifest(spark, tmp_path):
    texts = [f"{GOOD} Number {i}, as it was told. " + " ".join(f"{chr(97 + (i * 7 + k) % 26) * 4}{k}" for k in range(60)) for i in range(7)] + ["line with \x85 and   kept whole"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(json.dumps({"text": x, "source": "s"}, ensure_ascii=False) for x in texts[:4]) + "\n\n")
    (tmp_path / "in" / "c.jsonl").write_text("\n".join(json.dumps({"text": "", "content": x}) for x in [*texts[4:], texts[0]]))
    rows = jsonl.stream_local(spark, str(tmp_path / "in")).orderBy("at").collect()
    assert [r.text for r in rows] == [*texts, texts[0]] and [r.source for r in rows][3:5] == ["s", "local"]
    assert jsonl.stream_local(spark, str(tmp_path / "in"), limit=3).count() == 3
    events = []
    stages.run_stages([("build", lambda: stages.main([str(tmp_path / "in"), str(tmp_path / "out"), "--max-docs", "3"]))], events.append)
    made = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert (made["documents_in"], made["passed_filters"], made["removed_exact_duplicates"], made["documents_out"], made["shards"]) == (9, 8, 1, 7, 3)
    assert [e["event"] for e in events] == ["start", "done", "finished"] and sum(made["dropped_by_filter"].values()) == made["dropped"] == 1
    back = jsonl.read_shards(spark, str(tmp_path / "out")).orderBy("file", "line").collect()
    assert [r.text for r in back] == [corpus_text for corpus_text in texts[:7]]
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        jsonl.stream_local(spark, str(tmp_path / "bad.jsonl")).collect()


def test_lines_of_many_byte_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = {}
    for name in "ab":
        lines = ["" if rng.random() < 0.1 else f"{i} é " + "x" * int(rng.integers(0, 400)) for i in range(900)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * (name == "a"))
        want |= {(f"{name}.jsonl", i): x for i, x in enumerate(lines) if x}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(kept, ("7000", "100"), strict=True):
            spark.conf.set(k, v)
        lines = jsonl.ordered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 40
        assert {(os.path.basename(r.file), r.line): r.value for r in lines.collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_token_parts_at_known_offsets(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 65_536, int(rng.integers(0, 40))).tolist()) for i in range(60)]
    flat = [x for _, ids in rows for x in ids]
    stream_ = spark.createDataFrame(rows[::-1], "ord long, ids array<int>").repartition(5)
    assert sinks.write_bin(stream_, str(tmp_path / "t"), part_tokens=100) == len(flat)
    for k in range(-(-len(flat) // 100)):
        assert np.fromfile(tmp_path / "t" / f"tokens-{k:05d}.bin", "<u2").tolist() == flat[100 * k : 100 * k + 100]
    assert sinks.write_bin(stream_.limit(1), str(tmp_path / "t"), part_tokens=100) == len(stream_.limit(1).first().ids)
    assert len([f for f in os.listdir(tmp_path / "t") if f.endswith(".bin")]) <= 1  # earlier parts are gone


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    import pyarrow as pa

    batches = [pa.record_batch([pa.array([0, 0, 3]), pa.array([b"a", b"b", b"c"])], names=["part", "data"])]
    writer = parts.PartsWriter(str(tmp_path), "p", ".bin", None)

    def fails():
        yield batches[0]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(fails())
    lost, kept = writer.write(iter(batches)), writer.write(iter(batches))
    assert not [f for f in os.listdir(tmp_path) if f.startswith("p-")] and len(lost.files) == 2
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path)) == ["p-00000.bin", "p-00003.bin", "p.index.json"] and (tmp_path / "p-00000.bin").read_bytes() == b"ab"
    again = parts.PartsWriter(str(tmp_path), "p", ".bin", 3)
    with pytest.raises(ValueError, match="several tasks"):
        again.commit([again.write(iter(batches)), again.write(iter(batches))])
    again.abort([again.write(iter(batches))])
    assert sorted(os.listdir(tmp_path)) == ["p-00000.bin", "p-00003.bin", "p.index.json"]
    assert parts.opened("file:/tmp/x")[1] == parts.opened("file:///tmp/x")[1] == "/tmp/x"


def test_inputs_one_after_the_other_and_tokenizing(spark, tmp_path):
    texts = [f"{GOOD} Number {i}, as it was told. " + " ".join(f"{chr(97 + (i * 5 + k) % 26) * 4}{k}" for k in range(60)) for i in range(9)]
    for name, own in (("b", texts[:5]), ("a", [*texts[5:], texts[0]])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": x}) + "\n" for x in own))
    chained = jsonl.chain([jsonl.stream_local(spark, str(tmp_path / "b.jsonl"), "one", limit=4), jsonl.stream_local(spark, str(tmp_path / "a.jsonl"), "two", "code")])
    rows = chained.orderBy("ord").collect()
    assert [(r.ord, r.text, r.source, r.kind) for r in rows] == [(i, x, "one" if i < 4 else "two", "prose" if i < 4 else "code") for i, x in enumerate([*texts[:4], *texts[5:], texts[0]])]
    out, shards = str(tmp_path / "out"), str(tmp_path / "shards")
    assert stages.main([f"one={tmp_path}/b.jsonl", f"two={tmp_path}/a.jsonl", shards, "--max-docs", "4", "--seed", "3"]) == 0
    assert json.loads((tmp_path / "shards" / "manifest.json").read_text())["per_source"] == {"one": 5, "two": 4}
    assert tokenize.main(["train", shards, f"{tmp_path}/t.json", "--vocab", "400"]) == 0
    info = json.loads((tmp_path / "t.json.info.json").read_text())
    assert info["documents_trained_on"] == 9 and info["vocab_size"] == 400 and info["chars_per_token"] > 1
    assert tokenize.main(["encode", shards, f"{tmp_path}/t.json", out, "--val-tokens", "1", "--part-tokens", "500"]) == 0
    meta = sinks.load_meta(out)
    parts_of = lambda name: np.concatenate([np.fromfile(f, "<u2") for f in sorted((tmp_path / "out").glob(f"{name}-*.bin"))])
    model = bpe.Model.load(f"{tmp_path}/t.json")
    written = [json.loads(x)["text"] for f in sorted((tmp_path / "shards").glob("*.zst")) for x in zstandard.ZstdDecompressor().stream_reader(f.read_bytes()).read().decode().splitlines()]
    public = Tokenizer.from_file(f"{tmp_path}/t.json")
    want = [[*public.encode(x, add_special_tokens=False).ids, tokens.EOS] for x in written]
    assert parts_of("val").tolist() == want[0] and parts_of("train").tolist() == [i for w in want[1:] for i in w]
    assert (meta["val_tokens"], meta["train_tokens"], meta["vocab_size"]) == (len(want[0]), sum(map(len, want[1:])), model.get_vocab_size())
    with pytest.raises(ValueError, match="no training tokens"):
        tokenize.encode(spark, shards, f"{tmp_path}/t.json", out, val_tokens=10**9)


def test_splits_and_bins(spark, tmp_path):
    items = spark.createDataFrame([(i, f"p{i}", "c", "r") for i in range(10)], "ord long, prompt string, chosen string, rejected string")
    assert sinks.write_split(items, str(tmp_path), "dpo", 0.2, ["ord"]) == {"train": 8, "val": 2}
    assert [r.prompt for r in jsonl.read_preferences(spark, str(tmp_path / "dpo_val.jsonl")).orderBy("line").collect()] == ["p0", "p1"]
    (tmp_path / "sft.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "x"}]}) + "\n" + json.dumps({"other": 1}))
    with pytest.raises(Exception, match="no messages at .*:2"):
        jsonl.read_conversations(spark, str(tmp_path / "sft.jsonl")).collect()
    ids = spark.createDataFrame([(1, [5, 6]), (0, [65_535])], "ord long, ids array<int>")
    assert sinks.write_bin(ids, str(tmp_path / "x")) == 3
    assert np.fromfile(tmp_path / "x" / "tokens-00000.bin", "<u2").tolist() == [65_535, 5, 6]
    with pytest.raises(Exception, match="16 bits"):
        sinks.write_bin(spark.createDataFrame([(0, [70_000])], "ord long, ids array<int>"), str(tmp_path / "x"))
    assert sorted(os.listdir(tmp_path / "x")) == ["tokens-00000.bin", "tokens.index.json"]
    with pytest.raises(FileNotFoundError):
        sinks.load_meta(str(tmp_path / "none"))
    assert jsonl.load_prompts(spark, None).count() == 5
    (tmp_path / "p.jsonl").write_text('{"prompt": "one"}\n"two"\n3\n')
    assert [r.prompt for r in jsonl.load_prompts(spark, str(tmp_path / "p.jsonl")).orderBy("line").collect()] == ["one", "two", "3"]


def test_stream(spark, tmp_path):
    near = GOOD + " She told it often."
    rows = [(0, GOOD, "s", "prose"), (1, GOOD, "s", "prose"), (2, "short", "s", "prose"), (3, near, "s", "prose")]
    spark.createDataFrame(rows, "ord long, text string, source string, kind string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("ord long, text string, source string, kind string").parquet(str(tmp_path / "in"))
    stream.run(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    kept = [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert kept in ([GOOD], [near])


def test_build_keeps_every_document_once(spark, sf):
    from siltstone.plans.queries import documents

    docs = documents(spark, sf)
    a = corpus.build(docs.repartition(7), window=None)
    assert a.count() == docs.count()
    m = corpus.manifest(a).first()
    assert m.documents_in == m.dropped + m.removed_exact_duplicates + m.removed_near_duplicates + m.documents_out
    assert corpus.manifest(corpus.build(docs.limit(0))).first().documents_out == 0


def test_settings(tmp_path):
    path = tmp_path / config.NAME
    path.write_text('[data]\ndedupe_threshold = 1\n[model]\npreset = "base"\n')
    got = config.load(path, {"SILTSTONE_DATA_VAL_TOKENS": "5", "SILTSTONE_NO_SUCH": "1"})
    assert got["data"]["dedupe_threshold"] == 1.0 and got["data"]["val_tokens"] == 5 and got["model"]["preset"] == "base"
    assert config.find(tmp_path) == path and not config.problems(got)
    path.write_text(config.dumps(got))
    assert config.load(path, {}) == got
    for bad in ("[nothing]\n", "[data]\nno = 1\n", '[data]\nval_tokens = "x"\n'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load(path, {})
    assert config.problems({**got, "model": {"vocab_size": 70_000}})
    (tmp_path / "smoke.toml").write_text(config.dumps(config.smoke(got)))
    assert config.load(tmp_path / "smoke.toml", {}) == config.smoke(got) and config.problems({"train": {"dtype": "int8"}})
    assert config.smoke(got)["model"]["preset"] == "nano" and not config.problems(config.smoke(got)) and got["model"]["preset"] != "nano"
