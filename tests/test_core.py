"""Goldens, contracts and properties of the core engine."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texweave.functions import latex, vocabulary
from texweave.functions.vocabulary import Vocabulary
from texweave.operators import batching, metrics, model_math, policy, raster
from texweave.sources import manifest
from texweave.streaming import profile

LEXED = [
    # Fixed value of the format.
    (r"\begin{array}{cc}a&b\\c&d\end{array}", r"\begin{array} { c c } a & b \\ c & d \end{array}"),
    (r"k-m<9", "k - m < 9"),
    (r"[{u_{0}}^{w}]", "[ { u _ { 0 } } ^ { w } ]"),
    (r"\log[7]z/\pi{}", r"\log [ 7 ] z / \pi { }"),
    (r"\begin{cases}q\end{cases}", r"\begin { c a s e s } q \end { c a s e s }"),
    (r"\mu\!\sigma", r"\mu \! \sigma"),
    ("﻿é \\", "é \\"),
    ("", ""),
    (" \t\n\x1c\x85　", ""),
    ("\\operatorname*", "\\operatorname *"),
]


def text_rows(spark, rows):
    return spark.createDataFrame([(str(i), t, s) for i, (t, s) in enumerate(rows)], "id string, raw_latex string, subset string")


def test_lexer_goldens_and_idempotence(spark):
    df = spark.createDataFrame([(a,) for a, _ in LEXED] + [(None,)], "t string")
    once = [r[0] for r in df.select(latex.normalize(F.col("t"))).collect()]
    assert once == [b for _, b in LEXED] + [None]
    again = [r[0] for r in spark.createDataFrame([(x,) for x in once], "t string").select(latex.normalize(F.col("t"))).collect()]
    assert again == once


def scan(text):
    """A plain scanner to hold the pattern against."""
    found, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c != "\\":
            found.append(c)
            i += 1
        else:
            for whole in ("\\begin{array}", "\\end{array}"):
                if text.startswith(whole, i):
                    break
            else:
                j = i + 1
                while j < len(text) and text[j].isalpha():
                    j += 1
                whole = text[i : max(j, i + 2)]
            found.append(whole)
            i += len(whole)
    return found


def test_lexer_against_scanner(spark):
    rnd = random.Random(5)
    alphabet = ["\\", "{", "}", "a", "b", "é", " ", "\n", "1", "_", "\\begin{array}", "\\end{array}", "\\frac", "世", "\x1c", "$"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(latex.tokens(F.col("t"))).collect()]
    assert got == [scan(t) for t in texts]


def test_vocabulary_round_trip(spark, tmp_path):
    v = Vocabulary.core()
    assert v.tokens[:4] == vocabulary.SPECIAL and len(set(v.tokens)) == len(v)
    v.save(str(tmp_path))
    assert Vocabulary.from_saved(str(tmp_path)) == v
    (tmp_path / "v.txt").write_text("a\n\nb\n")
    assert Vocabulary.load(str(tmp_path / "v.txt"), 2).ids == {"<bos>": 0, "<pad>": 1, "<eos>": 2, "<unk>": 3, "a": 4, "b": 5}
    with pytest.raises(ValueError):
        Vocabulary.load(str(tmp_path / "v.txt"), 3)
    with pytest.raises(ValueError):
        Vocabulary(("a", "a"))
    rows = policy.measured(text_rows(spark, [(r"\frac{a}{b}+日", None)]), v)
    coded = vocabulary.decode(vocabulary.encode(rows, v), v).first()
    assert coded["ids"][0] == vocabulary.BOS and coded["ids"][-1] == vocabulary.EOS and coded["ids"].count(vocabulary.UNK) == coded["unknown"] == 1
    assert coded["decoded"] == r"\frac { a } { b } +"


SAMPLES = [("x", "SPE"), ("x + y = 2", "SPE"), ("x" + " + x" * 19, "HWE"), ("日 日", ""), ("a", None)]


def test_policies(spark):
    v, rows = Vocabulary.core(), text_rows(spark, SAMPLES)
    told = policy.measured(rows, v)
    assert [r["n"] for r in told.orderBy("id").collect()] == [3, 7, 41, 4, 3]
    keep = policy.judged(told, policy.Policy(32, "keep", "drop"))
    found = policy.report(keep, policy.Policy(32, "keep", "drop"), v, "unit")
    assert found["total_samples"] == 5 and found["accepted_samples"] == 4 and found["dropped_overlength_samples"] == 1
    assert found["unknown_token_count"] == 2 and found["unknown_sample_rate"] == 0.2 and found["unknown_token_rate"] == 2 / 58
    assert found["subset_distribution"] == {"HWE": 1, "SPE": 2, "unspecified": 2}
    assert found["sequence_length"]["p50"] == 4 and found["sequence_length"]["p99"] == 41
    with pytest.raises(policy.UnknownTokenError, match="'3'"):
        policy.enforce(told, policy.Policy(100))
    with pytest.raises(policy.OverlengthError, match="'2'"):
        policy.enforce(told, policy.Policy(32, "keep"))
    assert policy.enforce(told, policy.Policy(32, "drop", "drop")).count() == 3
    with pytest.raises(ValueError):
        policy.Policy(1)
    assert policy.statistics(keep.filter("false")).first()["unknown_token_rate"] == 0.0


def test_nearest_rank_percentiles(spark):
    rnd = random.Random(2)
    for size in (1, 2, 3, 7, 100):
        values = sorted(rnd.randint(1, 50) for _ in range(size))
        df = spark.createDataFrame([(v,) for v in values], "n int")
        for q in (0.5, 0.9, 0.95, 0.99):
            assert df.agg(policy._quantile(q)).first()[0] == values[max(1, math.ceil(q * size)) - 1]


def test_collation(spark):
    df = spark.createDataFrame([(0, [0, 90, 2]), (0, [0, 90, 11, 91, 2]), (1, [0, 2])], "batch_id int, ids array<int>")
    a, b, c = batching.collate(df).orderBy("batch_id", F.size("ids")).collect()
    assert a["decoder_input_ids"] == [0, 90, 2, 1, 1] and a["decoder_attention_mask"] == [1, 1, 1, 0, 0] and a["labels"] == [90, 2, -100, -100, -100]
    assert b["labels"] == [90, 11, 91, 2, -100] and c["decoder_input_ids"] == [0, 2]


def test_order_shards_and_shuffle(spark):
    df = spark.range(1000).repartition(7)
    numbered = batching.with_ordinal(df, "id")
    assert all(r["id"] == r["ordinal"] for r in numbered.collect())
    shards = [numbered.filter(batching.shard(F.col("ordinal"), 3) == k).count() for k in range(3)]
    assert sum(shards) == 1000 and max(shards) - min(shards) <= 1
    assert batching.with_ordinal(df.filter("id < 0"), "id").count() == 0
    one = spark.range(0, 500, 1, 2)
    out = [r[0] for r in batching.bounded_shuffle(one, 16, 7).collect()]
    assert sorted(out) == list(range(500)) and out != list(range(500)) and out == [r[0] for r in batching.bounded_shuffle(one, 16, 7).collect()]
    assert [r[0] for r in batching.bounded_shuffle(one, 1, 7).collect()] == list(range(500))
    keys = [[r[0] for r in df.orderBy(batching.permuted(F.col("id"), s), "id").collect()] for s in (1, 2)]
    assert keys[0] != keys[1] and sorted(keys[0]) == list(range(1000))


def pairs(spark, rows):
    return metrics.tokenized(spark.createDataFrame([(str(i), p, r) for i, (p, r) in enumerate(rows)], "pair_id string, prediction string, reference string"))


def test_metrics(spark):
    df = pairs(spark, [("a + b", "a + b"), ("x", "x y")])
    assert metrics.corpus_bleu(df).first()[0] == pytest.approx(0.7788007830714049)
    assert df.agg(F.avg(metrics.normalized_distance(F.col("p"), F.col("r")))).first()[0] == 0.25
    assert metrics.corpus_bleu(pairs(spark, [("", "x")])).first()[0] == 0.0
    assert metrics.corpus_bleu(pairs(spark, [("q", "x")])).first()[0] == 0.0
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choices("abcde", k=rnd.randint(0, 12))), " ".join(rnd.choices("abcde", k=rnd.randint(0, 12)))) for _ in range(60)]

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    got = {r["pair_id"]: r["x"] for r in pairs(spark, rows).select("pair_id", metrics.edit_distance(F.col("p"), F.col("r")).alias("x")).collect()}
    assert got == {str(i): distance(p.split(), r.split()) for i, (p, r) in enumerate(rows)}


def test_edit_distance_queries_take_whole_texts(spark, tmp_path):
    """Differences after token 40 count, in both queries."""
    from texweave.plans import catalog

    rnd = random.Random(7)
    turns = [rnd.choices("abcdefgh", k=n) for n in (60, 75, 41, 120, 0, 299)]
    turns.append(turns[-1][:250] + ["z"] * 49)
    spark.createDataFrame([(1, i, "user", " ".join(t)) for i, t in enumerate(turns)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    want = [distance(a, b) for a, b in zip(turns, turns[1:])]
    got = {r["pair_id"]: r["distance"] for r in catalog.token_edit_distance(spark, str(tmp_path)).collect()}
    assert got == {f"1:{i}": d for i, d in enumerate(want)}
    mean = sum(d / max(len(a), len(b), 1) for d, a, b in zip(want, turns, turns[1:])) / len(want)
    assert catalog.mean_normalized_edit_distance(spark, str(tmp_path)).first()[0] == pytest.approx(mean, abs=1e-9)


def solid(w, h, value=255):
    return np.dstack([np.full((h, w, 3), value, np.uint8), np.full((h, w), 255, np.uint8)])


def test_raster_contract():
    box = solid(64, 32)
    box[9:22, 8:47, :3] = 0
    r = raster.process(box)
    assert r["bbox"] == (8, 9, 47, 22) and r["resize_size"] == (384, 128) and r["padding"] == (0, 128, 0, 128) and not r["inverted"]
    r = raster.process(solid(32, 20))
    assert r["empty"] and r["resize_size"] == (384, 240) and r["padding"] == (0, 72, 0, 72)
    dark = solid(64, 32, 0)
    dark[9:23, 8:56, :3] = 255
    assert raster.process(dark)["inverted"]
    near = solid(16, 8)
    near[3, 3:8, :3] = 0
    near[4, 3, :3], near[4, 4, :3], near[4, 5, :3] = 199, 200, 201
    r = raster.process(near)
    assert r["bbox"] == (3, 3, 8, 5) and r["resize_size"] == (384, 154) and r["padding"] == (0, 115, 0, 115)
    hidden = solid(10, 10)
    hidden[..., 3] = 0
    hidden[..., :3] = 7
    assert raster.process(hidden)["empty"]
    assert r["tensor"].dtype == np.float32 and r["tensor"].shape == (3, 384, 384)


def test_raster_expressions_equal_numpy(spark):
    rng = np.random.default_rng(4)
    spec = raster.Spec(12, 12)
    rows = [rng.integers(0, 256, (8, 8)) for _ in range(20)] + [np.full((8, 8), 9), np.eye(8, dtype=int) * 255]
    df = spark.createDataFrame([(i, [int(v) for v in r.ravel()]) for i, r in enumerate(rows)], "i int, px array<int>")
    df = df.withColumn("px", raster.invert_if(F.col("px"), raster.border_mean(F.col("px"), 8, 8) < 127.5)).withColumn("px", raster.dynamic_range(F.col("px")))
    df = df.withColumn("box", raster.foreground_box(F.col("px"), 8, 8))
    b = F.col("box")
    df = df.select("i", raster.crop(F.col("px"), 8, b).alias("part"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))
    tw, th = raster.fit(F.col("w"), F.col("h"), spec)
    df = df.withColumns({"tw": tw, "th": th}).withColumn("rs", raster.bilinear(F.col("part"), *map(F.col, ("w", "h", "tw", "th"))))
    out = df.select("i", raster.center_pad(F.col("rs"), F.col("tw"), F.col("th"), spec).alias("px")).collect()
    for r in out:
        gray = rows[r["i"]].astype(np.uint8)
        rgba = np.dstack([gray, gray, gray, np.full((8, 8), 255, np.uint8)])
        assert (raster.process(rgba, spec)["image"].ravel() == np.array(r["px"])).all()


def test_state_mapping(spark):
    target = spark.createDataFrame([("b", [2], 0), ("a", [1], 1)], "name string, shape array<int>, pos int")
    make = lambda rows: spark.createDataFrame(rows, "name string, shape array<int>")
    good = [("encoder.a", [1]), ("encoder.b", [2]), ("decoder.x", [9])]
    assert [r["name"] for r in model_math.map_state(make(good), target).collect()] == ["b", "a"]
    for rows, words in (
        (good[:1], "missing"),
        (good + [("encoder.c", [1])], "unexpected"),
        ([("encoder.a", [3]), good[1]], "shape"),
        (good + [("encoder.a", [1])], "duplicate"),
    ):
        with pytest.raises(model_math.StateMappingError, match=words):
            model_math.map_state(make(rows), target).collect()


def test_model_arithmetic(spark):
    stages = model_math.stage_table(spark)
    counts = {r["stage"]: r["parameters"] for r in model_math.parameter_counts(stages).collect()}
    assert counts == {"stage1": 155_072, "stage2": 840_704, "stage3": 5_812_608, "stage4": 6_719_744}
    assert model_math.stem_parameters() + sum(counts.values()) == 13_553_376
    assert model_math.output_shapes(stages).orderBy("stage").collect()[-1]["tokens"] == 144
    assert all(r["ok"] for r in model_math.channel_chain(stages).collect())
    with pytest.raises(ValueError):
        model_math.check_schedule(1.0, 2.0, 0, 10)
    got = spark.range(3).select(model_math.lr_multiplier(F.col("id"), 1.0, 0.1, 2, 4)).collect()
    assert [r[0] for r in got] == [0.5, 1.0, 1.0]


def test_manifest(spark, tmp_path):
    lines = [{"id": "a", "image": "i/a.png", "raw_latex": "x", "subset": "S", "extra": 1}, {"id": 7, "image": "/abs.png", "raw_latex": None}]
    path = tmp_path / "m.jsonl"
    path.write_text(json.dumps(lines[0]) + "\n\n  \n" + json.dumps(lines[1]) + "\n")
    got = manifest.read_strict(spark, str(path)).orderBy("line").collect()
    assert [(r["line"], r["id"], r["image_path"], r["raw_latex"]) for r in got] == [(1, "a", f"{tmp_path}/i/a.png", "x"), (4, "7", "/abs.png", "None")]
    fast = manifest.read(spark, str(path)).orderBy("id").collect()
    assert [r["id"] for r in fast] == ["7", "a"] and fast[1]["subset"] == "S"
    for bad, words in (("[1]", "line 1"), ('{"id": "", "image": "x", "raw_latex": "y"}', "empty"), ('{"id": "a", "image": "x"}', "raw_latex")):
        with pytest.raises(ValueError, match=words):
            manifest.parse_line(bad, 1)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "m.jsonl").write_text(path.read_text())
    stream = manifest.stream(spark, str(folder))
    out = profile.run_available(profile.counters(stream, Vocabulary.core(), policy.Policy(32, "keep", "drop"))).collect()
    assert {r["subset"]: r["total_samples"] for r in out} == {"S": 1, "unspecified": 1}
    with pytest.raises(ValueError):
        manifest.records(spark, [{"id": "", "raw_latex": "x"}])


def test_report_file(tmp_path):
    policy.write_json({"b": 1, "a": {"ü": 2}}, str(tmp_path / "x" / "r.json"))
    assert (tmp_path / "x" / "r.json").read_text() == '{\n  "a": {\n    "ü": 2\n  },\n  "b": 1\n}\n'
    assert hashlib.sha256(("\n".join(vocabulary.Vocabulary(("a",)).tokens) + "\n").encode()).hexdigest() == vocabulary.Vocabulary(("a",)).sha256
