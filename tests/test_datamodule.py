"""Configurations, the path from manifest to batch, artifacts and golden images."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from texweave.functions.vocabulary import Vocabulary
from texweave.operators import artifacts, batching, metrics, policy, raster
from texweave.plans import config, datamodule
from texweave.sources import manifest

KNOWN = Vocabulary.core()

# The fixture corpus of the format, fixed values: id, subset, text, length with BOS and EOS, unknown tokens.
CORPUS = [
    ("short-x", "SPE", "x", 3, 0),
    ("linear", "SPE", "x + y = 2", 7, 0),
    ("fraction", "CPE", r"\frac { a + b } { c - d }", 13, 0),
    ("sqrt", "CPE", r"\sqrt { x ^ 2 + y ^ 2 }", 12, 0),
    ("scripts", "SCE", "x _ i ^ 2 + y _ j ^ 3", 13, 0),
    ("greek", "SCE", r"\alpha + \beta = \Gamma", 7, 0),
    ("array", "HWE", r"\begin{array} { c c } a & b \\ c & d \end{array}", 15, 0),
    ("sum", "HWE", r"\sum _ { i = 0 } ^ { n } i", 14, 0),
    ("delimiters", "SPE", r"\left ( \frac { x } { y } \right )", 13, 0),
    ("equality", "CPE", "a = b", 5, 0),
    ("unknown-matrix", "SCE", r"\begin { m a t r i x } a & b \\ c & d \end { m a t r i x }", 27, 2),
    ("overlength", "HWE", " + ".join("x" * 20), 41, 0),
]

# Golden rasters, fixed values: width, height, background and painted boxes (y0, y1, x0, x1, value); an alpha channel only where the background is None.
RASTERS = {
    "empty_image": (32, 20, 255, []),
    "near_threshold": (16, 8, 255, [(3, 4, 3, 8, 0), (4, 5, 3, 4, 199), (4, 5, 4, 5, 200), (4, 5, 5, 6, 201)]),
    "one_pixel_foreground": (9, 7, 255, [(3, 4, 4, 5, 0)]),
    "simple_black_formula": (64, 32, 255, [(9, 12, 8, 24, 0), (19, 22, 8, 24, 0), (9, 22, 15, 18, 0), (14, 17, 31, 47, 0), (9, 22, 38, 41, 0)]),
    "tall_formula": (30, 160, 255, [(5, 155, 13, 16, 0), (20, 24, 7, 23, 0), (78, 82, 7, 23, 0), (136, 140, 7, 23, 0)]),
    "transparent_background": (80, 40, None, [(10, 14, 12, 68, 0), (24, 28, 12, 68, 0), (10, 28, 38, 42, 0)]),
    "white_on_black": (64, 32, 0, [(9, 12, 8, 56, 255), (20, 23, 8, 56, 255), (9, 23, 30, 34, 255)]),
    "wide_formula": (160, 30, 255, [(11, 14, 5, 155, 0), (7, 19, 18, 22, 0), (7, 19, 78, 82, 0), (7, 19, 138, 142, 0)]),
}
# Digests of the processed image and tensor of each golden raster, fixed values.
DIGESTS = {
    "empty_image": ("5d43ef4c92530741d2b4fd10fe5bdde293012d99f94163e290f2d4ed42806b29", "ac621f05060c1c3ccd971c9f98a5ca2c5b19612990133d4621fc6387577a8a67"),
    "near_threshold": ("52c3337bb903646c83ffafbfb67299d3e436b2c5be9228079065ab0fb98b3068", "686795b5bbd56467b61a3c4fe288371e47c034dce1e18f0e0127af4298237fb6"),
    "one_pixel_foreground": ("8123c216413f82bbaa0339c27a43d9822c2a043e20662b27c97874429b996e9a", "adb110635a404d5299ab493f077342b715c4ad1ff9de06bb7ce85e89d56bb038"),
    "simple_black_formula": ("f34ad56d48f3131a1386ad9034c55cabfbbc4f161f0db269afe1095a61ca113a", "4c625e72e0cef0dd6c18f6cbb2057e18bdbedc1e1a908700e8c74bd9c688af76"),
    "tall_formula": ("1a41efe06e2ddc6cc602569ed595f5cfc1ff3387acdb0bc43c7d9e0684d88918", "cb42eee068a1c8aaa509641611993f7f2b33f5ae16bf055ccaa31b02d53d22ad"),
    "transparent_background": ("edd5fd0e483f0cf7ab43272bb76dc96075921def4a0b14baea8af2f93af0eb8d", "2477e5ee50cbda4385aeda073cdc6675567d7c504800f233125c3908c8f53e59"),
    "white_on_black": ("2269bba1cd6810d1c5e0222f3530079e42ef34cfe8e53a5d0293241beb024ac2", "7738be12c483dbc0300ad3e911320682dbad99809fce86a26ed4e3d23f4d5229"),
    "wide_formula": ("dcee76ba43cbcd4f3236409b438b3d9108c8757f5554a6823018fd17d3613dbc", "6c72a5c5417b0f2923591b58b67bc0f5bc47d49f34721bda4517de8596aa04c2"),
}


def painted(name):
    width, height, background, boxes = RASTERS[name]
    image = np.full((height, width, 4), 255 if background is None else background, np.uint8)
    image[..., 3] = 0 if background is None else 255
    if background is None:
        image[..., :3] = 0
        image[0:5, 0:5, :3] = (255, 0, 0)
    for y0, y1, x0, x1, value in boxes:
        image[y0:y1, x0:x1] = (value, value, value, 255)
    return image


def written(tmp_path, rows, name="manifest.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps({"id": i, "image": f"{i}.png", "raw_latex": t, "subset": s, "source": "fixture"}) for i, s, t, *_ in rows) + "\n\n", encoding="utf-8")
    return f"file://{path}"


def test_golden_images(spark):
    rows = spark.createDataFrame([(n, bytearray(painted(n).tobytes()), w, h) for n, (w, h, *_) in RASTERS.items()], "id string, data binary, width int, height int")
    assert rows.filter(~artifacts.valid_raster(F.col("data"), F.col("width"), F.col("height"))).count() == 0
    got = {r["id"]: (r["image_sha256"], r["tensor_sha256"]) for r in raster.preprocess(rows).collect()}
    assert got == DIGESTS


def test_profile_of_the_fixture_corpus(spark, tmp_path):
    rows = manifest.read(spark, written(tmp_path, CORPUS))
    measured = policy.measured(rows, KNOWN)
    assert {r["id"]: (r["n"], r["unknown"]) for r in measured.collect()} == {i: (n, u) for i, _, _, n, u in CORPUS}
    keep = policy.Policy(32, "keep", "drop")
    sides = spark.createDataFrame([(i, 10 + k, 7 + k) for k, (i, *_) in enumerate(CORPUS)], "id string, width int, height int")
    report = policy.report(policy.judged(measured, keep).join(sides, "id"), keep, KNOWN, "fixture")
    assert (report["total_samples"], report["accepted_samples"], report["unknown_token_count"], report["dropped_overlength_samples"]) == (12, 11, 2, 1)
    assert report["unknown_sample_rate"] == pytest.approx(0.08333333333333333) and report["unknown_token_rate"] == pytest.approx(0.011764705882352941)
    lengths = report["sequence_length"]
    assert [lengths[k] for k in ("p50", "p90", "p95", "p99", "max", "count")] == [13, 27, 41, 41, 41, 12] and lengths["mean"] == pytest.approx(14.166666666666666)
    assert report["subset_distribution"] == {"CPE": 3, "HWE": 3, "SCE": 3, "SPE": 3} and report["accepted_subset_distribution"]["HWE"] == 2
    assert report["image_dimensions"] == {"count": 11, "min_width": 10, "max_width": 20, "mean_width": 15.0, "min_height": 7, "max_height": 17, "mean_height": 12.0}
    assert policy.enforce(measured, policy.Policy(32, "drop", "drop")).count() == 10
    with pytest.raises(policy.UnknownTokenError, match="unknown-matrix"):
        policy.enforce(measured, policy.Policy(64, "error", "drop"))
    with pytest.raises(policy.OverlengthError, match="overlength"):
        policy.enforce(measured, policy.Policy(32, "keep", "error"))
    empty = policy.report(policy.judged(policy.measured(rows.limit(0), KNOWN), keep), keep, KNOWN, "none")
    assert empty["total_samples"] == 0 and empty["unknown_sample_rate"] == 0.0 and empty["image_dimensions"] is None


def test_batches_of_a_split(spark, tmp_path):
    path = written(tmp_path, CORPUS[:10])
    data = config.DataConfig.of({"train_manifest": path, "val_manifest": path, "batch_size": 4, "ignored": 1, "max_sequence_length": 32})
    module = datamodule.DataModule(spark, data, KNOWN)
    with pytest.raises(RuntimeError):
        module.loader("train")
    module.setup("validate")
    assert list(module.splits) == ["val"] and module.count("val") == 10
    found = module.loader("val").collect()
    assert sorted((r["batch_id"], r["position"]) for r in found) == [(k // 4, k % 4) for k in range(10)]
    assert [r["id"] for r in sorted(found, key=lambda r: (r["batch_id"], r["position"]))] == [i for i, *_ in CORPUS[:10]]
    for r in found:
        n = next(n for i, _, _, n, _ in CORPUS if i == r["id"])
        longest = max(len(x["decoder_input_ids"]) for x in found if x["batch_id"] == r["batch_id"])
        ids = [0, *(KNOWN.ids[t] for t in r["normalized_latex"].split()), 2]
        assert r["decoder_input_ids"] == ids + [1] * (longest - n) and r["decoder_attention_mask"] == [1] * n + [0] * (longest - n)
        assert r["labels"] == ids[1:] + [-100] * (longest - n + 1)
    whole = {r["batch_id"]: r for r in datamodule.gathered(module.loader("val")).collect()}
    assert [whole[k]["size"] for k in range(3)] == [4, 4, 2] and whole[0]["id"] == [i for i, *_ in CORPUS[:4]] and whole[2]["subset"] == ["SPE", "CPE"]
    assert {r["batch_id"] for r in module.loader("val", limit=2).collect()} == {0, 1}
    assert [r["id"] for r in datamodule.nth(module.splits["val"], 3).collect()] == ["sqrt"] and datamodule.nth(module.splits["val"], 10).count() == 0
    module.setup("fit")
    module.setup("fit")
    order = lambda m: [r["id"] for r in m.splits["train"].orderBy("ordinal").collect()]
    again = datamodule.DataModule(spark, data, KNOWN)
    again.setup("fit")
    assert order(module) == order(again) != [i for i, *_ in CORPUS[:10]] and sorted(order(module)) == sorted(i for i, *_ in CORPUS[:10])
    streamed = datamodule.DataModule(spark, config.DataConfig(train_manifest=path, val_manifest=path, streaming=True, shuffle_buffer_size=4), KNOWN)
    streamed.setup("fit")
    assert sorted(order(streamed)) == sorted(order(module))
    with pytest.raises(ValueError, match="test"):
        module.setup()


def test_batch_guards(spark):
    rows = spark.createDataFrame([("a", [0, 5, 2]), ("b", [0, 5, 5, 2])], "id string, ids array<int>")
    assert datamodule.guarded(rows, 4).collect() == rows.collect()
    with pytest.raises(Exception, match="sample b has 4 ids"):
        datamodule.guarded(rows, 3).collect()
    for ids in ([5, 2], [0, 5], [0], []):
        with pytest.raises(Exception, match="BOS and EOS"):
            datamodule.guarded(spark.createDataFrame([("c", ids)], "id string, ids array<int>"), 9).collect()
    with pytest.raises(ValueError):
        datamodule.guarded(rows, 1)
    stored = spark.createDataFrame([("a", "x+y", "y"), ("b", "x+y", None)], "id string, raw_latex string, normalized_latex string")
    assert [r[0] for r in stored.orderBy("id").select(datamodule.normalized(stored)).collect()] == ["y", "x + y"]
    none = spark.createDataFrame([], "ordinal long, id string, subset string, source string, raw_latex string")
    assert datamodule.batches(none, KNOWN, 4, 9).count() == 0


def test_ordinals_of_equal_keys_and_wide_rows(spark):
    rows = spark.createDataFrame([(k % 5 if k % 7 else None, f"v{k}") for k in range(60)], "k long, v string")
    got = batching.with_ordinal(rows, "k").collect()
    assert sorted(r["ordinal"] for r in got) == list(range(60)) and sorted(r["v"] for r in got) == sorted(f"v{k}" for k in range(60))
    ordered = [r["k"] for r in sorted(got, key=lambda r: r["ordinal"])]
    assert ordered == sorted(ordered, key=lambda k: (k is not None, k or 0))
    assert batching.with_ordinal(rows.limit(0), "k").count() == 0


def stages():
    table = [(48, 48, 128, 1, 6, 3, False, False), (128, 96, 512, 1, 6, 3, True, False), (512, 192, 1024, 3, 6, 5, True, True), (1024, 384, 2048, 1, 6, 5, True, True)]
    names = ("in_channels", "mid_channels", "out_channels", "num_blocks", "num_layers", "kernel_size", "downsample", "use_light_conv")
    return {f"stage{k}": dict(zip(names, row)) for k, row in enumerate(table, 1)}


def test_configurations():
    plain = {"input_size": 384, "encoder_hidden_size": 2048, "stem_channels": [3, 32, 48], "stage_config": stages(), "activation": "relu"}
    encoder = config.EncoderConfig.of(plain)
    assert encoder.image_size == 384 and encoder.hidden_size == 2048 and encoder == config.EncoderConfig.of(plain | {"image_size": 384, "hidden_size": 2048, "input_size": 1})
    assert encoder.sha256 == hashlib.sha256(json.dumps(encoder.architecture(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert encoder.sha256 != config.EncoderConfig.of(plain | {"batch_norm_eps": 1e-6}).sha256

    def changed(stage, **values):
        told = stages()
        told[stage] |= values
        return plain | {"stage_config": told}

    for wrong in (plain | {"input_size": 100}, plain | {"activation": "gelu"}, plain | {"stem_channels": [3, 48]}, plain | {"stem_channels": [1, 32, 48]}, plain | {"encoder_hidden_size": 7}, plain | {"batch_norm_eps": 0}, plain | {"initialization": "x"}, changed("stage2", in_channels=5), changed("stage1", kernel_size=4), changed("stage1", num_blocks=0), changed("stage3", other=1), plain | {"stage_config": {k: v for k, v in stages().items() if k != "stage4"}}):
        with pytest.raises(config.ConfigError):
            config.EncoderConfig.of(wrong)
    sizes = {"vocab_size": 687, "decoder_hidden_size": 384, "decoder_layers": 2, "decoder_attention_heads": 16, "decoder_ffn_dim": 1536, "max_position_embeddings": 1027}
    ids = {"bos_token_id": 0, "pad_token_id": 1, "eos_token_id": 2, "unk_token_id": 3, "decoder_start_token_id": 0, "tie_word_embeddings": False}
    model = config.ModelConfig.of(plain | sizes | ids)
    assert model == config.ModelConfig(encoder) and model.encoder_hidden_size == 2048 and model.decoder()["d_model"] == 384 and model.decoder()["forced_eos_token_id"] == 2
    for wrong in ({"decoder_layers": 0}, {"decoder_attention_heads": 7}, {"eos_token_id": 687}, {"unk_token_id": 2}, {"decoder_start_token_id": 1}, {"tie_word_embeddings": True}):
        with pytest.raises(config.ConfigError):
            config.ModelConfig.of(plain | sizes | ids | wrong)
    for wrong in ({"batch_size": 0}, {"num_workers": -1}, {"image_size": 0}, {"unknown_policy": "maybe"}, {"overlength_policy": "keep"}, {"max_sequence_length": 1}):
        with pytest.raises(ValueError):
            config.DataConfig.of(wrong)
    config.check_image_size(config.DataConfig(), model)
    with pytest.raises(config.ConfigError):
        config.check_image_size(config.DataConfig(image_size=64), model)
    for wrong in ((0, 1, False), (5, 2, False), (5, 1, True)):
        with pytest.raises(config.ConfigError):
            config.check_generation(*wrong)


def test_initialization_modes():
    """All combinations of mode, weights and checkpoint."""
    told = {}
    for mode in ("scratch", "pretrained", "resume", "other"):
        for weights in (None, "w"):
            for checkpoint in (None, "c"):
                try:
                    told[mode, weights, checkpoint] = config.initialization_mode({"init_mode": mode, "pretrained_path": weights, "resume_from_checkpoint": checkpoint})
                except config.ConfigError:
                    pass
    assert told == {("scratch", None, None): "scratch", ("pretrained", "w", None): "pretrained", ("scratch", None, "c"): "resume", ("resume", None, "c"): "resume"}
    assert config.monitor(True) == ("BLEU", "max") and config.checkpoint_name(3, 1200, 0.5) == "best-03-1200-0.5000" and config.worker_seed(2**32 + 5) == 5
    assert config.absolute(None, "/b") is None and config.absolute("a/c", "/b") == "/b/a/c" and config.absolute("/x", "/b") == "/x"
    base = {"data": {"batch_size": 16, "name": "d"}, "seed": 1}
    assert config.compose(base, "data.batch_size=4", "data.name=tiny", "+trainer.limit=2") == {"data": {"batch_size": 4, "name": "tiny"}, "seed": 1, "trainer": {"limit": 2}} and base["data"]["batch_size"] == 16
    for wrong in ("data.other=1", "none.batch_size=1"):
        with pytest.raises(config.ConfigError):
            config.compose(base, wrong)


def test_artifacts_and_specs(spark, tmp_path):
    files = [("a", "z.json", b"{}"), ("a", "b.json", b"\0x"), ("b", "one", b"")]
    got = {r["artifact"]: r["sha256"] for r in artifacts.artifact_sha256(spark.createDataFrame([(a, n, bytearray(p)) for a, n, p in files], "artifact string, name string, payload binary")).collect()}
    assert got == {"a": hashlib.sha256(b"b.json\0\0x\0z.json\0{}\0").hexdigest(), "b": hashlib.sha256(b"one\0\0").hexdigest()}
    one = spark.range(1).select(artifacts.fixture_sha256(F.lit(bytearray(b"i")), F.lit(bytearray(b"g")), F.lit(bytearray(b"t")), F.lit(config.canonical_json({"b": 1, "a": [2]})))).first()[0]
    assert one == hashlib.sha256(b'igt{"a":[2],"b":1}').hexdigest()
    artifacts.save_spec(raster.Spec(48, 32), str(tmp_path / "x" / "spec.json"))
    assert artifacts.load_spec(str(tmp_path / "x" / "spec.json")) == raster.Spec(48, 32)
    for wrong in ("[]", json.dumps(raster.Spec().to_dict() | {"resize": "nearest"}), json.dumps(raster.Spec().to_dict() | {"std": 0})):
        (tmp_path / "bad.json").write_text(wrong)
        with pytest.raises(ValueError):
            artifacts.load_spec(str(tmp_path / "bad.json"))
    ids = spark.range(1).select(artifacts.pair_ids(F.array(F.lit(7)), F.array(F.lit(8), F.lit(9)), 0, 2)).first()[0]
    assert ids == [0, 7, 2, 8, 9, 2]
    for call in (lambda: artifacts.activation("gelu", F.lit(1)), lambda: artifacts.pad_right_bottom(F.array(), 1, 1, -1)):
        with pytest.raises(ValueError):
            call()


def test_edit_distance_beyond_one_plane(spark):
    """More distinct tokens in a pair than the letters before the surrogates."""
    places = [1, 35_327, 35_328, 36_000]
    rows = spark.createDataFrame([(p,) for p in places], "p int")
    assert [ord(r[0]) for r in rows.orderBy("p").select(metrics.letter(F.col("p"))).collect()] == [0x4E01, 0x4E00 + 35_327, 0x10000 + 35_328, 0x10000 + 36_000]
    one = spark.range(1).select(metrics.edit_distance(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("x"), F.lit("c"), F.lit("d")))).first()[0]
    assert one == 2
