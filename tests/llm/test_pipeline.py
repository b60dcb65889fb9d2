"""The pipeline's stages on a small corpus with planted cases."""

import random
import struct
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(1)
    stems = {"xx": ["ka", "ro", "mi", "tu"], "zz": ["lle", "eau", "oi", "ren"]}
    text = lambda lang, n: " ".join("".join(rnd.choices(stems[lang], k=rnd.randint(2, 5))) for _ in range(n)) + "."
    rows = [(i, text(lang, rnd.randint(60, 200)), lang) for i, lang in enumerate(rnd.choices(list(stems), k=80))]
    passage = text("xx", 70)
    rows += [(200, rows[0][1], "xx"), (201, rows[1][1].replace("ka", "ro", 1), "xx"), (202, "# $ " * 30, "xx"), (203, "12 34", "xx"), (204, None, "xx")]
    rows += [(300, text("xx", 60) + " " + passage, "xx"), (301, text("xx", 90) + " " + passage, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {203, 204} & kept["language_id"].keys() == set() and set(range(80)) <= kept["language_id"].keys()
    assert 202 not in kept["quality_rules"] and set(range(80)) <= kept["quality_rules"].keys()
    assert {200, 201} & kept["minhash_near_dedup"].keys() == set() and set(range(80)) | {300, 301} <= kept["minhash_near_dedup"].keys()
    assert kept["substring_dedup"][300].endswith(passage) and passage not in kept["substring_dedup"][301] and len(kept["substring_dedup"][301].split()) == 90
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Every piece of every text that the stages left, by the library's ids, in sequences without gaps.
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for doc_id, left in kept["substring_dedup"].items():
        ids = [*library.encode(left, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.add((doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert len(result) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in result} == want
    full = {}
    for r in sorted(result, key=lambda r: r["offset"]):
        assert r["offset"] == full.get(r["sequence_id"], 0)
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(full.values()) <= 4096 and len(full) <= sum(full.values()) // 4096 + 2
