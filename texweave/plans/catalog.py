"""All queries of the core engine by name, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texweave.functions import latex, vocabulary
from texweave.operators import artifacts, batching, metrics, model_math, policy, raster
from texweave.plans import datamodule, views
from texweave.plans.views import VOCABULARY
from texweave.streaming import profile

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---- pieces of SQL ---------------------------------------------------------


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


REC = "rec AS (SELECT doc_id::VARCHAR AS id, doc_id, text AS raw, lang AS subset, source FROM documents)"
TOK = f"{REC}, tok AS (SELECT *, regexp_extract_all(replace(nfc_normalize(raw), chr(65279), ''), '{latex.TOKEN_RE2}') AS tokens FROM rec)"
MEAS = f"{TOK}, meas AS (SELECT *, len(tokens) + 2 AS n, len(list_filter(tokens, lambda t: t NOT IN ({_quoted(VOCABULARY.entries)}))) AS unknown FROM tok)"
JUDGED = f"{MEAS}, judged AS (SELECT *, n > {views.MAX_LENGTH} AS over, n <= {views.MAX_LENGTH} AS accepted FROM meas)"
STATS = """count(*) AS total_samples, count(*) FILTER (WHERE accepted) AS accepted_samples, count(*) FILTER (WHERE unknown > 0) AS unknown_samples,
 coalesce(sum(unknown), 0)::BIGINT AS unknown_token_count, 0::BIGINT AS dropped_unknown_samples, count(*) FILTER (WHERE over) AS overlength_samples,
 count(*) FILTER (WHERE over) AS dropped_overlength_samples, CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) FILTER (WHERE unknown > 0))::DOUBLE / count(*) END AS unknown_sample_rate,
 CASE WHEN coalesce(sum(n), 0) = 0 THEN 0.0 ELSE sum(unknown)::DOUBLE / sum(n)::DOUBLE END AS unknown_token_rate, max(n)::INT AS max, sum(n)::DOUBLE / count(*) AS mean,
 quantile_disc(n, 0.5)::INT AS p50, quantile_disc(n, 0.9)::INT AS p90, quantile_disc(n, 0.95)::INT AS p95, quantile_disc(n, 0.99)::INT AS p99"""
SUBSET = "CASE WHEN coalesce(subset, '') = '' THEN 'unspecified' ELSE subset END"
VOCAB = f"vocab AS (SELECT unnest(range({len(VOCABULARY)}))::INT AS token_id, unnest([{_quoted(VOCABULARY.tokens)}]) AS token)"
IDMAP = f"MAP([{_quoted(VOCABULARY.tokens)}], range({len(VOCABULARY)}))"
IDS = f"{MEAS}, ids AS (SELECT *, list_concat([0], list_transform(tokens, lambda t: coalesce({IDMAP}[t], 3)), [2]) AS ids FROM meas)"
WS = r"[^\x09-\x0d\x1c-\x20\x{85}\pZ]+"


def _pairs_sql() -> str:
    side = lambda c: f"regexp_extract_all({c}, '{WS}')"
    return f"""turns AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
pairs AS (SELECT conv_id || ':' || turn AS pair_id, {side('text')} AS p, {side('ref')} AS r FROM turns WHERE ref IS NOT NULL)"""


def _grams_sql(side: str) -> str:
    return " UNION ALL ".join(f"SELECT pair_id, {k} AS ord, unnest(list_transform(range(1, greatest(len({side}) - {k - 1}, 0) + 1), lambda j: array_to_string({side}[j:j + {k - 1}], ' '))) AS gram FROM pairs" for k in range(1, 5))


GRAMS = f"""{_pairs_sql()}, pg AS (SELECT pair_id, ord, gram, count(*) AS n FROM ({_grams_sql('p')}) GROUP BY ALL), rg AS (SELECT pair_id, ord, gram, count(*) AS m FROM ({_grams_sql('r')}) GROUP BY ALL),
clip AS (SELECT pair_id, ord, sum(least(n, coalesce(m, 0)))::BIGINT AS matches, sum(n)::BIGINT AS total FROM pg LEFT JOIN rg USING (pair_id, ord, gram) GROUP BY ALL),
pooled AS (SELECT ord, sum(matches)::BIGINT AS matches, sum(total)::BIGINT AS total FROM clip GROUP BY ord)"""
GRAY = "g0 AS (SELECT vec_id, list_transform(embedding, lambda v: least(255, greatest(0, floor(v::DOUBLE * 256 + 128)))::INT) AS px FROM embeddings)"
BORDER = "[i for i in range(64) if i < 8 or i >= 56 or i % 8 = 0 or i % 8 = 7]"
POL = f"{GRAY}, g1 AS (SELECT *, list_sum(list_transform({BORDER}, lambda i: px[i + 1]))::DOUBLE / 28 AS border FROM g0), g2 AS (SELECT vec_id, border, border < 127.5 AS inverted, CASE WHEN border < 127.5 THEN list_transform(px, lambda v: 255 - v) ELSE px END AS pol FROM g1)"
RANGE = f"{POL}, g3 AS (SELECT *, list_min(pol) AS lo, list_max(pol) - list_min(pol) AS span FROM g2), g4 AS (SELECT vec_id, inverted, CASE WHEN span = 0 THEN pol ELSE list_transform(pol, lambda v: (((v - lo) * 255 + span // 2) // span)::INT) END AS st FROM g3)"
BOX = f"""{RANGE}, g5 AS (SELECT *, list_filter(range(64), lambda i: st[i + 1] < 200) AS hits FROM g4),
g6 AS (SELECT *, len(hits) = 0 AS empty, coalesce(list_min(list_transform(hits, lambda i: i % 8)), 0)::INT AS x0, coalesce(list_min(list_transform(hits, lambda i: i // 8)), 0)::INT AS y0,
 coalesce(list_max(list_transform(hits, lambda i: i % 8)) + 1, 8)::INT AS x1, coalesce(list_max(list_transform(hits, lambda i: i // 8)) + 1, 8)::INT AS y1 FROM g5)"""
SIDE = 12
CROP = f"""{BOX}, g7 AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, list_transform(list_filter(range(64), lambda i: i % 8 >= x0 AND i % 8 < x1 AND i // 8 >= y0 AND i // 8 < y1), lambda i: st[i + 1]) AS part FROM g6)"""
FIT = f"""{CROP}, g8 AS (SELECT *, least({SIDE}.0::DOUBLE / w, {SIDE}.0::DOUBLE / h) AS scale FROM g7),
g9 AS (SELECT *, least({SIDE}, greatest(1, floor(w * scale + 0.5)::INT)) AS tw, least({SIDE}, greatest(1, floor(h * scale + 0.5)::INT)) AS th FROM g8)"""
_X, _Y = "((i % tw) + 0.5::DOUBLE) * w / tw - 0.5", "((i // tw) + 0.5::DOUBLE) * h / th - 0.5"


def _tap(y: str, x: str) -> str:
    return f"part[least(greatest({y}, 0), h - 1)::INT * w + least(greatest({x}, 0), w - 1)::INT + 1]::DOUBLE"


def _mix(y: str) -> str:
    wx = f"(({_X}) - floor({_X}))"
    return f"({_tap(y, f'floor({_X})')} * (1 - {wx}) + {_tap(y, f'floor({_X}) + 1')} * {wx})"


_WY = f"(({_Y}) - floor({_Y}))"
RESIZE = f"""{FIT}, g10 AS (SELECT *, list_transform(range(tw * th), lambda i: least(greatest(floor({_mix(f'floor({_Y})')} * (1 - {_WY}) + {_mix(f'floor({_Y}) + 1')} * {_WY} + 0.5), 0), 255)::INT) AS rs FROM g9)"""
PADDED = f"""{RESIZE}, g11 AS (SELECT *, ({SIDE} - tw) // 2 AS l, ({SIDE} - th) // 2 AS t FROM g10),
g12 AS (SELECT *, list_transform(range({SIDE * SIDE}), lambda i: CASE WHEN i % {SIDE} >= l AND i % {SIDE} < l + tw AND i // {SIDE} >= t AND i // {SIDE} < t + th THEN rs[(i // {SIDE} - t) * tw + i % {SIDE} - l + 1] ELSE 0 END::INT) AS cv FROM g11)"""
LOGITS = "lg AS (SELECT vec_id, embedding AS z, CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS label FROM embeddings)"
SRC = "src AS (SELECT (CASE WHEN doc_id % 11 = 0 THEN 'decoder.' ELSE 'encoder.' END) || 'w' || doc_id AS name, [(doc_id % 5)::INT, 3] AS shape FROM documents), sel AS (SELECT substr(name, 9) AS name, shape FROM src WHERE starts_with(name, 'encoder.'))"
TGT = "tgt AS (SELECT 'w' || doc_id AS name, [(doc_id % 5)::INT, (3 + toxic)::INT] AS shape, doc_id AS pos FROM labels)"
STAGES = "st AS (SELECT * FROM (VALUES " + ", ".join("('{}', {}, {}, {}, {}, {}, {}, {}, {})".format(*s) for s in model_math.STAGES) + ") t(stage, in_ch, mid_ch, out_ch, blocks, layers, kernel, down, light))"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _joined(c, name: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(name)


# ---- profile ---------------------------------------------------------------


@query(f"WITH {JUDGED} SELECT {STATS} FROM judged")
def profile_report(spark: SparkSession, d: str) -> DataFrame:
    return policy.statistics(views.judged(spark, d))


@query(f"WITH {JUDGED} SELECT {SUBSET} AS subset, {STATS} FROM judged GROUP BY 1")
def profile_by_subset(spark: SparkSession, d: str) -> DataFrame:
    return policy.statistics(views.judged(spark, d).withColumn("subset", policy.subset_name(F.col("subset"))), "subset")


@query(f"WITH {REC} SELECT {SUBSET} AS subset, count(*) AS n FROM (SELECT nullif(subset, 'es') AS subset FROM rec) GROUP BY 1")
def subset_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = views.records(spark, d).withColumn("subset", F.nullif("subset", F.lit("es")))
    return rows.groupBy(policy.subset_name(F.col("subset")).alias("subset")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JUDGED} SELECT {SUBSET} AS subset, count(*) AS n FROM judged WHERE accepted GROUP BY 1")
def accepted_subset_distribution(spark: SparkSession, d: str) -> DataFrame:
    return views.judged(spark, d).filter("accepted").groupBy(policy.subset_name(F.col("subset")).alias("subset")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT (len(tokens) + 2)::INT AS length, count(*) AS n FROM tok GROUP BY 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = views.records(spark, d).select((F.size(latex.tokens(latex.clean(F.col("raw_latex")))) + 2).alias("length"))
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOK} SELECT quantile_disc(len(tokens) + 2, 0.5)::INT AS p50, quantile_disc(len(tokens) + 2, 0.9)::INT AS p90, quantile_disc(len(tokens) + 2, 0.95)::INT AS p95, quantile_disc(len(tokens) + 2, 0.99)::INT AS p99 FROM tok")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = views.records(spark, d).select((F.size(latex.tokens(latex.clean(F.col("raw_latex")))) + 2).alias("n"))
    return rows.agg(*(F.expr(f"cast(percentile_disc({q}) within group (order by n) as int)").alias(p) for q, p in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))))


@query(f"WITH {TOK} SELECT quantile_disc(len(tokens) + 2, 0.5)::INT AS p50, quantile_disc(len(tokens) + 2, 0.99)::INT AS p99 FROM tok")
def length_percentiles_by_window(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    histogram = length_histogram(spark, d)  # a row per distinct length
    running = histogram.withColumns({"upto": F.sum("n").over(Window.orderBy("length")), "all": F.sum("n").over(Window.partitionBy())})
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * q)), F.col("length")))
    return running.agg(at(0.5).alias("p50"), at(0.99).alias("p99"))


# ---- lexer and tokenizer ---------------------------------------------------


@query(f"WITH {TOK} SELECT id, len(tokens)::INT AS n, tokens[1] AS first, tokens[-1] AS last FROM tok")
def lex_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = latex.tokens(latex.clean(F.col("raw_latex")))
    return views.records(spark, d).select("id", t.alias("t")).select("id", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"))


@query(f"WITH {TOK} SELECT id, array_to_string(tokens, ' ') AS normalized FROM tok")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return views.records(spark, d).select("id", latex.normalize(F.col("raw_latex")).alias("normalized"))


@query(f"WITH {REC}, x AS (SELECT id, chr(65279) || 'e' || chr(769) || ' A' || chr(778) || raw AS t FROM rec) SELECT id, array_to_string(regexp_extract_all(replace(nfc_normalize(t), chr(65279), ''), '{latex.TOKEN_RE2}'), ' ') AS normalized FROM x")
def normalize_nfc_bom(spark: SparkSession, d: str) -> DataFrame:
    return views.records(spark, d).select("id", latex.normalize(F.concat(F.lit("﻿é Å"), "raw_latex")).alias("normalized"))


@query(rf"WITH {REC}, x AS (SELECT id, '\begin{{array}}{{c}}\frac{{' || raw || '}}\,\alpha_1\\\end{{array}}\begin {{x}}\' AS t FROM rec) SELECT id, array_to_string(regexp_extract_all(t, '{latex.TOKEN_RE2}'), ' ') AS normalized FROM x")
def lex_latex_derived(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(r"\begin{array}{c}\frac{"), "raw_latex", F.lit("}\\,\\alpha_1\\\\\\end{array}\\begin {x}\\"))
    return views.records(spark, d).select("id", latex.normalize(text).alias("normalized"))


@query(f"WITH {IDS} SELECT id, array_to_string(ids, ' ') AS ids FROM ids")
def encode_ids(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.encode(views.measured(spark, d), VOCABULARY).select("id", _joined("ids", "ids"))


@query(f"WITH {IDS} SELECT id, array_to_string(ids[2:-2], ' ') AS ids FROM ids")
def encode_no_special(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.encode(views.measured(spark, d), VOCABULARY, special=False).select("id", _joined("ids", "ids"))


@query(f"WITH {MEAS} SELECT id, array_to_string(list_filter(tokens, lambda t: t IN ({_quoted(VOCABULARY.entries)})), ' ') AS decoded FROM meas")
def decode_ids(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.decode(vocabulary.encode(views.measured(spark, d), VOCABULARY), VOCABULARY).select("id", "decoded")


@query(f"WITH {MEAS} SELECT id, unknown::INT AS unknown FROM meas")
def unknown_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.measured(spark, d).select("id", "unknown")


@query(f"WITH {TOK}, {VOCAB} SELECT token, coalesce(token_id, 3)::INT AS token_id, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tok) LEFT JOIN vocab USING (token) GROUP BY ALL")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    counted = views.records(spark, d).select(F.explode(latex.tokens(latex.clean(F.col("raw_latex")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(VOCABULARY.table(spark)), "token", "left").select("token", F.coalesce("token_id", F.lit(3)).alias("token_id"), "n")  # the vocabulary is a fixed size


@query(f"WITH {VOCAB} SELECT sha256(string_agg(token, chr(10) ORDER BY token_id) || chr(10)) AS sha256, count(*) AS size, count(DISTINCT token) AS distinct_tokens FROM vocab")
def vocab_sha256(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token"))), lambda x: x["token"]), "\n")
    return VOCABULARY.table(spark).agg(F.sha2(F.concat(lines, F.lit("\n")).cast("binary"), 256).alias("sha256"), F.count(F.lit(1)).alias("size"), F.count_distinct("token").alias("distinct_tokens"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def row_sha256(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


# ---- policies, records, order ----------------------------------------------


@query(f"WITH {JUDGED} SELECT id FROM judged WHERE accepted AND unknown = 0")
def policy_drop_drop(spark: SparkSession, d: str) -> DataFrame:
    return views.judged(spark, d, views.DROP_DROP).filter("accepted").select("id")


@query(f"WITH {JUDGED} SELECT id FROM judged WHERE accepted")
def policy_keep_drop(spark: SparkSession, d: str) -> DataFrame:
    return views.judged(spark, d).filter("accepted").select("id")


@query(f"WITH {JUDGED} SELECT id, CASE WHEN unknown > 0 THEN 'unknown' ELSE 'overlength' END AS reason, n::INT AS n, unknown::INT AS unknown FROM judged WHERE unknown > 0 OR over")
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = views.judged(spark, d).filter("unknown > 0 or overlength")
    return rows.select("id", F.when(F.col("unknown") > 0, "unknown").otherwise("overlength").alias("reason"), "n", "unknown")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS subset, source, '/data/img/' || doc_id || '.png' AS image_path FROM documents WHERE doc_id % 5 <> 0")
def record_coercion(spark: SparkSession, d: str) -> DataFrame:
    from texweave.sources.manifest import MANIFEST, resolve

    c = F.col
    line = F.when(c("doc_id") % 5 == 0, "  ").otherwise(F.to_json(F.struct(c("doc_id").alias("id"), F.concat(F.lit("img/"), c("doc_id").cast("string"), F.lit(".png")).alias("image"), c("text").alias("raw_latex"), F.when(c("doc_id") % 3 != 0, c("lang")).alias("subset"), "source", F.lit(1).alias("extra"))))
    parsed = views.table(spark, d, "documents").select(line.alias("line")).filter(F.length(F.trim("line")) > 0).select(F.from_json("line", MANIFEST).alias("r"))
    return parsed.select("r.id", "r.subset", "r.source", resolve(F.col("r.image"), "/data").alias("image_path"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/abs/' || page_id ELSE '/base/../x/' || page_id END AS path FROM pages")
def image_path_resolution(spark: SparkSession, d: str) -> DataFrame:
    from texweave.sources.manifest import resolve

    image = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/abs/"), "page_id")).otherwise(F.concat(F.lit("../x/"), "page_id"))
    return views.table(spark, d, "pages").select("page_id", resolve(image, "/base").alias("path"))


@query(r"SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x09-\x0d\x1c-\x20\x{85}\pZ]') GROUP BY doc_id")
def blank_line_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = views.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.col("line").rlike(rf"[^{latex.WHITE}]")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


ORD = "o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)"


@query(f"WITH {ORD} SELECT doc_id, ordinal, ordinal % 4 AS shard FROM o")
def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = batching.with_ordinal(views.table(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", "ordinal", batching.shard(F.col("ordinal"), 4).alias("shard"))


@query(f"WITH {ORD} SELECT doc_id, ordinal // 16 AS batch_id, ordinal % 16 AS pos FROM o")
def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = batching.with_ordinal(views.table(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", batching.batch(F.col("ordinal"), 16).alias("batch_id"), (F.col("ordinal") % 16).alias("pos"))


COLLATED = f"""{IDS}, acc AS (SELECT id, doc_id, ids, n, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM ids WHERE n <= {views.MAX_LENGTH}),
col AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS longest FROM acc)"""


def _collated(spark: SparkSession, d: str) -> DataFrame:
    rows = views.judged(spark, d).filter("accepted").select("id", "doc_id", "tokens")
    numbered = batching.with_ordinal(rows, "doc_id").withColumn("batch_id", batching.batch(F.col("ordinal"), 16))
    return batching.collate(vocabulary.encode(numbered, VOCABULARY))


@query(f"WITH {COLLATED} SELECT id, batch_id, array_to_string(list_concat(ids, list_transform(range(longest - n), lambda i: 1)), ' ') AS decoder_input_ids FROM col")
def collate_padded_ids(spark: SparkSession, d: str) -> DataFrame:
    return _collated(spark, d).select("id", "batch_id", _joined("decoder_input_ids", "decoder_input_ids"))


@query(f"WITH {COLLATED} SELECT id, batch_id, repeat('1', n::INT) || repeat('0', (longest - n)::INT) AS mask FROM col")
def collate_attention_mask(spark: SparkSession, d: str) -> DataFrame:
    return _collated(spark, d).select("id", "batch_id", F.array_join(F.transform("decoder_attention_mask", lambda x: x.cast("string")), "").alias("mask"))


@query(f"WITH {COLLATED} SELECT id, batch_id, array_to_string(list_concat(ids[2:], list_transform(range(longest - n + 1), lambda i: -100)), ' ') AS labels FROM col")
def collate_labels(spark: SparkSession, d: str) -> DataFrame:
    return _collated(spark, d).select("id", "batch_id", _joined("labels", "labels"))


@query()
def seeded_permutation(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select("doc_id").withColumn("key", batching.permuted(F.col("doc_id"), 42))
    return batching.with_ordinal(rows, "key", "doc_id", name="place").select("doc_id", "place")


@query()
def bounded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return batching.bounded_shuffle(views.table(spark, d, "documents").select("doc_id"), 64, 42)


# ---- metrics ---------------------------------------------------------------


@query(f"WITH {GRAMS} SELECT * FROM pg")
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ngram_counts(views.pairs(spark, d), "p")


@query(f"WITH {GRAMS} SELECT * FROM clip")
def clipped_matches(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clipped(views.pairs(spark, d))


@query(f"WITH {GRAMS} SELECT pair_id, matches FROM clip WHERE ord = 1 AND matches > 0")
def clipped_matches_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.pairs(spark, d)
    both = pairs.select("pair_id", F.explode("p").alias("g")).intersectAll(pairs.select("pair_id", F.explode("r").alias("g")))
    return both.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matches"))


@query(f"""WITH {GRAMS}, len AS (SELECT sum(len(p))::DOUBLE AS p, sum(len(r))::DOUBLE AS r FROM pairs), pr AS (SELECT min(matches) AS lo, avg(ln(matches::DOUBLE / total)) AS ml FROM pooled)
SELECT round(CASE WHEN p = 0 OR lo = 0 THEN 0.0 ELSE (CASE WHEN p > r THEN 1.0 ELSE exp(1 - r / p) END) * exp(ml) END, 9) AS bleu FROM len, pr""")
def corpus_bleu(spark: SparkSession, d: str) -> DataFrame:
    return metrics.corpus_bleu(views.pairs(spark, d)).select(F.round("bleu", 9).alias("bleu"))


@query(f"WITH {GRAMS} SELECT ord, matches, total, matches::DOUBLE / total AS precision FROM pooled")
def bleu_by_order(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_order(views.pairs(spark, d)).withColumn("precision", F.col("matches") / F.col("total"))


# DuckDB's levenshtein compares bytes, so it has no letters for the tokens of whole turns: no SQL, a plain DP in the tests.
@query()
def token_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return views.pairs(spark, d).select("pair_id", metrics.edit_distance(F.col("p"), F.col("r")).alias("distance"))


@query()
def mean_normalized_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return views.pairs(spark, d).agg(F.round(F.avg(metrics.normalized_distance(F.col("p"), F.col("r"))), 9).alias("distance"))


# ---- rasters ---------------------------------------------------------------

SPEC = raster.Spec(SIDE, SIDE)


@query(f"WITH {GRAY} SELECT vec_id, array_to_string(list_transform(range(48), lambda i: (px[(i // 3) * 4 + i % 3 + 1] * px[(i // 3) * 4 + 4] + 255 * (255 - px[(i // 3) * 4 + 4]) + 127) // 255), ' ') AS rgb FROM g0")
def alpha_composite(spark: SparkSession, d: str) -> DataFrame:
    return views.gray(spark, d).select("vec_id", _joined(raster.alpha_composite(F.col("px")), "rgb"))


@query(f"WITH {GRAY} SELECT vec_id, array_to_string(list_transform(range(21), lambda i: (px[i * 3 + 1] * 299 + px[i * 3 + 2] * 587 + px[i * 3 + 3] * 114 + 500) // 1000), ' ') AS gray FROM g0")
def grayscale(spark: SparkSession, d: str) -> DataFrame:
    return views.gray(spark, d).select("vec_id", _joined(raster.grayscale(F.slice("px", 1, 63)), "gray"))


def _polar(spark: SparkSession, d: str) -> DataFrame:
    rows = views.gray(spark, d).withColumn("border", raster.border_mean(F.col("px"), 8, 8))
    return rows.withColumn("inverted", F.col("border") < SPEC.polarity_border_threshold).withColumn("px", raster.invert_if(F.col("px"), F.col("inverted")))


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    rows = _polar(spark, d).withColumn("px", raster.dynamic_range(F.col("px")))
    return rows.withColumn("box", raster.foreground_box(F.col("px"), 8, 8))


def _resized(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("box")
    rows = _boxed(spark, d).select("vec_id", raster.crop(F.col("px"), 8, b).alias("part"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))
    tw, th = raster.fit(F.col("w"), F.col("h"), SPEC)
    sized = rows.withColumns({"tw": tw, "th": th})
    return sized.withColumn("px", raster.bilinear(F.col("part"), *map(F.col, ("w", "h", "tw", "th"))))


@query(f"WITH {POL} SELECT vec_id, border, inverted, array_to_string(pol, ' ') AS px FROM g2")
def border_polarity(spark: SparkSession, d: str) -> DataFrame:
    return _polar(spark, d).select("vec_id", "border", "inverted", _joined("px", "px"))


@query(f"WITH {RANGE} SELECT vec_id, array_to_string(st, ' ') AS px FROM g4")
def dynamic_range(spark: SparkSession, d: str) -> DataFrame:
    return _polar(spark, d).select("vec_id", _joined(raster.dynamic_range(F.col("px")), "px"))


@query(f"WITH {BOX} SELECT vec_id, x0, y0, x1, y1, empty FROM g6")
def foreground_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _boxed(spark, d).select("vec_id", "box.*")


@query(f"WITH {CROP} SELECT vec_id, w::INT AS w, h::INT AS h, array_to_string(part, ' ') AS px FROM g7")
def crop(spark: SparkSession, d: str) -> DataFrame:
    return _resized(spark, d).select("vec_id", "w", "h", _joined("part", "px"))


@query(f"WITH {FIT} SELECT vec_id, tw::INT AS w, th::INT AS h FROM g9")
def fit_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _resized(spark, d).select("vec_id", F.col("tw").alias("w"), F.col("th").alias("h"))


@query(f"WITH {RESIZE} SELECT vec_id, array_to_string(rs, ' ') AS px FROM g10")
def bilinear_resize(spark: SparkSession, d: str) -> DataFrame:
    return _resized(spark, d).select("vec_id", _joined("px", "px"))


@query(f"WITH {PADDED} SELECT vec_id, array_to_string(cv, ' ') AS px FROM g12")
def center_pad(spark: SparkSession, d: str) -> DataFrame:
    return _resized(spark, d).select("vec_id", _joined(raster.center_pad(F.col("px"), F.col("tw"), F.col("th"), SPEC), "px"))


@query(f"WITH {PADDED}, f AS (SELECT vec_id, list_transform(cv, lambda v: ((v::FLOAT / 255::FLOAT) - 0.7931::FLOAT) / 0.1738::FLOAT) AS t FROM g12) SELECT vec_id, list_min(t) AS low, list_max(t) AS high, round(list_sum(list_transform(t, lambda x: x::DOUBLE)), 6) AS total FROM f")
def normalize_tensor(spark: SparkSession, d: str) -> DataFrame:
    t = raster.standardize(raster.center_pad(F.col("px"), F.col("tw"), F.col("th"), SPEC))
    rows = _resized(spark, d).select("vec_id", t.alias("t"))
    return rows.select("vec_id", F.array_min("t").alias("low"), F.array_max("t").alias("high"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query(f"WITH {CROP} SELECT count(*) AS n, min(w)::INT AS min_width, max(w)::INT AS max_width, avg(w) AS mean_width, min(h)::INT AS min_height, max(h)::INT AS max_height, avg(h) AS mean_height FROM g7")
def image_dimension_stats(spark: SparkSession, d: str) -> DataFrame:
    sides = (("w", "width"), ("h", "height"))
    return _resized(spark, d).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{side}") for c, side in sides for f, name in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))))


@query()
def image_preprocess_udf(spark: SparkSession, d: str) -> DataFrame:
    raw = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    return raster.preprocess(views.gray(spark, d).select("vec_id", raw.alias("data"), F.lit(4).alias("width"), F.lit(4).alias("height")), raster.Spec(48, 48), "vec_id")


# ---- tensors, checkpoints, schedules ---------------------------------------


@query(f"""WITH {LOGITS}, t AS (SELECT vec_id, label, list_transform(z, lambda x: x::DOUBLE) AS z FROM lg WHERE label <> -100),
l AS (SELECT vec_id, ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[label + 1] AS loss FROM t) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM l""")
def cross_entropy_ignore_index(spark: SparkSession, d: str) -> DataFrame:
    rows = views.logits(spark, d).filter("label <> -100").select(model_math.cross_entropy(F.col("z"), F.col("label")).alias("loss"))
    return rows.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * ((i % 5) - 2))), 5) AS y FROM embeddings")
def linear_projection(spark: SparkSession, d: str) -> DataFrame:
    weights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 5 - 2)
    return views.table(spark, d, "embeddings").select("vec_id", F.round(model_math.dot(F.col("embedding"), weights), 5).alias("y"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS token FROM embeddings")
def greedy_argmax(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "embeddings").select("vec_id", model_math.argmax(F.col("embedding")).alias("token"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), f AS (SELECT vec_id, a, list_transform(range(64), lambda i: (a[64 - i] - a[i + 1])) AS g FROM e)
SELECT vec_id, round(list_max(list_transform(g, lambda x: abs(x))), 6) AS max_abs, round(list_sum(list_transform(g, lambda x: abs(x))) / 64, 6) AS mean_abs, round(sqrt(list_sum(list_transform(g, lambda x: x * x))) / greatest(sqrt(list_sum(list_transform(a, lambda x: x * x))), 1e-12), 6) AS l2_relative FROM f""")
def tensor_diff_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "embeddings").select("vec_id", model_math.differences(F.col("embedding"), F.reverse("embedding")).alias("x"))
    return rows.select("vec_id", *(F.round(f"x.{c}", 6).alias(c) for c in ("max_abs", "mean_abs", "l2_relative")))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    source = views.state_source(spark, d)
    return model_math.selected(source, model_math.vote_prefix(source, model_math.ENCODER_PREFIXES, False))


@query(f"WITH {SRC}, {TGT} SELECT name FROM tgt WHERE name NOT IN (SELECT name FROM sel)")
def state_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    return views.state_target(spark, d).join(_selected(spark, d), "name", "left_anti").select("name")


@query(f"WITH {SRC}, {TGT} SELECT name FROM sel WHERE name NOT IN (SELECT name FROM tgt)")
def state_unexpected_keys(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).join(views.state_target(spark, d), "name", "left_anti").select("name")


@query(f"WITH {SRC}, {TGT} SELECT name, array_to_string(sel.shape, 'x') AS source_shape, array_to_string(tgt.shape, 'x') AS target_shape FROM sel JOIN tgt USING (name) WHERE sel.shape <> tgt.shape")
def state_shape_mismatch(spark: SparkSession, d: str) -> DataFrame:
    both = _selected(spark, d).join(views.state_target(spark, d).withColumnRenamed("shape", "target"), "name").filter("shape <> target")
    return both.select("name", F.array_join(F.col("shape").cast("array<string>"), "x").alias("source_shape"), F.array_join(F.col("target").cast("array<string>"), "x").alias("target_shape"))


@query(f"WITH {SRC} SELECT CASE WHEN bool_or(starts_with(name, 'module.encoder.')) THEN 'module.encoder.' WHEN bool_or(starts_with(name, 'model.encoder.')) THEN 'model.encoder.' WHEN bool_or(starts_with(name, 'encoder.')) THEN 'encoder.' ELSE '' END AS any_prefix, CASE WHEN bool_and(starts_with(name, 'module.model.')) THEN 'module.model.' WHEN bool_and(starts_with(name, 'module.')) THEN 'module.' WHEN bool_and(starts_with(name, 'model.')) THEN 'model.' ELSE '' END AS all_prefix FROM src")
def state_prefix_vote(spark: SparkSession, d: str) -> DataFrame:
    source = views.state_source(spark, d)
    one = model_math.vote_prefix(source, model_math.ENCODER_PREFIXES, False).withColumnRenamed("prefix", "any_prefix")
    return one.crossJoin(model_math.vote_prefix(source, model_math.MODEL_PREFIXES, True).withColumnRenamed("prefix", "all_prefix"))  # one row each


@query(f"WITH {SRC} SELECT substr(name, 1, length(name) - 1) AS name, count(*) AS n FROM sel GROUP BY 1 HAVING count(*) > 1")
def state_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).groupBy(F.expr("substring(name, 1, length(name) - 1)").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"WITH {SRC}, {TGT} SELECT name, pos FROM tgt JOIN sel USING (name) ORDER BY pos")
def state_target_order(spark: SparkSession, d: str) -> DataFrame:
    return views.state_target(spark, d).join(_selected(spark, d).select("name"), "name").select("name", "pos").orderBy("pos")


_LIGHT = "({i} * mid_ch + 2 * mid_ch + mid_ch * kernel * kernel + 2 * mid_ch)"
_FULL = "({i} * mid_ch * kernel * kernel + 2 * mid_ch)"
_layer = lambda i: f"CASE WHEN light THEN {_LIGHT.format(i=i)} ELSE {_FULL.format(i=i)} END"
_squeeze = lambda i: f"(({i} + layers * mid_ch) * (out_ch // 2) + out_ch + (out_ch // 2) * out_ch + 2 * out_ch)"


@query(f"WITH {STAGES} SELECT stage, ((CASE WHEN down THEN 9 * in_ch + 2 * in_ch ELSE 0 END) + ({_layer('in_ch')}) + (layers - 1) * ({_layer('mid_ch')}) + {_squeeze('in_ch')} + (blocks - 1) * (({_layer('out_ch')}) + (layers - 1) * ({_layer('mid_ch')}) + {_squeeze('out_ch')}))::BIGINT AS parameters FROM st")
def stage_parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    return model_math.parameter_counts(model_math.stage_table(spark))


@query(f"WITH {STAGES}, s AS (SELECT stage, out_ch AS channels, (96 / pow(2, sum(down::INT) OVER (ORDER BY stage)))::INT AS side FROM st) SELECT stage, channels, side, side * side AS tokens FROM s")
def stage_output_shapes(spark: SparkSession, d: str) -> DataFrame:
    return model_math.output_shapes(model_math.stage_table(spark))


@query(f"WITH {STAGES}, s AS (SELECT stage, in_ch, coalesce(lag(out_ch) OVER (ORDER BY stage), 48) AS expected FROM st) SELECT stage, expected, expected = in_ch AS ok FROM s")
def stage_channel_chain(spark: SparkSession, d: str) -> DataFrame:
    return model_math.channel_chain(model_math.stage_table(spark))


@query("SELECT step, round(CASE WHEN step < 5000 THEN (step + 1) / 5000.0::DOUBLE ELSE 0.01 + 0.99 * 0.5 * (1 + cos(pi() * least((step - 5000) / 95000.0::DOUBLE, 1.0))) END, 6) AS multiplier FROM (SELECT unnest(range(100000)) AS step)")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    m = model_math.lr_multiplier(F.col("step"), 1e-5, 1e-7, 5000, 100_000)
    return spark.range(100_000).select(F.col("id").alias("step")).select("step", F.round(m, 6).alias("multiplier"))


@query("(SELECT event_id AS step, value AS metric, 'best' AS kind FROM events ORDER BY value DESC, event_id LIMIT 3) UNION ALL (SELECT event_id, value, 'last' FROM events ORDER BY event_id DESC LIMIT 1)")
def topk_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("metric"))
    best = rows.orderBy(F.desc("metric"), "step").limit(3).withColumn("kind", F.lit("best"))
    last = rows.agg(F.max("step").alias("step"), F.max_by("metric", "step").alias("metric")).withColumn("kind", F.lit("last"))
    return best.union(last)


@query("SELECT user_id % 10 AS epoch, round(sum(value * (1 + event_id % 16)) / sum(1 + event_id % 16), 6) AS loss FROM events GROUP BY 1")
def epoch_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    weight = 1 + F.col("event_id") % 16
    return views.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("epoch")).agg(F.round(F.sum(F.col("value") * weight) / F.sum(weight), 6).alias("loss"))


@query(f"WITH {JUDGED} SELECT {SUBSET} AS subset, count(*) AS total_samples, count(*) FILTER (WHERE accepted) AS accepted_samples, count(*) FILTER (WHERE unknown > 0) AS unknown_samples, sum(unknown)::BIGINT AS unknown_token_count, sum(n)::BIGINT AS total_token_count, max(n)::INT AS max FROM judged GROUP BY 1")
def streaming_profile(spark: SparkSession, d: str) -> DataFrame:
    batch = views.table(spark, d, "documents")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(d))
    records = stream.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_latex"), F.col("lang").alias("subset"))
    return profile.run_available(profile.counters(records, VOCABULARY, views.KEEP_DROP))


def _stream_folder(d: str) -> str:
    """The documents as a stream source: a folder or a pattern that fits the one file."""
    return f"{d}/documents.parque[t]"


# ---- batch path and artifacts ----------------------------------------------


def _split(spark: SparkSession, d: str) -> DataFrame:
    rows = views.judged(spark, d).filter("accepted").select("id", "doc_id", "subset", "source", "raw_latex")
    numbered = batching.with_ordinal(rows, "doc_id")
    return vocabulary_batches(numbered)


def vocabulary_batches(numbered: DataFrame) -> DataFrame:
    return datamodule.batches(numbered, VOCABULARY, 16, views.MAX_LENGTH)


NORMAL = f"{MEAS}, acc AS (SELECT id, subset, source, array_to_string(tokens, ' ') AS normal, n, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM meas WHERE n <= {views.MAX_LENGTH})"


@query(f"WITH {NORMAL} SELECT ordinal // 16 AS batch_id, ordinal % 16 AS position, id, subset, source, normal AS normalized_latex, max(n) OVER (PARTITION BY ordinal // 16) AS padded_length FROM acc")
def batch_rows(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("batch_id", "position", "id", "subset", "source", "normalized_latex", F.size("decoder_input_ids").cast("long").alias("padded_length"))


@query(f"WITH {NORMAL} SELECT ordinal // 16 AS batch_id, count(*) AS size, string_agg(id, ' ' ORDER BY ordinal) AS ids, string_agg(coalesce(source, ''), ' ' ORDER BY ordinal) AS sources FROM acc GROUP BY ALL")
def batch_metadata(spark: SparkSession, d: str) -> DataFrame:
    whole = datamodule.gathered(_split(spark, d).select("batch_id", "position", "id", F.coalesce("source", F.lit("")).alias("source")))
    return whole.select("batch_id", F.col("size").cast("long").alias("size"), F.array_join("id", " ").alias("ids"), F.array_join("source", " ").alias("sources"))


@query(f"WITH {NORMAL} SELECT id, ordinal // 16 AS batch_id FROM acc WHERE ordinal // 16 < 3")
def batch_limit(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).filter("batch_id < 3").select("id", "batch_id")  # the limit is the feature


@query(f"WITH {IDS} SELECT id, array_to_string(list_concat(ids, ids[2:]), ' ') AS ids FROM ids")
def pair_template(spark: SparkSession, d: str) -> DataFrame:
    rows = vocabulary.encode(views.measured(spark, d).select("id", "tokens"), VOCABULARY, special=False)
    return rows.select("id", artifacts.pair_ids(F.col("ids"), F.col("ids"), vocabulary.BOS, vocabulary.EOS).alias("pair")).select("id", _joined("pair", "ids"))


@query(f"WITH {GRAY} SELECT vec_id, array_to_string(list_concat(flatten(list_transform(range(8), lambda y: list_concat(px[y * 8 + 1:y * 8 + 8], [0]))), list_transform(range(9), lambda i: 0)), ' ') AS padded FROM g0")
def pad_right_bottom(spark: SparkSession, d: str) -> DataFrame:
    return views.gray(spark, d).select("vec_id", artifacts.pad_right_bottom(F.col("px"), 8, 8).alias("p")).select("vec_id", _joined("p", "padded"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: greatest(v::DOUBLE, 0))), 6) AS total FROM embeddings")
def relu_activation(spark: SparkSession, d: str) -> DataFrame:
    positive = F.transform("embedding", lambda v: artifacts.activation("relu", v))
    return views.table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(positive, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH v AS (SELECT 'stage' || label AS stage, unnest(embedding)::DOUBLE AS r FROM embeddings), w AS (SELECT stage, r, floor(r * 64) / 64 AS a FROM v)
SELECT stage, round(max(abs(a - r)), 9) AS max_abs_error, round(avg(abs(a - r)), 9) AS mean_abs_error, round(sqrt(sum((a - r) * (a - r))) / greatest(sqrt(sum(r * r)), 1e-12), 9) AS relative_error FROM w GROUP BY stage""")
def compare_stage_outputs(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "embeddings").select(F.concat(F.lit("stage"), "label").alias("stage"), "vec_id", F.posexplode("embedding").alias("k", "v"))
    reference = rows.select("stage", F.struct("vec_id", "k").alias("at"), F.col("v").cast("double").alias("value"))
    actual = reference.withColumn("value", F.floor(F.col("value") * 64) / 64)
    told = artifacts.compare_stages(reference, actual)
    return told.select("stage", *(F.round(c, 9).alias(c) for c in told.columns[1:]))


@query(f"WITH {JUDGED} SELECT count(*) AS count, min(n)::INT AS min_width, max(n)::INT AS max_width, avg(n) AS mean_width, min(len(tokens))::INT AS min_height, max(len(tokens))::INT AS max_height, avg(len(tokens)) AS mean_height FROM judged WHERE accepted")
def accepted_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions over accepted rows only; lengths stand in for the sides of images, which the tables lack."""
    return policy.image_dimensions(views.judged(spark, d).withColumns({"width": F.col("n"), "height": F.size("tokens")}))
