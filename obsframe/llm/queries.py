"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_graph import nearest
from .conversation_align import damaged_and_repaired
from .decontam_winnow import decontaminate
from .dedup_omh import near_duplicates
from .dedup_pfp import remove_repeats
from .frames import keep_out, table
from .jaccard_groups import jaccard_components
from .langid_ecoc import identify
from .packing_mbs import pack
from .phrase_trie import collocations
from .quality_gam import score_quality
from .secret_crf import KINDS, find_secrets
from .sharding_jump import shard_slots
from .toxicity_subword import score_toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WINDOW = 2048


def op1_quality_additive_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = keep_out("doc_id", 5, 0)
    scored = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_secrets_random_field(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    of = lambda kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(written(of(KINDS[:3])), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *counts[3:])


def op3_toxicity_subword_bag(spark: SparkSession, folder: str) -> DataFrame:
    held_out = keep_out("doc_id", 5, 0)
    scored = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_pack_min_bin_slack(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(table(spark, folder, "documents"), TOKENIZER, WINDOW, end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")


def op5_nearest_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_shard_jump_hash(spark: SparkSession, folder: str) -> DataFrame:
    return shard_slots(table(spark, folder, "documents"), 16)


def op7_decontaminate_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_near_duplicates_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), 0.8)
    return found.select("doc_id", "class_id", "class_size", "class_key", "representative", "n_words")


def op9_language_output_codes(spark: SparkSession, folder: str) -> DataFrame:
    held_out = keep_out("doc_id", 3, 1)
    found = identify(table(spark, folder, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_repeats_prefix_free_parsing(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op11_conversation_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return damaged_and_repaired(table(spark, folder, "conversations"))


def op12_jaccard_token_groups(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), 80)


def op13_phrases_double_array(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"), 100, 2000)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run  # it uses this module's parameters

    return run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_additive_model, op2_secrets_random_field, op3_toxicity_subword_bag, op4_pack_min_bin_slack,
                              op5_nearest_pruned_graph, op6_shard_jump_hash, op7_decontaminate_winnowing,
                              op8_near_duplicates_order_minhash, op9_language_output_codes, op10_repeats_prefix_free_parsing,
                              op11_conversation_alignment, op12_jaccard_token_groups, op13_phrases_double_array, pipeline)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT rid, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM split),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid, rid AS seen FROM split UNION SELECT r.rid, b.y FROM reach r JOIN both_ways b ON b.x = r.seen)
SELECT any_value(s.doc_id) AS doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(o.doc_id) AS component_id, count(*) AS component_size
FROM reach r JOIN split s ON s.rid = r.rid JOIN split o ON o.rid = r.seen LEFT JOIN sizes z ON z.rid = r.rid GROUP BY r.rid
"""

OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws)) AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM split, range(1, 6) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, i AS cut, array_to_string(string_split(c.phrase, ' ')[1:i], ' ') AS first_part,
         array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ') AS rest FROM f c, range(1, 5) u(i) WHERE i < c.k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)]) AS phrase FROM f, range(2, 5) v(m) WHERE m < k),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = b.lang AND p.phrase = b.phrase AND p.a >= b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op12_jaccard_token_groups": OP12_SQL, "op13_phrases_double_array": OP13_SQL}
