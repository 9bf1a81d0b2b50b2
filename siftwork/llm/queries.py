"""Registered queries of the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import chat, decontamination, fingerprints, langid, licenses, neardup, packing, substrings, token_files, urls
from siftwork.session import prepare, stored, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes of every document, and for ids divisible by 100 the search within 3 bits over all documents: n_within and nearest (null for other ids)."""
    probes = stored(fingerprints.edit_probes(table(spark, sf_dir, "documents")), "fingerprints")
    asked = probes.filter("doc_id % 100 = 0").select("doc_id", "fingerprint").distinct()
    found = fingerprints.neighbours(probes.select("doc_id", "fingerprint"), asked)
    return probes.join(found, ["doc_id", "fingerprint"], "left").select(*probes.columns, "n_within", "nearest")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.token_folder(docs)
    manifest = token_files.write_token_files(docs, tokenizer_file("word_bpe_49k.json"), 2, folder)
    return token_files.read_token_files(manifest, folder)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 0, with_ids=False)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_conversations(chat.written(chat.format_conversations(turns)))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return urls.filter_urls(table(spark, sf_dir, "pages"), *urls.default_tables(spark))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit(docs.filter(~held | held.isNull()))
    return langid.predict(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.without_repeats(docs, window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_token_files": op2_token_files,
        "op3_decontamination": op3_decontamination,
        "op4_licenses": op4_licenses,
        "op5_packing": op5_packing,
        "op6_chat": op6_chat,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_urls": op8_urls,
        "op9_language": op9_language,
        "op10_substrings": op10_substrings,
        "pipeline": pipeline,
    }


_SHINGLES = """
SELECT {id}, w AS words, least(5, len(w)) AS k
FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table})
WHERE len(w) > 0
"""

OP3 = f"""
WITH items AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
docs AS ({_SHINGLES.format(id="doc_id", table="documents")}),
item_shingles AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS s FROM items, unnest(range(1, len(words) - k + 2)) AS t(i)),
sizes AS (SELECT item_id, k, count(*) AS n FROM item_shingles GROUP BY ALL),
doc_shingles AS (
  SELECT DISTINCT doc_id, j.k, array_to_string(words[i:i + j.k - 1], ' ') AS s
  FROM docs, (SELECT DISTINCT k FROM items) AS j, unnest(range(1, len(words) - j.k + 2)) AS t(i)),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, n_shared, n_shared / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared * 100 >= 80 * n
"""

OP7 = None  # connected components over all pairs: too slow in SQL on whole tables; tested against brute force

_RULES = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in urls.RULES)
_LISTED = ", ".join(f"('{h}', '{p}', 'block', false)" for h, p in urls.LISTED)
OP8 = f"""
WITH entries(h, p, v, is_rule) AS (VALUES {_RULES}, {_LISTED}),
parts AS (
  SELECT page_id, row_number() OVER () AS rid, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{licenses.UPPER}', '{licenses.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT rid, h || p AS rule, v, is_rule, row_number() OVER (PARTITION BY rid, is_rule ORDER BY length(h || p) DESC, h || p) AS best
  FROM parts JOIN entries ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, r.rule, coalesce(r.v, CASE WHEN l.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE is_rule AND best = 1) r USING (rid) LEFT JOIN (SELECT * FROM hits WHERE NOT is_rule AND best = 1) l ON parts.rid = l.rid
"""

OP10 = """
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM docs, unnest(range(1, len(w) - 11)) AS t(i)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM places) WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, i + j AS i FROM gone, range(0, 13) AS t(j)),
lists AS (SELECT doc_id, list(i) AS cut FROM covered GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(cut), 0) AS n_removed,
    array_to_string(CASE WHEN cut IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(cut, i)) END, ' ') AS text
  FROM docs LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(text) AS kept_sha256 FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op8_urls": OP8, "op10_substrings": OP10}
