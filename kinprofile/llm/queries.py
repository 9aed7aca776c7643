"""Registered queries of the corpus operators, with production parameters over whole tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprofile.llm import alignment, ann, bpe, debruijn, embdedup, langid, linededup, minhash, packing, pii, secrets, sharding, whitening
from kinprofile.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def joined(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def pii_model(docs: DataFrame) -> pii.Field:
    return pii.fit(pii.labelled_table(docs))


@register()
def op1_pii(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii_model(docs))
    return found.select(
        "doc_id", *[count_of("pii_base", k) for k in pii.KINDS],
        F.sha2(joined("pii_base").cast("binary"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"),
    )


@register("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(e, e) > 0),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.95),
reach AS (SELECT a AS node, b AS other FROM pairs),
walk AS (WITH RECURSIVE w(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT w.node, r.other FROM w JOIN reach r ON w.other = r.node) SELECT * FROM w),
comp AS (SELECT node, min(other) AS component_id FROM walk GROUP BY node)
SELECT node AS vec_id, (SELECT count(*) FROM pairs WHERE a = node)::BIGINT AS n_links, component_id, node = component_id AS kept FROM comp""")
def op2_embedding_dedup(spark, sf):
    return embdedup.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Trained on documents outside the held-out fold; doc_id only picks the fold and the bounded sample."""
    return langid.fit(docs.where(~held_out()), key=F.col("doc_id"))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@register()
def op3_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.drop("lang"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register()
def op4_sharding(spark, sf):
    text = F.col("text").cast("binary")
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    return sharding.shuffle_into_shards(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register()
def op5_secrets(spark, sf):
    found = secrets.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex")))
    return base.select(
        "doc_id", *[count_of("base", k) for k in ("assign", "access", "hex")],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


@register()
def op6_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.encode_column(docs, public_tokenizers.path(TOKENIZER), ids="ids", decoded="decoded")
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@register()
def op7_packing(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), end_id=2, size=4096)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@register()  # an approximate search has no SQL: tests measure its recall against brute force
def op8_ann(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ann.search(rows.where("vec_id % 20 = 0"), rows, k=20)


@register(r"""WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS cell FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM cells x JOIN cells y ON x.cell = y.cell AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
walk AS (WITH RECURSIVE w(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.node, l.b FROM w JOIN links l ON w.other = l.a) SELECT * FROM w)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT node, min(other) AS component_id FROM walk GROUP BY node) c ON c.node = s.doc_id""")
def op9_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@register(r"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id""")
def op10_line_dedup(spark, sf):
    found = linededup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register(r"""WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM windows JOIN firsts USING (key), range(13) r(o) WHERE first < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM words),
kept AS (SELECT p.doc_id, count(*) FILTER (WHERE g.j IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY p.j) FILTER (WHERE g.j IS NULL) AS text
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id""")
def op11_debruijn(spark, sf):
    found = debruijn.drop_repeats(table(spark, sf, "documents").select("doc_id", "text"), k=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register()
def op12_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"), components=16)


@register()
def op13_alignment(spark, sf):
    vocabularies = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.align_tokenizers(table(spark, sf, "documents").select("doc_id", "text"), *vocabularies)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
