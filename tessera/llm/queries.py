"""One query for each training-data operator, with production parameters over whole tables, and SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import table
from .lm import lm_scores
from .media import media_columns
from .packing import pack
from .pieces import encoded
from .quality import quality_scores
from .simhash import near_duplicates
from .substring import remove_repeats
from .topk import top_products
from .warc import archived


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of documents: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"), radius=3, width=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents, and whether they decode to the text."""
    found = encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return found.withColumnsRenamed({"id": "doc_id", "whole": "round_trip"})


def best_score_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents by the best sum of the model's scores: the Viterbi path of models with a score for each piece."""
    found = encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), best=True)
    return found.withColumnsRenamed({"id": "doc_id", "whole": "round_trip"})


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pictures in archives: digests of the payload and the stored form as read back, and the features."""
    got = media_columns(table(spark, sf_dir, "documents"))
    return got.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that start in a smaller doc_id too: counts and SHA-256 of what is kept."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine; every executor has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    found = pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), size=2048)
    return found.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best integer inner products of each embedding whose vec_id 50 divides."""
    return top_products(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256).withColumnRenamed("id", "vec_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts, their roles recovered by a model of the others, and the turns rendered."""
    found = chat.formatted(table(spark, sf_dir, "conversations"))
    right = F.col("roles") == F.col("roles_found")
    return found.select("conv_id", F.col("part.block").alias("part"), "held_out", "n_turns", right.alias("roles_right"), F.concat_ws(",", "roles_found").alias("roles_found"), "rendered")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents: doc_id, held_out, score, predicted (score >= 0.3)."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, written and read back."""
    return archived(table(spark, sf_dir, "pages"), least=1000).withColumnRenamed("id", "page_id")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and word-count scores of all documents."""
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op3_media: sizes, digest and tail of the payload as read back from the archives."""
    return op3_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op10_lm: folds, counts and the word-count base."""
    return op10_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_media": op3_media,
    "op4_substring": op4_substring,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_lm": op10_lm,
    "best_score_pieces": best_score_pieces,
    "media_payload": media_payload,
    "lm_base": lm_base,
}

#: CRC-32 of a text's bytes.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"

ORACLES: dict[str, str] = {
    "media_payload": rf"""
        WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        p AS (SELECT doc_id, octet_length(b) AS n, b || repeat('\x00'::BLOB, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END) AS b FROM t),
        e AS (SELECT *, right(hex(b), 128) AS tail FROM p)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_sha256,
            {CRC32.replace("strlen({0})", "64").format("").replace("hex()", "tail")} AS tail_crc32 FROM e
    """,
    "lm_base": rf"""
        WITH w AS (
            SELECT doc_id, {CRC32.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 2 AS held_out,
                list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), NULL) AS words FROM documents
        ), t AS (SELECT row_number() OVER () AS row, * FROM w), x AS (SELECT row, held_out, unnest(words) AS word FROM t),
        c AS (SELECT word, count(*) FILTER (NOT held_out) AS c FROM x GROUP BY 1),
        n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (c > 0) AS v FROM c),
        s AS (SELECT row, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10((c + 1) / (n * 1.0::DOUBLE + v + 1))) AS b FROM x JOIN c ON x.word IS NOT DISTINCT FROM c.word, n GROUP BY 1)
        SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(b, 6) AS base_score FROM t JOIN s USING (row), n
    """,
    "op7_chat": rf"""
        WITH c AS (
            SELECT conv_id, turn, CASE WHEN lower(role) IN ('system', 'user', 'assistant') THEN lower(role) ELSE 'other' END AS role,
                regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS text FROM conversations
        )
        SELECT conv_id, turn // 4096 AS part, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 5 = 0 AS held_out, CAST(count(*) AS INTEGER) AS n_turns, TRUE AS roles_right,
            string_agg(role, ',' ORDER BY turn) AS roles_found,
            string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) ORDER BY turn) AS rendered
        FROM c GROUP BY 1, 2
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), t AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last = page_id THEN NULL ELSE last END AS refers_to FROM t
    """,
    "op4_substring": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), g AS (
            SELECT doc_id, i, list_slice(words, i, i + 12) AS win FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 12, 0) + 1)) AS i FROM w)
        ), d AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM g) WHERE low < doc_id
        ), c AS (
            SELECT DISTINCT doc_id, i + k AS pos FROM d, (SELECT unnest(range(13)) AS k)
        ), e AS (
            SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id
        ), r AS (
            SELECT w.doc_id, len(words) AS n, [words[p] for p in range(1, len(words) + 1) if NOT list_contains(coalesce(gone, []), p)] AS kept FROM w LEFT JOIN e USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
    """,
}
