"""The opN queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, line_dedup, media, mixing, pii, simhash, tokens, toxicity, urls, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: see mixing.taken() for nulls, repeated rows and ties. slots and first_slot come besides."""
    return mixing.taken(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures that the embeddings are drawn as, the tables holding no image of their own.

    The picture table is every embedding's picture and, as copies to be found,
    three edits of each picture whose id is divisible by 100.
    """
    return media.copies(media.with_edits(media.rendered(table(spark, sf_dir, "embeddings"))), keep=("edit",))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines and words deleted, and length and SHA-256 of the text that is left (of a null one: null)."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed=("lines_removed", "words_removed"))
    return out.select("doc_id", "lines_removed", "words_removed", F.length("text").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each whole text; a null text is an empty one with none, repeated rows and null ids are rows like any other."""
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), ["doc_id"])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written and read back: see warc.archive(); null html is an empty payload, of equal payloads the largest page_id is the response."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each whole text: empty and null texts get the lowest score, long ones that of their most toxic words, repeated rows the same one."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in code points of each whole text; a null or empty one has none, repeated rows and null ids are rows like any other."""
    return pii.report(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, share, tiles and longest tile of each document that holds an item: see decontam.leaks() for nulls, ties and repeated rows."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or the trees' verdict of each URL, with the score besides: see urls.judged() for null and odd URLs and repeated rows."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document: see simhash.cluster() for texts without a word, null ids and repeated rows."""
    return simhash.cluster(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_media, op3_line_dedup, op4_tokens, op5_warc, op6_toxicity, op7_pii, op8_decontamination, op9_url_filter, op10_simhash)}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": rf"""WITH d AS (SELECT doc_id, source, row_number() OVER () AS nr, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, max(CASE WHEN cap > level * w THEN level END) OVER () AS top FROM l),
t AS (SELECT source, sid, source_size, CAST(cap AS BIGINT) AS most, CASE WHEN cap <= level * w THEN cap ELSE top * w END AS target, CAST(least(round(CASE WHEN cap <= level * w THEN cap ELSE top * w END), floor(cap)) AS BIGINT) AS quota FROM f),
n AS (SELECT total, block, CAST(ceil(total / block) AS BIGINT) AS slots FROM (SELECT total, min(b) AS block FROM (SELECT CAST(sum(quota) AS BIGINT) AS total FROM t), (SELECT CAST({mixing.LEAST_BLOCK} * 2 ** unnest(range(40)) AS BIGINT) AS b) WHERE ceil(total / b) <= {mixing.MOST_SLOTS} GROUP BY 1)),
e AS (SELECT sid, CAST(floor(CAST(upto - quota AS DOUBLE) / total * {1 << mixing.POINT_BITS}) AS BIGINT) AS low, CAST(floor(CAST(upto AS DOUBLE) / total * {1 << mixing.POINT_BITS}) AS BIGINT) AS high FROM (SELECT *, sum(quota) OVER (ORDER BY sid) AS upto FROM t), n),
k AS (SELECT slot, CAST((CAST(slot + 1 AS HUGEINT) * {mixing.GOLDEN}) % {1 << mixing.POINT_BITS} AS BIGINT) AS u FROM (SELECT unnest(range(slots)) AS slot FROM n)),
o AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM k JOIN e ON u >= low AND u < high),
g AS (SELECT sid, least(any_value(most), count(*) * any_value(block)) AS words FROM o JOIN t USING (sid), n GROUP BY sid),
p AS (SELECT d.*, sid, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % ((SELECT count(*) FROM d) // {mixing.BUCKET} + 1), h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT nr, sid, pos + epoch * source_size AS a, least(pos + epoch * source_size + size, words) AS b FROM p JOIN g USING (sid), (SELECT unnest([0, 1]) AS epoch) WHERE size > 0 AND pos + epoch * source_size < words),
r AS (SELECT nr, sid, a, b, block, unnest(range(CAST(a // block AS BIGINT), CAST((b - 1) // block AS BIGINT) + 1)) AS rank FROM q, n),
x AS (SELECT nr, CAST(sum(least(b, (rank + 1) * block) - greatest(a, rank * block)) AS BIGINT) AS taken, count(DISTINCT slot) AS slots, min(slot) AS first_slot FROM r JOIN o USING (sid, rank) GROUP BY nr)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(slots, 0) AS slots, first_slot FROM p LEFT JOIN x USING (nr)""",
    "op3_line_dedup": r"""WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM raw WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM a),
l AS (SELECT doc_id, n, line, array_to_string(ws, ' ') AS w, len(ws) AS c, row_number() OVER d AS k, sum(len(ws)) OVER (d ROWS UNBOUNDED PRECEDING) AS upto FROM w WHERE len(ws) > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT a.doc_id, a.k AS p, b.k AS q FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.c >= 50 AND b.upto - b.c - a.upto + a.c < 50
  UNION SELECT b.doc_id, a.k, b.k FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.c >= 50 AND b.upto - a.upto < 50),
t AS (SELECT r.doc_id, p, q, string_agg(w, chr(10) ORDER BY k) AS content FROM r JOIN l ON l.doc_id = r.doc_id AND l.k BETWEEN p AND q GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS nth FROM t),
g AS (SELECT DISTINCT l.doc_id, l.n FROM f JOIN l ON l.doc_id = f.doc_id AND l.k BETWEEN p AND q WHERE nth > 1),
s AS (SELECT w.doc_id, count(g.n) AS lines_removed, coalesce(sum(CASE WHEN g.n IS NOT NULL THEN len(ws) END), 0) AS words_removed, coalesce(string_agg(CASE WHEN g.n IS NULL THEN line END, chr(10) ORDER BY w.n), '') AS left_text FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.n = w.n GROUP BY 1)
SELECT raw.doc_id, coalesce(lines_removed, 0) AS lines_removed, CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed, CAST(length(left_text) AS INT) AS chars_left, sha256(left_text) AS text_sha256 FROM raw LEFT JOIN s USING (doc_id)""",
    "op5_warc": """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest AND payload_bytes >= 1000""",
}
