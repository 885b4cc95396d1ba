"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    collocations,
    decontam,
    embeddings,
    licenses,
    minhash,
    mixing,
    packing,
    quality,
    secrets,
    sharding,
    substrings,
    topk,
    turns,
)
from ledgerloom.llm.tables import table

#: Weights of the sources in code point order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of each vector."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated 200-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, length=200).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed token rows."""
    return packing.pack(table(spark, sf_dir, "documents"), length=2048)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, n=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document the benchmark covers, and from which items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated", "n_near",
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document enter the weighted mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    weights = mixing.ranked_weights(docs, "source", SOURCE_WEIGHTS)
    mixed = mixing.mix(docs, weights, max_epochs=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.is_held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def _document_path() -> Column:
    """Documents as files: hundreds within thousands within sources, the first of each
    hundred and thousand being its licence file."""
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    return (
        F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", "source", thousand, F.lit("LICENSE")))
        .when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", thousand, hundred, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", thousand, hundred, F.concat("doc_id", F.lit(".txt"))))
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of each document, its own or its directory's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _document_path().alias("path"))
    return licenses.scan(docs).select("doc_id", "license", "similarity", "license_dir")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of each document: counts by kind, and where they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = [r.kind for r in secrets.BASE_RULES]
    of_base = secrets.of_kinds(F.col("secrets"), base)
    counts = {
        f"n_{kind}": F.size(secrets.of_kinds(F.col("secrets"), [kind])).cast("long")
        for kind in base
    }
    return secrets.find_secrets(docs).select(
        "doc_id", *(count.alias(name) for name, count in counts.items()),
        F.sha2(secrets.joined(of_base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in the shuffled shards, read from the shards."""
    written = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), "grown_shard",
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each damaged conversation lacks, and its cheapest repair."""
    given = table(spark, sf_dir, "conversations")
    return turns.with_absent(turns.repair(turns.damage(given)), given)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words keep company most."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs, longest=5, least=100, first=2000)


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of highest product with every fiftieth."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_substrings": op2_substrings,
    "op3_pack": op3_pack,
    "op4_minhash": op4_minhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_shard": op10_shard,
    "op11_conversations": op11_conversations,
    "op12_collocations": op12_collocations,
    "op13_topk": op13_topk,
}

_TEMPLATES = ", ".join("('{}', '{}')".format(*t) for t in licenses.TEMPLATES)
_TERMS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"

#: The queries that SQL can express; the others are tested against brute force.
SQL: dict[str, str] = {
    "op8_licenses": f"""
WITH total AS (SELECT COUNT(*) AS n FROM documents WHERE text IS NOT NULL),
held AS (
  SELECT unnest(list_distinct({_TERMS.format('text')})) AS term FROM documents WHERE text IS NOT NULL
),
rarity AS (
  SELECT term, ln((1 + (SELECT n FROM total)) / (1 + COUNT(*))) + 1 AS idf FROM held GROUP BY term
),
template_terms AS (
  SELECT license, unnest({_TERMS.format('notice')}) AS term FROM (VALUES {_TEMPLATES}) v(license, notice)
),
patterns AS (
  SELECT license, term, COUNT(*) * coalesce(ANY_VALUE(idf), ln(1 + (SELECT n FROM total)) + 1) AS w
  FROM template_terms LEFT JOIN rarity USING (term) GROUP BY license, term
),
sizes AS (SELECT license, sqrt(SUM(w * w)) AS size FROM patterns GROUP BY license),
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
),
words AS (SELECT doc_id, line, unnest({_TERMS.format('text')}) AS term FROM lines),
weights AS (
  SELECT doc_id, line, term, COUNT(*) * ANY_VALUE(idf) AS w
  FROM words JOIN rarity USING (term) GROUP BY doc_id, line, term
),
lengths AS (SELECT doc_id, line, sqrt(SUM(w * w)) AS length FROM weights GROUP BY doc_id, line),
dots AS (
  SELECT doc_id, line, license, SUM(weights.w * patterns.w) AS dot
  FROM weights JOIN patterns USING (term) GROUP BY doc_id, line, license
),
own AS (
  SELECT doc_id, license, round(dot / (length * size), 6) AS similarity
  FROM dots JOIN lengths USING (doc_id, line) JOIN sizes USING (license)
  WHERE round(dot / (length * size), 6) >= {licenses.LEAST_COSINE}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / (length * size), 6) DESC, license) = 1
),
files AS (
  SELECT doc_id, doc_id % 100 = 0 AS is_license,
         concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR),
                   CASE WHEN doc_id % 1000 <> 0 THEN CAST(doc_id // 100 AS VARCHAR) END) AS dir
  FROM documents
),
grants AS (
  SELECT dir AS above, license FROM files JOIN own USING (doc_id) WHERE is_license
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license) = 1
),
inherited AS (
  SELECT dir, above, grants.license AS granted
  FROM (SELECT DISTINCT dir FROM files) JOIN grants ON dir = above OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1
)
SELECT doc_id, coalesce(license, granted) AS license, similarity,
       CASE WHEN license IS NULL THEN above END AS license_dir
FROM files LEFT JOIN own USING (doc_id) LEFT JOIN inherited USING (dir)
""",
    "op12_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]'), lambda w: w <> '') AS w FROM pieces
),
totals AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM words, (VALUES (1), (2), (3), (4), (5)) s(size) WHERE len(w) >= size
),
counts AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, COUNT(*) AS f
  FROM places GROUP BY ALL HAVING COUNT(*) >= 100
),
cuts AS (
  SELECT lang, phrase, size, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS front,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)
),
scored AS (
  SELECT c.lang, c.phrase, c.size, a, l.f AS l, r.f AS r, n,
         CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, k
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = front
  JOIN counts r ON r.lang = c.lang AND r.phrase = rest JOIN totals t ON t.lang = c.lang
),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM worst s
WHERE NOT EXISTS (
  SELECT 1 FROM counts o
  WHERE o.lang = s.lang AND o.size > s.size AND 100 * o.f >= 100 * s.a
    AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')
)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
    "op13_topk": """
WITH scaled AS (
  SELECT vec_id, row_number() OVER () AS line,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
       CAST(row_number() OVER (PARTITION BY q.line ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank,
       c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
FROM scaled q JOIN scaled c ON q.line <> c.line AND len(q.v) = len(c.v)
WHERE q.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY q.line ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) <= 5
""",
}
