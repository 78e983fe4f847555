"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._shared import read_table
from lectern.llm.byte_bpe import Vocabulary, encode_bytes
from lectern.llm.centroid_clusters import cluster_vectors
from lectern.llm.exact_dedup import exact_groups
from lectern.llm.line_dedup import dropped_lines
from lectern.llm.maxent_lm import lm_scores
from lectern.llm.near_dedup import near_groups
from lectern.llm.packing import pack_documents
from lectern.llm.pii import find_personal_data, listed
from lectern.llm.quality_pu import quality_scores
from lectern.llm.quality_rules import ALPHA, DELTA, RULES, cutoffs, quality_verdicts
from lectern.llm.sentencepiece_codec import encode_documents
from lectern.llm.sharding import byte_shards
from lectern.llm.source_divergence import audit_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is installed; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


@_query
def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql() -> str:
    """The cutoffs' tests in SQL: all terms of the binomial tail, by lgamma."""
    share = ALPHA / len(RULES)
    signals = " UNION ALL ".join(f"SELECT doc_id, lang, quality, '{r}' AS rule, {RULES[r][0].replace(' div ', ' // ')} AS signal FROM f WHERE NOT base_failed" for r in RULES)
    steps = " UNION ALL ".join(f"SELECT '{r}' AS rule, {k} AS step, {c} AS cut" for r in RULES for k, c in enumerate(cutoffs(r)))
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln({1 - share}))"
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	

]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	

]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 2]) AS n FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM g WHERE n > 1) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, lang, len(words) AS n_words, length(regexp_replace(t, '[ 	

]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(list_distinct(words)) AS n_distinct, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), f AS (
  SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, quality FROM c LEFT JOIN labels ON labels.doc_id = c.doc_id
), s AS ({signals}), steps AS ({steps}
), k AS (
  SELECT lang, s.rule, step, cut, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS bad,
    count(*) FILTER (quality = 1 AND signal > cut) AS k, count(*) FILTER (quality = 0 AND signal > cut) AS b FROM s JOIN steps ON s.rule = steps.rule GROUP BY ALL HAVING n > 0
), p AS (
  SELECT *, CASE WHEN k >= n * {share} THEN 1 ELSE (SELECT sum({term}) FROM unnest(range(0, k + 1)) AS u(i)) END AS p_value FROM k
), stop AS (
  SELECT lang, rule, min(step) FILTER (p_value > {DELTA} / ((SELECT count(DISTINCT lang) FROM k) * {len(RULES)})) AS stop FROM p GROUP BY ALL
), cuts AS (
  SELECT p.lang, p.rule, arg_max(cut, (b * n - k * bad) * 1000 - step) AS cut FROM p JOIN stop ON p.lang = stop.lang AND p.rule = stop.rule WHERE stop IS NULL OR step < stop GROUP BY ALL
), out AS (
  SELECT DISTINCT doc_id FROM s JOIN cuts ON s.lang = cuts.lang AND s.rule = cuts.rule WHERE signal > cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out) AS kept FROM f
"""


ORACLES["op2_risk_controlled_rules"] = _rules_sql()


@_query
def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select("doc_id", of("email"), of("ip"), of("card"), of("phone"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@_query
def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = byte_shards(read_table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _shards_sql() -> str:
    """Sizes, checksums, the prefix sum and its cuts in SQL; the checksum goes byte by byte over a table made by its rule."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return f"""
WITH b AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, CASE WHEN coalesce(text, '') = '' THEN []
    ELSE list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) END AS bytes FROM documents
), s AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS place FROM s
), c AS (
  SELECT *, CAST(before * 8 // total AS INT) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM c
"""


ORACLES["op4_byte_shards"] = _shards_sql()


@_query
def op5_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "mended",
    )  # fmt: skip


@_query
def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), words=4, similarity=0.8)


ORACLES["op7_chosen_path"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ 	

]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingle FROM w
), n AS (
  SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (
  SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
)
SELECT n.doc_id, n.n AS n_shingles, min(r.v) AS component_id, n.doc_id = min(r.v) AS kept
FROM n JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n
"""


@_query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


@_query
def op9_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.3)


@_query
def op10_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dropped_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_copies", "n_near", F.array_join(F.transform("dropped", lambda k: k.cast("string")), ",").alias("dropped"))


ORACLES["op10_deletion_neighbourhood"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents
), w AS (
  SELECT doc_id, line_no, doc_id * 10000000 + line_no AS place,
    list_filter(regexp_split_to_array(lower(line), '[ 	

]+'), lambda x: x <> '') AS words FROM l
), k AS (
  SELECT *, array_to_string(words, ' ') AS key, len(words) AS n FROM w
), d AS (
  SELECT key, any_value(words) AS words, any_value(n) AS n, min(place) AS first FROM k WHERE n > 0 GROUP BY key
), v AS (
  SELECT key, first, i, n - 1 AS m, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS variant
  FROM (SELECT key, first, n, words, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5)
), near AS (
  SELECT a.key FROM v a JOIN v b ON a.variant = b.variant AND a.i = b.i AND a.m = b.m AND b.first < a.first
  UNION SELECT a.key FROM v a JOIN d b ON a.variant = b.key AND b.first < a.first AND b.n = a.m
  UNION SELECT b.key FROM v a JOIN d b ON a.variant = b.key AND a.first < b.first AND b.n = a.m
), j AS (
  SELECT k.doc_id, k.line_no, k.n, CASE WHEN k.n = 0 THEN 'kept' WHEN d.first < k.place THEN 'copy' WHEN near.key IS NOT NULL THEN 'near' ELSE 'kept' END AS verdict
  FROM k LEFT JOIN d ON k.key = d.key AND k.n > 0 LEFT JOIN near ON near.key = k.key AND k.n > 0
)
SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (verdict = 'copy') AS n_copies, count(*) FILTER (verdict = 'near') AS n_near,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (verdict <> 'kept'), '') AS dropped
FROM j GROUP BY doc_id
"""


@_query
def op11_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64, scale=64, seed=1)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clusters_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """Every round in SQL: all distances, the nearest centroid, and the floor of its members' mean."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""]
    nearest = f"""
a{{0}} AS (
  SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, d * {k} + c) AS c, min(d) AS d
  FROM (SELECT id, vec_id, kept.v, c, CAST(list_sum(list_transform(range(1, {size + 1}), lambda i: (kept.v[i] - m.v[i]) * (kept.v[i] - m.v[i]))) AS BIGINT) AS d FROM kept, c{{0}} m) GROUP BY id
)"""
    moved = f"""
c{{1}} AS (
  SELECT m.c, coalesce(f.v, m.v) AS v FROM c{{0}} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {size + 1})) AS i FROM a{{0}}) GROUP BY c, i) GROUP BY c
  ) f ON m.c = f.c
)"""
    for r in range(rounds):
        steps += [nearest.format(r), moved.format(r, r + 1)]
    steps.append(nearest.format(rounds))
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c
"""


ORACLES["op11_block_norms"] = _clusters_sql()


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read_table(spark, sf_dir, "documents"), least=30, top=50)


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), p AS (
  SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM c
), w AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL
), q AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM w
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), best AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM best)
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""

@_query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary.read(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = encode_bytes(read_table(spark, sf_dir, "documents"), vocabulary, packed=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
