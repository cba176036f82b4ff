"""The queries opN_ of this subpackage, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm import decontaminate, lines, mixing, secrets, sharding, simhash, tokens, topk, toxicity, warc

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the vocabulary file is; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as records of dictionary-compressed archives, read these back. Null html is empty; null ids are never referred to."""
    files, uri = warc.archived(table(spark, sf_dir, "pages"))
    return warc.read_archives(files, uri, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document; null and empty texts have none."""
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spans_text(F.col("found.base")), 256).alias("base_sha256"), secrets.spans_text(F.col("found.all")).alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; null texts have none."""
    n = tokens.token_lengths(F.col("text"), tokenizer_path())
    counted = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest by integer inner product of every hundredth vector among all others."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(vectors, F.col("id") % 100 == 0, k=10)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def held_out(doc_id) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learnt from a bounded sample of the labelled documents that are not held out."""
    return toxicity.train(*toxicity.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held_out(F.col("id"))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. A null doc_id is not held out."""
    scored = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity.toxicity(F.col("text"), toxicity_model(spark, sf_dir)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on five or more sources: lines before and removed, characters and hash of the text that is left (null: empty)."""
    left, n, removed = lines.without_spread_lines(table(spark, sf_dir, "documents"), "source", "text", least_sites=5)
    text = F.coalesce(F.col("text"), F.lit(""))
    return left.select("doc_id", F.col(n).alias("n_lines"), F.col(removed).alias("n_removed"), F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 8-word windows of the benchmark, and the items these are from."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select(F.col("id").alias("doc_id"), "n_words", decontaminate.words_hit(F.col("hits")).alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document, and when in training (0 to 1) its first copy comes, if any."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position")).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of near equal bytes."""
    dealt = sharding.shards(table(spark, sf_dir, "documents"), 16)
    return dealt.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_secret_scan, op3_token_counts, op4_exact_top_k, op5_simhash, op6_toxicity, op7_line_dedup, op8_decontaminate, op9_mixing, op10_sharding)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALLOWED = r"regexp_matches(x, '^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$') OR regexp_matches(x, '^sha(1|256|384|512)-') OR len(list_distinct(str_split(x, ''))) = 1"
_HIDDEN = "(?i:example|placeholder|changeme|dummy|xxxx)"


def _places(of: str, text: str, pattern: str, group: int) -> str:
    """of, pos (code points before it), whole and part of every match of the pattern in text."""
    lengths = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda y: length(y))), 0)"
    cut = f"SELECT *, string_split_regex({text}, '{pattern}') AS g, regexp_extract_all({text}, '{pattern}') AS w, regexp_extract_all({text}, '{pattern}', {group}) AS p FROM {of} WHERE regexp_matches({text}, '{pattern}')"
    return f"SELECT * EXCLUDE (g, w, p, i), {lengths('g[:i]')} + {lengths('w[:i - 1]')} AS pos, w[i] AS whole, p[i] AS part FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ({cut}))"


def _base_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"SELECT r, CAST(pos AS BIGINT) AS s, {rank} AS rank, '{kind}' AS kind, CAST(pos + length(whole) AS BIGINT) AS e FROM ({_places('d', 't', pattern, group)}) WHERE length(part) >= {least}"


def _entropy_sql(rank: int, kind: str, chars: str, window: int, threshold: float) -> str:
    lengths = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda y: length(y))), 0)"
    runs = f"SELECT r, pos, whole AS x FROM ({_places('d', 't', f'[{chars}]{{{window},}}', 0)})"
    parts = f"""SELECT r, pos, g, w, unnest(range(1, len(g) + 1)) AS i FROM (
        SELECT r, pos, string_split_regex(x, '{_HIDDEN}') AS g, regexp_extract_all(x, '{_HIDDEN}') AS w FROM ({runs}) WHERE NOT ({_ALLOWED}))"""
    windows = f"SELECT *, unnest(range(0, length(x) - {window} + 1)) AS o FROM (SELECT r, i, pos + {lengths('g[:i - 1]')} + {lengths('w[:i - 1]')} AS pos, g[i] AS x FROM ({parts}))"
    hot = f"SELECT r, pos, min(o) AS a, max(o) AS b FROM ({windows}) WHERE list_aggregate(str_split(substr(x, o + 1, {window}), ''), 'entropy') >= {threshold} - 1e-9 GROUP BY r, pos, i"
    return f"SELECT r, CAST(pos + a AS BIGINT) AS s, {rank} AS rank, '{kind}' AS kind, CAST(pos + b + {window} AS BIGINT) AS e FROM ({hot})"


def _inverse_sql(y: str, knots) -> str:
    """The time at which a schedule has used up the share y, as SQL."""
    legs = [(a, b, (b[0] - a[0]) * (a[1] + b[1]) / 2) for a, b in zip(knots, knots[1:], strict=False)]
    whole = sum(leg[2] for leg in legs)
    base, out = whole, None
    for (t0, w0), (t1, w1), area in reversed(legs):
        base -= area
        z = f"(greatest({y} * {whole!r}::DOUBLE - {base!r}::DOUBLE, 0) / {t1 - t0!r}::DOUBLE)"
        at = f"({t0!r}::DOUBLE + coalesce({z} * 2 / nullif(sqrt(greatest({w0 * w0!r}::DOUBLE + {z} * {2 * (w1 - w0)!r}::DOUBLE, 0)) + {w0!r}::DOUBLE, 0), 0) * {t1 - t0!r}::DOUBLE)"
        out = at if out is None else f"CASE WHEN {y} * {whole!r}::DOUBLE < {base + area!r}::DOUBLE THEN {at} ELSE {out} END"
    return f"least({out}, {knots[-1][0]!r}::DOUBLE)"


_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
          CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
        FROM m""",
    "op2_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        b AS ({_base_sql(0, "assign", _ASSIGN, 2, 6)} UNION ALL {_base_sql(1, "access", "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_base_sql(2, "hex", "[0-9a-f]+", 0, 24)}),
        h AS ({_entropy_sql(3, "entropy_hex", "0-9A-Fa-f", 20, 2.9)} UNION ALL {_entropy_sql(4, "entropy_base64", "A-Za-z0-9+/_=-", 20, 3.8)}),
        a AS (SELECT * FROM b UNION ALL SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = h.r AND b.s <= h.s AND b.e >= h.e)),
        n AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
          string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM a GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (r)""",
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op7_line_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT r, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        b AS (SELECT trim(line, {_BLANK}) AS k FROM l WHERE length(trim(line, {_BLANK})) >= 1 AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 5),
        g AS (SELECT r, count(*) AS n, count(k) AS gone, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k IS NULL), '') AS rest
          FROM l LEFT JOIN b ON trim(line, {_BLANK}) = k GROUP BY r)
        SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, length(coalesce(rest, '')) AS kept_chars, sha256(coalesce(rest, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (r)""",
    "op8_decontaminate": rf"""
        WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 7], ' ') AS k, least(len(w), 8) AS n
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
        d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        size AS (SELECT DISTINCT n FROM win),
        hit AS (SELECT r, s, n, item_id FROM (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN size WHERE len(w) >= n)) JOIN win USING (k, n)),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
        it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)""",
    "op9_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][nth % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (SELECT *, cap / weight AS level, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights FROM w
          WINDOW before AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        n AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - caps) / ((SELECT sum(weight) FROM w) - weights) AS need FROM l),
        g AS (SELECT source AS of, source_size, nth, least(cap, coalesce(weight * (SELECT arg_min(need, level) FROM n WHERE level >= need), cap)) AS target FROM n),
        p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
        m AS (SELECT *, CAST(round(target) AS BIGINT) - start AS room, start / nullif(target, 0) AS y FROM p JOIN g ON source IS NOT DISTINCT FROM of)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(greatest(0, least(size, room)) + greatest(0, least(size, room - source_size)) AS BIGINT) AS taken,
          CASE WHEN least(size, room) > 0 THEN round(CASE nth % 3 WHEN 0 THEN {_inverse_sql("y", mixing.SCHEDULES[0])} WHEN 1 THEN {_inverse_sql("y", mixing.SCHEDULES[1])} ELSE {_inverse_sql("y", mixing.SCHEDULES[2])} END, 9) END AS position FROM m""",
    "op10_sharding": """
        WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
        d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(coalesce(text, '')) AS g FROM documents),
        o AS (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS LAST) - 1 AS nth, CAST(coalesce(sum(size) OVER (ORDER BY g, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
        z AS (SELECT CAST(sum(size) AS BIGINT) AS n FROM d),
        u AS (SELECT DISTINCT g FROM o, (SELECT unnest(range(1, 16)) * n // 16 AS cut FROM z) WHERE start <= cut AND start + size >= cut),
        w AS (SELECT g, min(start) AS first FROM o WHERE g IN (FROM u) GROUP BY g HAVING sum(size) <= (SELECT 0.02::DOUBLE * n / 16 FROM z)),
        q AS (SELECT o.*, CAST(least(coalesce(first, start) * 16 // n, 15) AS INTEGER) AS shard FROM o CROSS JOIN z LEFT JOIN w USING (g))
        SELECT doc_id, size, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(t), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32,
          'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q, c""",
}
