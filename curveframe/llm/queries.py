"""Registered queries of the corpus operators with the SQL that answers the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.llm import (
    anchors,
    bpe_automaton,
    decontaminate,
    grace_dedup,
    license_scan,
    minhash_forest,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    suffix_dedup,
    transcripts,
    whitening,
)
from curveframe.llm.common import stage, table

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


@query(
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return grace_dedup.classes(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    """
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
doc_words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    coalesce(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words
  FROM lowered
),
item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark
),
sized AS (SELECT item_id, words, least(13, len(words)) AS size FROM item_words WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS body
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM sized)
),
places AS (
  SELECT row_no, size, i, array_to_string(words[i:i + size - 1], ' ') AS body
  FROM (
    SELECT row_no, words, size, unnest(range(1, len(words) - size + 2)) AS i
    FROM doc_words, (SELECT DISTINCT size FROM sized) WHERE len(words) >= size
  )
),
hits AS (SELECT row_no, i, size, item_id FROM places JOIN windows USING (size, body)),
hit_words AS (
  SELECT row_no, count(DISTINCT place) AS n_hit
  FROM (SELECT row_no, unnest(range(i, i + size)) AS place FROM hits) GROUP BY row_no
),
hit_items AS (
  SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT row_no, item_id FROM hits) GROUP BY row_no
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (row_no) LEFT JOIN hit_items USING (row_no)"""
)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.words_hit().alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("hit_items"), ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query()
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        F.round("p_quality", 6).alias("p_quality"),
        (F.col("p_quality") < 0.5).alias("low_quality"),
        F.round("p_civil", 6).alias("p_civil"),
        (F.col("p_civil") < 0.5).alias("toxic"),
        quality.kept().alias("kept"),
    )


def _license_sql() -> str:
    values = ",".join(
        f"('{name}', [{','.join(repr(pair) for pair in pairs)}], {words}, {license_scan.targets(words)})"
        for name, pairs, words in license_scan.template_rows()
    )
    least = license_scan.THRESHOLD / (2 - license_scan.THRESHOLD)
    return f"""
WITH listed(license_id, wanted, size, aims) AS (VALUES {values}),
templates AS (SELECT row_number() OVER () AS template, * FROM listed),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(lower(text), chr(10)) AS bodies FROM documents),
lines AS (SELECT row_no, generate_subscripts(bodies, 1) - 1 AS line, unnest(bodies) AS body FROM docs),
cut AS (SELECT row_no, line, string_split_regex(body, '[.!?;:][ \\t\\r]+') AS parts FROM lines),
sentences AS (SELECT row_no, line, generate_subscripts(parts, 1) AS part, unnest(parts) AS body FROM cut),
worded AS (
  SELECT row_no, line, part,
    list_filter(string_split_regex(body, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS words
  FROM sentences
),
single AS (SELECT row_no, line, part, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM worded),
tokens AS (
  SELECT row_no, line, i, row_number() OVER seq - 1 AS place, word || ' ' || lead(word) OVER seq AS pair
  FROM single WINDOW seq AS (PARTITION BY row_no ORDER BY line, part, i)
),
held AS (
  SELECT row_no, template FROM (SELECT DISTINCT row_no, pair FROM tokens)
  JOIN (SELECT template, unnest(wanted) AS pair, len(wanted) AS n FROM templates) USING (pair)
  GROUP BY row_no, template, n HAVING count(*) >= {least} * n - 1e-9
),
whole AS (
  SELECT row_no, list(pair ORDER BY place) AS pairs, list(line ORDER BY place) AS at_line
  FROM tokens WHERE row_no IN (SELECT row_no FROM held) GROUP BY row_no
),
cuts AS (
  SELECT row_no, place AS cut FROM tokens WHERE i = 1
  UNION ALL SELECT row_no, len(pairs) FROM whole
),
aimed AS (
  SELECT row_no, template, license_id, wanted, size, cut AS start, unnest(aims) AS aim
  FROM held JOIN templates USING (template) JOIN cuts USING (row_no)
),
reached AS (
  SELECT a.row_no, template, license_id, wanted, start, aim,
    max(cut) FILTER (cut <= start + aim) AS under, min(cut) FILTER (cut >= start + aim) AS above
  FROM aimed a JOIN cuts c ON a.row_no = c.row_no AND c.cut > start AND c.cut <= start + 2 * size
  GROUP BY ALL
),
runs AS (
  SELECT row_no, template, license_id, wanted, start, under AS stop FROM reached WHERE under IS NOT NULL
  UNION SELECT row_no, template, license_id, wanted, start, above FROM reached WHERE above IS NOT NULL
),
paired AS (SELECT r.*, list_distinct(pairs[start + 1:stop - 1]) AS held FROM runs r JOIN whole USING (row_no)),
scored AS (
  SELECT *, 2.0::DOUBLE * common / (len(held) + len(wanted)) AS dice, 3 * common - len(held) - len(wanted) AS weight
  FROM (SELECT *, len(list_intersect(held, wanted)) AS common FROM paired)
),
best AS (
  SELECT row_no, start, license_id, stop, dice, weight FROM scored WHERE dice >= {license_scan.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY row_no, start ORDER BY weight DESC, license_id, stop DESC) = 1
),
chosen AS (
  SELECT * FROM best a WHERE NOT EXISTS (
    SELECT 1 FROM best b WHERE b.row_no = a.row_no
      AND 2 * (least(a.stop, b.stop) - greatest(a.start, b.start)) > least(a.stop - a.start, b.stop - b.start)
      AND (b.weight > a.weight OR b.weight = a.weight AND (b.license_id < a.license_id
        OR b.license_id = a.license_id AND b.start < a.start)))
)
SELECT doc_id, CASE WHEN at_line[start + 1] = at_line[stop] THEN 'line' ELSE 'paragraph' END AS unit,
  at_line[start + 1]::INT AS unit_no, at_line[stop]::INT AS last_no, start::INT AS start, (stop - start)::INT AS words,
  license_id, round(dice, 6) AS dice
FROM chosen JOIN whole USING (row_no) JOIN docs USING (row_no)"""


@query(_license_sql())
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.findings(table(spark, folder, "documents"))


@query()
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _spans_sql() -> str:
    kinds = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern
        # RE2 folds case beyond ASCII, so letters are spelled out.
        if "(?i:" in pattern:
            names = "password|passwd|secret|token|api_?key"
            spelled = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in names)
            pattern = pattern.replace(f"(?i:{names})", spelled)
        pattern = pattern.replace("'", "''")
        kinds.append(
            f"""
  SELECT blob, '{rule.kind}' AS kind, {rank} AS rank, generate_subscripts(found, 1) AS i, unnest(found) AS hit,
    unnest(held) AS held, unnest(gaps[1:len(found)]) AS gap, {rule.least} AS least
  FROM (SELECT blob, regexp_extract_all(text, '{pattern}') AS found,
    regexp_extract_all(text, '{pattern}', {rule.group}) AS held,
    string_split_regex(text, '{pattern}') AS gaps FROM blobs WHERE regexp_matches(text, '{pattern}'))"""
        )
    return f"""
WITH versions AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT blob, any_value(text) AS text FROM versions GROUP BY blob),
hits AS ({" UNION ALL ".join(kinds)}),
placed AS (
  SELECT blob, kind, rank, held, least, length(hit) AS width,
    sum(length(gap) + length(hit)) OVER (PARTITION BY blob, kind ORDER BY i) - length(hit) AS start
  FROM hits
),
good AS (
  SELECT blob, kind, rank, start, kind || ':' || start::BIGINT || ':' || (start + width)::BIGINT AS span
  FROM placed WHERE length(held) >= least
),
summed AS (
  SELECT blob, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM good GROUP BY blob
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM versions LEFT JOIN summed USING (blob)"""


@query(_spans_sql())
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ledger = stage(secret_scan.scan(docs, secret_scan.empty_ledger(spark)), "ledger")
    found = secret_scan.findings(docs, ledger)
    base = [rule.kind for rule in secret_scan.BASE]

    def count(kind: str):
        return F.size(F.filter("found", lambda span: span["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))), ","
        )

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("found", lambda span: span["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


@query()
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.turns(table(spark, folder, "conversations"))


@query()
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


@query(
    """
WITH worded AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words
  FROM documents
),
windows AS (
  SELECT row_no, doc_id, i, array_to_string(words[i:i + 49], ' ') AS body
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM worded WHERE len(words) >= 50)
),
judged AS (SELECT row_no, i, coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY body) AS gone FROM windows),
removed AS (SELECT DISTINCT row_no, unnest(range(i, i + 50)) AS place FROM judged WHERE gone),
flat AS (SELECT row_no, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM worded),
kept AS (
  SELECT row_no, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS body
  FROM flat ANTI JOIN removed USING (row_no, place) GROUP BY row_no
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (row_no)"""
)
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = anchors.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    """
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS words
  FROM documents
),
shingled AS (
  SELECT row_no, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS found
  FROM worded
),
classes AS (
  SELECT min(doc_id) AS node, any_value(found) AS found
  FROM shingled WHERE len(found) > 0 AND doc_id IS NOT NULL GROUP BY list_sort(found)
),
sizes AS (SELECT node, len(found) AS n FROM classes),
flat AS (SELECT node, md5_number(unnest(found)) AS shingle FROM classes),
common AS (
  SELECT x.node AS a, y.node AS b, count(*) AS n FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.node < y.node
  GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.node = a JOIN sizes q ON q.node = b
  WHERE 100 * common.n >= 75 * (p.n + q.n - common.n)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(node, seen) AS (
  SELECT node, node FROM sizes
  UNION
  SELECT both_ways.b, seen FROM reached JOIN both_ways ON both_ways.a = reached.node AND seen < both_ways.b
),
lowest AS (SELECT node, min(seen) AS component FROM reached GROUP BY node),
placed AS (
  SELECT list_sort(found) AS key, component FROM classes JOIN lowest USING (node)
)
SELECT doc_id, len(found) AS n_shingles, coalesce(component, doc_id) AS component_id,
  coalesce(coalesce(component, doc_id) = doc_id, true) AS kept
FROM shingled LEFT JOIN placed ON placed.key = list_sort(found) AND len(found) > 0"""
)
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return minhash_forest.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, chosen by its id, repeats a stretch to its end; without an id, none does."""
    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    chosen = hashed.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    spot = chosen.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    sized = spot.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), tail)
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query(
    """
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
      lambda c, x: list_reduce([xor(c, x)] || range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END))) AS h
  FROM documents
),
spotted AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM worded),
sized AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM spotted),
planted AS (
  SELECT row_no, doc_id, n,
    CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS words
  FROM sized
),
flat AS MATERIALIZED (SELECT row_no, n, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS word FROM planted),
blocks(block, row_no, n, i, name) AS (
  SELECT 1::BIGINT, row_no, n, i, hash(word) FROM flat WHERE n >= 6
  UNION ALL
  SELECT 2 * x.block, x.row_no, x.n, x.i, hash(x.name, y.name)
  FROM blocks x JOIN blocks y ON x.row_no = y.row_no AND y.i = x.i + x.block
  WHERE x.n >= 4 * x.block
),
recurring AS (
  SELECT row_no, block, lead(i) OVER (PARTITION BY row_no, block, name ORDER BY i) - i AS lag FROM blocks WHERE block > 1
),
lags AS (SELECT DISTINCT row_no, lag FROM recurring WHERE lag >= block // 2 AND lag < block),
equal AS (
  SELECT x.row_no, lag, x.i, x.i - row_number() OVER (PARTITION BY x.row_no, lag ORDER BY x.i) AS island
  FROM lags JOIN flat x USING (row_no) JOIN flat y ON y.row_no = x.row_no AND y.i = x.i + lag AND y.word = x.word
),
stretches AS (SELECT row_no, min(i) AS start, count(*) + lag AS length, lag FROM equal GROUP BY row_no, lag, island),
runs AS (
  SELECT row_no, start, length, min(lag) AS period FROM stretches
  WHERE length >= greatest(6, 4 * lag) GROUP BY row_no, start, length
),
summed AS (
  SELECT row_no, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS best
  FROM runs GROUP BY row_no
),
dropped AS (SELECT DISTINCT row_no, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row_no, string_agg(word, ' ' ORDER BY i) AS body FROM flat ANTI JOIN dropped USING (row_no, i) GROUP BY row_no)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(body, '')) AS collapsed_sha256
FROM planted LEFT JOIN summed USING (row_no) LEFT JOIN kept USING (row_no)"""
)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    found = periodic_runs.collapse_runs(docs)
    best = F.array_max(F.transform("runs", lambda run: F.struct(run["length"], -run["start"], -run["period"])))
    listed = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found, model, error = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(share) for share in (model.explained if model else [])]).cast("array<double>")
    flat = found.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return flat.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query()
def op13_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe_automaton.encode(table(spark, folder, "documents").select("doc_id", "text"))
    return bpe_automaton.decode(encoded).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
