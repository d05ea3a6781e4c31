"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, caps, exact_dedup, language, line_dedup, mixing, records, secrets, simhash, topk, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_simhash, op3_warc, op4_byte_bpe, op5_exact_dedup, op6_language_id, op7_near_vectors, op8_line_dedup, op9_token_records, op10_mixing, op11_vector_codes, op12_token_alignment, op13_exact_topk, pipeline)}


def _secret_sql() -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    keeps = {
        "assign": (secrets.ASSIGN, f"length(regexp_extract(hit, {quote(secrets.ASSIGN)}, 2)) >= 8"), "access": (secrets.ACCESS, "length(hit) >= 16"), "hex": (secrets.HEX, "length(hit) >= 32"),
        "weak_id": (secrets.WEAK_ID, "true"), "weak_secret": (secrets.WEAK_SECRET, "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')"), "endpoint": (secrets.ENDPOINT, "true"),
    }
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, "start", "start" + length(hit) AS "end" FROM (
            SELECT doc_id, hit, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start" FROM (
            SELECT doc_id, unnest(string_split_regex(text, {quote(keeps[kind][0])})) AS gap, unnest(regexp_extract_all(text, {quote(keeps[kind][0])})) AS hit,
            unnest(range(len(string_split_regex(text, {quote(keeps[kind][0])})))) AS i FROM d) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE hit IS NOT NULL AND {keeps[kind][1]}"""
        for rank, kind in enumerate(secrets.KINDS)
    )
    apart = """(o."end" <= p."start" OR o."start" >= p."end")"""
    near = lambda kinds: f"""EXISTS (SELECT 1 FROM w o WHERE o.doc_id = p.doc_id AND o.kind IN {kinds} AND {apart} AND abs(o."start" - p."start") <= {secrets.SCOPE})"""
    ids, values = near("('access', 'weak_id')"), near("('assign', 'hex', 'weak_secret')")
    text = """string_agg(kind || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY "start", rank)"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS ({parts}),
        w AS (SELECT * FROM p WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND (o.rank < 3 OR o.rank = 3 AND p.rank = 4) AND NOT {apart})),
        r AS (SELECT * FROM w p WHERE rank < 3 OR (kind = 'weak_secret' OR {values}) AND (kind = 'weak_id' OR {ids}))
        SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce({text} FILTER (rank < 3), '')) AS base_sha256, coalesce({text}, '') AS spans FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY 1"""


def _whole_vectors_sql(scale: int) -> str:
    sound = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings WHERE {sound})"


def _codes_sql() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [
        _whole_vectors_sql(vector_codes.SCALE),
        f"p AS MATERIALIZED (SELECT vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x FROM k CROSS JOIN (SELECT unnest(range({parts})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS i, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))",
    ]
    distance = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min({{'d': {distance}, 'i': i}}) AS near FROM p JOIN c{r} USING (part) GROUP BY 1, 2)")
        if r < vector_codes.ROUNDS:
            means = f"SELECT part, i, list(floor(s / n) ORDER BY pos) AS c FROM (SELECT part, near.i AS i, pos, sum(v) AS s, count(*) AS n FROM (SELECT part, near, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.part, c{r}.i, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN ({means}) m ON m.part = c{r}.part AND m.i = c{r}.i)")
    last = vector_codes.ROUNDS
    steps.append(f"f AS (SELECT vec_id, string_agg(printf('%02x', near.i), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a{last} GROUP BY 1)")
    steps.append("l AS (SELECT label, sum(error)::BIGINT AS label_error FROM f JOIN k USING (vec_id) GROUP BY 1)")
    steps.append(f"h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, i, pos)) AS codebooks_sha256 FROM (SELECT part, i, unnest(c) AS v, unnest(range(len(c))) AS pos FROM c{last}))")
    return f"WITH {', '.join(steps)} SELECT f.vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label CROSS JOIN h"


_BARE = "regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')"

ORACLES: dict[str, str] = {
    "op1_secret_scan": _secret_sql(),
    "op3_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= {warc.REVISIT_BYTES} GROUP BY 1),
        r AS (SELECT p.*, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.html = p.html)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op5_exact_dedup": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op7_near_vectors": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT r.vec_id, p.v FROM r JOIN p ON p.u = r.seen),
        c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY 1), n AS (SELECT u, count(*) AS n FROM p GROUP BY 1)
        SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.u = c.vec_id""",
    "op8_line_dedup": f"""WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        b AS (SELECT doc_id, source, i, line, {_BARE} AS bare FROM l),
        s AS (SELECT bare FROM b WHERE bare <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(1))) >= {line_dedup.MIN_SITES})
        SELECT doc_id, count(*)::INT AS n_lines, count(s.bare)::INT AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s.bare IS NULL), '')) AS clean_sha256
        FROM b LEFT JOIN s ON s.bare = b.bare GROUP BY doc_id""",
    "op10_mixing": f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY 1),
        f AS (SELECT *, row_number() OVER o AS place, (SELECT sum(source_size) FROM s) - {mixing.MOST} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
            (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
        t AS (SELECT source, source_size, least(({mixing.MOST} * source_size)::DOUBLE, (SELECT arg_min(free::DOUBLE / rest, place) FROM f WHERE free * weight <= {mixing.MOST} * source_size * rest) * weight) AS target,
            ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS "offset" FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, substr(md5(doc_id::VARCHAR), 1, {mixing.SLICE_DIGITS}), doc_id)::DOUBLE AS rank FROM d)
        SELECT doc_id, size, source_size, target, (size * (floor(rank * (target / source_size) + "offset") - floor((rank - 1) * (target / source_size) + "offset")))::BIGINT AS taken
        FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source""",
    "op11_vector_codes": _codes_sql(),
    "op13_exact_topk": f"""WITH {_whole_vectors_sql(topk.SCALE)}, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM k q JOIN k c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
