"""The thin queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .linededup import remove_repeated_chunks

    kept = remove_repeated_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"), pairs=True)
    return kept.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary())


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged_rows, repair_report

    return repair_report(damaged_rows(_table(spark, sf_dir, "conversations")))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_report

    return cluster_report(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_topk, op4_licenses, op5_language_id, op6_warc, op7_packing, op8_line_dedup, op9_token_counts, op10_suffix_dedup, op11_conversations, op12_jaccard, op13_centroids, pipeline)}


TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
 SELECT * FROM r WHERE rank <= 10"""

# Five hex digits, 20 bits, are four letters of base32.
WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 d AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p)
 SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to FROM d"""


# Two hex digits a byte; windows are told by their MD5. Windows that follow each other by 50 bytes or fewer leave no byte between them.
REPEATS_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
 p AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 218) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 60)) AS base FROM d)),
 w AS (SELECT doc_id, base + j AS i, md5_number(substr(part, 2 * j + 1, 100)) AS s FROM (SELECT doc_id, base, part, unnest(range(0, least(60, n - 49 - base))) AS j FROM p)),
 f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1),
 r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM w JOIN f USING (s) WHERE m < doc_id),
 g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
 spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
 cut AS (SELECT doc_id, 0 AS a, 0 AS b FROM d UNION ALL SELECT * FROM spans),
 parts AS (SELECT doc_id, a, b, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY b, a), n) AS upto, h, n FROM cut JOIN d USING (doc_id))
 SELECT doc_id, any_value(n) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) FILTER (WHERE b > a) AS n_spans,
 sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (upto - b)), '' ORDER BY b, a))) AS kept_sha256 FROM parts GROUP BY doc_id"""


LINES_SQL = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
 filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE regexp_matches(line, '[^ \\t\\n\\r\\f\\v]')),
 p AS (SELECT doc_id, k, ls, i AS a, line, lead(i) OVER w AS b, lead(line) OVER w AS next FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY line, next, ls[a + 2 : b] ORDER BY doc_id, k) > 1 AS gone FROM p WHERE b IS NOT NULL),
 counts AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS removed_chunks FROM r GROUP BY 1),
 x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r WHERE gone),
 kept AS (SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS removed_lines, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL) AS t FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY 1)
 SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(removed_chunks, 0) AS removed_chunks, coalesce(removed_lines, 0) AS removed_lines,
 CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256 FROM documents LEFT JOIN kept ON kept.doc_id = documents.doc_id LEFT JOIN counts ON counts.doc_id = documents.doc_id"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round as two common tables: the nearest centroid by joined components, and the centroids' floored means."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS c, v AS w FROM (SELECT v, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM v) ORDER BY c LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT m.c AS c, d, sum(x) AS s, count(*) AS n FROM (SELECT r, unnest(v) AS x, unnest(range(64)) AS d FROM v) JOIN a{i} USING (r) GROUP BY 1, 2),
 c{i + 1} AS MATERIALIZED (SELECT c, coalesce(f, w) AS w FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS f FROM s{i} GROUP BY c) USING (c))""")
    last = f"""SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c = m.c"""
    return "WITH " + ",\n ".join(parts) + "\n " + last


def _repair_sql() -> str:
    """CRC-32 bit by bit; then from each conversation's last row back the cheapest edits from each of the four states, told apart by cost, then letters."""
    crc = """xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)),
 lambda a, b: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295), 4294967295) % 20"""
    inits, to = {0: "su", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}
    asks = ["user", "user", "assistant", "user"]

    def past(q: int) -> str:
        step = lambda letter, cost, state, line: f"{{'c': s{state}.c + {cost}, 'a': '{letter}' || s{state}.a, 't': {line}s{state}.t}}"
        late = "(CASE WHEN cut THEN 5 ELSE 0 END)"
        ways = [step("D", "2", q, ""), f"CASE WHEN NOT gone THEN {step('R', f'1 + {late}', to[asks[q][0]], f"'{asks[q]}:' || text || chr(10) || ")} END"]
        ways += [f"CASE WHEN NOT gone AND i = '{x}' THEN {step('K', late, to[x], "role || ':' || text || chr(10) || ")} END" for x in inits[q]]
        return f"list_min([{', '.join(ways)}]) AS b{q}"

    def added(own: str, rest: str, q: int, name: str) -> str:
        state = f"{rest}{to[asks[q][0]]}"
        return f"list_min([{own}{q}, {{'c': {state}.c + 5, 'a': 'I' || {state}.a, 't': '{asks[q]}:' || chr(10) || {state}.t}}]) AS {name}{q}"

    every = lambda f: ", ".join(f(q) for q in range(4))
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 kinds AS (SELECT *, {crc} AS m FROM raw),
 hit AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS r FROM hit),
 told AS (SELECT conv_id, turn, role, text, r, left(role, 1) AS i, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS late, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM placed),
 rows_ AS (SELECT *, blank OR again AS gone, late AND NOT blank AND NOT again AS cut FROM told),
 facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
 count(*) FILTER (WHERE r > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1),
 rec AS (SELECT conv_id, count(*) AS r, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s1, {{'c': 5, 'a': 'I', 't': 'assistant:' || chr(10)}} AS s2, {{'c': 0, 'a': '', 't': ''}} AS s3 FROM rows_ GROUP BY 1
 UNION ALL SELECT conv_id, r, {every(lambda q: added("b", "f", q, "s"))} FROM (SELECT conv_id, r, {every(lambda q: f"b{q}")}, {every(lambda q: added("b", "b", q, "f"))} FROM (SELECT rec.conv_id, rec.r - 1 AS r, {every(past)} FROM rec JOIN rows_ ON rows_.conv_id IS NOT DISTINCT FROM rec.conv_id AND rows_.r = rec.r)))
 SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit,
 sha256(coalesce(left(s0.t, length(s0.t) - 1), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rec ON rec.conv_id IS NOT DISTINCT FROM o.conv_id AND rec.r = 0"""


JACCARD_SQL = """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
 s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i : i + 2])) END AS sh FROM d),
 x AS (SELECT r, len(sh) AS n, md5_number(array_to_string(unnest(sh), ' ')) AS h FROM s),
 p AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
 SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.sh)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id FROM s JOIN reach ON reach.a = s.r JOIN s t ON t.r = reach.b GROUP BY s.r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": TOP_K_SQL, "op6_warc": WARC_SQL, "op8_line_dedup": LINES_SQL, "op10_suffix_dedup": REPEATS_SQL, "op11_conversations": _repair_sql(), "op12_jaccard": JACCARD_SQL, "op13_centroids": _centroid_sql()}
