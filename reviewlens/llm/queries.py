"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as _bpe
from . import exact_dedup as _exact
from . import hard_negatives as _negatives
from . import line_dedup as _lines
from . import packing as _packing
from . import pii as _pii
from . import prefix_trie as _trie
from . import simhash as _simhash
from . import token_counts as _counts
from . import topk as _topk
from . import warc as _warc
from . import toxicity as _toxicity
from . import url_filter as _urls
from ..session import shared_path
from .common import read_table, written


PII_KEY = "example key"     # a caller brings a secret of their own


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii.replace_pii(read_table(spark, sf_dir, "documents"), PII_KEY, mark="n_replaced")


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def capture_records(pages: DataFrame) -> DataFrame:
    """Five captures of each page: two full responses, of which the second has other content,
    and revisits under a variant of the URL, after each of them and before both."""
    md = F.md5("html")
    http_date = lambda tag: F.concat(F.lit(tag), F.col("page_id").cast("string"))

    def capture(n: int, kind: str, url, after: int, headers: dict, digest):
        pairs = [x for k, v in headers.items() for x in (F.lit(k), v)]
        held = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
        return F.struct((F.col("page_id") * 5 + n).alias("record_id"), F.lit(kind).alias("type"), url.alias("url"),
                        (F.col("page_id") + after).alias("time"),
                        F.lit(200 if kind == "response" else 304).alias("status"),
                        held.alias("headers"), digest.alias("digest"))

    url = F.col("url")
    none = F.lit(None).cast("string")
    made = F.array(
        capture(0, "response", url, 0, {
            "Content-Type": F.lit("text/html"), "ETag": F.concat(F.lit('"'), md, F.lit('"')),
            "Last-Modified": http_date("T"), "Cache-Control": F.lit("max-age=1"),
            "Content-Length": F.length("html").cast("string")}, md),
        capture(1, "revisit", F.concat(F.regexp_replace(url, "^https?://", "HTTPS://WWW."), F.lit("#a")), 1000, {
            "etag": F.concat(F.lit('W/"'), md, F.lit('"')), "Cache-Control": F.lit("max-age=2"),
            "Content-Length": F.lit("0"), "Date": http_date("D")}, none),
        capture(2, "response", url, 2000, {
            "ETag": F.concat(F.lit('"2'), md, F.lit('"')), "Last-Modified": http_date("U")}, F.md5(md)),
        capture(3, "revisit", url, 3000, {
            "Last-Modified": F.when(url.startswith("https"), http_date("U")).otherwise(http_date("T"))}, none),
        capture(4, "revisit", url, -1, {}, md))
    return pages.select(F.explode(made).alias("c")).select("c.*")


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _warc.resolve_revisits(capture_records(read_table(spark, sf_dir, "pages")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(fields, "\n"))


def vocabulary_path() -> str:
    """Where the installed public tokenizer files lie."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_bpe.digest_texts(read_table(spark, sf_dir, "documents"), vocabulary_path())
            .withColumnRenamed("id", "doc_id"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return _toxicity.score(docs, _toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; then, by their labels, those of low quality deleted and the others
    revised to a tokenizer version that counts the end token; the second batch is replayed."""
    counted = written(_counts.count_tokens(read_table(spark, sf_dir, "documents"), "byte_bpe_50k",
                                           vocabulary_path()), "token-counts")
    judged = (counted.join(read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")),
                           "doc_id").filter("q is not null")
              .withColumn("op", F.when(F.col("q") == 0, "delete").otherwise("revise"))
              .withColumns({"tokenizer": F.lit("byte_bpe_50k+end"), "tokens": F.col("tokens") + 1}))
    store = _counts.Rollup(spark, shared_path(spark, "token-rollup"))
    store.commit("inserts", counted.withColumns({"op": F.lit("insert"), "seq": F.lit(1)}))
    store.commit("judged", judged.withColumn("seq", F.lit(2)))
    store.commit("judged", judged.withColumn("seq", F.lit(3)))
    return store.totals()


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.simhash_dedup(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(read_table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with up to three turns of the one whose id is the next lower multiple of 20."""
    turns = _trie.turns_of(read_table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    return _trie.prefix_trie(*_trie.shared_starts(
        turns, conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("int"), most=3))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return _negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_pivot_topk": op2_pivot_topk,
    "op3_revisit_resolution": op3_revisit_resolution,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_token_rollup": op7_token_rollup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pivot_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                   FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op3_revisit_resolution": """
        WITH p AS (SELECT page_id, url, md5(html) AS md, length(html) AS n FROM pages),
             c AS (SELECT page_id * 5 AS id, 0 AS v, url, page_id AS t, md AS digest, '"' || md || '"' AS etag,
                          'T' || page_id AS lm,
                          ['cache-control: max-age=1', 'content-length: ' || n, 'content-type: text/html',
                           'etag: "' || md || '"', 'last-modified: T' || page_id] AS h FROM p
                   UNION ALL
                   SELECT page_id * 5 + 1, 1, regexp_replace(url, '^https?://', 'HTTPS://WWW.') || '#a',
                          page_id + 1000, NULL, 'W/"' || md || '"', NULL,
                          ['cache-control: max-age=2', 'date: D' || page_id, 'etag: W/"' || md || '"'] FROM p
                   UNION ALL
                   SELECT page_id * 5 + 2, 0, url, page_id + 2000, md5(md), '"2' || md || '"', 'U' || page_id,
                          ['etag: "2' || md || '"', 'last-modified: U' || page_id] FROM p
                   UNION ALL
                   SELECT page_id * 5 + 3, 1, url, page_id + 3000, NULL, NULL,
                          CASE WHEN url LIKE 'https%' THEN 'U' ELSE 'T' END || page_id,
                          ['last-modified: ' || CASE WHEN url LIKE 'https%' THEN 'U' ELSE 'T' END || page_id] FROM p
                   UNION ALL
                   SELECT page_id * 5 + 4, 1, url, page_id - 1, md, NULL, NULL, [] FROM p),
             r AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')
                             AS rest FROM c),
             u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?]*)', 1)),
                                                           ':(80|443)?$', ''), '^www\\.', '') AS host,
                          regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1) AS path,
                          list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'),
                              lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('utm_source',
                                  'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref')))
                              AS kept FROM r),
             k AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END ||
                          CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon FROM u),
             j AS (SELECT a.id, a.canon, a.t, a.etag, a.lm, a.digest, a.h,
                          (SELECT max((b.t, b.id)) FROM k b WHERE b.v = 0 AND b.canon = a.canon
                                                              AND (b.t, b.id) < (a.t, a.id)) AS hit
                   FROM k a WHERE a.v = 1),
             m AS (SELECT j.*, s.id AS response_id, s.digest AS sd, s.h AS sh,
                          CASE WHEN s.id IS NULL THEN 'no_response'
                               WHEN j.etag IS NOT NULL THEN
                                    CASE WHEN regexp_replace(j.etag, '^W/', '') = s.etag THEN 'resolved' ELSE 'mismatch' END
                               WHEN j.lm IS NOT NULL THEN CASE WHEN j.lm = s.lm THEN 'resolved' ELSE 'mismatch' END
                               WHEN j.digest = s.digest THEN 'resolved' ELSE 'unvalidated' END AS outcome
                   FROM j LEFT JOIN k s ON s.v = 0 AND (s.t, s.id) = j.hit)
        SELECT id AS record_id, canon AS url, t AS time, response_id, outcome,
               CASE WHEN outcome = 'resolved' THEN sd END AS digest,
               CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_concat(
                    list_filter(sh, lambda x: len(list_filter(h, lambda y:
                        string_split(y, ':')[1] = string_split(x, ':')[1])) = 0), h)), chr(10)) END AS headers
        FROM m""",
    "op5_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
                   FROM documents),
             u AS (SELECT line, min((doc_id, no)) AS place, length(line) AS n FROM l GROUP BY line),
             h AS (SELECT *, unnest([n, greatest(0, n - 1)]) AS m FROM u),
             k AS (SELECT DISTINCT line, place, n, unnest([m || 'f' || left(line, greatest(0, (m - 1) // 2)),
                                                           m || 'l' || right(line, greatest(0, (m - 1) // 2))]) AS k
                   FROM h),
             p AS (SELECT DISTINCT a.line AS a, a.n AS n, b.line AS b, b.n AS o FROM k a JOIN k b
                   ON a.k = b.k AND b.place < a.place AND abs(a.n - b.n) <= 1),
             e AS (SELECT DISTINCT a FROM p WHERE len(list_filter(range(greatest(n, o)), lambda i:
                       CASE WHEN n = o THEN left(a, i) = left(b, i) AND substring(a, i + 2) = substring(b, i + 2)
                            WHEN n > o THEN left(a, i) || substring(a, i + 2) = b
                            ELSE left(b, i) || substring(b, i + 2) = a END)) > 0),
             s AS (SELECT l.doc_id, l.no, l.line,
                          (l.doc_id, l.no) = u.place AND l.line NOT IN (SELECT a FROM e) AS kept
                   FROM l JOIN u ON l.line = u.line)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (kept) AS INTEGER) AS n_kept,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (kept), '')) AS text_sha256
        FROM s GROUP BY doc_id""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_url_filter": """
        WITH g AS (SELECT row_number() OVER () AS nr, page_id, coalesce(url, '') AS url FROM pages),
             s AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                   FROM g),
             h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
             r AS (SELECT *, CASE
                       WHEN suffix('.' || host, '.example.org') AND prefix(path, '/en/1') THEN 'example.org/en/1'
                       WHEN suffix('.' || host, '.example.org') AND prefix(path, '/es/') THEN 'example.org/es/'
                       WHEN suffix('.' || host, '.com') AND prefix(path, '/fr/') THEN 'com/fr/'
                       WHEN suffix('.' || host, '.com') AND prefix(path, '/de/') THEN 'com/de/'
                       WHEN suffix('.' || host, '.org') AND prefix(path, '/') THEN 'org/' END AS rule FROM h),
             a AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END
                             AS action,
                          -- crc32, bit by bit: -1 stands for a shift
                          xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                              range(octet_length(encode(url))), lambda i: list_concat(
                                  [CAST('0x' || substr(hex(encode(url)), 2 * i + 1, 2) AS BIGINT)],
                                  [-1, -1, -1, -1, -1, -1, -1, -1])))),
                              lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                                                ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 5 = 0 AS aside
                   FROM r),
             u AS (SELECT *, CASE WHEN action IS NULL THEN 'judge' WHEN aside THEN 'calibrate' ELSE action END AS used,
                          repeat(chr(2), 4) || url || chr(3) AS marked FROM a),
             w AS (SELECT nr, used, unnest(list_transform(range(1, length(marked) - 3),
                                                          lambda i: substr(marked, i, 5))) AS gram FROM u),
             f AS (SELECT gram, count(*) FILTER (used = 'allow') AS a, count(*) FILTER (used = 'block') AS b,
                          count(*) FILTER (used IN ('judge', 'calibrate')) AS w FROM w GROUP BY gram),
             e AS (SELECT gram, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(w)::BIGINT AS w
                   FROM (SELECT unnest([substr(gram, 1), substr(gram, 2), substr(gram, 3), substr(gram, 4),
                                        substr(gram, 5)]) AS gram, a, b, w FROM f) GROUP BY gram),
             c AS (SELECT *, sum(a) OVER x AS na, count(*) FILTER (a > 0) OVER x AS ta,
                          sum(b) OVER x AS nb, count(*) FILTER (b > 0) OVER x AS tb
                   FROM e WINDOW x AS (PARTITION BY length(gram), left(gram, length(gram) - 1))),
             v AS (SELECT 1.0::DOUBLE / (count(*) + 1) AS p FROM e WHERE length(gram) = 1 AND a + b > 0),
             p1 AS (SELECT gram, CASE WHEN na > 0 THEN (a + ta * p)::DOUBLE / (na + ta) ELSE p END AS pa,
                           CASE WHEN nb > 0 THEN (b + tb * p)::DOUBLE / (nb + tb) ELSE p END AS pb
                    FROM c, v WHERE length(gram) = 1),
             p2 AS (SELECT c.gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
                           CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb
                    FROM c JOIN p1 ON length(c.gram) = 2 AND p1.gram = substr(c.gram, 2)),
             p3 AS (SELECT c.gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
                           CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb
                    FROM c JOIN p2 ON length(c.gram) = 3 AND p2.gram = substr(c.gram, 2)),
             p4 AS (SELECT c.gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
                           CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb
                    FROM c JOIN p3 ON length(c.gram) = 4 AND p3.gram = substr(c.gram, 2)),
             p5 AS (SELECT c.gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
                           CASE WHEN nb > 0 THEN (b + tb * pb) / (nb + tb) ELSE pb END AS pb
                    FROM c JOIN p4 ON length(c.gram) = 5 AND p4.gram = substr(c.gram, 2)),
             l AS (SELECT w.nr, sum(round((ln(pa) - ln(pb)) * 1048576)::BIGINT)::BIGINT AS units, count(*) AS n
                   FROM w JOIN p5 USING (gram) WHERE used IN ('judge', 'calibrate') GROUP BY w.nr),
             t AS (SELECT u.*, units, n, least(1024, greatest(-1024, floor(units::DOUBLE / (n * 16384))))::BIGINT AS step
                   FROM u LEFT JOIN l USING (nr)),
             k AS (SELECT step, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'block') AS b
                   FROM t WHERE used = 'calibrate' GROUP BY step),
             z AS (SELECT sum(a) AS a, sum(b) AS b FROM k),
             o AS (SELECT cut, sum(CASE WHEN k.step >= cut THEN k.a * z.b ELSE k.b * z.a END) AS good
                   FROM range(-1024, 1026) AS q(cut), k, z WHERE z.a > 0 AND z.b > 0 GROUP BY cut),
             d AS (SELECT coalesce((SELECT cut FROM o ORDER BY good DESC, abs(cut), cut LIMIT 1), 0) AS cut),
             n AS (SELECT count(*) FILTER (used = 'allow') > 0 AND count(*) FILTER (used = 'block') > 0 AS able FROM u)
        SELECT page_id, host, path, rule,
               coalesce(action, CASE WHEN NOT able OR step >= cut THEN 'allow' ELSE 'block' END) AS verdict,
               CASE WHEN able AND action IS NULL THEN units::DOUBLE / n / 1048576 END AS score
        FROM t, d, n""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                             coalesce(text, '')) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
             h AS (SELECT DISTINCT c, c - c % 20 AS base,
                          -- crc32, bit by bit: -1 stands for a shift
                          xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                              range(length(c::VARCHAR)), lambda i: list_concat(
                                  [CAST(ascii(substr(c::VARCHAR, i + 1, 1)) AS BIGINT)],
                                  [-1, -1, -1, -1, -1, -1, -1, -1])))),
                              lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                                                ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
                   FROM t),
             r AS (SELECT h.c, 0 AS own, t.pos, role, text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h
                   UNION ALL
                   SELECT h.c, 1, t.pos, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
             q AS (SELECT c, row_number() OVER w AS depth, text,
                          list(length(role) || ':' || role || text || chr(1)) OVER w AS prefix
                   FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
             p AS (SELECT c, depth, sha256(array_to_string(prefix, '')) AS k, text FROM q
                   UNION ALL SELECT c, 0, '', '' FROM h),
             n AS (SELECT min(c) AS conv_id, depth, k, count(*) AS n_convs,
                          (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved
                   FROM p GROUP BY depth, k),
             e AS (SELECT DISTINCT a.k AS parent, b.k AS child FROM p a JOIN p b ON a.c = b.c AND b.depth = a.depth + 1),
             l AS (SELECT *, k NOT IN (SELECT parent FROM e) AS leaf FROM n),
             s AS (SELECT a.k, sum(l.saved)::BIGINT AS saved_tokens, count(*) FILTER (l.leaf) AS n_leaves
                   FROM l JOIN p b ON b.c = l.conv_id AND b.depth = l.depth
                   JOIN p a ON a.c = b.c AND a.depth <= b.depth GROUP BY a.k),
             d AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
                   FROM p JOIN (SELECT c, max(depth) AS depth FROM p GROUP BY c) USING (c, depth) GROUP BY k)
        SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs,
               (SELECT count(*) FROM e WHERE e.parent = n.k) AS n_children, n_leaves, saved_tokens,
               sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN s USING (k) LEFT JOIN d USING (k) LEFT JOIN e ON e.child = n.k LEFT JOIN n m ON m.k = e.parent""",
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike,
                          CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                   FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                          row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
                   FROM s WHERE alike),
             h AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                          row_number() OVER (PARTITION BY p.anchor_id, positive_id
                                             ORDER BY s.score DESC, s.vec_id) AS r
                   FROM p JOIN s ON p.n <= 5 AND s.anchor_id = p.anchor_id AND NOT s.alike
                        AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM h WHERE r <= 10""",
}
