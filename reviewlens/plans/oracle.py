"""DuckDB SQL for each registered query, written row by row the way the
source application's SQL reads (join review rows to item rows, then group).

The Spark side pre-aggregates before its join; agreement with these plain
row-level statements is what checks that rewrite.
"""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ITEMS = """items AS (
  SELECT CAST(p_partkey AS VARCHAR) AS asin, p_name AS title, p_brand AS brand, p_type AS main_cat
  FROM part
  WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_type IS NOT NULL AND p_brand IS NOT NULL
    AND p_type NOT IN ('Grocery', 'Pet Supplies', 'Baby', 'Books', 'Appstore for Android', 'Gift Cards'))"""

REVIEWS = """ndocs AS (SELECT count(*) AS n FROM documents),
reviews AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS rid, CAST(l.l_partkey AS VARCHAR) AS asin,
         dc.text AS review_text, dc.doc_id,
         CAST(epoch(l.l_shipdate) AS BIGINT) AS unix_time,
         CAST(l.l_returnflag <> 'R' AS INTEGER) AS outcome
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN documents dc ON dc.doc_id = ((l.l_orderkey * 7 + l.l_linenumber) % (SELECT n FROM ndocs)
                                    + (SELECT n FROM ndocs)) % (SELECT n FROM ndocs)
  WHERE o.o_custkey IS NOT NULL AND l.l_partkey IS NOT NULL AND dc.text IS NOT NULL)"""

FACT = """scored AS (SELECT *, outcome AS sentiment FROM reviews),
known AS (SELECT s.* FROM scored s JOIN (SELECT asin AS id FROM items) ids ON s.asin = ids.id),
fact AS (
  SELECT i.asin, i.title, i.brand, i.main_cat, k.unix_time, k.sentiment,
         DATE '1970-01-01' + CAST(floor(k.unix_time / 86400) AS INTEGER) AS d
  FROM known k JOIN items i ON i.asin = k.asin)"""

LABEL_FACT = FACT.replace(
    "scored AS (SELECT *, outcome AS sentiment FROM reviews)",
    "scored AS (SELECT r.*, CAST(lb.quality AS INTEGER) AS sentiment FROM reviews r "
    "JOIN labels lb ON lb.doc_id = r.doc_id)")

SHARE = "CAST(SUM(sentiment) AS BIGINT) / COUNT(1) * 100"
CALENDAR_YEAR = "CAST(year(d) AS INTEGER)"
WEEK_YEAR = "CAST(year(d + CAST(6 - dayofweek(d) AS INTEGER)) AS INTEGER)"
MONTH = "CAST(month(d) AS INTEGER)"


def with_fact(body: str, fact: str = FACT) -> str:
    return f"WITH {ITEMS},\n{REVIEWS},\n{fact},\n{body}"


REPORTS = {
    "category_report": f"""category_report AS (
  SELECT main_cat, {SHARE} AS sentiment_rank, COUNT(1) AS review_count FROM fact GROUP BY main_cat)""",
    "brand_report": f"""brand_report AS (
  SELECT brand, {SHARE} AS sentiment_rank, COUNT(1) AS review_count FROM fact GROUP BY brand
  HAVING COUNT(1) >= 2000)""",
    "product_report": f"""product_report AS (
  SELECT title, brand, {SHARE} AS sentiment_rank, COUNT(1) AS review_count FROM fact
  GROUP BY title, brand HAVING COUNT(1) >= 100)""",
}


def over(report: str, select: str) -> str:
    return with_fact(REPORTS[report] + "\n" + select)


BRAND_ORDERS = {
    "brands_most_popular": "review_count DESC, brand",
    "brands_best_sentiment": "sentiment_rank DESC, review_count DESC, brand",
    "brands_least_popular": "review_count ASC, brand",
    "brands_worst_sentiment": "sentiment_rank ASC, review_count ASC, brand",
}
PRODUCT_ORDERS = {
    "products_most_popular": "review_count DESC, title, brand",
    "products_best_sentiment": "sentiment_rank DESC, review_count DESC, title, brand",
    "products_least_popular": "review_count ASC, title, brand",
    "products_worst_sentiment": "sentiment_rank ASC, review_count ASC, title, brand",
}

ORACLE_SQL["category_sentiment"] = over("category_report", "SELECT * FROM category_report")
ORACLE_SQL["category_sentiment_ranked"] = over(
    "category_report",
    "SELECT * FROM category_report ORDER BY sentiment_rank DESC, review_count DESC, main_cat")
ORACLE_SQL["brand_sentiment"] = over("brand_report", "SELECT * FROM brand_report")
for _name, _order in BRAND_ORDERS.items():
    ORACLE_SQL[_name] = over("brand_report", f"SELECT * FROM brand_report ORDER BY {_order} LIMIT 20")
ORACLE_SQL["top_brands_by_sentiment"] = over(
    "brand_report",
    "SELECT * FROM brand_report ORDER BY sentiment_rank DESC, review_count ASC, brand LIMIT 10")
ORACLE_SQL["top_brands_by_reviews"] = over(
    "brand_report",
    "SELECT * FROM brand_report ORDER BY review_count DESC, sentiment_rank ASC, brand LIMIT 10")

for _name, _year, _top in (
        ("brand_sentiment_by_year", CALENDAR_YEAR, "sentiment_rank DESC, review_count ASC, brand"),
        ("brand_sentiment_by_week_year", WEEK_YEAR, "sentiment_rank DESC, review_count ASC, brand")):
    ORACLE_SQL[_name] = over("brand_report", f""",
top AS (SELECT brand FROM brand_report ORDER BY {_top} LIMIT 10)
SELECT brand, {_year} AS year, {SHARE} AS sentiment_rank
FROM fact WHERE brand IN (SELECT brand FROM top)
GROUP BY brand, {_year} ORDER BY year, brand""".lstrip())

ORACLE_SQL["product_sentiment"] = over("product_report", "SELECT * FROM product_report")
for _name, _order in PRODUCT_ORDERS.items():
    ORACLE_SQL[_name] = over("product_report", f"SELECT * FROM product_report ORDER BY {_order} LIMIT 20")

_UNION = " UNION ".join(
    f"(SELECT * FROM product_report ORDER BY {o} LIMIT 20)" for o in PRODUCT_ORDERS.values())
ORACLE_SQL["product_rankings"] = over("product_report", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{n.removeprefix('products_')}' AS ranking, "
    f"CAST(row_number() OVER (ORDER BY {o}) AS INTEGER) AS place, * FROM product_report) WHERE place <= 20"
    for n, o in PRODUCT_ORDERS.items()))
ORACLE_SQL["product_report"] = over("product_report", f"SELECT DISTINCT * FROM ({_UNION})")
ORACLE_SQL["product_report_keyed"] = over(
    "product_report",
    f"SELECT sha256(concat_ws(chr(1), title, brand)) AS id, title, brand, sentiment_rank, review_count "
    f"FROM (SELECT DISTINCT * FROM ({_UNION}))")

CATEGORY_DEMAND = f"""category_demand AS (
  SELECT main_cat, {MONTH} AS month, COUNT(1) AS demand FROM fact GROUP BY main_cat, {MONTH})"""
ORACLE_SQL["category_demand"] = with_fact(CATEGORY_DEMAND + "\nSELECT * FROM category_demand ORDER BY main_cat, month")
ORACLE_SQL["category_demand_for"] = with_fact(
    CATEGORY_DEMAND + "\nSELECT * FROM category_demand WHERE main_cat = 'STANDARD'")
ORACLE_SQL["demand_categories"] = with_fact(
    CATEGORY_DEMAND + "\nSELECT main_cat FROM category_demand GROUP BY main_cat")

BRAND_DEMAND = f""",
top AS (SELECT brand FROM brand_report ORDER BY review_count DESC, sentiment_rank ASC, brand LIMIT 10),
brand_demand AS (
  SELECT brand, {MONTH} AS month, COUNT(1) AS demand FROM fact
  WHERE brand IN (SELECT brand FROM top) GROUP BY brand, {MONTH})"""
ORACLE_SQL["brand_demand"] = over("brand_report", BRAND_DEMAND.lstrip() + "\nSELECT * FROM brand_demand ORDER BY brand, month")
ORACLE_SQL["brand_demand_for"] = over("brand_report", BRAND_DEMAND.lstrip() + "\nSELECT * FROM brand_demand WHERE brand IN (SELECT brand FROM brand_report ORDER BY review_count DESC, sentiment_rank ASC, brand LIMIT 1)")

ORACLE_SQL["sentiment_labels"] = with_fact(
    REPORTS["category_report"] + "\nSELECT * FROM category_report", fact=LABEL_FACT)

ORACLE_SQL["last_write_wins"] = """
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""


# -- input side -------------------------------------------------------------------

def _fmt_price(n: str) -> str:
    return f"format('{{:,.2f}}', {n})"


RAW_ITEMS = f"""raw0 AS (
  SELECT p_partkey AS _key, CAST(p_partkey AS VARCHAR) AS asin, p_name AS title,
    CASE WHEN p_partkey % 97 = 96 THEN NULL ELSE p_brand END AS brand,
    CASE WHEN p_partkey % 53 = 0 THEN 'Gift Cards' ELSE p_type END AS main_cat,
    CASE p_partkey % 8
      WHEN 0 THEN '$' || {_fmt_price('p_retailprice')}
      WHEN 1 THEN 'from $' || {_fmt_price('p_retailprice')}
      WHEN 2 THEN '$1,' || {_fmt_price('p_retailprice')}
      WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '$1.00 - $2.00' WHEN 6 THEN '.99'
      ELSE 'N/A' END AS price,
    p_type AS cat0, p_brand AS cat1,
    'About ' || p_name AS description,
    CASE p_partkey % 4
      WHEN 0 THEN strftime(DATE '2013-01-01' + CAST(p_partkey % 365 AS INTEGER), '%B %-d, %Y')
      WHEN 1 THEN strftime(DATE '2013-01-01' + CAST(p_partkey % 365 AS INTEGER), '%-m/%-d/%Y')
      WHEN 2 THEN NULL ELSE 'n/a' END AS date,
    CASE p_partkey % 4
      WHEN 0 THEN '>#' || format('{{:,}}', p_size * 1000 + p_partkey) || ' in Things (See top 100)'
      WHEN 1 THEN NULL WHEN 2 THEN 'unranked'
      ELSE '[">#' || format('{{:,}}', p_size * 1000 + p_partkey) || ' in X"]' END AS rank
  FROM part),
raw AS (SELECT * FROM raw0 UNION ALL SELECT * FROM raw0 WHERE _key % 50 = 0)"""

ITEM_FILTER = ("asin IS NOT NULL AND title IS NOT NULL AND main_cat IS NOT NULL AND brand IS NOT NULL "
               "AND main_cat NOT IN ('Grocery', 'Pet Supplies', 'Baby', 'Books', "
               "'Appstore for Android', 'Gift Cards')")

PRICE = (r"COALESCE(TRY_CAST(replace(regexp_extract(price, "
         r"'^[^\p{Nd}]*(\d[\d,]*(?:\.\d*)?(?:[eE][+-]?\d+)?)\s*$', 1), ',', '') AS FLOAT), "
         r"CAST(-1 AS FLOAT))")
RANK = (r"COALESCE(TRY_CAST(replace(regexp_extract(rank, '\p{Nd}+(,\p{Nd}+)*', 0), ',', '') "
        r"AS BIGINT), CAST(-1 AS BIGINT))")
DATE = ("COALESCE("
        "CAST(epoch(try_strptime(date, '%B %-d, %Y')) AS DOUBLE), "
        "CAST(epoch(try_strptime(date, '%b %-d, %Y')) AS DOUBLE), "
        "CAST(epoch(try_strptime(date, '%-m/%-d/%Y')) AS DOUBLE), "
        "CAST(epoch(try_strptime(date, '%Y-%m-%d')) AS DOUBLE), "
        "CAST(epoch(try_strptime(date, '%Y-%m-%dT%H:%M:%S%z')) AS DOUBLE), "
        "CAST(-1 AS DOUBLE))")

ORACLE_SQL["metadata_filter"] = f"""WITH {RAW_ITEMS}
SELECT asin, title, brand, main_cat FROM raw WHERE {ITEM_FILTER}"""
ORACLE_SQL["price_clean"] = f"WITH {RAW_ITEMS}\nSELECT asin, price AS price_text, {PRICE} AS price FROM raw"
ORACLE_SQL["date_clean"] = f"WITH {RAW_ITEMS}\nSELECT asin, date AS date_text, {DATE} AS unixTime FROM raw"
ORACLE_SQL["date_shapes"] = """
WITH k AS (SELECT p_partkey, epoch(DATE '2013-01-01' + CAST(p_partkey % 365 AS INTEGER)) AS day,
                  p_partkey * 37 % 1440 * 60 AS minutes, p_partkey % 60 AS seconds FROM part)
SELECT p_partkey, CAST(day + CASE p_partkey % 12 WHEN 2 THEN minutes + seconds WHEN 3 THEN minutes + seconds
  WHEN 5 THEN minutes WHEN 6 THEN minutes + seconds - 7200 WHEN 7 THEN minutes WHEN 8 THEN minutes + seconds
  WHEN 9 THEN minutes WHEN 11 THEN minutes + seconds + p_partkey % 1000 / 1000 ELSE 0 END AS DOUBLE) AS unixTime
FROM k"""
ORACLE_SQL["rank_clean"] = f"WITH {RAW_ITEMS}\nSELECT asin, rank AS rank_text, {RANK} AS rank FROM raw"
ORACLE_SQL["metadata_clean"] = f"""WITH {RAW_ITEMS}
SELECT asin, title, brand, main_cat, cat0 || '|' || cat1 AS category, description, '' AS image, {PRICE} AS price, {DATE} AS unixTime, {RANK} AS rank
FROM raw WHERE {ITEM_FILTER}"""

CLEAN_RAW = f"clean AS (SELECT * FROM raw WHERE {ITEM_FILTER})"
ORACLE_SQL["reviews_known_items"] = f"""WITH {RAW_ITEMS},\n{CLEAN_RAW},\n{REVIEWS}
SELECT r.rid, r.asin, r.unix_time, r.doc_id, sha256(r.review_text) AS review_text_sha256 FROM reviews r
JOIN (SELECT asin AS id FROM clean) ids ON r.asin = ids.id"""
ORACLE_SQL["reviews_known_items_semi"] = f"""WITH {RAW_ITEMS},\n{CLEAN_RAW},\n{REVIEWS}
SELECT r.rid, r.asin, r.unix_time, r.doc_id, sha256(r.review_text) AS review_text_sha256 FROM reviews r WHERE r.asin IN (SELECT asin FROM clean)"""
ORACLE_SQL["reviews_clean"] = "WITH " + REVIEWS.replace(
    "AND dc.text IS NOT NULL)",
    "AND dc.text IS NOT NULL AND (l.l_orderkey * 7 + l.l_linenumber) % 13 <> 0)") + """
SELECT rid, asin, unix_time, doc_id, sha256(review_text) AS review_text_sha256 FROM reviews"""
ORACLE_SQL["load_counts"] = f"""WITH {RAW_ITEMS},\n{CLEAN_RAW},\n{REVIEWS}
SELECT (SELECT COUNT(*) FROM clean) AS metadata_count,
       (SELECT COUNT(*) FROM reviews r JOIN (SELECT asin AS id FROM clean) ids ON r.asin = ids.id)
         AS review_count"""

ORACLE_SQL["metadata_scan"] = f"""WITH {RAW_ITEMS}
SELECT
  CASE WHEN _key % 250 = 125 THEN NULL ELSE asin END AS asin,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE title END AS title,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE brand END AS brand,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE main_cat END AS main_cat,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE price END AS price,
  CASE WHEN _key % 250 = 125 OR _key % 10 = 9 THEN NULL ELSE cat0 || '|' || cat1 END AS category,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE description END AS description,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE '' END AS image,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE date END AS date,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE rank END AS rank
FROM raw"""

ORACLE_SQL["review_scan"] = "WITH " + REVIEWS.replace("AND dc.text IS NOT NULL)", ")") + """
SELECT rid AS reviewerID, asin, unix_time AS unixReviewTime, sha256(review_text) AS review_text_sha256
FROM reviews"""

ORACLE_SQL["training_tsv_scan"] = r"""
SELECT sha256(trim(regexp_replace(d.text, '\s+', ' ', 'g'))) AS text_sha256,
       (lb.quality = 1) AS sentiment
FROM documents d JOIN labels lb ON lb.doc_id = d.doc_id"""

ORACLE_SQL["sample_first_lines"] = f"""WITH {RAW_ITEMS},
lines AS (SELECT *, row_number() OVER (ORDER BY _key) AS line_no FROM raw)
SELECT
  CASE WHEN _key % 250 = 125 THEN NULL ELSE asin END AS asin,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE title END AS title,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE brand END AS brand,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE main_cat END AS main_cat,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE price END AS price,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE date END AS date,
  CASE WHEN _key % 250 = 125 THEN NULL ELSE rank END AS rank
FROM lines WHERE line_no <= 1000 AND _key % 100 <> 42"""

ORACLE_SQL["sample_reserialized"] = "WITH " + REVIEWS.replace(
    "dc.text AS review_text, dc.doc_id,",
    "dc.text AS review_text, dc.doc_id, l.l_orderkey, l.l_linenumber,"
).replace("AND dc.text IS NOT NULL)", ")") + """,
lines AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS line_no FROM reviews)
SELECT rid AS reviewerID, asin,
       CASE WHEN (l_orderkey * 7 + l_linenumber) % 17 = 0 THEN CAST(0 AS BIGINT) ELSE unix_time END
         AS unixReviewTime,
       CAST(NULL AS VARCHAR) AS summary, sha256(review_text) AS review_text_sha256
FROM lines WHERE line_no <= 1000"""

_JSON = """CASE WHEN {x} IS NULL THEN 'null' ELSE '"' || array_to_string(list_transform(range(1, length({x}) + 1),
  lambda i: CASE WHEN regexp_full_match(substr({x}, i, 1), '[ !#$%()*,\\-./0-9:;=?@A-Z\\[\\]^_a-z{{|}}~]') THEN substr({x}, i, 1)
    WHEN substr({x}, i, 1) = chr(92) THEN chr(92) || chr(92)
    WHEN unicode(substr({x}, i, 1)) = 8 THEN '\\b' WHEN unicode(substr({x}, i, 1)) = 9 THEN '\\t'
    WHEN unicode(substr({x}, i, 1)) = 10 THEN '\\n' WHEN unicode(substr({x}, i, 1)) = 12 THEN '\\f'
    WHEN unicode(substr({x}, i, 1)) = 13 THEN '\\r'
    WHEN unicode(substr({x}, i, 1)) < 65536 THEN '\\u' || printf('%04X', unicode(substr({x}, i, 1)))
    ELSE '\\u' || printf('%04X', 55296 + ((unicode(substr({x}, i, 1)) - 65536) >> 10))
      || '\\u' || printf('%04X', 56320 + ((unicode(substr({x}, i, 1)) - 65536) & 1023)) END), '') || '"' END"""
ORACLE_SQL["sample_reserialized_bytes"] = ORACLE_SQL["sample_reserialized"].replace(
    "lines AS (", "texts AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n "
    "FROM reviews) WHERE n <= 1000),\nlines AS (").replace("FROM reviews)\nSELECT", "FROM texts)\nSELECT").split(
    "SELECT rid AS reviewerID")[0] + """SELECT sha256('{"reviewerID":' || """ + _JSON.format(x="rid") + """
  || ',"asin":' || """ + _JSON.format(x="asin") + """ || ',"reviewText":' || """ + _JSON.format(x="review_text") + """
  || ',"summary":null,"unixReviewTime":' || CASE WHEN (l_orderkey * 7 + l_linenumber) % 17 = 0 THEN 0 ELSE unix_time END
  || '}') AS line_sha256 FROM lines"""
ORACLE_SQL["category_sentiment_stored"] = ORACLE_SQL["category_sentiment"]
ORACLE_SQL["report_replace"] = ORACLE_SQL["category_sentiment"]
ORACLE_SQL["report_readback"] = ORACLE_SQL["top_brands_by_sentiment"]


def _key_check(name: str, relation: str, keys: list[str]) -> str:
    null_test = " OR ".join(f"{k} IS NULL" for k in keys)
    key_list = ", ".join(keys)
    return (f"SELECT '{name}' AS report, CAST(COALESCE(SUM(c), 0) AS BIGINT) AS rows, "
            f"CAST(COALESCE(SUM(CASE WHEN {null_test} THEN c END), 0) AS BIGINT) AS null_keys, "
            f"CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_keys "
            f"FROM (SELECT {key_list}, COUNT(*) AS c FROM {relation} GROUP BY {key_list})")


ORACLE_SQL["report_key_check"] = with_fact(",\n".join([
    REPORTS["category_report"], REPORTS["brand_report"], REPORTS["product_report"],
    f"""by_year AS (
  SELECT brand, {CALENDAR_YEAR} AS year FROM fact
  WHERE brand IN (SELECT brand FROM brand_report
                  ORDER BY sentiment_rank DESC, review_count ASC, brand LIMIT 10)
  GROUP BY brand, {CALENDAR_YEAR})""",
    f"""product_keyed AS (
  SELECT sha256(concat_ws(chr(1), title, brand)) AS id FROM (SELECT DISTINCT * FROM ({_UNION})))""",
    CATEGORY_DEMAND,
    BRAND_DEMAND.lstrip(",\n").strip(),
]) + "\n" + "\nUNION ALL\n".join([
    _key_check("category_sentiment", "category_report", ["main_cat"]),
    _key_check("brand_sentiment", "brand_report", ["brand"]),
    _key_check("brand_sentiment_by_year", "by_year", ["brand", "year"]),
    _key_check("product_sentiment", "product_keyed", ["id"]),
    _key_check("category_demand", "category_demand", ["main_cat", "month"]),
    _key_check("brand_demand", "brand_demand", ["brand", "month"]),
]))


# -- text features and metrics ---------------------------------------------------------

def _stop_list() -> str:
    from reviewlens.functions.stopwords import ENGLISH_STOP_WORDS
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


TOKENS = r"""tok AS (
  SELECT doc_id, COALESCE(text, '') AS text,
         list_filter(string_split_regex(lower(COALESCE(text, '')), '\s+'), lambda x: length(x) > 0) AS w
  FROM documents)"""
CLEAN = f"""cln AS (
  SELECT doc_id, list_filter(w, lambda x: NOT list_contains({_stop_list()}, x)) AS c FROM tok)"""

ORACLE_SQL["tokenize_words"] = f"""WITH {TOKENS}
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens FROM tok"""
ORACLE_SQL["remove_stop_words"] = f"""WITH {TOKENS},\n{CLEAN}
SELECT doc_id, CAST(len(c) AS INTEGER) AS n_words, array_to_string(c, ' ') AS words FROM cln"""
ORACLE_SQL["word_bigrams"] = f"""WITH {TOKENS},\n{CLEAN},
bg AS (SELECT doc_id, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) AS b FROM cln)
SELECT doc_id, CAST(len(b) AS INTEGER) AS n_bigrams, array_to_string(b, '|') AS bigrams FROM bg"""
ORACLE_SQL["term_counts"] = f"""WITH {TOKENS},\n{CLEAN}
SELECT term, COUNT(*) AS count FROM (SELECT unnest(c) AS term FROM cln) GROUP BY term"""
ORACLE_SQL["document_frequency"] = f"""WITH {TOKENS},\n{CLEAN}
SELECT term, COUNT(*) AS doc_count FROM (SELECT unnest(list_distinct(c)) AS term FROM cln) GROUP BY term"""
ORACLE_SQL["char_trigrams"] = f"""WITH {TOKENS},\n{CLEAN}
SELECT gram, COUNT(*) AS count FROM (
  SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram
  FROM (SELECT array_to_string(c, ' ') AS t FROM cln) WHERE length(t) >= 3)
GROUP BY gram"""
NGRAMS = """gr AS (SELECT doc_id, unnest(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])))
  AS term FROM cln),
dict AS (SELECT term, row_number() OVER (ORDER BY COUNT(DISTINCT doc_id) DESC, term) - 1 AS id,
  COUNT(DISTINCT doc_id) AS doc_count FROM gr GROUP BY term)"""
ORACLE_SQL["ngram_dictionary"] = f"WITH {TOKENS},\n{CLEAN},\n{NGRAMS}\nSELECT term, id, doc_count FROM dict"
ORACLE_SQL["ngram_counts"] = f"""WITH {TOKENS},\n{CLEAN},\n{NGRAMS}
SELECT doc_id, id, COUNT(*) AS count FROM gr JOIN dict USING (term) WHERE doc_count >= 2 GROUP BY doc_id, id"""
ORACLE_SQL["max_abs_scaled_counts"] = f"""WITH {TOKENS},\n{CLEAN},
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(c) AS term FROM cln) GROUP BY doc_id, term)
SELECT doc_id, term, tf, tf / max(tf) OVER (PARTITION BY term) AS scaled FROM tf"""

LABELLED = """x AS (
  SELECT lb.doc_id, lb.quality AS label, lb.toxic AS prediction, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels lb JOIN documents d ON d.doc_id = lb.doc_id)"""


def _rate(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0)"


ORACLE_SQL["binary_metrics"] = f"""WITH {LABELLED},
c AS (SELECT
  CAST(COALESCE(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
  CAST(COALESCE(SUM(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
  CAST(COALESCE(SUM(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn,
  CAST(COALESCE(SUM(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn
  FROM x)
SELECT tp, fp, tn, fn,
  {_rate('tp + tn', 'tp + fp + tn + fn')} AS accuracy,
  {_rate('tp', 'tp + fp')} AS precision_pos,
  {_rate('tp', 'tp + fn')} AS recall_pos,
  {_rate('2 * tp', '2 * tp + fp + fn')} AS f1_pos,
  {_rate('tn', 'tn + fn')} AS precision_neg,
  {_rate('tn', 'tn + fp')} AS recall_neg
FROM c"""

BY_SCORE = """s AS (
  SELECT score, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg
  FROM x WHERE score IS NOT NULL GROUP BY score)"""

ORACLE_SQL["roc_auc"] = f"""WITH {LABELLED},\n{BY_SCORE},
r AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS neg_before FROM s)
SELECT CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives,
       (SELECT count(*) FROM x WHERE score IS NULL) AS unscored,
       {_rate('SUM(pos * (2 * neg_before + neg))', '2 * SUM(pos) * SUM(neg)')} AS auc_roc
FROM r"""

ORACLE_SQL["pr_auc"] = f"""WITH {LABELLED},\n{BY_SCORE},
r AS (SELECT *,
  COALESCE(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
  COALESCE(SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM s)
SELECT CAST(SUM(pos) AS BIGINT) AS positives, (SELECT count(*) FROM x WHERE score IS NULL) AS unscored,
       round(SUM(pos * (pos_before + pos) / (pos_before + pos + neg_before + neg)) / NULLIF(SUM(pos), 0), 9)
         AS auc_pr
FROM r"""

ORACLE_SQL["category_sentiment_ranked_sql"] = ORACLE_SQL["category_sentiment_ranked"]
for _name in ("category_sentiment", "brand_sentiment", "brand_sentiment_by_year", "product_sentiment",
              "category_demand", "brand_demand"):
    ORACLE_SQL[f"{_name}_sql"] = ORACLE_SQL[_name]

_DUP_ITEMS = f"""{RAW_ITEMS},
dup_items AS (SELECT asin, title, brand, main_cat FROM raw WHERE {ITEM_FILTER}),
{REVIEWS},
scored AS (SELECT *, outcome AS sentiment FROM reviews)"""
ORACLE_SQL["category_sentiment_duplicated_items"] = f"""WITH {_DUP_ITEMS},
known AS (SELECT s.* FROM scored s JOIN (SELECT asin AS id FROM dup_items) ids ON s.asin = ids.id)
SELECT i.main_cat, {SHARE} AS sentiment_rank, COUNT(1) AS review_count
FROM known k JOIN dup_items i ON i.asin = k.asin GROUP BY i.main_cat"""
ORACLE_SQL["category_sentiment_duplicated_items_semi"] = f"""WITH {_DUP_ITEMS},
known AS (SELECT s.* FROM scored s WHERE s.asin IN (SELECT asin FROM dup_items))
SELECT i.main_cat, {SHARE} AS sentiment_rank, COUNT(1) AS review_count
FROM known k JOIN dup_items i ON i.asin = k.asin GROUP BY i.main_cat"""


# -- model queries: checked by contract, as no SQL knows the fitted predictions ---------------

_TRAINERS = ("LogisticRegression(regParam=0.001)", "LogisticRegression(regParam=0.01)",
             "LogisticRegression(regParam=0.1)", "LinearSVC(regParam=0.01)",
             "NaiveBayes(smoothing=1.0)", "NaiveBayes(smoothing=0.1)", "NaiveBayes(smoothing=0.01)")
ORACLE_SQL["model_leaderboard"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', TRUE, TRUE)" for i, name in enumerate(_TRAINERS)) + ") v(iteration, trainer, fitted, rates_ok)"
ORACLE_SQL["model_search_rungs"] = ("SELECT 7::BIGINT AS candidates, TRUE AS halved, TRUE AS rows_grow, "
                                    "TRUE AS last_has_all")
ORACLE_SQL["best_model"] = "SELECT TRUE AS is_best, TRUE AS rates_ok"
ORACLE_SQL["final_metrics"] = "SELECT TRUE AS all_counted, TRUE AS rates_ok, TRUE AS beats_baseline"
ORACLE_SQL["model_roundtrip"] = "SELECT doc_id, TRUE AS same FROM documents"
ORACLE_SQL["sentiment_sql_function"] = "SELECT doc_id, TRUE AS same FROM documents"
ORACLE_SQL["review_sentiment"] = f"""WITH {REVIEWS}
SELECT rid, asin, unix_time, doc_id, TRUE AS sentiment_ok, TRUE AS score_ok FROM reviews"""
ORACLE_SQL["category_sentiment_model"] = over(
    "category_report", "SELECT main_cat, review_count, TRUE AS share_ok FROM category_report")

# -- the job ------------------------------------------------------------------------------

ORACLE_SQL["job_counts"] = ORACLE_SQL["load_counts"]
ORACLE_SQL["report_job_from_json"] = f"""WITH {RAW_ITEMS},
dup_items AS (SELECT asin, title, brand, main_cat FROM raw WHERE {ITEM_FILTER} AND _key % 250 <> 125),
{REVIEWS},
known AS (SELECT s.*, length(review_text) % 2 AS sentiment FROM reviews s
          JOIN (SELECT asin AS id FROM dup_items) ids ON s.asin = ids.id)
SELECT i.main_cat, {SHARE} AS sentiment_rank, COUNT(1) AS review_count
FROM known k JOIN dup_items i ON i.asin = k.asin GROUP BY i.main_cat"""

# Reviews without a time: they count in no year and no month.
TIMED = FACT.replace("FROM known k JOIN items i ON i.asin = k.asin)",
                     "FROM known k JOIN items i ON i.asin = k.asin WHERE k.doc_id % 17 <> 0)")
ORACLE_SQL["brand_sentiment_by_year_table"] = with_fact(f"""
all_fact AS (SELECT i.brand, k.sentiment FROM known k JOIN items i ON i.asin = k.asin),
report AS (SELECT brand, {SHARE} AS sentiment_rank, COUNT(1) AS review_count FROM all_fact GROUP BY brand
           HAVING COUNT(1) >= 2000),
top AS (SELECT brand FROM report ORDER BY sentiment_rank DESC, review_count ASC, brand LIMIT 10)
SELECT brand, {CALENDAR_YEAR} AS year, {SHARE} AS sentiment_rank FROM fact
WHERE brand IN (SELECT brand FROM top) GROUP BY brand, {CALENDAR_YEAR}""", fact=TIMED)
ORACLE_SQL["category_demand_table"] = with_fact(f"""
out AS (SELECT main_cat, {MONTH} AS month, COUNT(1) AS demand FROM fact GROUP BY main_cat, {MONTH})
SELECT * FROM out""", fact=TIMED)
ORACLE_SQL["brand_demand_table"] = with_fact(f"""
all_fact AS (SELECT i.brand, k.sentiment FROM known k JOIN items i ON i.asin = k.asin),
report AS (SELECT brand, {SHARE} AS sentiment_rank, COUNT(1) AS review_count FROM all_fact GROUP BY brand
           HAVING COUNT(1) >= 2000),
top AS (SELECT brand FROM report ORDER BY review_count DESC, sentiment_rank ASC, brand LIMIT 10)
SELECT brand, {MONTH} AS month, COUNT(1) AS demand FROM fact
WHERE brand IN (SELECT brand FROM top) GROUP BY brand, {MONTH}""", fact=TIMED)
