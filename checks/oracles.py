"""SQL counterpart of each query, for DuckDB on the same tables."""

from __future__ import annotations

from checks.parameters import CHINESE, EXTRA_STOPWORDS, JAPANESE, LATIN, LEXICON, TAXONOMY, TOKEN_LEXICON, TURNS
from shoplens.functions.text import BLANK
from shoplens.functions.words import ENGLISH_STOPWORDS, NOUN_TAGS

ORACLES: dict[str, str] = {}


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


def half_even(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10**digits}, 0) / {10**digits}"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


SALES = """sales AS (
  SELECT l_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS customer, p_name AS product,
         l_quantity AS quantity, p_retailprice AS price, l_quantity * p_retailprice AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_quantity > 0 AND p_retailprice > 0)"""

PURCHASES = """sales AS (
  SELECT ts AS order_date, user_id AS customer, 1.0 AS quantity, value AS price, value AS revenue
  FROM events WHERE event_type = 'purchase' AND value > 0)"""

EVENTS = """gaps AS (
  SELECT event_id, ts, user_id, CASE WHEN value <= 80 THEN event_type END AS event_type,
         CASE WHEN event_type <> 'error' THEN value END AS value, props
  FROM events)"""

# -- typing and roles ----------------------------------------------------------------

DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}

ORACLES["text_column_stats"] = """
SELECT "column", round(avg_len, 3) AS avg_len, contains("column", 'text') AS name_match, "column" = 'text' AS chosen
FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(length(CAST({c} AS VARCHAR))) AS avg_len FROM documents" for c in DOCUMENT_COLUMNS
) + ")"


def role_case(numeric, datetime) -> str:
    return f"""CASE WHEN "column" IN ({quoted(numeric)}) THEN 'numeric'
  WHEN "column" IN ({quoted(datetime) or "''"}) THEN 'datetime'
  WHEN n_unique <= 20 THEN 'categorical' WHEN n_unique <= 100 THEN 'high_cardinality' ELSE 'text' END"""


ORACLES["column_types"] = f"""
SELECT "column", dtype, {role_case(("doc_id", "n_chars"), ())} AS role FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS n_unique FROM documents"
    for c, t in DOCUMENT_COLUMNS.items()
) + ")"

ROLES = {"date": "order_date", "customer": "customer", "product": "product", "quantity": "quantity", "price": "price"}
ORACLES["commerce_roles"] = f"WITH {SALES} " + " UNION ALL ".join(
    f"SELECT '{role}' AS role, '{c}' AS \"column\", count({c}) AS n_values FROM sales" for role, c in ROLES.items()
)

# -- scalar operators ----------------------------------------------------------------

CATEGORY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(text, '{k}')" for k in keywords) + f" THEN '{category}'"
    for category, keywords in TAXONOMY
) + " ELSE 'unclassified' END"

ORACLES["classify_reviews"] = f"SELECT doc_id, {CATEGORY} AS category FROM documents"

HITS = f"""lex(pos, word, score) AS ({values((i, w, s) for i, (w, s) in enumerate(LEXICON))}),
hits AS (SELECT doc_id, pos, word, score FROM documents JOIN lex ON contains(text, word))"""
SCORES = f"""{HITS},
scores AS (
  SELECT d.doc_id, CAST(coalesce(sum(score), 0) AS BIGINT) AS score,
         coalesce(string_agg(word, ', ' ORDER BY length(word) DESC, pos), '') AS keywords
  FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id),
labels AS (
  SELECT *, CASE WHEN score >= 1 THEN 'positive' WHEN score <= -1 THEN 'negative' ELSE 'neutral' END AS label
  FROM scores)"""

ORACLES["sentiment_scores"] = f"WITH {SCORES} SELECT doc_id, score, keywords FROM scores"
ORACLES["sentiment_labels"] = f"WITH {SCORES} SELECT doc_id, label FROM labels"

ORACLES["doc_language"] = r"""
WITH n AS (
  SELECT doc_id,
    length(regexp_replace(text, '[^가-힣]', '', 'g')) AS ko,
    length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS en,
    length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS zh,
    length(regexp_replace(text, '[^\x{3040}-\x{309f}\x{30a0}-\x{30ff}]', '', 'g')) AS ja
  FROM documents)
SELECT doc_id, CASE WHEN greatest(ko, en, zh, ja) = 0 THEN 'en'
  WHEN ko = greatest(ko, en, zh, ja) THEN 'ko' WHEN en = greatest(ko, en, zh, ja) THEN 'en'
  WHEN zh = greatest(ko, en, zh, ja) THEN 'zh' ELSE 'ja' END AS language
FROM n"""

STOP = quoted([*ENGLISH_STOPWORDS, *EXTRA_STOPWORDS])
TOKENS = f"""lists AS (
  SELECT doc_id, text,
    list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda t: t NOT IN ({STOP})) AS tokens
  FROM documents)"""
WORDS = f"{TOKENS}, words AS (SELECT doc_id, unnest(tokens) AS word FROM lists)"
FREQ = f"{WORDS}, freq AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM words GROUP BY word)"

ORACLES["tokenize_en"] = f"""WITH {TOKENS}
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM lists"""

TOKEN_SCORES = f"""{WORDS}, lex(word, score) AS ({values(TOKEN_LEXICON)}),
scored AS (
  SELECT d.doc_id, CAST(coalesce(sum(score), 0) AS BIGINT) AS score
  FROM documents d LEFT JOIN words USING (doc_id) LEFT JOIN lex USING (word) GROUP BY d.doc_id),
labels AS (
  SELECT *, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS label
  FROM scored)"""
ORACLES["vector_terms"] = r"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, regexp_extract_all(lower(translate(replace(text, 'er ', '-'), 'aeiou', 'AEIOU')), '[\p{L}\p{N}_]{2,}') AS t FROM documents)"""

ORACLES["token_sentiment"] = f"WITH {TOKEN_SCORES} SELECT doc_id, score, label FROM labels"


def plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{BLANK}+', ' ', 'g'))"


ORACLES["strip_html_pages"] = f"SELECT page_id, {plain('html')} AS text FROM pages"

ORACLES["clean_sales"] = """
SELECT l_orderkey AS line_of, l_linenumber AS line_no, strftime(l_shipdate, '%Y-%m-%d') AS order_date,
       o_custkey AS customer, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS quantity, l_extendedprice AS price,
       round(CAST(l_quantity AS INTEGER) * l_extendedprice, 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag <> 'R' AND l_discount NOT IN (0.01, 0.02) AND o_orderstatus <> 'P'
  AND (l_linestatus = 'F' OR l_tax >= 0.02) AND CAST(l_quantity AS INTEGER) > 0 AND l_extendedprice > 0"""

ORACLES["calendar_parts"] = """
SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day,
       CAST(isodow(ts) - 1 AS INTEGER) AS weekday
FROM events"""

# -- reviews -------------------------------------------------------------------------

ORACLES["category_distribution"] = f"""
WITH c AS (SELECT {CATEGORY} AS category, count(*) AS n FROM documents GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY category = 'unclassified', n DESC, category) AS INTEGER) AS rank,
       category, n, round(n * 100.0 / sum(n) OVER (), 2) AS pct
FROM c"""

ORACLES["category_examples"] = f"""
WITH c AS (SELECT doc_id, text, {CATEGORY} AS category FROM documents),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY doc_id) AS INTEGER) AS rank FROM c)
SELECT category, rank, doc_id,
       CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS example
FROM r WHERE rank <= 5"""


def label_table(labels, extra="") -> str:
    names = " UNION ALL ".join(f"SELECT '{x}' AS label" for x in labels)
    return f"""t AS (SELECT count(*) AS total{extra and ', ' + extra} FROM labels),
names AS ({names})
SELECT names.label, count(labels.label) AS n, round(count(labels.label) * 100.0 / any_value(total), 2) AS pct,
       any_value(total) AS total"""


ORACLES["sentiment_distribution"] = f"""WITH {SCORES},
{label_table(("positive", "neutral", "negative"), "avg(score) AS mean")}, round(any_value(mean), 4) AS avg_score
FROM names CROSS JOIN t LEFT JOIN labels ON labels.label = names.label GROUP BY names.label"""

ORACLES["top_keywords"] = f"""WITH {HITS},
c AS (SELECT CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS polarity, word, count(*) AS n
      FROM hits WHERE score <> 0 GROUP BY ALL),
r AS (SELECT polarity, CAST(row_number() OVER (PARTITION BY polarity ORDER BY n DESC, word) AS INTEGER) AS rank, word, n
      FROM c)
SELECT * FROM r WHERE rank <= 5"""

ORACLES["keyword_weights"] = f"""WITH {HITS}
SELECT word, CAST(score AS BIGINT) AS score, count(*) AS n,
  CASE WHEN score >= 2 THEN 'strong_positive' WHEN score >= 1 THEN 'positive'
       WHEN score <= -2 THEN 'strong_negative' WHEN score <= -1 THEN 'negative' ELSE 'neutral' END AS band
FROM hits GROUP BY word, score ORDER BY n DESC, word LIMIT 100"""

ORACLES["strongest_keywords"] = f"""WITH {HITS},
c AS (SELECT DISTINCT CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS polarity, word,
             CAST(abs(score) AS BIGINT) AS strength
      FROM hits WHERE score <> 0),
r AS (SELECT polarity, CAST(row_number() OVER (PARTITION BY polarity ORDER BY strength DESC, word) AS INTEGER) AS rank,
             word, strength
      FROM c)
SELECT * FROM r WHERE rank <= 15"""

ORACLES["representative_reviews"] = f"""WITH {SCORES},
r AS (SELECT label, doc_id, score, keywords, CAST(row_number() OVER (PARTITION BY label
        ORDER BY CASE label WHEN 'positive' THEN -score WHEN 'negative' THEN score ELSE 0 END, doc_id) AS INTEGER) AS rank
      FROM labels)
SELECT label, rank, doc_id, substring(text, 1, 200) AS example, score, keywords
FROM r JOIN documents USING (doc_id) WHERE rank <= 5"""

# -- exploratory statistics ----------------------------------------------------------

EVENT_COLUMNS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
    "event_type": "string", "value": "double", "props": "string",
}
EVENT_NUMBERS = ("event_id", "user_id", "value")
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")

EVENT_PROFILE = f"""{EVENTS},
p AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS n_null,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_unique FROM gaps"""
    for c, t in EVENT_COLUMNS.items()
) + f"""), roles AS (SELECT *, {role_case(EVENT_NUMBERS, ("ts",))} AS role FROM p)"""



def overview(columns) -> str:
    missing = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in columns)
    return f"""WITH {EVENT_PROFILE},
k AS (SELECT {", ".join(columns)} FROM gaps), d AS (SELECT DISTINCT * FROM k),
r AS (SELECT * FROM roles WHERE "column" IN ({quoted(columns)}))
SELECT count(*) AS n_rows, CAST({len(columns)} AS BIGINT) AS n_columns, CAST(sum({missing}) AS BIGINT) AS n_missing,
  round(sum({missing}) * 100.0 / (count(*) * {len(columns)}), 2) AS missing_pct,
  count(*) - (SELECT count(*) FROM d) AS n_duplicates,
  (SELECT count(*) FROM r WHERE role = 'numeric') AS n_numeric,
  (SELECT count(*) FROM r WHERE role = 'categorical') AS n_categorical,
  (SELECT count(*) FROM r WHERE role = 'datetime') AS n_datetime,
  (SELECT count(*) FROM r WHERE role IN ('text', 'high_cardinality')) AS n_text
FROM k"""


ORACLES["eda_overview"] = overview(list(EVENT_COLUMNS))
ORACLES["eda_overview_repeats"] = overview(["user_id", "event_type", "props"])

ORACLES["eda_profile"] = f'WITH {EVENT_PROFILE} SELECT "column", dtype, role, n_null, null_pct, n_unique FROM roles'


def describe(table: str, columns) -> str:
    measures = {"mean": "avg({})", "std": "stddev_samp({})", "min": "CAST(min({}) AS DOUBLE)",
                "p25": "quantile_cont({}, 0.25)", "p50": "quantile_cont({}, 0.5)", "p75": "quantile_cont({}, 0.75)",
                "max": "CAST(max({}) AS DOUBLE)"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, """
        + ", ".join(f"{half_even(sql.format(c), 2)} AS {name}" for name, sql in measures.items())
        + f" FROM {table}" for c in columns)


ORACLES["eda_describe"] = f"WITH {EVENTS} {describe('gaps', EVENT_NUMBERS)}"
ORACLES["eda_describe_lineitem"] = describe("lineitem", LINE_NUMBERS)

ORACLES["quartiles_of_parts"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))

VARIANCE = "v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_samp({c}), 2) AS variance FROM lineitem" for c in LINE_NUMBERS) + ")"
ORACLES["top_variance"] = f'WITH {VARIANCE} SELECT * FROM v ORDER BY variance DESC, "column" LIMIT 3'

ORACLES["histogram"] = f"""WITH {VARIANCE},
chosen AS (SELECT "column" FROM v ORDER BY variance DESC, "column" LIMIT 3),
x AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem" for c in LINE_NUMBERS) + """),
lim AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM x JOIN chosen USING ("column") GROUP BY "column"),
b AS (SELECT "column", least(29, CAST(floor((value - lo) / (hi - lo) * 30) AS BIGINT)) AS bin, count(*) AS n
      FROM x JOIN lim USING ("column") GROUP BY ALL),
frame AS (SELECT "column", lo, hi, unnest(range(30)) AS bin FROM lim)
SELECT "column", CAST(bin AS BIGINT) AS bin, round(lo + bin * ((hi - lo) / 30), 4) AS lo,
  round(CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 30) END, 4) AS hi, coalesce(n, 0) AS n
FROM frame LEFT JOIN b USING ("column", bin)"""

ORACLES["top_values"] = """
WITH c AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL),
r AS (SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank, value, n
      FROM c)
SELECT * FROM r WHERE rank <= 15"""

ORACLES["daily_counts"] = """
SELECT 'o_orderdate' AS "column", strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL"""

ORACLES["correlation"] = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 4) AS r FROM lineitem"
    for x in LINE_NUMBERS for y in LINE_NUMBERS)

FENCES = f"""{EVENTS},
x AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", event_id, CAST({c} AS DOUBLE) AS value FROM gaps" for c in EVENT_NUMBERS) + """),
q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
             quantile_cont(value, 0.75) AS q3 FROM x GROUP BY "column"),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q),
o AS (SELECT "column", any_value(q1) AS q1, any_value(q3) AS q3, any_value(lower) AS lower, any_value(upper) AS upper,
             count(*) FILTER (value < lower OR value > upper) AS n_outliers, count(*) AS n_rows
      FROM x JOIN f USING ("column") GROUP BY "column")"""

ORACLES["iqr_outliers"] = f"""WITH {FENCES}
SELECT "column", {", ".join(f"{half_even(c, 4)} AS {c}" for c in ("q1", "q3", "lower", "upper"))},
       n_outliers, round(n_outliers * 100.0 / n_rows, 2) AS pct FROM o"""

ORACLES["outlier_examples"] = f"""WITH {FENCES},
worst AS (SELECT * FROM o WHERE n_outliers > 0 ORDER BY n_outliers DESC LIMIT 3),
e AS (SELECT "column", n_outliers, lower, upper, value,
        CAST(row_number() OVER (PARTITION BY "column" ORDER BY event_id) AS INTEGER) AS rank
      FROM worst JOIN x USING ("column") WHERE value < lower OR value > upper)
SELECT "column", n_outliers, {half_even("lower", 4)} AS lower, {half_even("upper", 4)} AS upper, rank, value
FROM e WHERE rank <= 5"""

ORACLES["missing_summary"] = f'WITH {EVENT_PROFILE} SELECT "column", n_null, null_pct FROM roles WHERE n_null > 0'

ORACLES["box_stats"] = f"""WITH {FENCES}
SELECT "column", {half_even("any_value(q1)", 4)} AS q1, {half_even("any_value(q2)", 4)} AS median,
  {half_even("any_value(q3)", 4)} AS q3,
  {half_even("min(value) FILTER (value >= lower AND value <= upper)", 4)} AS whisker_low,
  {half_even("max(value) FILTER (value >= lower AND value <= upper)", 4)} AS whisker_high,
  {half_even("avg(value)", 4)} AS mean, {half_even("stddev_samp(value)", 4)} AS std
FROM x JOIN f USING ("column") GROUP BY "column" """

# -- sales ---------------------------------------------------------------------------

ORACLES["sales_kpis"] = f"""WITH {SALES}
SELECT strftime(min(order_date), '%Y-%m-%d') AS date_min, strftime(max(order_date), '%Y-%m-%d') AS date_max,
  count(*) AS n_orders, count(DISTINCT customer) AS n_customers, count(DISTINCT product) AS n_products,
  round(sum(revenue), 2) AS revenue, round(sum(revenue) / count(*), 2) AS revenue_per_order
FROM sales"""

ORACLES["monthly_revenue"] = f"""WITH {SALES}
SELECT strftime(order_date, '%Y-%m') AS month, round(sum(revenue), 2) AS revenue FROM sales GROUP BY 1"""

ORACLES["daily_orders"] = f"""WITH {SALES}
SELECT strftime(order_date, '%Y-%m-%d') AS day, count(*) AS n_orders FROM sales GROUP BY 1"""

ORACLES["weekday_orders"] = f"""WITH {SALES}
SELECT CAST(d AS INTEGER) AS weekday, count(order_date) AS n_orders
FROM range(7) r(d) LEFT JOIN sales ON isodow(order_date) - 1 = d GROUP BY d"""

for by in ("revenue", "quantity"):
    ORACLES[f"top_products_{by}"] = f"""WITH {SALES}
SELECT product, round(sum({by}), 2) AS {by} FROM sales GROUP BY product ORDER BY {by} DESC, product LIMIT 15"""

RFM = """base AS (
  SELECT customer, (epoch_us((SELECT max(order_date) FROM sales) + INTERVAL 1 DAY) - epoch_us(max(order_date)))
           // 86400000000 AS R, count(*) AS F, round(sum(revenue), 6) AS M
  FROM sales GROUP BY customer)"""

ORACLES["rfm_base"] = f"WITH {SALES}, {RFM} SELECT customer, CAST(R AS BIGINT) AS R, F, round(M, 2) AS M FROM base"

EDGES = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"


def score(metric: str) -> str:
    steps = " + ".join(f"CAST({metric} > e{metric}[{i}] AS INTEGER)" for i in (2, 3, 4, 5))
    ranked = f"greatest(1, ((rn{metric} - 1) * 5 + n - 2) // nullif(n - 1, 0))"
    up = f"CASE WHEN len(list_distinct(e{metric})) = 6 THEN 1 + {steps} ELSE {ranked} END"
    value = f"6 - ({up})" if metric == "R" else up
    return f"CAST(CASE WHEN n = 1 THEN 3 ELSE {value} END AS INTEGER) AS {metric}_score"


SCORED = f"""{RFM},
e AS (SELECT count(*) AS n, quantile_cont(R, {EDGES}) AS eR, quantile_cont(F, {EDGES}) AS eF,
             quantile_cont(M, {EDGES}) AS eM FROM base),
ranked AS (SELECT *, row_number() OVER (ORDER BY R, customer) AS rnR, row_number() OVER (ORDER BY F, customer) AS rnF,
             row_number() OVER (ORDER BY M, customer) AS rnM FROM base),
scores AS (SELECT customer, CAST(R AS BIGINT) AS R, F, M, {score("R")}, {score("F")}, {score("M")}
           FROM ranked CROSS JOIN e),
rfm AS (SELECT *, CASE
    WHEN R_score >= 4 AND F_score >= 4 AND M_score >= 4 THEN 'champion'
    WHEN F_score >= 3 AND M_score >= 3 THEN 'loyal'
    WHEN R_score >= 3 AND F_score >= 2 THEN 'potential'
    WHEN R_score >= 4 AND F_score <= 1 THEN 'new'
    WHEN R_score <= 2 AND F_score >= 2 THEN 'at_risk'
    WHEN R_score <= 2 AND F_score <= 2 THEN 'lost'
    ELSE 'general' END AS segment FROM scores)"""

ORACLES["rfm_scores"] = f"WITH {SALES}, {SCORED} SELECT customer, R, F, R_score, F_score, M_score FROM scores"
ORACLES["rfm_scores_purchases"] = f"WITH {PURCHASES}, {SCORED} SELECT customer, R, F, R_score, F_score, M_score FROM scores"
ORACLES["rfm_segments"] = f"WITH {PURCHASES}, {SCORED} SELECT customer, segment FROM rfm"

ORACLES["segment_distribution"] = f"""WITH {SALES}, {SCORED}
SELECT segment, count(*) AS n_customers, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM rfm GROUP BY segment"""

RULES = "['champion', 'loyal', 'potential', 'new', 'at_risk', 'lost', 'general']"
ORACLES["segment_scores"] = f"""WITH {SALES}, {SCORED}
SELECT CAST(list_position({RULES}, segment) AS BIGINT) AS rule, segment, round(avg(R_score), 2) AS r,
       round(avg(F_score), 2) AS f, round(avg(M_score), 2) AS m
FROM rfm GROUP BY segment"""

ORACLES["segment_summary"] = f"""WITH {SALES}, {SCORED}
SELECT segment, count(*) AS n_customers, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct,
       round(avg(R), 2) AS avg_r, round(avg(F), 2) AS avg_f, round(avg(M), 2) AS avg_m
FROM rfm GROUP BY segment"""

ORACLES["sales_findings"] = f"""WITH {SALES}, {SCORED},
s AS (SELECT segment, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM rfm GROUP BY segment)
SELECT 'champion_share' AS finding, segment, round(pct, 2) AS value FROM s WHERE segment = 'champion'
UNION ALL SELECT 'lost_share_high', segment, round(pct, 2) FROM s WHERE segment = 'lost' AND pct > 20
UNION ALL SELECT 'at_risk_share_high', segment, round(pct, 2) FROM s WHERE segment = 'at_risk' AND pct > 15
UNION ALL (SELECT 'largest_segment', segment, CAST(n AS DOUBLE) FROM s
           ORDER BY n DESC, list_position({RULES}, segment) LIMIT 1)
UNION ALL SELECT 'revenue_per_order', NULL, round(sum(revenue) / count(*), 2) FROM sales"""

# -- text mining ---------------------------------------------------------------------

ORACLES["word_freq"] = f"WITH {FREQ} SELECT word, n FROM freq"

ORACLES["corpus_overview"] = f"""WITH {FREQ}
SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM freq) AS n_words,
       'text' AS text_column, 'en' AS language"""

ORACLES["tfidf_keywords"] = f"""WITH {FREQ},
vocab AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + n_docs)) + 1 AS idf
          FROM freq ORDER BY n DESC, word LIMIT 1000),
w AS (SELECT doc_id, word, count(*) * any_value(idf) AS w FROM words JOIN vocab USING (word) GROUP BY doc_id, word),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS length FROM w GROUP BY doc_id),
s AS (SELECT word AS term, round(sum(w / length) / (SELECT count(*) FROM documents), 4) AS score
      FROM w JOIN l USING (doc_id) GROUP BY word ORDER BY score DESC, term LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER) AS rank, term, score FROM s"""


def ngrams(n: int) -> str:
    gram = " || ' + ' || ".join(f"tokens[i + {j}]" for j in range(n))
    return f"""WITH {TOKENS},
g AS (SELECT tokens, unnest(range(1, len(tokens) - {n - 2})) AS i FROM lists),
c AS (SELECT {gram} AS ngram, count(*) AS count FROM g GROUP BY 1 ORDER BY count DESC, ngram LIMIT 50)
SELECT CAST({n} AS INTEGER) AS n, CAST(row_number() OVER (ORDER BY count DESC, ngram) AS INTEGER) AS rank, ngram, count
FROM c"""


ORACLES["bigrams"], ORACLES["trigrams"] = ngrams(2), ngrams(3)
ORACLES["frequent_words"] = f"WITH {FREQ} SELECT word, n FROM freq ORDER BY n DESC, word LIMIT 1000"
ORACLES["frequent_trigrams"] = ngrams(3)

PAIRS = f"""{FREQ},
top AS (SELECT word FROM freq ORDER BY n DESC, word LIMIT 20),
dw AS (SELECT DISTINCT doc_id, word FROM words JOIN top USING (word)),
pairs AS (SELECT a.word AS w1, b.word AS w2, count(*) AS weight
          FROM dw a JOIN dw b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL HAVING count(*) >= 2)"""
GRAPH = f"""{PAIRS},
edges AS (SELECT * FROM pairs),
links AS (SELECT w1 AS node, w2 AS other, weight FROM edges UNION ALL SELECT w2, w1, weight FROM edges)"""

ORACLES["cooccurrence"] = f"WITH {PAIRS} SELECT w1, w2, weight FROM pairs"

ORACLES["degree_centrality"] = f"""WITH {GRAPH}
SELECT node, round(count(*) / (SELECT count(DISTINCT node) - 1.0 FROM links), 4) AS degree FROM links GROUP BY node"""

# Distances over at most 1, 2, 4 ... 32 edges; the graph has at most 20 words. All shortest
# paths are then listed along edges that lengthen a distance by exactly their weight.
DISTANCES = "d0 AS (SELECT DISTINCT node AS s, node AS t, 0 AS d FROM links UNION ALL SELECT * FROM links)" + "".join(
    f""",
d{i} AS (SELECT a.s, b.t, min(a.d + b.d) AS d FROM d{i - 1} a JOIN d{i - 1} b ON a.t = b.s GROUP BY ALL)"""
    for i in range(1, 6))

ORACLES["betweenness"] = f"""WITH RECURSIVE {GRAPH}, {DISTANCES},
tight AS (SELECT a.s, l.node, l.other FROM d5 a JOIN links l ON a.t = l.node
          JOIN d5 b ON b.s = a.s AND b.t = l.other WHERE a.d + l.weight = b.d),
paths AS (SELECT DISTINCT node AS s, node AS t, CAST([] AS VARCHAR[]) AS inner_nodes FROM links
          UNION ALL SELECT p.s, k.other, CASE WHEN p.s = p.t THEN inner_nodes ELSE list_append(inner_nodes, p.t) END
          FROM paths p JOIN tight k ON k.s = p.s AND k.node = p.t),
n AS (SELECT s, t, count(*) AS n FROM paths GROUP BY ALL),
passed AS (SELECT s, t, unnest(inner_nodes) AS node FROM paths),
load AS (SELECT node, sum(1.0 / n) AS load FROM passed JOIN n USING (s, t) GROUP BY node),
nodes AS (SELECT DISTINCT node, (SELECT count(DISTINCT node) FROM links) AS k FROM links)
SELECT node, round(coalesce(load, 0.0) / greatest((k - 1) * (k - 2), 1), 4) AS betweenness
FROM nodes LEFT JOIN load USING (node)"""

ORACLES["components"] = f"""WITH RECURSIVE {GRAPH},
reach AS (SELECT node AS source, node FROM links
          UNION SELECT source, other FROM reach JOIN links USING (node))
SELECT 'all' AS graph, source AS node, min(node) AS component FROM reach GROUP BY source"""

ORACLES["token_sentiment_distribution"] = f"""WITH {TOKEN_SCORES},
{label_table(("positive", "negative", "neutral"))}
FROM names CROSS JOIN t LEFT JOIN labels ON labels.label = names.label GROUP BY names.label"""

ORACLES["token_sentiment_examples"] = f"""WITH {TOKEN_SCORES},
r AS (SELECT label, doc_id, CAST(row_number() OVER (PARTITION BY label ORDER BY doc_id) AS INTEGER) AS rank
      FROM labels WHERE label <> 'neutral')
SELECT label, rank, doc_id, substring(text, 1, 120) AS example FROM r JOIN documents USING (doc_id) WHERE rank <= 3"""

ORACLES["cloud_weights"] = f"""WITH {FREQ}, lex(word, score) AS ({values(TOKEN_LEXICON)}),
c AS (SELECT word, n FROM freq ORDER BY n DESC, word LIMIT 100)
SELECT word, n, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS polarity
FROM c LEFT JOIN lex USING (word)"""

# -- context -------------------------------------------------------------------------

TURN_ROWS = f"""turns AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations),
kept AS (SELECT * FROM turns WHERE back <= {TURNS})"""

ORACLES["last_turns"] = f"WITH {TURN_ROWS} SELECT conv_id, turn, role, text, back FROM kept"

ORACLES["conversation_context"] = f"""WITH {TURN_ROWS},
lines AS (SELECT conv_id, back, concat(role, ': ', {plain('text')}) AS line FROM kept)
SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY back DESC) AS context FROM lines GROUP BY conv_id"""

ORACLES["page_context"] = f"""WITH parts AS (
    SELECT page_id, 1 AS place, {plain('html')} AS line FROM pages
    UNION ALL SELECT page_id, 2, 'Source: ' || {plain('url')} FROM pages WHERE {plain('url')} <> ''
    UNION ALL SELECT page_id, 3, 'page note' FROM pages WHERE page_id % 3 <> 0)
SELECT page_id, string_agg(line, chr(10) || chr(10) ORDER BY place) FILTER (trim(line) <> '') AS context FROM parts GROUP BY page_id"""

# -- tokens of other kinds -----------------------------------------------------------

LISTED = "SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM lists"
ORACLES["tokenize_lemmas"] = f"""WITH lists AS (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda t:
        CASE WHEN t LIKE '%ing' AND length(t) BETWEEN 6 AND 8 THEN left(t, length(t) - 3) ELSE t END), lambda t: t NOT IN ({STOP})) AS tokens
    FROM documents) {LISTED}"""


def script_tokens(letters: str, run: str) -> str:
    return f"""WITH lists AS (
    SELECT doc_id, list_filter(regexp_extract_all(translate(lower(text), '{LATIN}', '{letters}'), '{run}'), lambda t: t <> '{letters[:2]}') AS tokens
    FROM documents) {LISTED}"""


ORACLES["tokenize_zh"] = script_tokens(CHINESE, r"[\x{4e00}-\x{9fff}]{2,}")
ORACLES["tokenize_ja"] = script_tokens(JAPANESE, r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]{2,}")
NOUN_LETTER = "right(t, 1) IN ('n', 't')"
ORACLES["tokenize_analyzed"] = f"""WITH lists AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t:
        {NOUN_LETTER} AND length(t) >= 2 AND t NOT IN ({quoted(EXTRA_STOPWORDS)})) AS tokens
    FROM documents) {LISTED}"""
ORACLES["filter_tokens"] = f"""WITH words AS (
    SELECT doc_id, unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS forms FROM documents))
SELECT doc_id, pos, form, CASE right(form, 1) WHEN 'n' THEN '{NOUN_TAGS[0]}' ELSE '{NOUN_TAGS[1]}' END AS tag
FROM words WHERE right(form, 1) IN ('n', 't') AND length(form) >= 4 AND form NOT IN ('then', 'that')"""
