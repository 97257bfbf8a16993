"""SQL over the driver's tables that must give the same rows as the registered queries.

Written from the definitions, not from the Spark plans: lag bands are joins on lagged days, the
fill is an arg-max over earlier days, sentiments are list functions. Nothing of the engine is
imported.
"""

WINDOWS = (3, 7, 11, 15)
POSITIVE, NEGATIVE = "('the', 'and', 'for')", "('of', 'to', 'in', 'a')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _tokens(sentence: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({sentence}), '[^a-z]+'), lambda t: t <> '')"


def _class(tokens: str) -> str:
    hits = f"len(list_filter({tokens}, lambda t: t IN {POSITIVE}))"
    misses = f"len(list_filter({tokens}, lambda t: t IN {NEGATIVE}))"
    return f"CAST(sign({hits} - {misses}) + 1 AS INTEGER)"


def _sentences(text: str) -> str:
    return f"regexp_split_to_array({text}, '[.!?\\n]+')"


def _score(classes: str) -> str:
    return f"CAST(50 * list_sum({classes}) // nullif(len({classes}), 0) AS INTEGER)"


def _valid(text: str) -> str:
    return (f"list_filter(list_transform({_sentences(text)}, lambda s: {_tokens('s')}), "
            "lambda k: len(k) > 5)")


def _classes(text: str) -> str:
    return f"list_transform({_valid(text)}, lambda k: {_class('k')})"


# Page parts by patterns of this check's own, made for the pages at hand: flat markup and a handful
# of entities. The engine reads pages with a parser.
_DROP = (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<nav[^>]*>.*?</nav>"
         r"|<div class=.ad.[^>]*>.*?</div>")
_NEW_LINE = r"(?i)</?(p|br|h[1-6]|div|li|ul|ol|tr|table|blockquote)(\s[^>]*)?/?>"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&copy;": "©",
             "&middot;": "·", "&amp;": "&"}


def _plain(inner: str) -> str:
    out = f"regexp_replace({inner}, {_text(_NEW_LINE)}, chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for entity, char in _ENTITIES.items():
        out = f"replace({out}, {_text(entity)}, {_text(char)})"
    lines = f"string_split(regexp_replace({out}, '[ \\t\\r\\f]+', ' ', 'g'), chr(10))"
    kept = f"list_filter(list_transform({lines}, lambda l: trim(l, ' ')), lambda l: l <> '')"
    return f"nullif(array_to_string({kept}, chr(10)), '')"


_TITLE = _plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_BODY = _plain(f"regexp_extract(regexp_replace(html, {_text(_DROP)}, ' ', 'g'), "
               "'(?is)<article[^>]*>(.*?)</article>', 1)")
_AUTHORITY = "string_split(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), '@')"
_HOST = f"nullif(lower(split_part({_AUTHORITY}[-1], ':', 1)), '')"


def _lags(windows) -> str:
    return ", ".join(f"({w}, greatest({w} + {k}, 0))" for w in windows for k in range(-3, 4))


def _counts_of(channel: str) -> str:
    parts = []
    for name, label in (("pos", "buy"), ("neg", "sell"), ("hold", "hold")):
        hit = f"{channel}_prediction = '{label}'"
        parts += [f"count(*) FILTER ({hit}) AS {channel}_{name}_n",
                  f"count(*) FILTER ({hit} AND {channel}_result = 1) AS {channel}_{name}_correct"]
    parts.append(f"count(*) FILTER ({channel}_prediction <> '') AS {channel}_n")
    return ", ".join(parts)


def _accuracies_of(channel: str) -> str:
    ratio = "coalesce(CAST({0} AS DOUBLE) / nullif({1}, 0), 0.0) AS {2}"
    names = ("pos", "neg", "hold")
    parts = [ratio.format(f"{channel}_{n}_correct", f"{channel}_{n}_n", f"{channel}_{n}_accuracy")
             for n in names]
    total = "(" + " + ".join(f"{channel}_{n}_correct" for n in names) + ")"
    return ", ".join([*parts, ratio.format(total, f"{channel}_n", f"{channel}_accuracy")])


ACCURACIES = [f"{c}_{m}" for c in ("title", "text")
              for m in ("pos_accuracy", "neg_accuracy", "hold_accuracy", "accuracy")]
COVARIANCES = {"price_title": "10 * change, title_score", "price_text": "10 * change, text_score",
               "title_text": "10 * title_score, text_score"}


def _predict(channel: str) -> str:
    score = f"{channel}_score"
    return (f"CASE WHEN {score} IS NULL OR {score} = 0 THEN '' "
            f"WHEN {score} > 45 AND {score} < 55 THEN 'hold' WHEN {score} > 55 THEN 'buy' "
            f"WHEN {score} < 45 THEN 'sell' ELSE '' END AS {channel}_prediction")


def _result(channel: str) -> str:
    p = f"{channel}_prediction"
    return (f"CASE WHEN {p} = '' THEN -1 WHEN {p} = 'hold' AND abs(change) < 0.25 THEN 1 "
            f"WHEN {p} = 'buy' AND change > 0.25 THEN 1 "
            f"WHEN {p} = 'sell' AND change < -0.25 THEN 1 ELSE 0 END AS {channel}_result")


def _earlier(channel: str) -> str:
    """Latest known score of the three calendar days before."""
    return (f"(SELECT symbol, date, \"window\", arg_max(p_score, p_date) AS {channel}_earlier FROM "
            f"(SELECT b.symbol, b.date, b.\"window\", p.{channel}_score AS p_score, p.date AS p_date "
            "FROM band b JOIN band p ON p.symbol = b.symbol AND p.\"window\" = b.\"window\" "
            "AND p.date BETWEEN b.date - 3 AND b.date - 1 "
            f"WHERE p.{channel}_score IS NOT NULL) GROUP BY ALL)")


def _with(windows=(7,), fill: str = "lookback", policy: str = "poison") -> str:
    """The common table expressions; the engine evaluates those a query refers to."""
    guard = "AND n_n = n_resolved" if policy == "poison" else ""
    mean = ("CASE WHEN {0}_n > 0 " + guard.replace("n_n", "{0}_n")
            + " THEN CAST({0}_sum AS DOUBLE) / {0}_n END AS {0}_score")
    filled = {
        "lookback": "coalesce({0}_score, {0}_earlier, 50.0)",
        "neutral": "coalesce({0}_score, 50.0)",
        "none": "{0}_score",
    }[fill] + " AS {0}_score"
    return f"""
WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events),
prices AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*) AS volume
  FROM events WHERE isodow(ts) <= 5 GROUP BY user_id, CAST(ts AS DATE)),
days AS (
  SELECT symbol, date, open, close, 100 * (close - open) / nullif(open, 0) AS change FROM prices),
symbols AS (
  SELECT DISTINCT CAST(user_id % 4 AS VARCHAR) AS industry, CAST(user_id AS VARCHAR) AS symbol
  FROM events),
instruments AS (
  SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_name AS shortname FROM customer),
ranges AS (
  SELECT symbol, min(date) AS start_date, max(date) AS end_date FROM prices GROUP BY symbol),
articles AS (
  SELECT doc_id, doc_id // n AS turn, CAST(doc_id % n AS VARCHAR) AS symbol,
         DATE '2024-01-01' + CAST(((doc_id // n) * 7 + doc_id % n) % 30 AS INTEGER) AS date,
         split_part(text, chr(10), 1) AS title, 'doc/' || doc_id AS link, source AS href, text,
         CAST(doc_id AS VARCHAR) AS id
  FROM documents, n),
found AS (
  SELECT *, DATE '2024-01-01' + CAST(28 * ((date - DATE '2024-01-01') // 28) AS INTEGER) AS bucket_start,
         CASE WHEN length(text) < 200 THEN strftime(date, '%Y')
              WHEN doc_id % 2 = 0 THEN strftime(date, '%Y-%m-%d') || ' 00:00:00'
              ELSE strftime(date, '%a, %d %b %Y') || ' 00:00:00 GMT' END AS published
  FROM articles),
responses AS (
  SELECT *, CASE number WHEN 0 THEN 'not JSON' WHEN 1 THEN 'wrong type'
                        WHEN 2 THEN 'no article list' END AS reason
  FROM (SELECT symbol, bucket_start, turn // 10 AS page, CAST(count(*) AS INTEGER) AS n_articles,
               string_agg(link, ' ' ORDER BY id) AS links,
               (CAST(symbol AS BIGINT) + CAST(min(id) AS BIGINT)) % 7 AS number
        FROM found GROUP BY symbol, bucket_start, turn // 10)),
scored_articles AS (
  SELECT *, {_score('tc')} AS title_sentiment, {_score('xc')} AS text_sentiment
  FROM (SELECT *, {_classes('title')} AS tc, {_classes('text')} AS xc FROM articles)),
sums AS (
  SELECT symbol, date, count(*) AS n_links, count(href) AS n_resolved,
         sum(title_sentiment) FILTER (href IS NOT NULL) AS title_sum,
         count(title_sentiment) FILTER (href IS NOT NULL) AS title_n,
         sum(text_sentiment) FILTER (href IS NOT NULL) AS text_sum,
         count(text_sentiment) FILTER (href IS NOT NULL) AS text_n
  FROM scored_articles GROUP BY symbol, date),
counts AS (
  SELECT d.*, coalesce(n_links, 0) AS n_links, coalesce(n_resolved, 0) AS n_resolved,
         CAST(coalesce(title_sum, 0) AS BIGINT) AS title_sum, coalesce(title_n, 0) AS title_n,
         CAST(coalesce(text_sum, 0) AS BIGINT) AS text_sum, coalesce(text_n, 0) AS text_n
  FROM days d LEFT JOIN sums s ON s.symbol = d.symbol AND s.date = d.date),
lags("window", lag) AS (VALUES {_lags(windows)}),
band_sums AS (
  SELECT t.symbol, t.date, t.open, t.close, t.change, l."window",
         CAST(coalesce(sum(d.n_links), 0) AS BIGINT) AS article_count,
         sum(d.n_resolved) AS n_resolved, sum(d.title_sum) AS title_sum,
         sum(d.title_n) AS title_n, sum(d.text_sum) AS text_sum, sum(d.text_n) AS text_n
  FROM counts t CROSS JOIN lags l
  LEFT JOIN counts d ON d.symbol = t.symbol AND d.date = t.date - l.lag
  GROUP BY t.symbol, t.date, t.open, t.close, t.change, l."window"),
band AS (
  SELECT symbol, date, open, close, change, "window", article_count,
         {mean.format('title')}, {mean.format('text')} FROM band_sums),
filled AS (
  SELECT symbol, date, open, close, change, "window", article_count,
         {filled.format('title')}, {filled.format('text')}
  FROM band LEFT JOIN {_earlier('title')} USING (symbol, date, "window")
  LEFT JOIN {_earlier('text')} USING (symbol, date, "window")),
predicted AS (SELECT *, {_predict('title')}, {_predict('text')} FROM filled),
scored AS (SELECT *, {_result('title')}, {_result('text')} FROM predicted),
correct AS (
  SELECT symbol, "window", {_counts_of('title')}, {_counts_of('text')}
  FROM scored GROUP BY symbol, "window"),
accuracy AS (
  SELECT symbol, "window", {_accuracies_of('title')}, {_accuracies_of('text')} FROM correct),
covariance AS (
  SELECT symbol, "window", {', '.join(f'covar_samp({xy}) AS {n}' for n, xy in COVARIANCES.items())}
  FROM scored GROUP BY symbol, "window"),
sources AS (SELECT href, count(*) AS n FROM articles WHERE href IS NOT NULL GROUP BY href),
stored AS (SELECT page_id, url, {_HOST} AS href, {_TITLE} AS title, {_BODY} AS text FROM pages),
sample AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY md5('42|' || symbol || '|' || link), link) AS rank FROM articles) WHERE rank <= 10),
buckets AS (
  SELECT symbol, start_date + CAST(28 * k AS INTEGER) AS bucket_start,
         start_date + CAST(28 * k + 28 AS INTEGER) AS bucket_end
  FROM (SELECT *, unnest(range((end_date - start_date + 27) // 28)) AS k FROM ranges)),
sentences AS (
  SELECT doc_id, CAST(unnest(range(len(list))) AS INTEGER) AS pos, unnest(list) AS sentence
  FROM (SELECT doc_id, {_sentences('text')} AS list FROM documents))
"""


DAY = "CAST(date AS VARCHAR) AS date"
_BANDED = f'SELECT symbol, {DAY}, "window", article_count, title_score, text_score FROM band'
_SCORED = (f'SELECT symbol, {DAY}, open, close, change, "window", article_count, title_score, '
           "text_score, title_prediction, text_prediction, title_result, text_result FROM scored")
_PRICES = f"SELECT symbol, {DAY}, open, high, low, close, volume FROM prices"
_INDUSTRY_ACC = (f'SELECT industry, "window", '
                 + ", ".join(f"round(avg({a}), 6) AS {a}" for a in ACCURACIES)
                 + ' FROM accuracy JOIN symbols USING (symbol) GROUP BY industry, "window"')
_INDUSTRY_COV = (f'SELECT industry, "window", '
                 + ", ".join(f"round(CASE WHEN count({c}) = count(*) THEN sum({c}) END, 6) AS {c}"
                             for c in COVARIANCES)
                 + ' FROM covariance JOIN symbols USING (symbol) GROUP BY industry, "window"')
_COV = ('SELECT symbol, "window", ' + ", ".join(f"round({c}, 6) AS {c}" for c in COVARIANCES)
        + " FROM covariance")
_LINKS = ("SELECT symbol, date, row_number() OVER (PARTITION BY symbol, date ORDER BY link) "
          "AS position, link FROM articles")
_OWN = "SEMI JOIN (SELECT symbol FROM symbols WHERE industry <> '3') USING (symbol)"


def _stats(scope: str = "") -> str:
    return ("SELECT count(*) AS n_articles, count(*) FILTER (length(text) > 200) AS n_with_text, "
            f"count(DISTINCT href) AS n_sources FROM articles {scope}")


def _repeated(times: str) -> str:
    """Common table expressions of the scores of ``_with`` over articles that count ``times``."""
    return _with().replace(
        "FROM (SELECT *, " + _classes("title"),
        f"FROM (SELECT articles.*, {_classes('title')}").replace(
        "AS xc FROM articles)),", f"AS xc FROM articles, range({times}))),")


def _weights(counts: str) -> str:
    return (f"SELECT href, n, (n + CAST((SELECT sum(n) FROM {counts}) AS DOUBLE)) "
            f"/ (SELECT sum(n) FROM {counts}) AS weight FROM {counts}")


def oracle_sql() -> dict[str, str]:
    one, all_ = _with(), _with(WINDOWS)
    copies = "(SELECT href AS symbol, md5(text) AS link, date, id FROM articles)"
    means = ("(SELECT symbol, date, open, close, CASE WHEN text_n > 0 "
             "THEN CAST(text_sum AS DOUBLE) / text_n END AS mean FROM counts)")
    return {
        "A1_price_scan": one + _PRICES,
        "A1_wide_prices": one + f"""
SELECT industry AS symbol, {DAY}, min(open) AS open, max(high) AS high, min(low) AS low,
       max(close) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM prices JOIN symbols USING (symbol) GROUP BY industry, date""",
        "A2_symbol_dimension": one + "SELECT industry, symbol FROM symbols",
        "A3_search_scan": one + """
SELECT symbol, CAST(bucket_start AS VARCHAR) AS bucket_start,
       CAST(bucket_start + 28 AS VARCHAR) AS bucket_end, id, title, link, published, href, text
FROM found""",
        "A3_rejected_responses": one + """
SELECT CAST(bucket_start AS VARCHAR) AS folder, reason, count(*) AS n_responses
FROM responses GROUP BY bucket_start, reason""",
        "A3_accepted_articles": one + """
SELECT f.symbol, CAST(f.bucket_start AS VARCHAR) AS bucket_start,
       CAST(f.bucket_start + 28 AS VARCHAR) AS bucket_end, f.id, f.link, f.href
FROM found f JOIN responses r ON r.symbol = f.symbol AND r.bucket_start = f.bucket_start
 AND r.page = f.turn // 10 WHERE r.reason IS NULL""",
        "A4_snapshot_write": one + _PRICES,
        "A5_snapshot_read": one + f"SELECT symbol, {DAY}, link, href FROM articles",
        "A5_snapshot_symbol": one + f"""
SELECT symbol, {DAY}, link, href FROM articles WHERE symbol = '7'""",
        "A6_full_load": one + f"""
SELECT 'instruments' AS name, symbol AS key, shortname AS value FROM instruments
UNION ALL SELECT 'search_results', symbol || ' ' || bucket_start, string_agg(link, ' ' ORDER BY id)
FROM found GROUP BY symbol, bucket_start, turn // 10
UNION ALL SELECT 'prices', symbol || ' ' || date, CAST(volume AS VARCHAR) FROM prices
UNION ALL SELECT 'articles', symbol || ' ' || link, md5(text) FROM articles
UNION ALL SELECT 'timeline', symbol || ' ' || date, CAST(n_links AS VARCHAR) FROM counts
UNION ALL SELECT 'links', symbol || ' ' || date || ' ' || position, link FROM ({_LINKS})
UNION ALL SELECT 'source_weights', href, CAST(n AS VARCHAR) FROM sources""",
        "A6_saved_accuracy": one + "SELECT * FROM accuracy",
        "A6_saved_covariance": one + _COV,
        "A6_interrupted_save": one + f"""
SELECT 'prices' AS name, symbol || ' ' || date AS key, CAST(volume AS VARCHAR) AS value FROM prices
UNION ALL SELECT 'links', symbol || ' ' || date || ' ' || position, link FROM ({_LINKS})""",
        "A6_merged_deliveries": one + f"""
SELECT symbol || ' ' || date || ' ' || position AS key, link AS value FROM ({_LINKS})
UNION ALL SELECT symbol || ' ' || date, concat_ws(' ', n_links, n_resolved, title_sum, title_n,
                                                  text_sum, text_n) FROM counts""",
        "A7_csv_sink": one + f"SELECT symbol, {DAY}, link, href FROM sample",
        "A8_page_text": one + "SELECT page_id, url, href, title, text FROM stored",
        "A8_broken_pages": one + """
SELECT page_id, url, href, CASE WHEN page_id % 6 <> 4 THEN title END AS title,
       CASE WHEN page_id % 6 <> 4 THEN text END AS text,
       CASE WHEN page_id % 6 = 4 THEN 'ValueError: no text: a NUL character' END AS page_error
FROM stored""",
        "A8_page_failures": one + """
SELECT href, count(*) AS n_pages, count(*) FILTER (WHERE page_id % 6 = 4) AS n_failed
FROM stored GROUP BY href""",
        "A9_fetch_buckets": one + """
SELECT symbol, CAST(bucket_start AS VARCHAR) AS bucket_start,
       CAST(bucket_end AS VARCHAR) AS bucket_end FROM buckets""",
        "A9_missing_requests": one + """
, wanted AS (
  SELECT symbol, unnest(range(start_date, end_date, INTERVAL 1 DAY))::DATE AS day FROM ranges),
answered AS (
  SELECT DISTINCT symbol, date + CAST(k AS INTEGER) AS day
  FROM (SELECT *, unnest(range(1 + doc_id % 4)) AS k FROM articles WHERE doc_id % 3 = 0)),
missing AS (
  SELECT *, day - CAST(row_number() OVER (PARTITION BY symbol ORDER BY day) AS INTEGER) AS gap
  FROM wanted ANTI JOIN answered USING (symbol, day)),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY symbol, gap ORDER BY day) - 1) // 3 AS bucket
  FROM missing)
SELECT symbol, shortname AS q, CAST(min(day) AS VARCHAR) AS "from",
       CAST(max(day) + 1 AS VARCHAR) AS "to", 'US' AS country, 'en' AS lang
FROM placed JOIN instruments USING (symbol) GROUP BY symbol, shortname, gap, bucket""",
        "B1_symbol_filter": one + _PRICES + """
WHERE symbol IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)""",
        "B2_date_slice": one + _PRICES + """
WHERE date >= DATE '2024-01-08' AND date <= DATE '2024-01-19'""",
        "B3_drop_incomplete": one + f"""
SELECT symbol, {DAY}, open, close, mean FROM {means} WHERE mean IS NOT NULL""",
        "B4_valid_publications": one + f"""
SELECT symbol, link, CAST(CAST(coalesce(try_strptime(published, '%Y-%m-%d %H:%M:%S'),
         try_strptime(published, '%a, %d %b %Y %H:%M:%S GMT')) AS DATE) AS VARCHAR) AS date
FROM found WHERE length(text) >= 200""",
        "B5_project_articles": one + f"""
SELECT symbol, {DAY}, title, link, href, id, CAST(NULL AS VARCHAR) AS text,
       CAST(NULL AS INTEGER) AS title_sentiment, CAST(NULL AS INTEGER) AS text_sentiment
FROM found WHERE length(published) > 4""",
        "B6_select_rename": one + f"SELECT symbol, {DAY}, open, close FROM prices",
        "B7_nan_to_null": one + f"SELECT symbol, {DAY}, open, close, mean FROM {means}",
        "B8_day_change": one + f"SELECT symbol, {DAY}, change FROM days",
        "B9_nested_source": one + "SELECT symbol, link, href FROM articles WHERE href IS NOT NULL",
        "B10_valid_sentences": f"""
SELECT doc_id, CAST(len({_sentences('text')}) AS INTEGER) AS n_sentences,
       CAST(len({_valid('text')}) AS INTEGER) AS n_valid FROM documents""",
        "B11_has_text": """
SELECT doc_id, CAST(coalesce(length(text) > 200, FALSE) AS INTEGER) AS has_text FROM documents""",
        "B12_has_prediction": one + f"""
SELECT symbol, {DAY}, text_prediction FROM scored WHERE text_prediction <> ''""",
        "B13_search_terms": one + "SELECT symbol, shortname AS q FROM instruments",
        "B14_nonempty_histories": one + """
SELECT symbol, shortname, CAST(start_date AS VARCHAR) AS start_date,
       CAST(end_date AS VARCHAR) AS end_date FROM instruments JOIN ranges USING (symbol)""",
        "C1_price_news_join": one + f"""
SELECT symbol, {DAY}, open, close, n_links, n_resolved, title_sum, title_n, text_sum, text_n
FROM counts""",
        "C2_instrument_history": one + """
SELECT symbol, shortname, count(*) AS n_groups
FROM instruments JOIN (SELECT DISTINCT symbol, bucket_start, turn // 10 FROM found) USING (symbol)
GROUP BY symbol, shortname""",
        "C3_link_lookup": one + f"""
SELECT symbol, {DAY}, link, href, title_sentiment, text_sentiment
FROM scored_articles SEMI JOIN prices USING (symbol, date)""",
        "C4_lag_band_join": one + f"""
SELECT symbol, {DAY}, article_count, title_score, text_score FROM band""",
        "C5_industry_join": one + """
SELECT industry, symbol, "window", text_accuracy FROM accuracy JOIN symbols USING (symbol)""",
        "C6_window_lengths": all_ + f'SELECT symbol, {DAY}, "window", article_count FROM band',
        "C7_lookback": one + f"""
SELECT symbol, {DAY}, text_score, text_earlier AS earlier_score
FROM band LEFT JOIN {_earlier('text')} USING (symbol, date, "window")""",
        "D1_links_per_day": one + f"""
SELECT symbol, {DAY}, position, link FROM ({_LINKS})""",
        "D2_document_sentiment": one + """
SELECT link, title_sentiment, text_sentiment FROM scored_articles""",
        "D3_band_mean": one + f"SELECT symbol, {DAY}, title_score, text_score FROM band",
        "D3_band_mean_skip": _with(policy="skip") + f"""
SELECT symbol, {DAY}, title_score, text_score FROM band""",
        "D4_band_article_count": one + f"SELECT symbol, {DAY}, article_count FROM band",
        "D5_correct_counts": one + "SELECT * FROM correct",
        "D6_accuracies": all_ + "SELECT * FROM accuracy",
        "D7_industry_accuracy": one + _INDUSTRY_ACC,
        "D8_covariance": all_ + _COV,
        "D9_industry_covariance": one + _INDUSTRY_COV,
        "D8_merged_states": one + ('SELECT symbol, "window", ' + ", ".join(
            f"round({a}, 6) AS {a}" for a in ACCURACIES)
            + f', {", ".join(COVARIANCES)} FROM accuracy JOIN ({_COV}) USING (symbol, "window")'),
        "D10_source_counts": one + "SELECT href, n FROM sources",
        "D11_source_weight": one + ", hosts AS (SELECT href, count(*) AS n FROM stored "
                                   "WHERE href IS NOT NULL GROUP BY href) " + _weights("hosts"),
        "D12_corpus_statistics": one + _stats(),
        "D12_stored_statistics": one + """
SELECT count(*) AS n_articles, count(*) FILTER (length(text) > 200) AS n_with_text, true AS near
FROM articles""",
        "D13_date_range": one + """
SELECT symbol, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date
FROM ranges""",
        "D14_duplicate_links": one + f"""
SELECT symbol, link, count(*) AS n FROM {copies} GROUP BY symbol, link HAVING count(*) > 1""",
        "D14_drop_duplicate_links": one + f"""
SELECT symbol, link, id FROM {copies}
QUALIFY row_number() OVER (PARTITION BY symbol, link ORDER BY date, id) = 1""",
        "D14_scores_drop_duplicates": one + f"""
SELECT symbol, {DAY}, article_count, text_score FROM scored""",
        "D14_scores_keep_duplicates": _repeated("CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END") + f"""
SELECT symbol, {DAY}, article_count, text_score FROM scored""",
        "D15_bucket_counts": one + """
SELECT symbol, CAST(bucket_start AS VARCHAR) AS bucket_start, count(*) AS n_articles,
       count(DISTINCT turn // 10) AS n_responses FROM found GROUP BY symbol, bucket_start""",
        "D15_history_sizes": one + """
SELECT symbol, count(*) AS n_groups
FROM (SELECT DISTINCT symbol, bucket_start, turn // 10 FROM found) GROUP BY symbol""",
        "E1_lag_band_frame": all_ + _BANDED,
        "E2_lag_multiplicity": _with((0, 1, 2)) + _BANDED,
        "E3_fill_lookback": all_ + f"""
SELECT symbol, {DAY}, "window", title_score, text_score FROM filled""",
        "E3_fill_neutral": _with(WINDOWS, fill="neutral") + f"""
SELECT symbol, {DAY}, "window", title_score, text_score FROM filled""",
        "E3_scores_after_append": all_ + _SCORED,
        "E4_window_sweep": all_ + _SCORED,
        "E5_sample_rank": one + "SELECT symbol, link, CAST(rank AS INTEGER) AS rank FROM sample",
        "F1_publication_order": one + """
SELECT symbol, link, row_number() OVER (PARTITION BY symbol ORDER BY date, link) AS position
FROM articles""",
        "F1_publication_sort": one + f"SELECT symbol, {DAY}, link FROM articles",
        "F2_top_sources": one + "SELECT href, n FROM sources ORDER BY n DESC, href LIMIT 10",
        "F2_stored_top_sources": one + "SELECT href, n FROM sources ORDER BY n DESC, href LIMIT 10",
        "F3_sample": one + f"SELECT symbol, {DAY}, link, href, title FROM sample",
        "F4_date_order": one + f"""
SELECT symbol, {DAY}, open, close, change,
       row_number() OVER (PARTITION BY symbol ORDER BY date) AS position FROM days""",
        "G1_flatten_groups": one + """
SELECT symbol, CAST(bucket_start AS VARCHAR) AS bucket_start,
       CAST(bucket_start + 28 AS VARCHAR) AS bucket_end, link, published FROM found""",
        "G2_concat_frames": one + f"""
SELECT symbol, link, {DAY}, title FROM articles
UNION ALL SELECT href, url, NULL, title FROM stored""",
        "G3_distinct_sources": one + "SELECT href FROM sources",
        "H1_sentence_split": one + "SELECT doc_id, pos, sentence FROM sentences",
        "H2_token_count": one + f"""
SELECT doc_id, pos, CAST(len(tokens) AS INTEGER) AS n_tokens,
       array_to_string(tokens, ' ') AS tokens
FROM (SELECT doc_id, pos, {_tokens('sentence')} AS tokens FROM sentences)""",
        "H3_sentence_class": one + f"""
SELECT doc_id, pos, {_class('tokens')} AS class
FROM (SELECT doc_id, pos, {_tokens('sentence')} AS tokens FROM sentences)""",
        "H4_truncated_mean": one + f"""
SELECT doc_id, CAST(50 * sum(class) // count(*) AS INTEGER) AS score
FROM (SELECT doc_id, {_class('tokens')} AS class
      FROM (SELECT doc_id, {_tokens('sentence')} AS tokens FROM sentences)) GROUP BY doc_id""",
        "H5_classify": _with(WINDOWS, fill="none") + f"""
SELECT symbol, {DAY}, "window", title_score, title_prediction, text_score, text_prediction
FROM scored""",
        "H6_grade": all_ + f"""
SELECT symbol, {DAY}, "window", change, title_prediction, title_result, text_prediction,
       text_result FROM scored""",
        "H7_date_minus_days": one + f"""
SELECT symbol, {DAY}, CAST(date - 7 AS VARCHAR) AS lagged FROM prices""",
        "H8_lag_clamp": _with((2, 7)) + f"""
SELECT symbol, {DAY}, "window", CAST(lag AS INTEGER) AS lag FROM prices, lags""",
        "H9_format_date": one + """
SELECT symbol, coalesce(strftime(start_date, '%Y-%m-%d'), '') AS start,
       coalesce(strftime(end_date, '%Y-%m-%d'), '') AS "end"
FROM instruments LEFT JOIN ranges USING (symbol)""",
        "H10_safe_ratio": one + f"""
SELECT symbol, {DAY}, coalesce(CAST(title_sum AS DOUBLE) / nullif(title_n, 0), 0.0) AS ratio
FROM sums""",
        "H11_abs_change": one + f"SELECT symbol, {DAY}, abs(change) AS move FROM days",
        "H12_json_decode": one + """
SELECT symbol, id, title, link, published, href, text FROM found""",
        "H12_decode_responses": one + """
SELECT symbol, CAST(bucket_start AS VARCHAR) AS bucket_start, n_articles, reason,
       CASE WHEN reason IS NULL THEN links END AS links FROM responses""",
        "H13_to_day": "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events",
        "H14_or_empty": one + "SELECT page_id, coalesce(text, '') AS text FROM stored",
        "H15_text_length": """
SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents""",
        "H16_source_host": one + "SELECT page_id, href FROM stored",
        "H17_bucket_of_date": one + """
SELECT link, CAST((date - DATE '2024-01-01') // 28 AS INTEGER) AS bucket FROM articles""",
        "J1_enrich_articles": one + f"""
SELECT symbol, {DAY}, title, link, href, text, title_sentiment, text_sentiment
FROM scored_articles""",
        "J2_model_hook": one + """
SELECT link, title_sentiment, text_sentiment FROM scored_articles""",
        "J3_row_rules": one + f"""
SELECT symbol, {DAY}, change, title_prediction, text_prediction, title_result, text_result
FROM scored""",
        "K1_build_timeline": one + f"""
SELECT symbol, {DAY}, open, close, change, n_links FROM counts""",
        "K2_score_and_predict": one + _SCORED,
        "K3_analyze_accuracy": one + "SELECT * FROM accuracy",
        "K4_analyze_accuracies": all_ + _INDUSTRY_ACC,
        "K5_analyze_cov": one + _COV,
        "K6_analyze_covs": all_ + _INDUSTRY_COV,
        "K46_analyze_sweep": all_ + f"""
SELECT * FROM ({_INDUSTRY_ACC}) JOIN ({_INDUSTRY_COV}) USING (industry, "window")""",
        "K7_series": one + " UNION ALL ".join(
            f"SELECT symbol, \"window\", {DAY}, '{c}' AS series, {c} AS value, "
            "row_number() OVER (PARTITION BY symbol ORDER BY scored.date) AS position FROM scored"
            for c in ("open", "title_score", "text_score")),
        "K8_corpus_stats": one + _stats(_OWN),
        "K9_source_weights": one + f", own AS (SELECT href, count(*) AS n FROM articles {_OWN} "
                                   "WHERE href IS NOT NULL GROUP BY href) " + _weights("own"),
        "K10_sample_articles": one + f"SELECT symbol, {DAY}, link, title FROM sample {_OWN}",
        "K11_sentiment_distribution": one + """
SELECT symbol, "window", channel, bin, count(*) AS n FROM (
  SELECT symbol, "window", channel, least(CAST(floor(score / 10) AS INTEGER) + 1, 10) AS bin FROM (
    SELECT symbol, "window", 'title' AS channel, title_score AS score FROM scored
    UNION ALL SELECT symbol, "window", 'text', text_score FROM scored))
GROUP BY symbol, "window", channel, bin""",
        "K12_fetch_requests": one + """
SELECT symbol, shortname AS q, CAST(bucket_start AS VARCHAR) AS "from",
       CAST(bucket_end AS VARCHAR) AS "to", 'US' AS country, 'en' AS lang
FROM instruments JOIN buckets USING (symbol)""",
    }
