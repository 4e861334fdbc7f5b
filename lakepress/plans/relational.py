"""Relational building blocks: filters, joins, aggregates, windows, sorts and set operations, one query for each."""

from __future__ import annotations

from .domain import AS_OF, Dialect


def bodies(d: Dialect) -> dict[str, str]:
    s, rel = d.string, "is_relevant AND NOT is_backfill"
    recent = lambda n: f"published_at > {AS_OF} - {d.days(n)}"
    day = "CAST(published_at AS DATE)"
    rn = lambda part, order, name="rn": f"row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS {name}"
    return {
        # filters and projections
        "F01_recency": f"SELECT article_id, country_code FROM star WHERE {recent(7)}",
        "F02_predicates": f"SELECT article_id FROM star WHERE tier = 'official' AND event_type = 'economic' AND action_level >= 3 AND {recent(20)}",
        "F03_in_list": "SELECT tier, count(*) AS n FROM star WHERE tier IN ('official', 'mainstream') GROUP BY tier",
        "F04_array_member": f"SELECT country_code, count(*) AS n FROM star WHERE {d.has('topics', chr(39) + 'trade' + chr(39))} GROUP BY country_code",
        "F05_ilike": "SELECT doc_id FROM documents WHERE lower(text) LIKE '%licens%' OR lower(source) LIKE '%src1%'",
        "F06_regex_word": f"SELECT doc_id FROM documents WHERE {d.match('lower(text)', '(^|[^a-z])(idiot|scum|license)([^a-z]|$)')}",
        "F07_between": f"SELECT article_id FROM articles WHERE published_at BETWEEN {AS_OF} - {d.days(10)} AND {AS_OF} - {d.days(5)}",
        "F08_null_guard": "SELECT count(*) AS n FROM star WHERE event_key IS NOT NULL AND event_key <> '' AND length(trim(event_key)) > 5",
        "F09_coalesce": "SELECT coalesce(event_key, 'none') AS k, count(*) AS n FROM star GROUP BY 1",
        "F10_case_buckets": "SELECT CASE WHEN sentiment < -1.5 THEN 'very_negative' WHEN sentiment < -0.3 THEN 'negative' WHEN sentiment <= 0.3 THEN 'neutral' WHEN sentiment <= 1.5 THEN 'positive' ELSE 'very_positive' END AS bucket, count(*) AS n FROM star WHERE sentiment IS NOT NULL GROUP BY 1",
        "F13_blacklist": "SELECT event_key, count(*) AS n FROM star WHERE event_key IS NOT NULL AND NOT (event_key LIKE '%-0%' OR event_key LIKE '%zzz%') GROUP BY 1",
        "F15_registry_semi": "SELECT count(*) AS n FROM star WHERE country_code IN (SELECT n_name FROM nation WHERE n_regionkey < 3)",
        "F17_truncate": "SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 500), '...') ELSE text END AS body FROM documents",
        "F18_clamp": "SELECT article_id, greatest(-1.5, least(1.5, sentiment)) AS clamped FROM star WHERE sentiment IS NOT NULL",
        "F19_post_filter": "SELECT country_code, max(score) AS score FROM scores JOIN nation ON country_code = n_name WHERE n_regionkey = 2 GROUP BY 1",
        # joins
        "J01_star": f"SELECT country_code, tier, count(*) AS n, round(avg(sentiment), 4) AS mean FROM star WHERE {rel} GROUP BY 1, 2",
        "J02_left_coverage": "SELECT r.source_id, count(*) AS articles, count(a.article_id) AS analysed FROM articles r LEFT JOIN analysis a ON r.article_id = a.article_id GROUP BY 1",
        "J03_left_predicate_in_on": f"SELECT s.source_id, count(r.article_id) AS recent FROM sources s LEFT JOIN articles r ON r.source_id = s.source_id AND r.published_at > {AS_OF} - {d.days(7)} GROUP BY 1",
        "J04_anti_left_null": "SELECT r.article_id FROM articles r LEFT JOIN analysis a ON r.article_id = a.article_id WHERE a.article_id IS NULL",
        "J05_not_exists": "SELECT r.article_id FROM articles r WHERE NOT EXISTS (SELECT 1 FROM analysis a WHERE a.article_id = r.article_id)",
        "J06_not_in": "SELECT thread_id FROM threads WHERE thread_id NOT IN (SELECT article_id FROM articles WHERE is_duplicate)",
        "J07_semi": "SELECT country_code, count(*) AS n FROM star x WHERE EXISTS (SELECT 1 FROM sources s WHERE s.country_code = x.country_code AND s.active AND s.tier = 'official') GROUP BY 1",
        "J08_self_pairs": "SELECT a.thread_id AS id_1, b.thread_id AS id_2 FROM threads a JOIN threads b ON a.country_code = b.country_code AND a.thread_id < b.thread_id",
        "J09_overlap": "SELECT a.thread_id AS id_1, b.thread_id AS id_2, count(*) AS shared FROM links a JOIN links b ON a.article_id = b.article_id AND a.thread_id < b.thread_id GROUP BY 1, 2",
        "J12_same_day": f"SELECT a.article_id AS id_1, b.article_id AS id_2 FROM star a JOIN star b ON a.source_id = b.source_id AND CAST(a.published_at AS DATE) = CAST(b.published_at AS DATE) AND a.article_id < b.article_id",
        "J16_previous_rate": "SELECT currency, day, rate, lag(rate) OVER (PARTITION BY currency ORDER BY day) AS previous FROM fx",
        "J17_rate_30_days_ago": f"SELECT f.currency, m.last_day, {d.arg_max('f.rate', 'f.day')} AS rate_then FROM fx f JOIN (SELECT currency, max(day) AS last_day FROM fx GROUP BY currency) m ON f.currency = m.currency WHERE {d.day_diff('m.last_day', 'f.day')} >= 30 GROUP BY 1, 2",
        "J18_point_before": f"SELECT country_code, {d.arg_max('score', 'day')} AS score_then FROM scores WHERE {d.day_diff('DATE ' + chr(39) + '2024-01-31' + chr(39), 'day')} BETWEEN 6 AND 8 GROUP BY 1",
        "J19_latest_value": f"SELECT c.country_code, count(*) AS n, max(l.temperature) AS media FROM comments c LEFT JOIN (SELECT country_code, {d.arg_max('temperature', 'day')} AS temperature FROM temps GROUP BY 1) l ON c.country_code = l.country_code GROUP BY 1",
        "J20_unnest": f"SELECT topic, count(*) AS n FROM {d.unnest('star', 'topics', 'topic')} GROUP BY topic",
        "J21_top_3_as_list": f"SELECT t.thread_id, coalesce(l.items, '') AS items FROM threads t LEFT JOIN (SELECT thread_id, {d.list_join('article_id', 'rn')} AS items FROM (SELECT l.thread_id, l.article_id, {rn('l.thread_id', 'r.published_at DESC, l.article_id')} FROM (SELECT DISTINCT thread_id, article_id FROM links) l JOIN articles r ON l.article_id = r.article_id) z WHERE rn <= 3 GROUP BY thread_id) l ON t.thread_id = l.thread_id",
        "J22_scalar_subquery": f"SELECT article_id FROM articles WHERE published_at > (SELECT max(published_at) FROM articles) - {d.hours(3)}",
        "J23_six_tables": "SELECT p.article_id AS id_1, q.article_id AS id_2, s.country_code, x.sentiment AS s_1, y.sentiment AS s_2 FROM articles p JOIN articles q ON p.source_id = q.source_id AND q.article_id = p.article_id + 175 JOIN sources s ON p.source_id = s.source_id LEFT JOIN analysis x ON p.article_id = x.article_id LEFT JOIN analysis y ON q.article_id = y.article_id",
        "J24_registry": "SELECT s.score, n_name, r_name FROM scores s LEFT JOIN nation ON s.country_code = n_name LEFT JOIN region ON n_regionkey = r_regionkey WHERE s.day = DATE '2024-01-30'",
        "J25_merge_by_country": "SELECT n_name AS country_code, coalesce(a.n, 0) AS articles, coalesce(t.n, 0) AS threads, c.votes FROM nation LEFT JOIN (SELECT country_code, count(*) AS n FROM star GROUP BY 1) a ON a.country_code = n_name LEFT JOIN (SELECT country_code, count(*) AS n FROM threads GROUP BY 1) t ON t.country_code = n_name LEFT JOIN (SELECT country_code, CAST(sum(total) AS BIGINT) AS votes FROM un_votes GROUP BY 1) c ON c.country_code = n_name",
        "J26_cast_key": f"SELECT h.name, count(c.comment_id) AS n FROM channels h LEFT JOIN comments c ON CAST(h.channel_id AS {s}) = c.channel_id_ext AND h.platform = c.platform GROUP BY 1",
        "J27_full_outer": "SELECT coalesce(a.country_code, b.country_code) AS country_code, coalesce(a.day, b.day) AS day, a.volume, b.score FROM (SELECT * FROM gdelt WHERE volume > 1) a FULL OUTER JOIN (SELECT * FROM scores WHERE score > 0) b ON a.country_code = b.country_code AND a.day = b.day",
        "J28_days_by_country": f"SELECT n_name AS country_code, g.day, count(t.n) AS readings FROM nation CROSS JOIN (SELECT DISTINCT day FROM gdelt) g LEFT JOIN temps t ON t.country_code = n_name AND t.day <= g.day AND {d.day_diff('g.day', 't.day')} < 14 GROUP BY 1, 2",
        # aggregates
        "A01_group_by": "SELECT event_type, count(*) AS n, round(sum(sentiment), 3) AS total, round(avg(sentiment), 4) AS mean, min(sentiment) AS lo, max(sentiment) AS hi FROM star GROUP BY 1",
        "A02_count_distinct": "SELECT country_code, count(DISTINCT source_id) AS sources FROM star GROUP BY 1",
        "A03_many_distinct": "SELECT country_code, count(DISTINCT source_id) AS sources, count(DISTINCT tier) AS tiers, count(DISTINCT event_key) AS events FROM star GROUP BY 1",
        "A04_filter": f"SELECT country_code, count(*) FILTER (WHERE tier = 'official') AS loud, count(*) FILTER (WHERE {recent(1)}) AS last_day FROM star GROUP BY 1",
        "A05_having": f"SELECT country_code, event_key, count(*) AS n FROM star GROUP BY 1, 2 HAVING count(*) FILTER (WHERE action_level >= 4) >= 3 AND min(published_at) < {AS_OF} - {d.days(3)}",
        "A06_distinct_array": f"SELECT country_code, {d.set_join('tier')} AS tiers FROM star GROUP BY 1",
        "A07_ordered_array": f"SELECT source_id, {d.list_join('event_key', 'published_at', 'article_id')} AS event_keys FROM star GROUP BY 1",
        "A09_median": f"SELECT country_code, round({d.median('sentiment')}, 4) AS mid FROM star GROUP BY 1",
        "A10_vector_mean": ("SELECT label, i, round(avg(CAST(x AS DOUBLE)), 5) AS m FROM embeddings LATERAL VIEW posexplode(embedding) u_ AS i, x GROUP BY 1, 2" if d.spark else "SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 5) AS m FROM embeddings, range(0, 64) r(i) GROUP BY 1, 2"),
        "A11_two_levels": "SELECT day, round(max(m) - min(m), 4) AS spread FROM (SELECT CAST(published_at AS DATE) AS day, tier, avg(sentiment) AS m FROM star GROUP BY 1, 2) x GROUP BY day HAVING count(*) >= 2",
        "A12_totals": "SELECT count(*) AS n, count(sentiment) AS scored, count(DISTINCT country_code) AS countries, round(avg(sentiment), 5) AS mean FROM star",
        "A13_panel": "SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM analysis) AS analysed, (SELECT count(*) FROM threads) AS threads, (SELECT count(*) FROM sources WHERE active) AS active, (SELECT count(*) FROM comments) AS comments_",
        "A14_weighted_mean": "SELECT tier, round(sum(m * n) / sum(n), 3) AS mean FROM (SELECT tier, country_code, avg(sentiment) AS m, count(sentiment) AS n FROM star GROUP BY 1, 2) x WHERE n > 0 GROUP BY tier",
        "A15_spread": "SELECT country_code, CASE WHEN count(*) >= 2 THEN round(max(m) - min(m), 4) ELSE 0 END AS spread FROM (SELECT country_code, tier, avg(sentiment) AS m, count(*) AS n FROM star GROUP BY 1, 2) x WHERE n >= 3 GROUP BY 1",
        "A16_mode": f"SELECT country_code, emotion FROM (SELECT country_code, emotion, {rn('country_code', 'n DESC, newest DESC, emotion')} FROM (SELECT country_code, emotion, count(*) AS n, max(published_at) AS newest FROM comments GROUP BY 1, 2) a) b WHERE rn = 1",
        "A17_ratio": "SELECT country_code, round(CAST(count(CASE WHEN stance = 'pro' THEN 1 END) AS DOUBLE) / count(*), 2) AS pro, round(CAST(count(CASE WHEN stance = 'anti' THEN 1 END) AS DOUBLE) / count(*), 2) AS anti FROM comments GROUP BY 1",
        "A18_stdev": "SELECT country_code, round(avg(temperature), 4) AS mean, round(stddev_samp(temperature), 4) AS sd FROM temps GROUP BY 1",
        "A19_stdev_pop": "SELECT country_code, round(coalesce(nullif(stddev_pop(temperature), 0), 1), 4) AS sd FROM temps GROUP BY 1",
        "A20_distinct": f"SELECT DISTINCT {day} AS day, tier FROM star",
        "A21_pivot": f"SELECT {day} AS day, " + ", ".join(f"round(avg(CASE WHEN tier = '{t}' THEN sentiment END), 3) AS {t}" for t in ("official", "mainstream", "independent", "social", "domestic_opposition", "western_proxy", "analytics")) + " FROM star GROUP BY 1",
        "A22_capped_records": f"SELECT event_key, max(lvl) AS max_level, max(total) AS total, {d.list_join('article_id', 'rn')} AS newest FROM (SELECT event_key, article_id, max(action_level) OVER (PARTITION BY event_key) AS lvl, count(*) OVER (PARTITION BY event_key) AS total, {rn('event_key', 'published_at DESC, article_id')} FROM star WHERE event_key IS NOT NULL AND event_key <> '') x WHERE rn <= 5 GROUP BY 1",
        # one rank over all countries: a single task, of one row a country
        "A24_ordinal_rank": "SELECT country_code, amount, row_number() OVER (ORDER BY amount DESC, country_code) AS place FROM (SELECT country_code, CAST(sum(exports + imports) AS BIGINT) AS amount FROM trade WHERE exports > 0 OR imports > 0 GROUP BY 1) x",
        "A25_last_wins": f"SELECT country_code, {d.arg_max('exports', 'year')} AS exports, {d.arg_max('imports', 'year')} AS imports FROM trade GROUP BY 1",
        "A26_signed_boost": "SELECT country_code, CAST(greatest(-15, least(15, sum(b))) AS BIGINT) AS boost FROM (SELECT country_code, sign(sentiment) * 5 * least(count(*), 2) AS b FROM star WHERE action_level >= 5 AND sentiment IS NOT NULL GROUP BY country_code, sentiment, action_level) x GROUP BY 1",
        "A27_cross_tab": "SELECT tier, count(CASE WHEN event_type = 'military' THEN 1 END) AS military, count(CASE WHEN event_type = 'economic' THEN 1 END) AS economic, count(CASE WHEN event_type = 'security' THEN 1 END) AS security_ FROM star GROUP BY tier",
        # windows
        "W01_top_1": f"SELECT country_code, article_id FROM (SELECT country_code, article_id, {rn('country_code', 'action_level DESC, published_at DESC, article_id')} FROM star) x WHERE rn = 1",
        "W02_last_7": f"SELECT country_code, {d.list_join('temperature', 'day')} AS spark FROM (SELECT country_code, day, temperature, {rn('country_code', 'day DESC')} FROM temps) x WHERE rn <= 7 GROUP BY 1",
        "W03_two_caps": f"SELECT article_id, source_id, country_code FROM (SELECT article_id, source_id, country_code, {rn('source_id', 'action_level DESC, published_at DESC, article_id', 'a')}, {rn('country_code', 'action_level DESC, published_at DESC, article_id', 'b')} FROM star WHERE {recent(3)}) x WHERE a <= 2 AND b <= 4",
        "W04_top_by_two_keys": f"SELECT topic, tier, article_id, rn FROM (SELECT topic, tier, article_id, {rn('topic, tier', 'abs(sentiment) DESC, published_at DESC, article_id')} FROM {d.unnest('star', 'topics', 'topic')} WHERE sentiment IS NOT NULL) x WHERE rn <= 3",
        "W05_cadence": f"SELECT source_id, round({d.median('gap')}, 6) AS cadence_h FROM (SELECT source_id, CAST({d.us('published_at')} - lag({d.us('published_at')}) OVER (PARTITION BY source_id ORDER BY published_at, article_id) AS DOUBLE) / CAST(3600000000 AS DOUBLE) AS gap FROM articles) x WHERE gap > 0 GROUP BY 1",
        "W06_latest_row": f"SELECT country_code, day, temperature FROM (SELECT country_code, day, temperature, {rn('country_code', 'day DESC')} FROM temps) x WHERE rn = 1",
        "W07_distinct_on": f"SELECT country_code, event_key, article_id FROM (SELECT country_code, event_key, article_id, {rn('country_code, event_key', 'action_level DESC, reprint_count DESC NULLS LAST, published_at DESC, article_id')} FROM star WHERE event_key IS NOT NULL) x WHERE rn = 1",
        "W08_cluster_discount": f"SELECT article_id, round(power(CAST(0.2 AS DOUBLE), {rn('country_code, event_key', 'weight DESC, article_id').removesuffix(' AS rn')} - 1), 6) AS c FROM star WHERE event_key IS NOT NULL",
        "W09_decayed_mean": f"SELECT country_code, round(sum(tone * power(CAST(0.8 AS DOUBLE), rn - 1)) / sum(power(CAST(0.8 AS DOUBLE), rn - 1)), 4) AS tone FROM (SELECT country_code, tone, {rn('country_code', 'day DESC')} FROM gdelt WHERE tone IS NOT NULL) x GROUP BY 1",
        "W10_latest_against_base": f"SELECT country_code, round(max(CASE WHEN rn = 1 THEN tone END), 4) AS latest, round(avg(CASE WHEN rn > 2 THEN tone END), 4) AS base, round(stddev_samp(CASE WHEN rn > 2 THEN tone END), 4) AS sd FROM (SELECT country_code, tone, {rn('country_code', 'day DESC')} FROM gdelt WHERE tone IS NOT NULL) x GROUP BY 1",
        "W11_trailing_3": "SELECT country_code, day, CASE WHEN n < 2 THEN 'stable' WHEN temperature - m > 5 THEN 'rising' WHEN temperature - m < -5 THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT country_code, day, temperature, avg(temperature) OVER w AS m, count(*) OVER w AS n FROM temps WINDOW w AS (PARTITION BY country_code ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) x",
        "W12_trailing_30": "SELECT country_code, day, CASE WHEN n >= 5 THEN round((temperature - m) / coalesce(nullif(sd, 0), 1), 2) END AS z FROM (SELECT country_code, day, temperature, avg(temperature) OVER w AS m, stddev_samp(temperature) OVER w AS sd, count(*) OVER w AS n FROM temps WINDOW w AS (PARTITION BY country_code ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) x",
        "W13_year_on_year": "SELECT country_code, year, round(CAST(exports - p AS DOUBLE) * 100 / nullif(p, 0), 2) AS yoy FROM (SELECT country_code, year, exports, lag(exports) OVER (PARTITION BY country_code ORDER BY year) AS p FROM trade) x",
        "W14_exact_year_before": "SELECT a.country_code, a.year, round(CAST(a.exports - b.exports AS DOUBLE) * 100 / nullif(b.exports, 0), 2) AS yoy FROM trade a LEFT JOIN trade b ON a.country_code = b.country_code AND a.year = b.year + 1",
        "W15_quarters": f"SELECT source_id, round(avg(CASE WHEN rn > n - q THEN sentiment END) - avg(CASE WHEN rn <= q THEN sentiment END), 4) AS shift FROM (SELECT source_id, sentiment, rn, n, CAST(floor(n / 4) AS BIGINT) AS q FROM (SELECT source_id, sentiment, {rn('source_id', 'published_at, article_id')}, count(*) OVER (PARTITION BY source_id) AS n FROM star WHERE sentiment IS NOT NULL) x) y WHERE n >= 4 GROUP BY 1",
        "W16_halves": f"SELECT source_id, round(avg(CASE WHEN rn > h THEN action_level END) - avg(CASE WHEN rn <= h THEN action_level END), 4) AS shift FROM (SELECT source_id, action_level, rn, CAST(floor(n / 2) AS BIGINT) AS h FROM (SELECT source_id, action_level, {rn('source_id', 'published_at, article_id')}, count(*) OVER (PARTITION BY source_id) AS n FROM star) x) y WHERE h >= 1 GROUP BY 1",
        "W17_midpoint": f"SELECT source_id, count(CASE WHEN t <= (lo + hi) / 2 THEN 1 END) AS first_half, count(CASE WHEN t > (lo + hi) / 2 THEN 1 END) AS second_half FROM (SELECT source_id, t, min(t) OVER (PARTITION BY source_id) AS lo, max(t) OVER (PARTITION BY source_id) AS hi FROM (SELECT source_id, CAST({d.us('published_at')} AS DOUBLE) AS t FROM star) z) x GROUP BY 1",
        "W18_7_against_7": f"SELECT country_code, round(avg(CASE WHEN rn <= 7 THEN volume END), 4) AS last_7, round(avg(CASE WHEN rn BETWEEN 8 AND 14 THEN volume END), 4) AS before_7, max(CASE WHEN rn = 1 THEN volume END) >= 1.6 * avg(volume) AS spike FROM (SELECT country_code, volume, {rn('country_code', 'day DESC')} FROM gdelt) x GROUP BY 1",
        "W19_global_cap": f"SELECT article_id, country_code FROM (SELECT article_id, country_code, action_level, published_at, {rn('country_code', 'action_level DESC, published_at DESC, article_id')} FROM star WHERE {recent(5)}) x WHERE rn <= 3 ORDER BY action_level DESC, published_at DESC, article_id LIMIT 45",
        "W20_first_3_of_100": f"SELECT emotion, comment_id FROM (SELECT emotion, comment_id, {rn('emotion', 'published_at DESC, comment_id')} FROM (SELECT * FROM comments ORDER BY published_at DESC, comment_id LIMIT 100) a) x WHERE rn <= 3",
        # sorts and limits
        "L01_top": "SELECT article_id, action_level FROM star ORDER BY action_level DESC, published_at DESC, article_id LIMIT 20",
        "L02_nulls_last": "SELECT article_id, sentiment FROM star ORDER BY sentiment DESC NULLS LAST, article_id LIMIT 50",
        "L03_computed": "SELECT article_id FROM star ORDER BY action_level * abs(sentiment) DESC NULLS LAST, article_id LIMIT 25",
        "L04_case_rank": "SELECT article_id, tier FROM star ORDER BY CASE tier WHEN 'official' THEN 0 WHEN 'social' THEN 1 ELSE 2 END, published_at DESC, article_id LIMIT 30",
        "L05_page": "SELECT article_id, (SELECT count(*) FROM star) AS total FROM star ORDER BY published_at DESC, article_id LIMIT 20 OFFSET 40",
        "L06_sort_column": "SELECT thread_id, article_count FROM threads ORDER BY article_count DESC, thread_id LIMIT 15",
        "L07_after_aggregate": "SELECT tier, count(*) AS n FROM star GROUP BY tier ORDER BY n DESC, tier",
        "L08_extremes": "SELECT 'hot' AS what, country_code, temperature FROM (SELECT * FROM temps WHERE day = DATE '2024-01-30' ORDER BY temperature DESC, country_code LIMIT 1) a UNION ALL SELECT 'cold' AS what, country_code, temperature FROM (SELECT * FROM temps WHERE day = DATE '2024-01-30' ORDER BY temperature, country_code LIMIT 1) b",
        # set operations
        "U01_union_distinct": "SELECT thread_id AS id FROM threads WHERE article_count > 2 UNION SELECT thread_id AS id FROM threads WHERE max_action_level >= 5",
        "U02_key_sets": f"SELECT country_code, {d.set_join('event_key')} AS event_keys, {d.set_join('event_key', 'action_level >= 5')} AS hot_keys FROM star GROUP BY 1",
        "U03_fallback": "SELECT n_name AS country_code, coalesce(o.best, g.best) AS best, CASE WHEN o.best IS NOT NULL THEN 'own' WHEN g.best IS NOT NULL THEN 'world' END AS origin FROM nation LEFT JOIN (SELECT country_code, max(article_id) AS best FROM star WHERE tier = 'official' AND action_level = 6 GROUP BY 1) o ON o.country_code = n_name LEFT JOIN (SELECT country_code, max(article_id) AS best FROM star GROUP BY 1) g ON g.country_code = n_name",
        "U04_first_method_wins": f"SELECT id_1, id_2, method FROM (SELECT id_1, id_2, method, {rn('id_1, id_2', 'method')} FROM (SELECT a.thread_id AS id_1, b.thread_id AS id_2, 1 AS method FROM threads a JOIN threads b ON a.country_code = b.country_code AND a.max_action_level = b.max_action_level AND a.thread_id < b.thread_id UNION ALL SELECT a.thread_id, b.thread_id, 2 FROM links a JOIN links b ON a.article_id = b.article_id AND a.thread_id < b.thread_id) m) x WHERE rn = 1",
        # dates and numbers
        "D03_day_trunc": f"SELECT {day} AS day, count(*) AS n FROM star GROUP BY 1",
        "D04_epoch_hours": f"SELECT country_code, round(CAST({d.us('max(published_at)')} - {d.us('min(published_at)')} AS DOUBLE) / CAST(3600000000 AS DOUBLE), 6) AS span_h FROM star GROUP BY 1",
        "D05_year_window": "SELECT country_code, round(avg(CAST(agree AS DOUBLE) / nullif(agree + disagree, 0)), 4) AS agreement FROM un_votes WHERE year >= 1998 - 3 GROUP BY 1",
        "D06_exp_decay": f"SELECT article_id, round(exp(-{d.age_s('published_at')} / CAST(1209600 AS DOUBLE)), 8) AS w FROM articles",
        "D07_day_bucket": f"SELECT concat('velocity:', country_code, ':', {'date_format(published_at, ' + chr(39) + 'yyyyMMdd' + chr(39) + ')' if d.spark else 'strftime(published_at, ' + chr(39) + '%Y%m%d' + chr(39) + ')'}) AS dedup_key, count(*) AS n FROM star GROUP BY 1",
        "D08_parse_day": f"SELECT {'to_date(x, ' + chr(39) + 'yyyyMMdd' + chr(39) + ')' if d.spark else 'CAST(strptime(x, ' + chr(39) + '%Y%m%d' + chr(39) + ') AS DATE)'} AS day, count(*) AS n FROM (SELECT concat('202401', CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, CAST(event_id % 28 + 1 AS {s})) AS x FROM events) y GROUP BY 1",
        "D10_backfill_flag": f"SELECT published_at < {AS_OF} - {d.hours(48)} AS late, count(*) AS n FROM articles GROUP BY 1",
        "M01_math": "SELECT article_id, round(ln(1 + reprint_count), 6) AS a, round(log10(10 + reprint_count), 6) AS b, round(sqrt(abs(sentiment)), 6) AS c FROM star WHERE sentiment IS NOT NULL",
        "M06_percent_guard": "SELECT currency, day, CASE WHEN p <> 0 THEN round((rate - p) / p * 100, 4) END AS chg FROM (SELECT currency, day, rate, lag(rate) OVER (PARTITION BY currency ORDER BY day) AS p FROM fx) x",
        "M07_multipliers": "SELECT article_id, CASE action_level WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 8 WHEN 5 THEN 12 WHEN 6 THEN 15 ELSE 1 END AS m FROM star",
        "M08_cost": "SELECT model, script, round(sum(tokens_in * r_in + tokens_out * r_out) / 1000000, 6) AS cost FROM usage_ JOIN (SELECT 'alpha-large' AS name, CAST(2 AS DOUBLE) AS r_in, CAST(8 AS DOUBLE) AS r_out UNION ALL SELECT 'beta', CAST(0.5 AS DOUBLE), CAST(1.5 AS DOUBLE)) r ON model = name OR (model LIKE concat('%', name, '%') AND model <> name) GROUP BY 1, 2",
        # feeds
        "Q_map_history": "SELECT day, country_code, round(avg(score), 2) AS score FROM scores GROUP BY 1, 2",
        "Q_country_topics": f"SELECT country_code, topic, count(*) AS n, round(avg(sentiment), 3) AS mean FROM {d.unnest('star', 'topics', 'topic')} WHERE is_relevant GROUP BY 1, 2",
        "Q_tier_divergence": "SELECT country_code, tier, count(*) AS n, round(avg(sentiment), 3) AS mean FROM star WHERE is_relevant AND sentiment IS NOT NULL GROUP BY 1, 2",
        "Q_visits": "SELECT day, path, count(*) AS hits, count(DISTINCT visitor) AS visitors FROM views_ GROUP BY 1, 2",
        "Q_usage": "SELECT script, model, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens FROM usage_ GROUP BY 1, 2",
        "Q_high_impact": f"SELECT article_id, country_code, action_level FROM star WHERE action_level >= 5 AND {rel} ORDER BY published_at DESC, article_id LIMIT 50",
        "Q_vox_channels": "SELECT platform, channel_id_ext, count(*) AS n, round(avg(sentiment), 3) AS mean FROM comments GROUP BY 1, 2",
        "Q_un_summary": f"SELECT country_code, {d.arg_max('agree', 'year')} AS agree, max(year) AS year FROM un_votes GROUP BY 1",
        "Q_language_matrix": "SELECT country_code, max(CASE WHEN language = 'native' THEN 1 ELSE 0 END) AS native, max(CASE WHEN language = 'ru' THEN 1 ELSE 0 END) AS ru, max(CASE WHEN language = 'en' THEN 1 ELSE 0 END) AS en FROM sources WHERE active GROUP BY 1",
        "Q_integrity": "SELECT (SELECT count(*) FROM links l WHERE NOT EXISTS (SELECT 1 FROM analysis a WHERE a.article_id = l.article_id AND a.is_relevant)) AS dangling, (SELECT count(*) FROM articles r WHERE NOT EXISTS (SELECT 1 FROM analysis a WHERE a.article_id = r.article_id)) AS unanalysed, (SELECT count(*) FROM threads t WHERE t.article_count < 2) AS thin",
    }
