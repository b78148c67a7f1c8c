"""DuckDB SQL that states the expected result of each registered query on the given tables.

Written from the definitions of the operators, independently of the Spark plans: visits and
bounces with window functions over a whole visitor, joins as plain range joins.
"""

from __future__ import annotations

_PAGES = r"""
pages AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id,
         CAST(user_id AS VARCHAR) AS mid,
         'ar' || (user_id % 5) AS ar, 'ch' || (k % 3) AS ch, 'v' || (k % 4) AS vc,
         CASE WHEN event_type = 'signup' THEN '1' ELSE '0' END AS is_new,
         CASE event_type WHEN 'view' THEN 'good_detail' WHEN 'click' THEN 'good_list'
              WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'payment' ELSE 'home' END AS page_id,
         CASE WHEN event_type IN ('signup', 'view') THEN NULL
              WHEN event_type = 'click' THEN 'search' ELSE 'home' END AS last_page_id,
         CAST(k AS VARCHAR) AS item, k, event_type, value,
         CASE WHEN event_type = 'click' THEN 'keyword' ELSE 'sku_id' END AS item_type,
         CAST(floor(value * 100) AS BIGINT) AS during_time
  FROM (SELECT *, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS k FROM events)
)"""

_VISITS = (
    _PAGES
    + """,
visits AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY mid, CAST(make_timestamp(ts * 1000) AS DATE)
                                 ORDER BY ts, event_id) AS n
    FROM pages WHERE last_page_id IS NULL) WHERE n = 1
),
bounced AS (
  SELECT * FROM (
    SELECT *, lead(ts) OVER w AS next_ts, lead(last_page_id) OVER w AS next_last
    FROM pages WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id))
  WHERE last_page_id IS NULL
    AND (next_ts IS NULL OR next_last IS NULL OR next_ts - ts >= 21600000)
),
visitor_facts AS (
  SELECT vc, ch, ar, is_new, 0 AS uv, 1 AS pv, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END AS sv,
         0 AS uj, during_time AS dur, ts FROM pages
  UNION ALL SELECT vc, ch, ar, is_new, 1, 0, 0, 0, 0, ts FROM visits
  UNION ALL SELECT vc, ch, ar, is_new, 0, 0, 0, 1, 0, ts FROM bounced
),
visitor_stats AS (
  SELECT date_trunc('hour', make_timestamp(ts * 1000)) AS stt, vc, ch, ar, is_new,
         CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct,
         CAST(sum(sv) AS BIGINT) AS sv_ct, CAST(sum(uj) AS BIGINT) AS uj_ct,
         CAST(sum(dur) AS BIGINT) AS dur_sum, min(ts) AS ts
  FROM visitor_facts GROUP BY ALL
)"""
)

_ORDERS = """
orders_in AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_custkey % 25 AS province_id,
         o_orderstatus AS order_status, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         o_orderpriority, 1704067200 + (o_orderkey * 7919) % 2592000 AS s
  FROM orders
),
details AS (
  SELECT l_orderkey AS order_id, l_orderkey * 10 + l_linenumber AS detail_id, l_partkey AS sku_id,
         CAST(l_quantity AS BIGINT) AS sku_num, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(l_discount AS DECIMAL(18,2)) AS discount, CAST(l_tax AS DECIMAL(18,2)) AS tax,
         1704067200 + (l_orderkey * 7919) % 2592000 + l_linenumber * 2 - 6 AS s,
         l_returnflag, l_linestatus
  FROM lineitem
),
ordered AS (
  SELECT o.*, d.detail_id, d.sku_id, d.sku_num, d.amount, d.discount, d.tax
  FROM orders_in o JOIN details d ON o.order_id = d.order_id AND d.s BETWEEN o.s - 5 AND o.s + 5
),
paid AS (
  SELECT w.*, p.s + p.order_id % 1200 - 10 AS paid_s, p.user_id AS paid_user,
         p.total_amount AS paid_amount, p.o_orderpriority AS subject, p.order_status AS paid_status
  FROM ordered w JOIN orders_in p ON w.order_id = p.order_id
   AND p.s + p.order_id % 1200 - 10 BETWEEN w.s - 5 AND w.s + 900
)"""

_PRODUCTS = r"""
category AS (
  SELECT CAST(length(p_type) * 100 + ascii(p_type) AS BIGINT) AS category3_id, min(p_type) AS category3_name
  FROM part GROUP BY 1
),
trademark AS (
  SELECT CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT) AS tm_id, min(p_brand) AS tm_name
  FROM part GROUP BY 1
),
spu AS (SELECT CAST(p_size AS BIGINT) AS spu_id, min(p_name) AS spu_name FROM part GROUP BY 1),
products AS (
  SELECT p_partkey AS sku_id, p_name AS sku_name, CAST(p_retailprice AS DECIMAL(18,2)) AS sku_price,
         spu_id, spu_name, tm_id, tm_name, category3_id, category3_name
  FROM part
  JOIN spu ON spu_id = p_size
  JOIN trademark ON tm_id = CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT)
  JOIN category ON category3_id = length(p_type) * 100 + ascii(p_type)
)"""

_PROVINCES = """
provinces AS (
  SELECT n_nationkey AS province_id, n_name AS province_name, '0' || n_nationkey AS province_area_code,
         'N-' || n_nationkey AS province_iso_code, r_name || '-' || n_nationkey AS province_3166_2_code
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

_USERS = """
users AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS user_gender,
         CAST((DATE '2024-01-31' - (DATE '1950-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER))) // 365
              AS INTEGER) AS user_age
  FROM customer
)"""

_FACTS = """
product_facts AS (
  SELECT 'click' AS fact, CAST(item AS BIGINT) AS sku_id, CAST(NULL AS BIGINT) AS order_id,
         0 AS display_ct, 1 AS click_ct, 0 AS favor_ct, 0 AS cart_ct, 0 AS order_sku_num,
         0 AS comment_ct, 0 AS good_comment_ct, 0.0 AS order_amount, 0.0 AS payment_amount,
         0.0 AS refund_amount, ts
  FROM pages WHERE page_id = 'good_detail' AND item_type = 'sku_id'
  UNION ALL
  SELECT 'display', (k * i) % 100, NULL, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, ts
  FROM (SELECT *, unnest(range(1, k % 4 + 1)) AS i FROM pages) WHERE i % 2 = 1
  UNION ALL
  SELECT 'favor', k, NULL, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, ts // 1000 * 1000
  FROM pages WHERE event_type = 'click'
  UNION ALL
  SELECT 'cart', k, NULL, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, ts // 1000 * 1000
  FROM pages WHERE event_type = 'purchase'
  UNION ALL
  SELECT 'order', sku_id, order_id, 0, 0, 0, 0, sku_num, 0, 0, amount, 0, 0, s * 1000 FROM ordered
  UNION ALL
  SELECT 'payment', sku_id, order_id, 0, 0, 0, 0, 0, 0, 0, 0, amount, 0, paid_s * 1000 FROM paid
  UNION ALL
  SELECT 'refund', l_partkey, l_orderkey, 0, 0, 0, 0, 0, 0, 0, 0, 0, CAST(l_extendedprice AS DECIMAL(18,2)),
         (1704067200 + (l_orderkey * 7919) % 2592000 + 3600) * 1000
  FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL
  SELECT 'comment', l_partkey, NULL, 0, 0, 0, 0, 0, 1, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END,
         0, 0, 0, (1704067200 + (l_orderkey * 7919) % 2592000 + 7200) * 1000
  FROM lineitem WHERE l_returnflag = 'A'
)"""

_SALES = (
    _ORDERS
    + ","
    + _PRODUCTS
    + """,
sales AS (
  SELECT CAST(make_timestamp(s * 1000000) AS DATE) AS day, sku_id, sum(amount) AS order_amount,
         count(DISTINCT order_id) AS order_ct
  FROM ordered GROUP BY ALL
),
sold AS (SELECT * FROM sales JOIN products USING (sku_id))"""
)

_PROVINCE_STATS = (
    _ORDERS
    + ","
    + _PROVINCES
    + """,
province_stats AS (
  SELECT CAST(make_timestamp(s * 1000000) AS DATE) AS day, province_id, province_name, province_area_code,
         province_iso_code, province_3166_2_code, sum(amount) AS order_amount,
         count(DISTINCT order_id) AS order_count, min(s) * 1000 AS ts
  FROM ordered JOIN provinces USING (province_id) GROUP BY ALL
)"""
)

_DAY = "DATE '2024-01-15'"
_TIME = "'%Y-%m-%d %H:%M:%S'"


def _text(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), {_TIME})"


def _rates() -> str:
    """Half-up rounding in whole numbers."""
    return """
      CASE WHEN sv_ct = 0 THEN 0 ELSE (2 * uj_ct * 10000 + sv_ct) // (2 * sv_ct) / 100.0 END AS uj_rate,
      CASE WHEN sv_ct = 0 THEN 0
           ELSE (((2 * dur_sum + sv_ct) // (2 * sv_ct)) * 20 + 1000) // 2000 / 10.0 END AS dur_per_sv,
      CASE WHEN sv_ct = 0 THEN 0 ELSE (2 * pv_ct * 100 + sv_ct) // (2 * sv_ct) / 100.0 END AS pv_per_sv"""


_VISITOR_SUMS = ", ".join(
    f"CAST(sum({name}) AS BIGINT) AS {name}" for name in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")
)


def _top(keys: str, orders: bool) -> str:
    extra = ", CAST(sum(order_ct) AS BIGINT) AS order_ct" if orders else ""
    return f"""WITH {_SALES}
      SELECT {keys}, CAST(sum(order_amount) AS DOUBLE) AS order_amount{extra} FROM sold
      WHERE day = {_DAY} GROUP BY {keys} HAVING sum(order_amount) > 0
      ORDER BY sum(order_amount) DESC, {keys} LIMIT 10"""


def _top_by_day(keys: str) -> str:
    return f"""WITH {_SALES},
      ranked AS (
        SELECT day, {keys}, sum(order_amount) AS amount, sum(order_ct) AS orders,
               row_number() OVER (PARTITION BY day ORDER BY sum(order_amount) DESC, {keys}) AS n
        FROM sold GROUP BY day, {keys} HAVING sum(order_amount) > 0)
      SELECT CAST(day AS VARCHAR) AS day, {keys}, CAST(amount AS DOUBLE) AS order_amount,
             CAST(orders AS BIGINT) AS order_ct FROM ranked WHERE n <= 10"""


_PAGE_COLUMNS = "event_id, ts, mid, is_new, page_id, during_time"

_VISITOR_STATS = f"""WITH {_VISITS}
  SELECT strftime(stt, {_TIME}) AS stt, strftime(stt + INTERVAL 1 HOUR, {_TIME}) AS edt,
         * EXCLUDE (stt) FROM visitor_stats"""

_PRODUCT_STATS = f"""WITH {_PAGES}, {_ORDERS}, {_PRODUCTS}, {_FACTS},
  daily AS (
    SELECT date_trunc('day', make_timestamp(CAST(ts * 1000 AS BIGINT))) AS day, sku_id,
           CAST(sum(display_ct) AS BIGINT) AS display_ct, CAST(sum(click_ct) AS BIGINT) AS click_ct,
           CAST(sum(favor_ct) AS BIGINT) AS favor_ct, CAST(sum(cart_ct) AS BIGINT) AS cart_ct,
           CAST(sum(order_sku_num) AS BIGINT) AS order_sku_num,
           CAST(sum(comment_ct) AS BIGINT) AS comment_ct,
           CAST(sum(good_comment_ct) AS BIGINT) AS good_comment_ct,
           CAST(sum(order_amount) AS DOUBLE) AS order_amount,
           CAST(sum(payment_amount) AS DOUBLE) AS payment_amount,
           CAST(sum(refund_amount) AS DOUBLE) AS refund_amount,
           count(DISTINCT CASE WHEN fact = 'order' THEN order_id END) AS order_ct,
           count(DISTINCT CASE WHEN fact = 'payment' THEN order_id END) AS paid_order_ct,
           count(DISTINCT CASE WHEN fact = 'refund' THEN order_id END) AS refund_order_ct,
           CAST(min(ts) AS BIGINT) AS ts
    FROM product_facts GROUP BY 1, 2)
  SELECT strftime(day, {_TIME}) AS stt, strftime(day + INTERVAL 1 DAY, {_TIME}) AS edt,
         daily.* EXCLUDE (day), sku_name, CAST(sku_price AS DOUBLE) AS sku_price, spu_id, spu_name,
         tm_id, tm_name, category3_id, category3_name
  FROM daily JOIN products USING (sku_id)"""

_PROVINCE_ROWS = f"""WITH {_PROVINCE_STATS}
  SELECT strftime(CAST(day AS TIMESTAMP), {_TIME}) AS stt,
         strftime(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, {_TIME}) AS edt, province_id, province_name,
         province_area_code, province_iso_code, province_3166_2_code,
         CAST(order_amount AS DOUBLE) AS order_amount, order_count, ts
  FROM province_stats"""

_DICTIONARY = r"""
dictionary AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS word FROM benchmark
)"""

_KEYWORD_WORDS = rf"""WITH {_DICTIONARY},
searched AS (
  SELECT row_number() OVER () AS id, text,
         1704067200 + (conv_id * 3600) % 2592000 + turn * 60 AS s
  FROM conversations WHERE role = 'user' AND text IS NOT NULL
),
runs AS (SELECT id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS run FROM searched),
starts AS (SELECT id, run, unnest(range(1, length(run) + 1)) AS i FROM runs),
candidates AS (
  SELECT id, substr(run, i, size) AS word FROM (
    SELECT id, run, i, unnest(range(1, least((SELECT max(length(word)) FROM dictionary),
                                            length(run) - i + 1) + 1)) AS size
    FROM starts)
),
words AS (
  SELECT id, word FROM candidates JOIN dictionary USING (word)
  UNION ALL SELECT id, unnest(regexp_extract_all(lower(text), '\p{{N}}+')) FROM searched
),
all_words AS (
  SELECT id, word FROM words
  UNION ALL SELECT id, text FROM searched WHERE id NOT IN (SELECT id FROM words)
)"""

_KEYWORD_STATS = f"""{_KEYWORD_WORDS}
SELECT strftime(day, {_TIME}) AS stt, strftime(day + INTERVAL 1 DAY, {_TIME}) AS edt, keyword,
       'search' AS source, ct, ts FROM (
  SELECT date_trunc('day', make_timestamp(s * 1000000)) AS day, word AS keyword, count(*) AS ct,
         min(s) * 1000 AS ts
  FROM all_words JOIN searched USING (id) GROUP BY 1, 2)"""

_CHANGES = """
changes AS (
  SELECT 'customer' AS tab, c_custkey AS seq, 5 AS width, c_name AS name, CAST(c_custkey AS VARCHAR) AS id,
         c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS cust, CAST(NULL AS VARCHAR) AS status FROM customer
  UNION ALL
  SELECT 'orders', o_orderkey, 6, NULL, CAST(o_orderkey AS VARCHAR), NULL, CAST(o_custkey AS VARCHAR),
         o_orderstatus FROM orders
),
typed AS (
  SELECT *, CASE seq % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'insert' WHEN 2 THEN 'update' ELSE 'delete' END AS type
  FROM changes
),
routed AS (
  SELECT *, CASE WHEN tab = 'customer' THEN 'dim_user_info' WHEN type = 'insert' THEN 'dwd_order_info'
                 ELSE 'order_changes' END AS sink,
         CASE WHEN tab = 'customer' THEN 'dimension' WHEN type = 'insert' THEN 'topic' ELSE 'unrouted' END AS output
  FROM typed WHERE type <> 'delete'
)"""

_ORDER_WIDE = f"""WITH {_ORDERS}, {_PRODUCTS}, {_PROVINCES}, {_USERS}
  SELECT detail_id, order_id, sku_id, CAST(amount AS DOUBLE) AS order_price, sku_num, sku_name,
         CAST(discount AS DOUBLE) AS split_activity_amount, CAST(tax AS DOUBLE) AS split_coupon_amount,
         CAST(amount AS DOUBLE) AS split_total_amount, province_id, order_status, user_id,
         CAST(total_amount AS DOUBLE) AS total_amount, CAST(0 AS DOUBLE) AS activity_reduce_amount,
         CAST(0 AS DOUBLE) AS coupon_reduce_amount, CAST(total_amount AS DOUBLE) AS original_total_amount,
         CAST(order_id % 20 AS DOUBLE) AS feight_fee, {_text('s')} AS create_time,
         strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS create_date,
         strftime(make_timestamp(s * 1000000), '%H') AS create_hour,
         user_age, user_gender, province_name, province_area_code, province_iso_code, province_3166_2_code,
         spu_id, spu_name, tm_id, tm_name, category3_id, category3_name
  FROM ordered JOIN users USING (user_id) JOIN provinces USING (province_id) JOIN products USING (sku_id)"""

_PAYMENT_WIDE = f"""WITH {_ORDERS}, {_PRODUCTS}, {_PROVINCES}, {_USERS}
  SELECT order_id AS payment_id, subject, CASE WHEN paid_status = 'F' THEN '1101' ELSE '1102' END AS payment_type,
         {_text('paid_s')} AS payment_create_time, {_text('paid_s + 1')} AS callback_time,
         detail_id, order_id, sku_id, CAST(amount AS DOUBLE) AS order_price, sku_num, sku_name,
         CAST(discount AS DOUBLE) AS split_activity_amount, CAST(tax AS DOUBLE) AS split_coupon_amount,
         CAST(amount AS DOUBLE) AS split_total_amount, province_id, order_status, paid_user AS user_id,
         CAST(paid_amount AS DOUBLE) AS total_amount, CAST(0 AS DOUBLE) AS activity_reduce_amount,
         CAST(0 AS DOUBLE) AS coupon_reduce_amount, CAST(total_amount AS DOUBLE) AS original_total_amount,
         CAST(order_id % 20 AS DOUBLE) AS feight_fee, {_text('s')} AS order_create_time,
         user_age, user_gender, province_name, province_area_code, province_iso_code, province_3166_2_code,
         spu_id, spu_name, tm_id, tm_name, category3_id, category3_name
  FROM paid JOIN users USING (user_id) JOIN provinces USING (province_id) JOIN products USING (sku_id)"""

_DIM_LATEST = f"""WITH {_CHANGES}
  SELECT sinkTable, pk, max(seq) AS seq, max_by(c_name, seq) AS c_name FROM (
    SELECT sink AS sinkTable, id AS pk, seq, name AS c_name FROM routed WHERE output = 'dimension'
    UNION ALL SELECT sink, segment, seq, name FROM routed WHERE output = 'dimension')
  GROUP BY 1, 2"""

_BOUNCES = f"WITH {_VISITS} SELECT {_PAGE_COLUMNS} FROM bounced"

_NEW_FLAG = f"""WITH {_PAGES}
  SELECT event_id, ts, mid, CASE WHEN is_new = '1' AND n = 1 THEN '1' ELSE '0' END AS is_new, page_id, during_time
  FROM (SELECT *, row_number() OVER (PARTITION BY mid, is_new ORDER BY ts, event_id) AS n FROM pages)"""

_HITS = f"""{_PAGES}, {_ORDERS},
      hits AS (
        SELECT item AS keyword, CASE WHEN last_page_id = 'search' THEN 10 WHEN page_id = 'payment' THEN 2
                                     WHEN page_id = 'good_detail' THEN 1 ELSE 0 END AS weight,
               CAST(make_timestamp(ts * 1000) AS DATE) AS day FROM pages
        UNION ALL SELECT CAST(sku_id AS VARCHAR), 3, CAST(make_timestamp(s * 1000000) AS DATE) FROM ordered)"""

_BROKEN = "page_id = 'payment' AND ch = 'ch0'"

ORACLES: dict[str, str] = {
    "gmv_day": f"WITH {_SALES} SELECT CAST(sum(order_amount) AS DOUBLE) AS gmv FROM sold WHERE day = {_DAY}",
    "gmv_by_day": f"""WITH {_SALES}
      SELECT CAST(day AS VARCHAR) AS day, CAST(sum(order_amount) AS DOUBLE) AS gmv FROM sold GROUP BY 1""",
    "top_trademark": _top("tm_id, tm_name", False),
    "top_trademark_by_day": _top_by_day("tm_id, tm_name"),
    "top_category": _top("category3_id, category3_name", False),
    "top_category_by_day": _top_by_day("category3_id, category3_name"),
    "top_spu": _top("spu_id, spu_name", True),
    "top_spu_by_day": _top_by_day("spu_id, spu_name"),
    "province_amount": f"""WITH {_PROVINCE_STATS}
      SELECT province_name, CAST(sum(order_amount) AS DOUBLE) AS order_amount FROM province_stats
      WHERE day = {_DAY} GROUP BY province_id, province_name""",
    "province_amount_by_day": f"""WITH {_PROVINCE_STATS}
      SELECT CAST(day AS VARCHAR) AS day, CAST(province_id AS BIGINT) AS province_id, province_name,
             CAST(sum(order_amount) AS DOUBLE) AS order_amount FROM province_stats GROUP BY 1, 2, 3""",
    "visitor_by_flag": f"""WITH {_VISITS}
      SELECT is_new, {_VISITOR_SUMS} FROM visitor_stats WHERE CAST(stt AS DATE) = {_DAY} GROUP BY is_new""",
    "visitor_by_flag_and_day": f"""WITH {_VISITS},
      daily AS (SELECT CAST(CAST(stt AS DATE) AS VARCHAR) AS day, is_new, {_VISITOR_SUMS}
                FROM visitor_stats GROUP BY 1, 2)
      SELECT *, {_rates()} FROM daily""",
    "visitor_by_hour": f"""WITH {_VISITS},
      hourly AS (
        SELECT hour(stt) AS hr, sum(uv_ct) AS uv, sum(pv_ct) AS pv, sum(uj_ct) AS uj,
               sum(CASE WHEN is_new = '1' THEN uv_ct ELSE 0 END) AS new_uv
        FROM visitor_stats WHERE CAST(stt AS DATE) = {_DAY} GROUP BY 1)
      SELECT CAST(h AS INTEGER) AS hr, CAST(coalesce(uv, 0) AS BIGINT) AS uv_ct,
             CAST(coalesce(pv, 0) AS BIGINT) AS pv_ct, CAST(coalesce(uj, 0) AS BIGINT) AS uj_ct,
             CAST(coalesce(new_uv, 0) AS BIGINT) AS new_uv, lpad(CAST(h AS VARCHAR), 2, '0') AS hour_label
      FROM range(24) AS hours(h) LEFT JOIN hourly ON hourly.hr = h""",
    "visitor_by_hour_and_day": f"""WITH {_VISITS},
      hourly AS (
        SELECT CAST(stt AS DATE) AS day, hour(stt) AS hr, sum(uv_ct) AS uv, sum(pv_ct) AS pv, sum(uj_ct) AS uj,
               sum(CASE WHEN is_new = '1' THEN uv_ct ELSE 0 END) AS new_uv
        FROM visitor_stats GROUP BY 1, 2),
      days AS (SELECT DISTINCT day FROM hourly)
      SELECT CAST(days.day AS VARCHAR) AS day, CAST(h AS INTEGER) AS hr, CAST(coalesce(uv, 0) AS BIGINT) AS uv_ct,
             CAST(coalesce(pv, 0) AS BIGINT) AS pv_ct, CAST(coalesce(uj, 0) AS BIGINT) AS uj_ct,
             CAST(coalesce(new_uv, 0) AS BIGINT) AS new_uv, lpad(CAST(h AS VARCHAR), 2, '0') AS hour_label
      FROM days CROSS JOIN range(24) AS hours(h) LEFT JOIN hourly ON hourly.hr = h AND hourly.day = days.day""",
    "visitor_rates_by_day": f"""WITH {_VISITS},
      days AS (SELECT DISTINCT CAST(stt AS DATE) AS day FROM visitor_stats),
      sides AS (
        SELECT day, side, {", ".join(f"coalesce(CAST(sum({c}) AS BIGINT), 0) AS {c}" for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"))}
        FROM days CROSS JOIN (VALUES ('1'), ('0')) AS flags(side)
        LEFT JOIN visitor_stats ON is_new = side AND CAST(stt AS DATE) = day GROUP BY day, side),
      rated AS (SELECT *, {_rates()} FROM sides),
      long AS (
        SELECT day, 'visitors' AS type, side, CAST(uv_ct AS DOUBLE) AS v FROM rated
        UNION ALL SELECT day, 'pages', side, pv_ct FROM rated
        UNION ALL SELECT day, 'bounce_rate', side, uj_rate FROM rated
        UNION ALL SELECT day, 'seconds_per_visit', side, dur_per_sv FROM rated
        UNION ALL SELECT day, 'pages_per_visit', side, pv_per_sv FROM rated)
      SELECT CAST(day AS VARCHAR) AS day, type, CAST(max(CASE WHEN side = '1' THEN v END) AS DOUBLE) AS new,
             CAST(max(CASE WHEN side = '0' THEN v END) AS DOUBLE) AS old FROM long GROUP BY day, type""",
    "visitor_rates": f"""WITH {_VISITS},
      sides AS (
        SELECT side, {", ".join(f"coalesce(CAST(sum({c}) AS BIGINT), 0) AS {c}" for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"))}
        FROM (VALUES ('1'), ('0')) AS flags(side)
        LEFT JOIN visitor_stats ON is_new = side AND CAST(stt AS DATE) = {_DAY} GROUP BY side),
      rated AS (SELECT *, {_rates()} FROM sides),
      long AS (
        SELECT 'visitors' AS type, side, CAST(uv_ct AS DOUBLE) AS v FROM rated
        UNION ALL SELECT 'pages', side, pv_ct FROM rated
        UNION ALL SELECT 'bounce_rate', side, uj_rate FROM rated
        UNION ALL SELECT 'seconds_per_visit', side, dur_per_sv FROM rated
        UNION ALL SELECT 'pages_per_visit', side, pv_per_sv FROM rated)
      SELECT type, CAST(max(CASE WHEN side = '1' THEN v END) AS DOUBLE) AS new,
             CAST(max(CASE WHEN side = '0' THEN v END) AS DOUBLE) AS old FROM long GROUP BY type""",
    "keyword_score": f"""WITH {_HITS}
      SELECT keyword, CAST(sum(weight) AS BIGINT) AS ct FROM hits WHERE day = {_DAY}
      GROUP BY keyword ORDER BY ct DESC, keyword LIMIT 20""",
    "keyword_score_by_day": f"""WITH {_HITS},
      ranked AS (
        SELECT day, keyword, sum(weight) AS ct,
               row_number() OVER (PARTITION BY day ORDER BY sum(weight) DESC, keyword) AS n
        FROM hits GROUP BY day, keyword)
      SELECT CAST(day AS VARCHAR) AS day, keyword, CAST(ct AS BIGINT) AS ct FROM ranked WHERE n <= 20""",
    "visitor_stats": _VISITOR_STATS,
    "product_stats": _PRODUCT_STATS,
    "province_stats": _PROVINCE_ROWS,
    "keyword_stats": _KEYWORD_STATS,
    "keyword_segment": r"""
      WITH tokens AS (
        SELECT source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents
        UNION ALL
        SELECT source, text FROM documents
        WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\p{L}\p{M}\p{N}]'))
      SELECT source, word, count(*) AS ct FROM tokens GROUP BY 1, 2""",
    "search_filter": """
      SELECT text AS keyword, (1704067200 + (conv_id * 3600) % 2592000 + turn * 60) * 1000 AS ts
      FROM conversations WHERE role = 'user' AND text IS NOT NULL""",
    "visitor_facts": f"""WITH {_VISITS}
      SELECT vc, ch, ar, is_new, CAST(uv AS BIGINT) AS uv_ct, CAST(pv AS BIGINT) AS pv_ct,
             CAST(sv AS BIGINT) AS sv_ct, CAST(uj AS BIGINT) AS uj_ct, CAST(dur AS BIGINT) AS dur_sum, ts
      FROM visitor_facts""",
    "product_facts": f"""WITH {_PAGES}, {_ORDERS}, {_FACTS}
      SELECT fact, sku_id, order_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "comment_ct", "good_comment_ct", "ts"))},
             CAST(order_amount AS DOUBLE) AS order_amount, CAST(payment_amount AS DOUBLE) AS payment_amount,
             CAST(refund_amount AS DOUBLE) AS refund_amount
      FROM product_facts""",
    "unique_visit": f"WITH {_VISITS} SELECT {_PAGE_COLUMNS} FROM visits",
    "bounce_detail": _BOUNCES,
    "new_flag_repair": _NEW_FLAG,
    "dirty_split": f"""WITH {_PAGES}
      SELECT CASE WHEN {_BROKEN} THEN 'dirty' ELSE 'good' END AS kind, CAST(event_id AS VARCHAR) AS event_id
      FROM pages""",
    "log_split": f"""WITH {_PAGES}
      SELECT CASE WHEN page_id = 'home' THEN 'start' ELSE 'page' END AS kind, mid, ts,
             CASE WHEN page_id = 'home' THEN 'icon' ELSE page_id END AS detail, during_time AS millis
      FROM pages WHERE NOT ({_BROKEN})""",
    "display_explode": f"""WITH {_PAGES}
      SELECT 'query' AS display_type, CAST((k * i) % 100 AS VARCHAR) AS item,
             CASE WHEN i % 2 = 1 THEN 'sku_id' ELSE 'activity_id' END AS item_type,
             CAST(i AS INTEGER) AS "order", CAST(i AS INTEGER) AS pos_id, ts, page_id, event_id
      FROM (SELECT *, unnest(range(1, k % 4 + 1)) AS i FROM pages
            WHERE page_id <> 'home' AND NOT ({_BROKEN}))""",
    "order_wide": _ORDER_WIDE,
    "payment_wide": _PAYMENT_WIDE,
    "dim_enrich": f"""WITH {_ORDERS}, {_PRODUCTS}
      SELECT spu_name, tm_name, category3_name, CAST(sum(amount) AS DOUBLE) AS amount,
             CAST(sum(sku_num) AS BIGINT) AS sku_num, count(*) AS rows
      FROM details JOIN products USING (sku_id) GROUP BY 1, 2, 3""",
    "user_age": f"""WITH {_USERS}
      SELECT o_orderkey AS id, user_id, user_age, user_gender FROM orders JOIN users ON o_custkey = user_id""",
    "order_fill": f"""WITH {_ORDERS}
      SELECT order_id, order_status, user_id, CAST(total_amount AS DOUBLE) AS total_amount,
             CASE WHEN order_id % 2 = 1 THEN CAST(amount AS DOUBLE) END AS split_total_amount FROM ordered""",
    "province_rows": f"""WITH {_ORDERS}, {_PROVINCES}
      SELECT province_id, province_name, province_area_code, province_iso_code, province_3166_2_code,
             CAST(amount AS DOUBLE) AS order_amount, CAST(1 AS BIGINT) AS order_count
      FROM ordered JOIN provinces USING (province_id)""",
    "wide_json": f"""WITH {_ORDERS}
      SELECT detail_id, order_id, {_text('s')} AS create_time, CAST(amount AS DOUBLE) AS split_total_amount
      FROM ordered""",
    "time_parts": f"""WITH {_ORDERS}
      SELECT order_id AS id, {_text('s')} AS create_time, s * 1000 AS millis, {_text('s')} AS again,
             CAST(strftime(make_timestamp(s * 1000000), '%Y%m%d') AS INTEGER) AS day_number,
             CAST(hour(make_timestamp(s * 1000000)) AS INTEGER) AS hour,
             strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS create_date,
             strftime(make_timestamp(s * 1000000), '%H') AS create_hour
      FROM orders_in""",
    "unique_visit_second": f"""WITH {_PAGES}
      SELECT {_PAGE_COLUMNS} FROM (
        SELECT *, row_number() OVER (PARTITION BY mid, ts // 1000 ORDER BY ts, event_id) AS n
        FROM pages WHERE last_page_id IS NULL) WHERE n = 1""",
    "sql_keyword_split": r"""
      WITH tokens AS (
        SELECT (1704067200 + (conv_id * 3600) % 2592000 + turn * 60) * 1000 AS ts, text,
               regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS found
        FROM conversations WHERE role = 'user' AND text IS NOT NULL)
      SELECT ts, unnest(CASE WHEN len(found) > 0 THEN found ELSE [text] END) AS word FROM tokens""",
    "sql_keyword_dictionary": f"""{_KEYWORD_WORDS}
      SELECT s * 1000 AS ts, word FROM all_words JOIN searched USING (id)""",
    "sensor_csv": "SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS ts, value AS vc FROM events",
    "camel_columns": 'SELECT c_custkey AS "cCustkey", c_mktsegment AS "cMktsegment" FROM customer',
    "code_names": """
      SELECT CASE WHEN o_orderstatus = 'F' THEN '1101' ELSE '1102' END AS code, 'payment_type' AS code_group,
             CASE WHEN o_orderstatus = 'F' THEN 'alipay' ELSE 'wechat' END AS meaning, count(*) AS ct
      FROM orders GROUP BY ALL""",
    "cdc_rule_defaults": f"""WITH {_CHANGES}
      SELECT sink AS "sinkTable", type, 'id' AS "Pk", count(*) AS ct FROM routed GROUP BY ALL""",
    "cdc_normalise": f"""WITH {_CHANGES}
      SELECT 'shop' AS database, tab AS "tableName", type, seq,
             CAST(CASE WHEN seq % 4 >= 2 THEN width ELSE 0 END AS INTEGER) AS before_columns,
             CAST(CASE WHEN seq % 4 < 3 THEN width ELSE 0 END AS INTEGER) AS after_columns,
             CASE WHEN type = 'delete' THEN NULL ELSE coalesce(name, status) END AS value
      FROM typed""",
    "cdc_route": f"""WITH {_CHANGES}
      SELECT output, tab AS "tableName", type, seq, sink AS "sinkTable",
             CASE WHEN tab = 'customer' THEN 'c_custkey' ELSE 'o_orderkey' END AS "Pk"
      FROM routed""",
    "cdc_project": f"""WITH {_CHANGES}
      SELECT sink AS "sinkTable", seq,
             CASE sink WHEN 'dim_user_info' THEN 'c_custkey,c_mktsegment,c_name'
                       WHEN 'dwd_order_info' THEN 'o_custkey,o_orderkey,o_orderstatus' ELSE 'o_orderkey' END AS names,
             CASE sink WHEN 'dim_user_info' THEN name WHEN 'dwd_order_info' THEN cust END AS value
      FROM routed""",
    "dim_latest": _DIM_LATEST,
    "versioned_replace": f"""WITH {_VISITS},
      older AS (
        SELECT date_trunc('hour', make_timestamp(ts * 1000)) AS stt, vc, ch, ar, is_new
        FROM visitor_facts WHERE uj = 0 GROUP BY ALL)
      SELECT strftime(stt, {_TIME}) AS stt, strftime(stt + INTERVAL 1 HOUR, {_TIME}) AS edt, vc, ch, ar, is_new,
             uv_ct, pv_ct, sv_ct, uj_ct, dur_sum, CAST(2 AS BIGINT) AS ts
      FROM visitor_stats FULL JOIN older USING (stt, vc, ch, ar, is_new)""",
    "stream_visitor_stats": _VISITOR_STATS,
    "stream_product_stats": _PRODUCT_STATS,
    "stream_province_stats": _PROVINCE_ROWS,
    "stream_keyword_stats": _KEYWORD_STATS,
    "stream_bounce": _BOUNCES,
    "stream_new_flag": _NEW_FLAG,
    "stream_unique_visit": f"WITH {_VISITS} SELECT {_PAGE_COLUMNS} FROM visits",
    "stream_late_pages": f"""WITH {_PAGES},
      parted AS (
        SELECT *, greatest(0, least(2, CAST(floor((ts // 1000 - 1704067200) * 3 / 2592000) AS INTEGER))) AS part,
               event_id % 50 = 0 AS late, ts // 3600000 * 3600 AS h FROM pages),
      arriving AS (SELECT *, part + CASE WHEN late THEN 1 ELSE 0 END AS arrival FROM parted),
      passed AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival) - 15000 AS mark FROM arriving GROUP BY arrival)
      SELECT {_text('h')} AS stt, {_text('h + 3600')} AS edt, count(*) AS pv_ct
      FROM arriving LEFT JOIN passed ON passed.arrival = arriving.arrival - 1
      WHERE NOT late OR (h + 3600) * 1000 > mark GROUP BY h""",
    "stream_order_wide": _ORDER_WIDE,
    "stream_payment_wide": _PAYMENT_WIDE,
    "stream_cdc_route": f"""WITH {_CHANGES}
      SELECT sink AS "sinkTable", id AS pk, max(seq) AS seq, max_by(name, seq) AS c_name
      FROM routed WHERE output = 'dimension' GROUP BY 1, 2""",
    "stream_topics": f"""WITH {_CHANGES}
      SELECT sink AS topic, id AS o_orderkey, cust AS o_custkey, status AS o_orderstatus
      FROM routed WHERE output = 'topic'""",
    "stream_topic_table": f"""WITH {_PAGES}
      SELECT event_id, mid, {_text('ts // 1000')} AS rt, {_text('ts // 1000 + 28800')} AS later FROM pages""",
    "stream_window_update": f"""
      SELECT strftime(day, {_TIME}) AS stt, strftime(day + INTERVAL 1 DAY, {_TIME}) AS edt, id,
             CAST(vc AS DOUBLE) AS vc, times FROM (
        SELECT date_trunc('day', ts) AS day, CAST(user_id AS VARCHAR) AS id,
               sum(CAST(value AS DECIMAL(18,2))) AS vc, count(DISTINCT epoch_us(ts) % 3) AS times
        FROM events GROUP BY 1, 2)""",
    "stream_window_firings": f"""
      WITH e AS (
        SELECT CAST(user_id AS VARCHAR) AS id, CAST(value AS DECIMAL(18,2)) AS vc, ts, event_id,
               epoch_ms(ts) AS ms, epoch_ms(ts) // 86400000 * 86400000 AS start,
               greatest(least(floor((epoch_us(ts) // 1000000 - 1704067200) * 3 / 2592000), 2), 0)
                 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS b
        FROM events
      ), newest AS (SELECT b, max(ms) AS top FROM e GROUP BY b),
      steps AS (SELECT unnest(range(0, 5)) AS b),
      clock AS (
        SELECT s.b, CASE WHEN s.b = 4 THEN 4102444800000 ELSE max(n.top) END AS now
        FROM steps s LEFT JOIN newest n ON n.b < s.b GROUP BY s.b
      ), spans AS (SELECT b, now, lag(now) OVER (ORDER BY b) AS was FROM clock),
      rows_in AS (
        SELECT e.*, start + 86400000 AS fin, now,
               start + 86400000 <= coalesce(now, 0) AS late
        FROM e JOIN spans USING (b) WHERE now IS NULL OR ms > now - 691200000
      ), windows AS (SELECT DISTINCT id, start, fin FROM rows_in),
      -- What is due when event time moves from was to now, with the rows that came before.
      due AS (
        SELECT w.id, w.start, w.fin, s.b, s.now, s.was,
               (SELECT count(*) FROM rows_in r WHERE r.id = w.id AND r.start = w.start AND r.b < s.b) AS ct,
               (SELECT sum(vc) FROM rows_in r WHERE r.id = w.id AND r.start = w.start AND r.b < s.b) AS vc
        FROM windows w JOIN spans s ON s.now >= w.fin
      ), fired AS (
        SELECT id, start, b, 0 AS place, 0 AS ms, 0 AS event_id,
               CASE WHEN was IS NULL OR was < fin THEN 'end' ELSE 'timer' END AS kind, ct, vc
        FROM due WHERE ct > 0 AND (
          was IS NULL OR was < fin
          OR (was < fin + 691200000
              AND (least(now, fin + 691199999) - fin) // 259200000 > (was - fin) // 259200000))
        UNION ALL
        SELECT id, start, b, 1, ms, event_id, 'late',
               (SELECT count(*) FROM rows_in r WHERE r.id = l.id AND r.start = l.start
                  AND (r.b < l.b OR (r.b = l.b AND (r.ms, r.event_id) <= (l.ms, l.event_id)))),
               (SELECT sum(vc) FROM rows_in r WHERE r.id = l.id AND r.start = l.start
                  AND (r.b < l.b OR (r.b = l.b AND (r.ms, r.event_id) <= (l.ms, l.event_id))))
        FROM rows_in l WHERE late
      )
      SELECT id, strftime(make_timestamp(start * 1000), {_TIME}) AS stt,
             strftime(make_timestamp((start + 86400000) * 1000), {_TIME}) AS edt,
             CAST(row_number() OVER (PARTITION BY id, start ORDER BY b, place, ms, event_id) AS INTEGER) AS firing,
             kind, ct, CAST(vc AS DOUBLE) AS vc
      FROM fired""",
}
ORACLES["stream_dim_upsert"] = ORACLES["stream_cdc_route"]
ORACLES["cdc_snapshots"] = " UNION ALL ".join(
    f"""
      SELECT '{name}' AS "tableName",
             CASE {key} % 500 WHEN 1 THEN 'CREATE' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS op,
             CAST({key} + CASE WHEN {key} % 500 = 3 THEN 1000000000 ELSE 0 END AS VARCHAR) AS pk,
             CASE {key} % 500 WHEN 2 THEN 'old' WHEN 3 THEN {column} END AS before,
             CASE WHEN {key} % 500 < 3 THEN {column} END AS after, CAST(2 AS BIGINT) AS seq
      FROM {name} WHERE {key} % 500 IN (1, 2, 3) AND NOT ({key} % 500 = 2 AND {column} = 'old')"""
    for name, key, column in (("customer", "c_custkey", "c_mktsegment"), ("orders", "o_orderkey", "o_orderpriority"))
)
ORACLES["stream_rule_changes"] = f"""WITH {_CHANGES}
      SELECT output, tab AS "tableName", type, seq,
             sink || CASE WHEN tab = 'orders' AND type = 'insert' AND seq % 3 >= 1 THEN '_1'
                          WHEN tab = 'customer' AND type = 'update' AND seq % 3 >= 2 THEN '_2' ELSE '' END AS "sinkTable"
      FROM routed"""
