"""ANSI SQL with the same results as the registered queries, for DuckDB."""

from __future__ import annotations

CUSTOMERS = """
customers AS (
  SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         'Customer' AS first_name, substr(c_name, 10) AS last_name,
         '555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone,
         c_mktsegment AS company, CAST(c_nationkey AS BIGINT) AS customer_group_id,
         '10.0.0.' || CAST(c_custkey % 256 AS VARCHAR) AS registration_ip,
         n_name AS country, r_name AS region, span.first_day, span.last_day
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day
             FROM orders GROUP BY o_custkey) AS span ON span.o_custkey = c_custkey
)"""

VALS = """
vals AS (
  SELECT user_id AS customer_id, event_type AS name,
         json_extract_string(props, '$.k') AS value, ts, event_id AS seq
  FROM events
)"""

SHOP_ORDERS = """
shop_orders AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id,
         'customer.' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@example.com' AS email,
         CASE WHEN o_orderstatus <> 'P' THEN 'cart-' || CAST(o_orderkey AS VARCHAR) END AS cart_id,
         o_orderstatus AS status, o_orderdate AS date_created,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total
  FROM orders
)"""

PRODUCTS = """
products AS (
  SELECT l_orderkey AS order_id, 'P-' || CAST(l_partkey AS VARCHAR) AS sku,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem
)"""

FEES = """
fees AS (
  SELECT l_orderkey AS order_id, 'tax' AS name, 'custom' AS type,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS amount,
         CAST(l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem WHERE l_tax > 0
)"""

CARTS = """
carts AS (
  SELECT 'cart-' || CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS customer_id,
         o_orderkey, o_orderdate AS created_time
  FROM orders WHERE o_orderstatus = 'O'
)"""

SEGMENT = """
segment AS (
  SELECT DISTINCT customer_id AS id FROM vals
  WHERE name = 'purchase' AND value = '7' AND customer_id > 0
)"""

CATALOG = """
typed AS (
  SELECT p_partkey AS n, p_brand, p_type, p_size,
         upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' '
           || upper(substr(split_part(p_name, ' ', 2), 1, 1))
           || lower(substr(split_part(p_name, ' ', 2), 2))
           || ' ' || CAST(p_partkey AS VARCHAR) AS label,
         list_extract(['text','multiline','password','radiobuttons','radio_buttons',
                       'multipleselect','multiple_select','dropdown','numberonly',
                       'number_only','number','date','checkboxes','weird'],
                      CAST(p_size % 14 AS BIGINT) + 1) AS bare
  FROM part
),
catalog AS (
  SELECT n, CASE WHEN n % 5 < 4 THEN label ELSE '(unnamed)' END AS name,
         CASE WHEN bare IN ('numberonly','number_only','number') THEN 'number'
              WHEN bare = 'date' THEN 'date'
              WHEN bare = 'checkboxes' THEN 'boolean' ELSE 'string' END AS type,
         CASE WHEN n % 2 = 0 THEN bare ELSE upper('type_' || bare || '_field') END AS raw_type,
         CASE WHEN n % 4 = 0 THEN p_brand || '|' || p_type
              WHEN n % 4 = 2 THEN p_brand END AS options,
         n % 7 = 0 AS built_in, n % 2 = 0 AS required
  FROM typed
)"""

TEXT_IDS = """
given AS (
  SELECT *, CASE WHEN seq % 20 = 1 THEN 'abc' || CAST(customer_id AS VARCHAR)
                 WHEN seq % 20 = 3 THEN '-' || CAST(customer_id AS VARCHAR)
                 WHEN seq % 20 = 5 THEN CAST(customer_id AS VARCHAR) || '.0'
                 WHEN seq % 20 = 7 THEN CAST(customer_id AS VARCHAR) || 'd'
                 WHEN seq % 20 = 9 THEN CAST(customer_id AS VARCHAR) || 'f'
                 ELSE CAST(customer_id AS VARCHAR) END AS text_id,
         seq % 20 NOT IN (1, 3, 7, 9) AND customer_id > 0 AS usable
  FROM vals
)"""

EXPORT_CELLS = """CAST(id AS VARCHAR) AS "Customer ID", email AS "Email", country AS "Country",
  company AS "Segment", '' AS "City" """

PLAIN = """id, email, first_name, last_name, phone, company, customer_group_id, registration_ip"""
DATED = PLAIN + """, strftime(first_day, '%Y-%m-%d') AS date_created,
  strftime(last_day, '%Y-%m-%d') AS date_modified"""


def with_tables(*tables: str) -> str:
    return "WITH " + ",".join(tables)


ORACLES: dict[str, str] = {
    "segment_export": with_tables(CUSTOMERS, VALS, SEGMENT)
    + f" SELECT {EXPORT_CELLS} FROM customers WHERE id IN (SELECT id FROM segment)",
    "segment_export_dates": with_tables(CUSTOMERS, VALS, SEGMENT)
    + """ SELECT CAST(id AS VARCHAR) AS "ID",
        coalesce(strftime(first_day, '%Y-%m-%dT%H:%M:%SZ'), '') AS "Created",
        coalesce(strftime(last_day, '%Y-%m-%dT%H:%M:%SZ'), '') AS "Modified", region AS "Region"
        FROM customers WHERE id IN (SELECT id FROM segment)""",
    "segment_export_incremental": with_tables(CUSTOMERS, VALS, SEGMENT)
    + f""" SELECT {EXPORT_CELLS} FROM customers
        WHERE id IN (SELECT id FROM segment) AND id % 2 <> 0""",
    "segment_counts": with_tables(CUSTOMERS, VALS, SEGMENT)
    + """ SELECT (SELECT count(*) FROM vals WHERE name = 'purchase' AND value = '7'
                  AND customer_id > 0) AS matched_rows,
        (SELECT count(*) FROM segment) AS matched,
        (SELECT count(*) FROM segment JOIN customers USING (id)) AS fetched""",
    "export_report": with_tables(CUSTOMERS, VALS, SEGMENT)
    + """ SELECT (SELECT count(*) FROM segment) AS matched,
        (SELECT count(*) FROM segment) AS fetched,
        (SELECT count(*) FROM segment JOIN customers USING (id)) AS written,
        false AS exported""",
    "export_files": with_tables(CUSTOMERS, VALS, SEGMENT)
    + """, first_run AS (
          SELECT DISTINCT customer_id AS id FROM vals
          WHERE name = 'purchase' AND value = '7' AND customer_id > 0 AND seq % 2 = 0
        )
        SELECT 'base' AS output, CAST(id AS VARCHAR) AS customer_id, email, company AS segment
        FROM customers WHERE id IN (SELECT id FROM segment)
        UNION ALL
        SELECT CASE WHEN id IN (SELECT id FROM first_run) THEN 'clean full'
                    ELSE 'clean increment' END, '', email, company
        FROM customers WHERE id IN (SELECT id FROM segment)""",
    "search_exact": with_tables(CUSTOMERS)
    + f""" SELECT 'id' AS asked, {PLAIN} FROM customers WHERE id = 42
        UNION ALL SELECT 'email', {PLAIN} FROM customers
          WHERE email = 'customer.000000043@example.com'
        UNION ALL SELECT 'name', {PLAIN} FROM customers
          WHERE first_name || ' ' || last_name = 'Customer 000000044'
        UNION ALL SELECT 'phone', {PLAIN} FROM customers WHERE phone = '555-0000045'
        UNION ALL SELECT 'company', {PLAIN} FROM customers
          WHERE company = 'MACHINERY' AND registration_ip = '10.0.0.77'""",
    "search_name_like": with_tables(CUSTOMERS)
    + f""" SELECT {DATED} FROM customers
        WHERE contains(lower(first_name || ' ' || last_name), 'customer 00000')
          AND contains(lower(company), 'ture')""",
    "search_company_dates": with_tables(CUSTOMERS)
    + f""" SELECT {DATED} FROM customers WHERE company = 'BUILDING'
          AND first_day >= TIMESTAMP '1995-01-10 00:00:00'
          AND first_day <= TIMESTAMP '1996-06-30 00:00:00'
          AND last_day >= TIMESTAMP '2000-06-01 00:00:00'
          AND last_day <= TIMESTAMP '2001-07-01 00:00:00'""",
    "search_group_ip": with_tables(CUSTOMERS)
    + f""" SELECT {DATED} FROM customers
        WHERE customer_group_id = (SELECT customer_group_id FROM customers WHERE id = 37)
          AND registration_ip = '10.0.0.37'""",
    "search_sorted": with_tables(CUSTOMERS)
    + f" SELECT {DATED} FROM customers WHERE contains(lower(company), 'hold')",
    "search_sorted_top": with_tables(CUSTOMERS)
    + " UNION ALL ".join(
        f""" SELECT * FROM (
          SELECT '{name}:{way}' AS sort, id, row_number() OVER (
            ORDER BY {column} {way} NULLS {"FIRST" if way == "asc" else "LAST"}, id) AS place
          FROM customers WHERE contains(lower(company), 'hold')) WHERE place <= 25"""
        for name, column in (("date_created", "first_day"), ("date_modified", "last_day"),
                             ("last_name", "last_name"))
        for way in ("asc", "desc")
    ),
    "search_by_order": with_tables(CUSTOMERS, SHOP_ORDERS, PRODUCTS)
    + """, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY customer_id
                                       ORDER BY date_created DESC, id DESC) AS rn
          FROM shop_orders WHERE customer_id > 0
        ), lines AS (SELECT order_id, count(*) AS n FROM products GROUP BY order_id),
        latest AS (
          SELECT customer_id, count(*) AS n_orders, sum(coalesce(n, 0)) AS n_products,
                 max(CASE WHEN rn = 1 THEN id END) AS newest_order, sum(total) AS total
          FROM ranked LEFT JOIN lines ON order_id = id WHERE rn <= 10 GROUP BY customer_id
        )
        SELECT c.id, c.email, n_orders, CAST(n_products AS BIGINT) AS n_products, newest_order,
               CAST(total AS DOUBLE) AS total
        FROM customers c JOIN latest ON customer_id = c.id
        WHERE c.id IN (SELECT customer_id FROM shop_orders WHERE status = 'P')""",
    "order_product_rows": with_tables(SHOP_ORDERS, PRODUCTS)
    + """ SELECT o.id, o.customer_id, p.sku, CAST(p.quantity AS BIGINT) AS quantity,
               CAST(p.price AS DOUBLE) AS price
        FROM shop_orders o JOIN products p ON p.order_id = o.id""",
    "landed_orders_rejects": """
        SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 0.5 ELSE o_orderkey END::DOUBLE AS id,
               concat_ws('; ', CASE WHEN o_orderkey % 11 = 0 THEN 'id: whole' END,
                         CASE WHEN o_orderkey % 13 = 0 THEN 'date_created: time' END) AS problems,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total
        FROM orders""",
    "landed_carts_rejects": """
        SELECT o_orderkey AS n,
               concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'id: string' END,
                         CASE WHEN o_orderkey % 5 = 0 THEN 'line_items: object' END) AS problems
        FROM orders WHERE o_orderstatus = 'O'""",
    "orders_newest_top": """
        SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
        FROM orders WHERE o_custkey > 0 QUALIFY place <= 100""",
    "search_with_recent_orders": with_tables(CUSTOMERS, SHOP_ORDERS, PRODUCTS)
    + """, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY customer_id
                                       ORDER BY date_created DESC, id DESC) AS rn
          FROM shop_orders WHERE customer_id > 0
        ), lines AS (SELECT order_id, count(*) AS n FROM products GROUP BY order_id),
        latest AS (
          SELECT customer_id, count(*) AS n_orders, sum(coalesce(n, 0)) AS n_products,
                 max(CASE WHEN rn = 1 THEN id END) AS newest_order, sum(total) AS total
          FROM ranked LEFT JOIN lines ON order_id = id WHERE rn <= 10 GROUP BY customer_id
        )
        SELECT c.id, c.email, coalesce(n_orders, 0) AS n_orders,
               CAST(coalesce(n_products, 0) AS BIGINT) AS n_products, newest_order,
               CAST(coalesce(total, 0) AS DOUBLE) AS total
        FROM customers c LEFT JOIN latest ON customer_id = c.id
        WHERE contains(lower(c.company), 'machin')""",
    "customers_by_email": with_tables(CUSTOMERS)
    + """, shared AS (
          SELECT * REPLACE ('group' || CAST(id % 700 AS VARCHAR) || '@example.com' AS email),
                 row_number() OVER (PARTITION BY id % 700 ORDER BY id) AS rn
          FROM customers
        )
        SELECT s.id, a.email, s.first_name, s.last_name, s.phone, s.company,
               s.customer_group_id, s.registration_ip
        FROM (SELECT DISTINCT 'group' || CAST(o_custkey % 1000 AS VARCHAR) || '@example.com'
                     AS email FROM orders) a
        LEFT JOIN shared s ON s.email = a.email AND s.rn = 1""",
    "customer_by_order": with_tables(CUSTOMERS)
    + """ SELECT o_orderkey AS order_id, id, email, country
        FROM orders JOIN customers ON id = o_custkey
        WHERE o_custkey > 0
          AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "guest_orders": """
        SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status,
               strftime(o_orderdate, '%Y-%m-%d') AS date_created
        FROM orders WHERE coalesce(o_custkey, 0) <= 0""",
    "orders_newest_first": """
        SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status,
               strftime(o_orderdate, '%Y-%m-%d') AS date_created
        FROM orders WHERE o_custkey > 0
        ORDER BY o_orderdate DESC, o_orderkey DESC""",
    "recent_orders_top10": """
        SELECT customer_id, id, recency, date_created, total FROM (
          SELECT o_custkey AS customer_id, o_orderkey AS id,
                 row_number() OVER (PARTITION BY o_custkey
                                    ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency,
                 strftime(o_orderdate, '%Y-%m-%d') AS date_created, o_totalprice AS total
          FROM orders WHERE o_custkey > 0
        ) WHERE recency <= 10""",
    "orders_by_email": with_tables(CUSTOMERS, SHOP_ORDERS, PRODUCTS)
    + """, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY email
                                       ORDER BY date_created DESC, id DESC) AS recency
          FROM shop_orders
          WHERE email IN (SELECT email FROM customers WHERE company = 'BUILDING')
        )
        SELECT email, id, recency, count(order_id) AS n_products
        FROM ranked LEFT JOIN products ON order_id = id
        WHERE recency <= 10 GROUP BY email, id, recency""",
    "orders_with_products": with_tables(PRODUCTS)
    + """ SELECT o_orderkey AS id, count(order_id) AS n_products,
               CAST(coalesce(sum(quantity), 0) AS DOUBLE) AS quantity,
               CAST(coalesce(sum(price), 0) AS DOUBLE) AS price, min(sku) AS first_sku
        FROM orders LEFT JOIN products ON order_id = o_orderkey GROUP BY o_orderkey""",
    "order_fees": with_tables(FEES)
    + """ SELECT order_id, name, type, CAST(amount AS DOUBLE) AS amount,
               CAST(tax AS DOUBLE) AS tax
        FROM fees JOIN orders ON o_orderkey = order_id""",
    "orders_with_fees": with_tables(FEES)
    + """ SELECT o_orderkey AS id, count(order_id) AS n_fees,
               CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount
        FROM orders LEFT JOIN fees ON order_id = o_orderkey GROUP BY o_orderkey""",
    "carts_by_order": with_tables(SHOP_ORDERS, CARTS)
    + """, asked AS (
          SELECT DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_orderkey
                               ELSE o_orderkey END AS order_id FROM orders
        )
        SELECT a.order_id, o.cart_id,
               CASE WHEN c.id IS NOT NULL THEN 'found' WHEN o.id IS NULL THEN 'order not found'
                    WHEN o.cart_id IS NULL THEN 'order has no cart' ELSE 'cart gone' END AS outcome,
               c.customer_id AS cart_customer_id
        FROM asked a LEFT JOIN shop_orders o ON o.id = a.order_id
        LEFT JOIN carts c ON c.id = o.cart_id""",
    "carts_mixed_keys": with_tables(SHOP_ORDERS, CARTS)
    + """, asked AS (
          SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR)
                      WHEN o_orderkey % 3 = 1 THEN 'cart-' || CAST(o_orderkey AS VARCHAR)
                      ELSE '9999999999' || CAST(o_orderkey AS VARCHAR) || '0000000000' END AS key,
                 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS order_id,
                 CASE WHEN o_orderkey % 3 = 1 THEN 'cart-' || CAST(o_orderkey AS VARCHAR) END
                   AS direct
          FROM orders
        ), resolved AS (
          SELECT a.key, a.direct, o.id AS order_id, coalesce(a.direct, o.cart_id) AS cart_id
          FROM asked a LEFT JOIN shop_orders o ON o.id = a.order_id
        )
        SELECT r.key, r.cart_id,
               CASE WHEN c.id IS NOT NULL THEN 'found'
                    WHEN r.order_id IS NULL AND r.direct IS NULL THEN 'order not found'
                    WHEN r.cart_id IS NULL THEN 'order has no cart' ELSE 'cart gone' END AS outcome,
               c.customer_id AS cart_customer_id,
               CASE WHEN c.id IS NOT NULL THEN CAST(1 AS BIGINT) END AS n_items
        FROM resolved r LEFT JOIN carts c ON c.id = r.cart_id""",
    "field_catalog_summary": with_tables(CATALOG)
    + " SELECT name, type, raw_type, options, built_in, required FROM catalog",
    "field_registry_build": with_tables(CATALOG)
    + " SELECT name, type, options, true AS saved_once FROM catalog WHERE NOT built_in",
    "registry_violations": """
        SELECT name, type, problem FROM (
          SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'empty name'
                         WHEN type = 'bogus' THEN 'unknown type' END AS problem
          FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN NULL
                            ELSE p_name || CAST(p_partkey AS VARCHAR) END AS name,
                       CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'date'
                            WHEN 2 THEN 'bogus' END AS type
                FROM part)
        ) WHERE problem IS NOT NULL""",
    "field_discovery": with_tables(VALS)
    + """, counts AS (
          SELECT name, count(*) AS rows, count(DISTINCT customer_id) AS customers,
                 count(DISTINCT value) AS distinct_values FROM vals GROUP BY name
        ), firsts AS (
          SELECT name, string_agg(value, '|' ORDER BY value) AS samples FROM (
            SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) AS rn
            FROM (SELECT DISTINCT name, value FROM vals WHERE value IS NOT NULL)
          ) WHERE rn <= 3 GROUP BY name
        )
        SELECT c.name, c.rows, c.customers, c.distinct_values, coalesce(samples, '') AS samples
        FROM counts c LEFT JOIN firsts f ON f.name = c.name""",
    "field_values_pivot": with_tables(VALS)
    + """, firsts AS (
          SELECT *, row_number() OVER (PARTITION BY customer_id, name ORDER BY seq) AS rn
          FROM vals WHERE name IN ('click', 'view', 'purchase')
        )
        SELECT customer_id, max(CASE WHEN name = 'click' THEN value END) AS click,
               max(CASE WHEN name = 'view' THEN value END) AS view,
               max(CASE WHEN name = 'purchase' THEN value END) AS purchase
        FROM firsts WHERE rn = 1 GROUP BY customer_id""",
    "field_value_violations": with_tables(VALS)
    + """ SELECT seq, customer_id, name, value,
               CASE WHEN name = 'purchase' THEN 'value not allowed' ELSE 'unknown field' END
                 AS violation
        FROM vals
        WHERE name NOT IN ('click', 'view', 'purchase', 'signup')
           OR (name = 'purchase'
               AND coalesce(value NOT IN (SELECT CAST(i AS VARCHAR) FROM range(50) t(i)), true))""",
    "field_values_current": with_tables(VALS)
    + """ SELECT customer_id, name, value, seq FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_id, name
                                       ORDER BY ts DESC, seq DESC) AS rn FROM vals
        ) WHERE rn = 1""",
    "field_values_upsert": with_tables(VALS, TEXT_IDS)
    + """, ranked AS (
          SELECT customer_id, name, value,
                 row_number() OVER (PARTITION BY customer_id, name
                                    ORDER BY seq % 2 DESC, ts DESC, seq DESC) AS rn
          FROM given WHERE seq % 2 = 0 OR usable
        )
        SELECT customer_id, name, value FROM ranked WHERE rn = 1""",
    "field_value_rejects": with_tables(VALS, TEXT_IDS)
    + " SELECT seq, text_id AS customer_id, name, value FROM given WHERE NOT usable",
    "customers_masked": with_tables(CUSTOMERS)
    + """ SELECT id,
          substr(split_part(email, '@', 1), 1, 2)
            || repeat('*', greatest(0, length(split_part(email, '@', 1)) - 2)) || '@'
            || substr(split_part(email, '@', 2), 1, 2)
            || repeat('*', greatest(0, length(split_part(email, '@', 2)) - 2)) AS email,
          CASE WHEN length(phone) <= 8 THEN '****'
               ELSE substr(phone, 1, 4) || '...' || substr(phone, length(phone) - 3) END AS phone,
          CASE WHEN length(registration_ip) <= 8 THEN '****'
               ELSE substr(registration_ip, 1, 4) || '...'
                    || substr(registration_ip, length(registration_ip) - 3) END AS registration_ip
        FROM customers""",
    "part_slugs": """
        SELECT p_partkey,
          regexp_replace(regexp_replace(lower(' --' || upper(p_name) || '!! ' || p_brand || ' '),
                         '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') AS slug,
          p_size % 3 = 0 AS flag_true, p_partkey % 2 <> 0 AS zero_true
        FROM part""",
    "run_status": """
        WITH states AS (
          SELECT o_orderkey AS n, o_orderdate, o_orderkey % 7 AS collected,
                 CASE WHEN o_orderstatus = 'F' THEN least(o_orderkey % 7, o_orderkey % 3)
                      ELSE 0 END AS done,
                 o_orderstatus = 'P' AS has_cursor
          FROM orders
        )
        SELECT 'run-' || CAST(n AS VARCHAR) AS key,
               CASE WHEN done > 0 THEN 'fetching customers (phase 2)'
                    WHEN collected > 0 AND NOT has_cursor THEN 'ready for phase 2'
                    ELSE 'collecting IDs (phase 1)' END AS phase,
               CASE WHEN done > 0 THEN CAST(round(100.0 * done / collected) AS BIGINT) END
                 AS percent,
               n % 11 AS page_num, collected, strftime(o_orderdate, '%Y-%m-%d') AS mtime
        FROM states""",
    "landed_customers": with_tables(CUSTOMERS)
    + """ SELECT CAST(id AS VARCHAR) AS "ID", email AS "Email", first_name AS "First",
               country AS "Country", CAST(customer_group_id AS VARCHAR) AS "Zip",
               region AS "Region" FROM customers""",
    "landed_customers_rejects": """
        SELECT c_custkey AS id,
               CASE c_custkey % 50 WHEN 0 THEN 'email: string' WHEN 1 THEN 'addresses: array'
                    ELSE '' END AS problems
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "landed_field_values": with_tables(VALS)
    + """ SELECT customer_id, name, value, count(*) AS rows FROM vals
        GROUP BY customer_id, name, value""",
    "landed_orders": with_tables(SHOP_ORDERS)
    + """ SELECT id, customer_id, email, cart_id, status,
               strftime(date_created, '%Y-%m-%d') AS date_created FROM shop_orders""",
    "landed_order_products": with_tables(PRODUCTS)
    + """ SELECT order_id, count(*) AS n_products, CAST(sum(quantity) AS BIGINT) AS quantity,
               CAST(sum(price) AS DOUBLE) AS price FROM products GROUP BY order_id""",
    "landed_order_fees": with_tables(FEES)
    + """ SELECT order_id, name, type, count(*) AS n_fees, CAST(sum(tax) AS DOUBLE) AS tax
        FROM fees GROUP BY order_id, name, type""",
    "landed_carts": with_tables(CARTS)
    + """ SELECT id, customer_id, strftime(created_time, '%Y-%m-%d') AS created_time,
               'O-' || CAST(o_orderkey AS VARCHAR) AS sku, CAST(1 AS BIGINT) AS n_items
        FROM carts""",
    "csv_round_trip": with_tables(CUSTOMERS)
    + """ SELECT CAST(id AS VARCHAR) AS "Customer ID",
               'Said "' || email || '",' || chr(10) || 'then \\ left ' AS "Note",
               CASE WHEN id % 3 = 0 THEN '' ELSE company END AS "Company" FROM customers""",
    "csv_column_values": """
        SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS "Customer ID"
        FROM orders WHERE o_custkey % 4 <> 0""",
    "feed_segment_resume": with_tables(VALS, SEGMENT) + " SELECT id FROM segment",
    "feed_incremental_export": with_tables(CUSTOMERS, VALS, SEGMENT)
    + """ SELECT CAST(id AS VARCHAR) AS "Customer ID", email AS "Email"
        FROM customers WHERE id IN (SELECT id FROM segment)""",
    "feed_values_current": with_tables(VALS)
    + """ SELECT customer_id, name, value FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_id, name
                                       ORDER BY ts DESC, seq DESC) AS rn
          FROM vals WHERE customer_id > 0
        ) WHERE rn = 1""",
    "feed_segment_two_fields": with_tables(VALS)
    + """ SELECT DISTINCT name AS field, customer_id AS id FROM vals
        WHERE customer_id > 0
          AND ((name = 'purchase' AND value = '7') OR (name = 'click' AND value = '3'))""",
    "feed_export_new_checkpoint": with_tables(CUSTOMERS, VALS, SEGMENT)
    + """ SELECT CAST(id AS VARCHAR) AS "Customer ID", email AS "Email"
        FROM customers WHERE id IN (SELECT id FROM segment)""",
    "feed_values_two_sources": with_tables(VALS)
    + """ SELECT customer_id, name, value FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_id, name
                                       ORDER BY ts DESC, seq DESC) AS rn
          FROM vals WHERE customer_id > 0
        ) WHERE rn = 1""",
    "export_increment_custom_id": with_tables(CUSTOMERS, VALS, SEGMENT)
    + """ SELECT CAST(id AS VARCHAR) AS "Customer ID", phone AS "Phone",
               CAST(0 AS BIGINT) AS new_in_third
        FROM customers WHERE id IN (SELECT id FROM segment)""",
    "registry_file": """
        SELECT 'part ' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'number' END AS type,
               CASE WHEN p_size % 3 = 0 THEN p_brand || '|' || p_type END AS options,
               CAST(0 AS BIGINT) AS position
        FROM part""",
    "stored_segment_export": with_tables(CUSTOMERS, VALS, SEGMENT)
    + f" SELECT {EXPORT_CELLS} FROM customers WHERE id IN (SELECT id FROM segment)",
    "stored_values_by_field": with_tables(VALS)
    + """ SELECT name, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers FROM vals GROUP BY name
        UNION ALL
        SELECT name || ' alone', count(*), count(DISTINCT customer_id) FROM vals
        WHERE name = 'purchase' GROUP BY name""",
    "stored_orders_latest": with_tables(SHOP_ORDERS)
    + """ SELECT id, customer_id, status || CASE WHEN id % 6 = 0 THEN '3' WHEN id % 3 = 0 THEN '2' ELSE '1' END AS status
        FROM shop_orders""",
    "stored_products_replaced": with_tables(PRODUCTS)
    + """ SELECT order_id, CASE WHEN order_id % 4 = 0 THEN 1 ELSE count(*) END AS n_products,
          CAST(CASE WHEN order_id % 4 = 0 THEN 1 ELSE sum(quantity) END AS BIGINT) AS quantity, min(sku) AS first_sku
        FROM products GROUP BY order_id""",
    "stored_rejects": with_tables(VALS)
    + """ SELECT CAST(customer_id + CASE WHEN seq % 9 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS customer_id,
          concat_ws('; ', CASE WHEN seq % 7 = 0 THEN 'name: string' END,
                    CASE WHEN seq % 9 = 0 THEN 'customer_id: whole' END) AS problems, count(*) AS n_rows
        FROM vals GROUP BY ALL""",
    "values_vacuumed": with_tables(VALS)
    + """ SELECT customer_id, name, value, CAST(2 AS BIGINT) AS n_deleted FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_id, name
                                       ORDER BY ts DESC, seq DESC) AS rn
          FROM vals WHERE customer_id > 0
        ) WHERE rn = 1""",
    "export_ledger": with_tables(CUSTOMERS, VALS)
    + """ SELECT id, CASE min(seq % 3) WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS run
        FROM customers JOIN vals ON customer_id = id
        WHERE name = 'purchase' AND value = '7' AND id > 0 GROUP BY id""",
}

ORACLES["export_ledger_folded"] = ORACLES["export_ledger"]
