"""Derived tables: one SELECT each over the given tables, in SQL that Spark and DuckDB both accept.

They stand in for what a crawl, a renderer or a model would supply, and are the inputs of operators
that plain HTML cannot feed. ``{name}`` is a given table or an earlier derived one.
"""

INSIGHTS = """
SELECT o_custkey AS page_id, o_orderkey AS seq,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' WHEN o_orderpriority LIKE '2%' THEN 'high'
      WHEN o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS severity,
 CASE o_orderkey % 7 WHEN 0 THEN 'cta' WHEN 1 THEN 'form' WHEN 2 THEN 'trust' WHEN 3 THEN 'value_prop'
      WHEN 4 THEN 'navigation' WHEN 5 THEN 'friction' ELSE 'heuristic' END AS category,
 CASE o_orderkey % 5 WHEN 0 THEN 'no_trust_above_fold' WHEN 1 THEN 'form_field_overload' WHEN 2 THEN 'no_security_badge'
      WHEN 3 THEN 'Weak_cta_text ' ELSE 'no_search' END AS type,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('/html/body/div[', CAST(o_orderkey % 3 AS VARCHAR(20)), ']') END AS element,
 CASE WHEN o_orderkey % 13 = 0 THEN 'short' ELSE concat('Shoppers may not trust checkout step ', CAST(o_orderkey % 9 AS VARCHAR(20))) END AS issue,
 concat('Move it up for segment ', o_orderpriority) AS recommendation,
 CASE WHEN o_orderkey % 4 = 0 THEN concat('PDP-CTA-00', CAST(o_orderkey % 3 + 1 AS VARCHAR(20))) END AS heuristic_id,
 CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 103 AS DOUBLE) / 100 END AS confidence,
 CASE WHEN o_orderkey % 6 <> 0 THEN concat('seen ', CAST(o_orderkey % 5 AS VARCHAR(20))) END AS evidence_text,
 CASE WHEN o_orderkey % 3 = 0 THEN concat('#s', CAST(o_orderkey % 8 AS VARCHAR(20))) END AS evidence_selector,
 CASE o_orderkey % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'heuristic' ELSE 'vision' END AS source,
 CASE WHEN o_orderkey % 8 = 1 THEN concat('shot-', CAST(o_orderkey % 12 AS VARCHAR(20)), '.png') END AS evidence_screenshot,
 CASE o_orderkey % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'font-size' WHEN 2 THEN 'z-index' END AS style_name,
 concat('v', CAST(o_orderkey % 17 AS VARCHAR(20))) AS style_value
FROM {orders}
"""

EVALUATIONS = """
SELECT l_orderkey AS page_id, l_linenumber - 1 AS viewport_index,
 ((l_linenumber * 100000 + l_suppkey % 100000) * 10000000 + l_partkey % 10000000) * 64 + CAST(l_quantity AS BIGINT) AS seq,
 CASE WHEN l_linenumber % 2 = 0 THEN 'optimized' ELSE 'baseline' END AS run,
 concat(CASE l_partkey % 5 WHEN 0 THEN 'PDP-PRICE' WHEN 1 THEN 'PDP-CTA' WHEN 2 THEN 'PDP-SELECT' WHEN 3 THEN 'PLP-GRID' ELSE 'XXX-NEW' END,
        '-00', CAST(l_partkey % 3 + 1 AS VARCHAR(20))) AS heuristic_id,
 CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' THEN 'partial' WHEN l_linestatus = 'O' THEN 'pass' ELSE 'not_applicable' END AS status,
 CASE l_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
 CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence,
 concat('Element [v', CAST(l_linenumber - 1 AS VARCHAR(20)), '-', CAST(l_suppkey % 20 AS VARCHAR(20)), '] and [', CAST(l_partkey % 30 AS VARCHAR(20)), '] ',
        CASE WHEN l_suppkey % 3 = 0 THEN 'is missing' WHEN l_suppkey % 3 = 1 THEN 'has no clear button' ELSE 'looks fine' END) AS observation,
 CASE WHEN l_suppkey % 5 = 0 THEN concat('Issue at [', CAST(l_suppkey % 7 AS VARCHAR(20)), ']') END AS issue,
 CASE WHEN l_suppkey % 6 = 0 THEN 'Move it up' END AS recommendation
FROM {lineitem}
"""

BOXES = """
SELECT l_orderkey AS page_id, l_linenumber - 1 AS viewport_index, l_suppkey % 20 AS element_index,
 ((l_linenumber * 100000 + l_suppkey % 100000) * 10000000 + l_partkey % 10000000) * 64 + CAST(l_quantity AS BIGINT) AS seq,
 CASE l_partkey % 11 WHEN 0 THEN 'cta' WHEN 1 THEN 'form' WHEN 2 THEN 'trust' WHEN 3 THEN 'value_prop' WHEN 4 THEN 'navigation'
   WHEN 5 THEN 'price' WHEN 6 THEN 'variant' WHEN 7 THEN 'stock' WHEN 8 THEN 'shipping' WHEN 9 THEN 'gallery' END AS element_type,
 CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence,
 l_partkey % 1200 AS x, (l_linenumber - 1) * 680 + l_suppkey % 900 AS y, CAST(l_quantity AS BIGINT) * 4 AS w,
 CASE WHEN l_quantity < 5 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 2 END AS h,
 CASE l_suppkey % 6 WHEN 0 THEN 'overlay' WHEN 1 THEN 'modal' ELSE '' END AS class_attr
FROM {lineitem}
"""

VIEWPORTS = """
SELECT DISTINCT l_orderkey AS page_id, l_linenumber - 1 AS viewport_index, (l_linenumber - 1) * 680 AS scroll_y, l_linenumber % 2 = 1 AS scanned
FROM {lineitem}
"""

PAGE_FACTS = """
SELECT c_custkey AS page_id, concat('https://shop', CAST(c_nationkey AS VARCHAR(20)), '.example.com/p/', CAST(c_custkey AS VARCHAR(20))) AS url, c_name AS title,
 CASE c_custkey % 4 WHEN 0 THEN 'pdp' WHEN 1 THEN 'plp' WHEN 2 THEN 'home' ELSE 'other' END AS page_type, lower(c_mktsegment) AS business_type
FROM {customer}
"""

ACTIONS = """
SELECT user_id AS run_id, event_id, ts,
 CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'extract_text' WHEN 'purchase' THEN 'type_text' WHEN 'signup' THEN 'go_to_url' ELSE 'click' END AS tool_name,
 CASE WHEN k % 8 = 7 THEN NULL ELSE k % 6 END AS element_index,
 event_type <> 'error' AS success,
 CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN 'Timeout' ELSE 'Element not found' END END AS error,
 concat('h', CAST(k % 9 AS VARCHAR(20))) AS dom_hash,
 CASE WHEN k % 23 = 0 THEN 'about:blank' ELSE concat('https://Shop', CAST(user_id % 7 AS VARCHAR(20)), '.example.com/',
   CASE k % 5 WHEN 0 THEN 'login' WHEN 1 THEN 'cart/' WHEN 2 THEN 'product/1#top' ELSE 'product/1' END) END AS url,
 concat('Page ', CAST(k % 4 AS VARCHAR(20))) AS title,
 CASE k % 10 WHEN 0 THEN 'Please correct the form' WHEN 1 THEN 'Card invalid' WHEN 2 THEN NULL ELSE 'Welcome back' END AS ax_text,
 CAST(k % 11 AS DOUBLE) / 10 AS progress_score,
 CAST(k % 7 AS BIGINT) AS n_elements,
 k
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e
"""

SIGNALS = """
SELECT l_orderkey AS page_id, l_linenumber - 1 AS viewport_index,
 ((l_linenumber * 100000 + l_suppkey % 100000) * 10000000 + l_partkey % 10000000) * 64 + CAST(l_quantity AS BIGINT) AS seq,
 CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 5 ELSE 0 END AS INT) AS blank_images,
 CAST(CASE WHEN l_partkey % 4 = 0 THEN l_partkey % 6 ELSE 0 END AS INT) AS placeholder_images,
 CAST(CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 9 ELSE 0 END AS INT) AS lazy_pending,
 l_suppkey % 23 = 0 AS spinner, l_suppkey % 29 = 0 AS skeleton,
 CAST(CASE WHEN l_partkey % 7 = 0 THEN l_partkey % 4 ELSE 0 END AS INT) AS text_placeholders, l_suppkey % 31 = 0 AS overlay,
 l_suppkey % 7 = 0 AS media_timed_out, CAST(l_quantity AS INT) AS total_images, CAST(l_quantity AS INT) - CAST(l_quantity AS INT) % 4 AS loaded_images,
 CAST(CAST(l_quantity AS INT) % 4 AS INT) AS failed_images,
 l_suppkey % 11 <> 0 AS scroll_verified
FROM {lineitem}
"""

PRICES = """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS jsonld_price,
 CASE WHEN p_partkey % 7 <> 0 THEN concat(CASE p_partkey % 4 WHEN 0 THEN '$' WHEN 1 THEN 'EUR ' WHEN 2 THEN '£' ELSE '$ 1,' END,
   CAST(CAST(p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 200 ELSE 0 END AS DECIMAL(12,2)) AS VARCHAR(20))) END AS dom_price_text,
 CASE WHEN p_partkey % 2 = 0 THEN 'https://schema.org/InStock' WHEN p_partkey % 11 <> 0 THEN 'SoldOut' END AS jsonld_availability,
 CASE p_partkey % 3 WHEN 0 THEN 'In stock' WHEN 1 THEN 'Out of stock' END AS dom_availability
FROM {part}
"""

NODES = """
SELECT l_orderkey AS page_id, ((l_partkey * 8 + l_linenumber) * 100000 + l_suppkey % 100000) * 64 + CAST(l_quantity AS BIGINT) AS doc_pos,
 l_linenumber AS form_id, l_linenumber % 4 AS depth, l_linenumber % 5 AS list_depth,
 CASE l_partkey % 13 WHEN 0 THEN 'button' WHEN 1 THEN 'a' WHEN 2 THEN 'h1' WHEN 3 THEN 'h2' WHEN 4 THEN 'input' WHEN 5 THEN 'form'
   WHEN 6 THEN 'nav' WHEN 7 THEN 'span' WHEN 8 THEN 'label' WHEN 9 THEN 'img' WHEN 10 THEN 'select' WHEN 11 THEN 'iframe' ELSE 'div' END AS tag,
 concat('/html/body/', CASE l_suppkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'main' WHEN 2 THEN 'footer' ELSE 'div' END, '/el[', CAST(l_partkey % 50 AS VARCHAR(20)), ']') AS xpath,
 CASE l_suppkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'main' WHEN 2 THEN 'footer' ELSE 'unknown' END AS region,
 CASE l_suppkey % 19 WHEN 0 THEN 'Click here' WHEN 1 THEN 'Add to cart' WHEN 2 THEN 'Welcome' WHEN 3 THEN '' WHEN 4 THEN 'OK'
   WHEN 5 THEN 'Trusted by 500 teams, money back guarantee' WHEN 6 THEN 'In stock' WHEN 7 THEN '$49.99'
   WHEN 8 THEN 'The one platform that helps every small shop sell twice as much' WHEN 9 THEN 'Accept all cookies' WHEN 10 THEN 'Sign in with Google to continue'
   WHEN 11 THEN 'Free shipping' WHEN 12 THEN '  Home  ' WHEN 13 THEN 'Subtotal and checkout' WHEN 14 THEN 'Email (required) error'
   WHEN 15 THEN 'Add to  bag' WHEN 16 THEN 'Loading...' WHEN 17 THEN 'Buy now' ELSE 'Shipping address payment' END AS text,
 CASE l_suppkey % 23 WHEN 0 THEN 'btn-primary cta' WHEN 1 THEN 'trust-badge' WHEN 2 THEN 'hero' WHEN 3 THEN 'product-price' WHEN 4 THEN 'breadcrumb'
   WHEN 5 THEN 'cookie-banner' WHEN 6 THEN 'chat-widget' WHEN 7 THEN 'Swatch' WHEN 8 THEN 'product-card' WHEN 9 THEN 'unavailable'
   WHEN 10 THEN 'cart-item' WHEN 11 THEN 'checkout-form' WHEN 12 THEN 'product-grid filter-panel' WHEN 13 THEN 'pricing plan' WHEN 14 THEN 'promo-bar'
   WHEN 15 THEN 'newsletter-popup' WHEN 16 THEN 'fixed bottom-0 consent' WHEN 17 THEN 'modal-overlay' WHEN 18 THEN 'price' WHEN 19 THEN 'skeleton'
   WHEN 20 THEN 'cookies' ELSE '' END AS class_attr,
 CASE l_partkey % 17 WHEN 0 THEN 'add-button' WHEN 1 THEN 'onetrust-banner-sdk' WHEN 2 THEN 'cart-box' WHEN 3 THEN 'intercom-frame' WHEN 4 THEN 'size-option' ELSE '' END AS id_attr,
 CASE l_partkey % 7 WHEN 0 THEN 'button' WHEN 1 THEN 'navigation' WHEN 2 THEN 'dialog' WHEN 3 THEN 'listbox' ELSE '' END AS role_attr,
 CASE WHEN l_partkey % 13 = 4 THEN CASE l_suppkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'hidden' WHEN 2 THEN 'submit' WHEN 3 THEN 'radio' ELSE '' END ELSE '' END AS type_attr,
 CASE l_suppkey % 6 WHEN 0 THEN 'address' WHEN 1 THEN 'option-size' WHEN 2 THEN 'add' WHEN 3 THEN 'quantity' ELSE '' END AS name_attr,
 CASE l_suppkey % 7 WHEN 0 THEN '/' WHEN 1 THEN '/product/5' WHEN 2 THEN '/cart' ELSE '' END AS href_attr,
 CASE l_partkey % 9 WHEN 0 THEN 'Cookie banner' WHEN 1 THEN 'Filter items' WHEN 2 THEN 'Close' ELSE '' END AS label_attr,
 CASE l_partkey % 5 WHEN 0 THEN 'https://cdn.example.com/product.jpg' WHEN 1 THEN 'data:image/gif;base64,R0' WHEN 2 THEN 'https://widget.intercom.io/x' ELSE '' END AS src_attr,
 CASE l_partkey % 6 WHEN 0 THEN 'Your name' ELSE '' END AS placeholder_attr,
 l_partkey % 8 = 0 AS required_attr, l_partkey % 10 = 3 AS onclick_attr, l_returnflag <> 'R' AS is_visible,
 CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 900 + (l_linenumber - 1) * 400 END AS y,
 CAST(l_quantity AS BIGINT) * 4 AS w, CAST(l_quantity AS BIGINT) AS h
FROM {lineitem}
"""

URLS = """
SELECT o_orderkey AS page_id,
 concat('https://', CASE o_orderkey % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'WWW.' ELSE '' END, 'shop', CAST(o_custkey % 50 AS VARCHAR(20)), '.example.com',
  CASE o_orderkey % 12 WHEN 0 THEN '/' WHEN 1 THEN '/product/blue-shirt' WHEN 2 THEN '/category/shirts?page=2' WHEN 3 THEN '/cart' WHEN 4 THEN '/checkout'
   WHEN 5 THEN '/account/login' WHEN 6 THEN '/pricing' WHEN 7 THEN '/blog/article' WHEN 8 THEN '/insurance/quote' WHEN 9 THEN '/hotel/booking' WHEN 10 THEN '/about.html' ELSE '/index.html#top' END) AS url,
 CASE o_orderkey % 5 WHEN 0 THEN 'Add to cart, free shipping and returns, in stock, $12.50' WHEN 1 THEN 'Filter and sort by price, showing 24 results $5 - $90'
   WHEN 2 THEN 'Subtotal, proceed to checkout' WHEN 3 THEN 'Sign in or create account' ELSE 'Subscribe to our newsletter, latest article' END AS page_text,
 o_orderdate AS seen_at
FROM {orders}
"""

REPLIES = """
SELECT page_id, viewport_index, run, seq, heuristic_id,
 concat(CASE WHEN viewport_index % 2 = 0 THEN concat('```json', chr(10)) ELSE 'Here you go: ' END,
  CASE WHEN seq % 37 = 0 THEN '{{"evaluations": oops' ELSE concat(
  '{{"evaluations":[{{"heuristicId":"', heuristic_id, '","status":"', CASE status WHEN 'pass' THEN 'Passed' WHEN 'fail' THEN 'FAILED' WHEN 'partial' THEN 'partially' ELSE CASE WHEN seq % 2 = 0 THEN 'N/A' ELSE 'unsure' END END,
  '","observation":"', observation, '","confidence":', CASE WHEN viewport_index = 3 THEN '85' ELSE CAST(CAST(confidence AS DECIMAL(3,2)) AS VARCHAR(20)) END, '}}]}}') END,
  CASE WHEN viewport_index % 2 = 0 THEN concat(chr(10), '```') ELSE '' END) AS response
FROM {evaluations}
"""

JSONLD = """
SELECT p_partkey AS page_id,
 concat('<html><head><script type="application/ld+json">',
  CASE p_partkey % 4
   WHEN 0 THEN concat('{{"@type":"Product","name":"', p_name, '","sku":"S', CAST(p_partkey AS VARCHAR(20)), '","brand":{{"name":"', p_brand, '"}},"image":["https://cdn/', CAST(p_size AS VARCHAR(20)), '.jpg"],"offers":{{"price":"', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR(20)), '","priceCurrency":"USD","availability":"https://schema.org/', CASE p_partkey % 3 WHEN 0 THEN 'InStock' WHEN 1 THEN 'SoldOut' ELSE 'Discontinued' END, '"}}}}')
   WHEN 1 THEN concat('{{"@graph":[{{"@type":"WebPage","name":"x"}},{{"@type":["Product","Thing"],"name":"', p_name, '","brand":"', p_brand, '","offers":[{{"price":', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR(20)), '}},{{"price":1}}],"aggregateRating":{{"ratingValue":"4.', CAST(p_partkey % 10 AS VARCHAR(20)), '","ratingCount":', CAST(p_size AS VARCHAR(20)), '}}}}]}}')
   WHEN 2 THEN '{{"@type":"Organization","name":"Shop"}}'
   ELSE '{{"@type":"Product", broken' END,
  '</script><meta property="product:price:amount" content="', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR(20)), '"></head><body><h1>', p_name, '</h1><span class="price">$', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR(20)), '</span></body></html>') AS html
FROM {part}
"""

STEP_REPLIES = """
SELECT event_id, user_id AS run_id,
 CASE event_type
  WHEN 'click' THEN concat('```json', chr(10), '{{"thinking":"t","evaluation_previous_goal":"ok","memory":"m","next_goal":"look","action":{{"name":"click","params":{{"index":', CAST(user_id % 9 AS VARCHAR(20)), '}}}}}}', chr(10), '```')
  WHEN 'view' THEN concat('{{"candidates":[{{"toolName":"click","toolParams":{{"elementIndex":', CAST(user_id % 5 AS VARCHAR(20)), '}},"selfScore":', CAST(CAST(event_id % 15 AS DECIMAL(4,1)) / 10 AS VARCHAR(6)), '}},{{"toolName":"hover","toolParams":{{"index":1}}}},{{"toolName":"click","toolParams":{{"elementIndex":', CAST(event_id % 5 AS VARCHAR(20)), '}},"selfScore":0.4}}]}}')
  WHEN 'purchase' THEN concat('The verdict: {{"goalSatisfied":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"confidence":', CASE WHEN event_id % 3 = 0 THEN '1.5' ELSE '0.25' END, ',"reasoning":"r"}}')
  WHEN 'signup' THEN concat('{{"valid":', CASE WHEN event_id % 2 = 0 THEN 'false' ELSE 'true' END, ',"recheck":[{{"index":', CAST(event_id % 4 AS VARCHAR(20)), ',"reason":"blank"}},{{"reason":"no index"}}]}}')
  ELSE concat('I think this is a ', CASE event_id % 5 WHEN 0 THEN 'product detail' WHEN 1 THEN 'cart' WHEN 2 THEN 'checkout' WHEN 3 THEN 'login' ELSE 'plain' END, ' page',
    CASE WHEN event_id % 2 = 0 THEN concat(' {{"pageType":"', CASE event_id % 3 WHEN 0 THEN 'PDP' WHEN 1 THEN 'plp' ELSE 'nope' END, '","confidence":', CASE WHEN event_id % 4 = 0 THEN '7' ELSE '0.75' END, '}}') ELSE '' END) END AS response
FROM {events}
"""

# Derived table -> (SQL, the tables it reads).
DERIVED = {
    "insights": (INSIGHTS, ["orders"]),
    "evaluations": (EVALUATIONS, ["lineitem"]),
    "boxes": (BOXES, ["lineitem"]),
    "viewports": (VIEWPORTS, ["lineitem"]),
    "page_facts": (PAGE_FACTS, ["customer"]),
    "actions": (ACTIONS, ["events"]),
    "signals": (SIGNALS, ["lineitem"]),
    "prices": (PRICES, ["part"]),
    "nodes": (NODES, ["lineitem"]),
    "urls": (URLS, ["orders"]),
    "replies": (REPLIES, ["evaluations"]),
    "jsonld": (JSONLD, ["part"]),
    "step_replies": (STEP_REPLIES, ["events"]),
}
