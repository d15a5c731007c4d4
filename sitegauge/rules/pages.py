"""Fixed values for typing pages and businesses."""

# Page type -> (url parts, element selectors, keywords). Order decides ties.
PAGE_TYPE_SIGNALS = {
    "pdp": (
        ["/product/", "/products/", "/item/", "/p/", "/pd/", "/-p-", "/dp/", "/goods/", ".html"],
        ['[itemtype*="Product"]', "[data-product-id]", "[data-sku]", "[data-product]",
         '[class*="product-detail"]', '[class*="pdp-"]', '[class*="product-page"]',
         '[class*="add-to-cart"]', '[class*="add-to-bag"]', '[class*="buy-now"]',
         '[class*="product-gallery"]', '[class*="product-image"]', '[class*="product-price"]',
         '[class*="variant-selector"]', '[class*="size-selector"]', '[class*="color-selector"]',
         '[class*="quantity-selector"]'],
        ["add to cart", "add to bag", "buy now", "product details", "size guide", "delivery",
         "shipping", "returns", "in stock", "out of stock", "sku:", "item #"],
    ),
    "plp": (
        ["/category/", "/categories/", "/collection/", "/collections/", "/shop/", "/c/", "/browse/", "/search"],
        ['[class*="product-grid"]', '[class*="product-list"]', '[class*="product-card"]',
         '[class*="category-page"]', '[class*="collection-page"]', '[class*="filter-"]',
         '[class*="facet-"]', '[class*="sort-"]'],
        ["filter", "sort by", "showing", "products", "results", "items", "view all", "load more"],
    ),
    "cart": (
        ["/cart", "/basket", "/bag", "/shopping-cart"],
        ['[class*="cart-item"]', '[class*="basket-item"]', '[class*="cart-product"]',
         '[class*="cart-total"]', '[class*="cart-summary"]'],
        ["your cart", "your bag", "your basket", "subtotal", "checkout", "proceed to checkout", "remove item"],
    ),
    "checkout": (
        ["/checkout", "/payment", "/order", "/purchase", "/billing"],
        ['[class*="checkout-"]', '[class*="payment-"]', '[class*="billing-"]',
         '[class*="shipping-form"]', '[class*="order-summary"]'],
        ["billing address", "shipping address", "payment method", "credit card", "place order",
         "complete purchase", "order total"],
    ),
    "account": (
        ["/account", "/login", "/signin", "/sign-in", "/register", "/signup", "/my-account"],
        ['[class*="login-"]', '[class*="signin-"]', '[class*="account-"]', '[class*="register-"]',
         '[class*="auth-"]'],
        ["sign in", "log in", "create account", "register", "forgot password", "my orders", "my account"],
    ),
}
PAGE_TYPES = ["pdp", "plp", "homepage", "cart", "checkout", "account", "other"]
# Share of each signal family, in ten-thousandths, and the least score that decides.
PAGE_URL_POINTS, PAGE_ELEMENT_POINTS, PAGE_KEYWORD_POINTS, PAGE_MIN_POINTS = 4500, 3500, 2000, 5000

# Business type -> (url parts, element selectors, keywords). Order decides ties.
BUSINESS_SIGNALS = {
    "ecommerce": (
        ["/cart", "/checkout", "/product/", "/shop/", "/store/", "/buy/", "/add-to-cart"],
        ['[class*="cart"]', '[class*="basket"]', '[class*="product-price"]', '[class*="add-to-cart"]',
         '[class*="buy-now"]', "button[data-add-to-cart]", ".price", '[itemtype*="Product"]'],
        ["add to cart", "buy now", "checkout", "shopping cart", "free shipping", "in stock",
         "out of stock", "price", "discount", "sale"],
    ),
    "saas": (
        ["/pricing", "/signup", "/trial", "/demo", "/features", "/integrations"],
        ['[class*="pricing"]', '[class*="plan"]', '[class*="tier"]', '[class*="trial"]',
         '[class*="demo"]', '[class*="feature-list"]', '[class*="integration"]'],
        ["free trial", "start trial", "pricing", "per month", "per user", "enterprise", "sign up",
         "get started", "request demo", "api", "integration", "workflow"],
    ),
    "banking": (
        ["/account", "/banking", "/loan", "/mortgage", "/credit", "/deposit"],
        ['[class*="account"]', '[class*="balance"]', '[class*="transaction"]', '[class*="loan"]',
         '[class*="rate"]', '[class*="apr"]'],
        ["account", "balance", "transfer", "loan", "mortgage", "interest rate", "apr", "credit card",
         "savings", "checking", "deposit"],
    ),
    "insurance": (
        ["/quote", "/coverage", "/policy", "/claim", "/insurance"],
        ['[class*="quote"]', '[class*="premium"]', '[class*="coverage"]', '[class*="policy"]',
         '[class*="claim"]', '[class*="deductible"]'],
        ["get quote", "coverage", "premium", "policy", "claim", "deductible", "insured", "liability",
         "comprehensive", "collision"],
    ),
    "travel": (
        ["/booking", "/flight", "/hotel", "/travel", "/destination", "/vacation"],
        ['[class*="booking"]', '[class*="flight"]', '[class*="hotel"]', '[class*="destination"]',
         '[class*="travel-date"]', '[class*="room"]', '[class*="passenger"]'],
        ["book now", "flight", "hotel", "destination", "check-in", "check-out", "traveler",
         "passenger", "itinerary", "vacation"],
    ),
    "media": (
        ["/article", "/news", "/blog", "/video", "/podcast", "/subscribe"],
        ['[class*="article"]', '[class*="headline"]', '[class*="byline"]', '[class*="author"]',
         '[class*="subscribe"]', '[class*="newsletter"]', "article"],
        ["subscribe", "newsletter", "read more", "article", "author", "published", "breaking news",
         "latest", "trending"],
    ),
}
BUSINESS_TYPES = ["ecommerce", "saas", "banking", "insurance", "travel", "media", "other"]
# A tag with an attribute counts in the total of selectors but never matches.
UNMATCHED_SELECTORS = ["button[data-add-to-cart]"]
BUSINESS_URL_WEIGHT, BUSINESS_ELEMENT_WEIGHT, BUSINESS_KEYWORD_WEIGHT = 0.4, 0.35, 0.25
BUSINESS_MIN_CONFIDENCE = 0.6

HOME_PATHS = ["/", "", "/index.html", "/index.htm", "/home", "/home/"]
NAVIGATION_HOME_PATHS = ["/", "", "/index.html", "/home"]

# Url tag -> pattern over the lower-case url.
URL_SIGNALS = {
    "url_product_path": r"/(product|item|p|pd|goods)/",
    "url_product_slug": r"/products?/[a-z0-9-]+$",
    "url_variant_params": r"[?&](sku|variant|size|color)=",
    "url_category_path": r"/(category|collection|shop|catalog|c)/",
    "url_listing_params": r"[?&](page|sort|filter)=",
    "url_checkout_path": r"/(checkout|payment|order)",
    "url_cart_path": r"/(cart|basket|bag)",
    "url_landing_path": r"/(landing|lp|offer|promo|get|try|demo)",
    "url_pricing_path": r"/(pricing|plans|packages)",
    "url_homepage": r"^https?://[^/]+/?$",
}

# Page purpose -> goal of the page.
PURPOSE_GOALS = {
    "pdp": "purchase", "plp": "purchase", "homepage": "engagement", "lead_gen": "lead_capture",
    "saas_landing": "signup", "checkout": "purchase", "cart": "purchase", "category": "purchase",
    "search_results": "purchase", "unknown": "unknown",
}

# Score floor -> confidence of the product page detector.
PRODUCT_SCORE_STEPS = [(80, 0.95), (70, 0.9), (55, 0.8), (40, 0.65), (30, 0.55)]
PRODUCT_SCORE_ELSE = 0.4

# What a blocked page shows, first match wins.
BLOCKERS = [
    (r"accept\s*cookies?", "cookie_consent"),
    (r"cookie\s*consent", "cookie_consent"),
    (r"accept\s*all", "cookie_consent"),
    (r"sign\s*in\s*to\s*continue", "sign_in_wall"),
    (r"captcha|recaptcha", "captcha"),
]
ERROR_PAGE = r"(?i)/(?:login|signin|sign-in|error|404|403|unauthorized|access-denied)"
FORM_ERROR = r"(?i)\b(error|invalid|required|failed|please correct)\b"
