"""Fixed values for reading and classifying page elements."""

# Element type -> (signal kind, pattern, weight). Order decides ties.
ELEMENT_PATTERNS = {
    "cta": [
        ("tag", "button", 0.6), ("role", "button", 0.8), ("class", "cta", 0.9),
        ("class", "btn-primary", 0.85), ("class", "btn-cta", 0.9), ("attr", "data-cta", 0.95),
        ("tag", "a", 0.3), ("class", "button", 0.7),
        ("text", "buy|order|subscribe|sign up|get started|try free|add to cart", 0.8),
    ],
    "form": [
        ("tag", "form", 0.9), ("tag", "input", 0.7), ("tag", "select", 0.7), ("tag", "textarea", 0.7),
        ("role", "textbox", 0.8), ("role", "combobox", 0.8), ("class", "form", 0.6),
        ("class", "input", 0.5), ("attr", "data-form", 0.9),
    ],
    "trust": [
        ("class", "trust", 0.8), ("class", "badge", 0.6), ("class", "testimonial", 0.85),
        ("class", "review", 0.8), ("class", "rating", 0.8), ("class", "guarantee", 0.85),
        ("class", "secure", 0.7), ("class", "certification", 0.8), ("class", "partner", 0.6),
        ("class", "client", 0.5), ("class", "logo", 0.4), ("attr", "data-trust", 0.9),
        ("text", "trusted by|verified|certified|secure|guarantee|money back", 0.7),
    ],
    "value_prop": [
        ("tag", "h1", 0.7), ("class", "hero", 0.85), ("class", "headline", 0.8),
        ("class", "tagline", 0.8), ("class", "value-prop", 0.9), ("class", "benefit", 0.75),
        ("class", "feature", 0.6), ("class", "usp", 0.85), ("attr", "data-value-prop", 0.95),
    ],
    "navigation": [
        ("tag", "nav", 0.9), ("role", "navigation", 0.95), ("class", "nav", 0.7),
        ("class", "menu", 0.7), ("class", "breadcrumb", 0.85), ("class", "header", 0.5),
        ("class", "footer", 0.4), ("class", "sidebar", 0.5), ("attr", "data-nav", 0.9),
    ],
    "price": [
        ("class", "price", 0.9), ("class", "cost", 0.8), ("class", "amount", 0.7),
        ("class", "product-price", 0.9), ("class", "sale-price", 0.9), ("class", "regular-price", 0.85),
        ("attr", "data-price", 0.95), ("attr", "itemprop=price", 0.95),
        ("text", "₹|$|€|£|¥|usd|inr|eur|gbp", 0.6),
    ],
    "variant": [
        ("class", "swatch", 0.9), ("class", "variant", 0.85), ("class", "size-selector", 0.9),
        ("class", "color-selector", 0.9), ("class", "size-option", 0.85), ("class", "color-option", 0.85),
        ("role", "radiogroup", 0.7), ("role", "listbox", 0.6),
    ],
    "stock": [
        ("class", "stock", 0.9), ("class", "availability", 0.85), ("class", "inventory", 0.8),
        ("class", "in-stock", 0.9), ("class", "out-of-stock", 0.9), ("class", "sold-out", 0.9),
        ("text", "in stock|out of stock|available|sold out|limited", 0.8),
    ],
    "shipping": [
        ("class", "shipping", 0.9), ("class", "delivery", 0.85), ("class", "fulfillment", 0.8),
        ("class", "shipping-info", 0.9), ("class", "delivery-info", 0.9),
        ("text", "free shipping|free delivery|ships|arrives|delivery by", 0.7),
    ],
    "gallery": [
        ("class", "gallery", 0.9), ("class", "product-image", 0.85), ("class", "product-gallery", 0.9),
        ("class", "carousel", 0.7), ("class", "thumbnail", 0.8), ("class", "image-gallery", 0.9),
        ("class", "product-images", 0.9),
    ],
}
ELEMENT_TYPES = list(ELEMENT_PATTERNS)
MIN_TYPE_CONFIDENCE = 0.5

# Which tags and roles take input, and which subtrees are never read.
INTERACTIVE_TAGS = ["button", "a", "input", "select", "textarea", "summary", "details"]
INTERACTIVE_ROLES = [
    "button", "link", "checkbox", "radio", "textbox", "combobox",
    "listbox", "menuitem", "tab", "switch", "slider",
]
SKIP_TAGS = [
    "script", "style", "noscript", "meta", "link", "svg", "path",
    "defs", "clippath", "symbol", "use", "br", "hr", "wbr",
]
KEPT_ATTRIBUTES = [
    "class", "id", "role", "href", "type", "name", "placeholder", "aria-label", "data-testid",
]
MAX_TEXT = 100

# Meaning -> tags and roles that carry it.
SEMANTIC_TAGS = {
    "button": (["button"], ["button"]),
    "link": (["a"], ["link"]),
    "input": (["input", "textarea"], ["textbox", "searchbox"]),
    "select": (["select"], ["combobox", "listbox"]),
    "navigation": (["nav"], ["navigation"]),
    "form": (["form"], ["form"]),
    "heading": (["h1", "h2", "h3", "h4", "h5", "h6"], ["heading"]),
    "image": (["img", "picture"], ["img"]),
    "list": (["ul", "ol"], ["list"]),
}

# Intent -> words that express it. An intent not listed stands for itself.
INTENT_WORDS = {
    "cta": ["cta", "call to action", "action"],
    "button": ["button", "btn"],
    "nav": ["nav", "navigation", "menu"],
    "form": ["form", "input", "field"],
    "trust": ["trust", "secure", "safe", "verified", "certified"],
    "cart": ["cart", "basket", "bag", "add to cart", "add to bag"],
    "buy": ["buy", "purchase", "order", "checkout"],
    "signup": ["sign up", "signup", "register", "create account", "join"],
    "login": ["log in", "login", "sign in", "signin"],
}

# Type -> (meanings, class words, text words, tags, attributes). Order decides ties.
SEMANTIC_PATTERNS = {
    "cta": (
        ["button"], ["cta", "btn", "button", "action"],
        ["buy", "order", "subscribe", "sign up", "get started", "try", "add to cart", "add to bag", "checkout"],
        ["button"], ["data-cta", "data-action"],
    ),
    "form": (
        ["form", "input", "select"], ["form", "field", "input"], [],
        ["form", "input", "select", "textarea"], ["data-form"],
    ),
    "trust": (
        [], ["trust", "badge", "testimonial", "review", "rating", "guarantee", "secure", "certification"],
        ["trusted", "verified", "certified", "secure", "guarantee", "money back", "star", "review"],
        [], ["data-trust", "data-rating"],
    ),
    "value_prop": (
        ["heading"], ["hero", "headline", "tagline", "value-prop", "benefit", "usp"], [],
        ["h1", "h2"], ["data-value-prop"],
    ),
    "navigation": (
        ["navigation"], ["nav", "menu", "breadcrumb", "header", "footer", "sidebar"], [],
        ["nav"], ["data-nav"],
    ),
    "price": ([], ["price", "cost", "amount", "sale"], [], [], ["data-price", "itemprop=price"]),
    "product_image": (
        ["image"], ["product-image", "gallery", "product-photo", "main-image"], [],
        ["img"], ["data-product-image"],
    ),
    "variant_selector": (
        ["select"], ["variant", "option", "size", "color", "swatch"], ["size", "color", "quantity"],
        ["select"], ["data-variant", "data-option"],
    ),
}

# Crop categories -> element types they show.
CROP_TYPES = {
    "cta": ["cta"],
    "forms": ["form"],
    "trust": ["trust"],
    "value_prop": ["value_prop"],
    "navigation": ["navigation"],
    "pricing": ["cta", "value_prop"],
    "reviews": ["trust"],
    "layout": ["cta", "form", "trust", "value_prop", "navigation"],
    "imagery": ["value_prop", "cta"],
    "friction": ["form", "cta", "navigation"],
    "utility": ["cta", "navigation"],
}
