"""Fixed values for consent banners and other interface noise."""

# Consent platform -> selectors that reveal it, by prevalence.
CONSENT_PLATFORMS = [
    ("onetrust", ["#onetrust-consent-sdk", "#onetrust-banner-sdk"]),
    ("cookiebot", ["#CybotCookiebotDialog", "#CookiebotWidget"]),
    ("usercentrics", ["#usercentrics-root", "[data-usercentrics-cmp]"]),
    ("trustarc", ["#truste-consent-track", "#teconsent"]),
    ("quantcast", [".qc-cmp-ui-container", "#qc-cmp2-ui"]),
    ("didomi", ["#didomi-host", ".didomi-popup"]),
    ("osano", [".osano-cm-window", ".osano-cm-dialog"]),
    ("consent-manager", [".consent-manager", "#consent-manager"]),
    ("alpine-tailwind", ['[x-data*="consent"]', '[x-data*="cookie"]']),
    ("aria-cookie-banner", ['[aria-label*="cookie" i]', '[role="region"][aria-label*="cookie" i]',
                            '[aria-label*="cookie banner" i]']),
    ("fixed-cookie-banner", ['.fixed[class*="cookie"]', '.fixed.bottom-0[class*="cookie"]',
                             '.fixed.bottom-0[class*="consent"]']),
    ("shopify-cookies", [".cookies", "div.cookies", "section.cookies"]),
]

# Container signs and labelled banners.
COOKIE_CONTAINERS = [
    ".cookies", ".cookie-banner", ".consent-banner", ".privacy-banner", "#cookie-notice",
    "#consent-notice", '[class*="cookie"]', '[class*="consent"]', '[class*="gdpr"]',
    '[class*="privacy"]', '[id*="cookie"]', '[id*="consent"]', '[id*="gdpr"]', '[id*="privacy"]',
    "[data-cookie]", "[data-consent]", "[data-gdpr]",
]
COOKIE_BANNERS = [
    '[role="region"][aria-label*="cookie" i]', '[aria-label*="cookie banner" i]',
    '[aria-label*="cookie" i][role="dialog"]', '[aria-label*="consent" i][role="dialog"]',
]

# Words of an accept button, and words that rule a button out.
ACCEPT_WORDS = ["accept", "allow", "agree", "ok", "got it", "continue", "save"]
NOT_ACCEPT_WORDS = [
    "facebook", "google", "twitter", "apple", "linkedin", "instagram", "github", "microsoft", "amazon",
    "login", "log in", "sign in", "sign up", "register", "create account", "subscribe", "newsletter",
    "save 10", "save 15", "save 20", "% off", "discount", "promo", "coupon", "get offer", "claim",
    "unlock", "checkout", "buy now", "add to cart", "add to bag", "purchase", "shop now", "order now",
]

# Noise family -> selectors.
NOISE_SELECTORS = {
    "cookie-banners": [
        "#cookie-banner", "#cookie-consent", "#cookie-notice", "#cookie-popup", "#gdpr-banner",
        "#gdpr-consent", "#consent-banner", "#onetrust-consent-sdk", "#onetrust-banner-sdk",
        "#CybotCookiebotDialog", "#cookiescript_injected", "#sp-cc", ".cookie-banner",
        ".cookie-consent", ".cookie-notice", ".cookie-popup", ".gdpr-banner", ".consent-banner",
        ".cc-banner", ".cc-window", '[class*="cookie-consent"]', '[class*="cookie-banner"]',
        '[class*="gdpr-consent"]', '[data-testid*="cookie"]', '[aria-label*="cookie"]',
    ],
    "chat-widgets": [
        "#intercom-container", "#intercom-frame", "#drift-widget", "#drift-frame",
        "#hubspot-messages-iframe-container", "#tidio-chat", "#crisp-chatbox", "#ze-snippet",
        "#launcher", "#chat-widget", "#livechat-compact-container", "#fb-messenger-button",
        ".intercom-launcher", ".intercom-app", ".drift-widget", ".drift-frame-controller",
        ".freshdesk-widget", ".tawk-widget", ".zopim", ".olark-chat-button", '[class*="chat-widget"]',
        '[class*="livechat"]', 'iframe[src*="intercom"]', 'iframe[src*="drift"]',
        'iframe[src*="hubspot"]', 'iframe[src*="tidio"]', 'iframe[src*="crisp"]', 'iframe[src*="zendesk"]',
    ],
    "promo-bars": [
        ".promo-bar", ".promo-banner", ".announcement-bar", ".header-banner", ".notification-bar",
        ".top-bar", ".sticky-banner", ".promotion-bar", ".sale-banner", ".discount-banner",
        '[class*="promo-bar"]', '[class*="announcement"]',
        '[style*="position: fixed"][style*="top: 0"]', '[style*="position: sticky"][style*="top: 0"]',
    ],
    "newsletter-modals": [
        "#newsletter-modal", "#newsletter-popup", "#signup-modal", "#subscribe-modal", "#email-popup",
        "#klaviyo-popup", "#privy-popup", "#optinmonster-popup", ".newsletter-modal",
        ".newsletter-popup", ".signup-modal", ".subscribe-popup", ".email-capture", ".lead-capture",
        ".popup-modal", ".klaviyo-popup", ".privy-popup", ".optinmonster",
        '[class*="newsletter-popup"]', '[class*="email-signup"]', '[class*="exit-intent"]',
    ],
    "interstitials": [
        "#overlay", "#modal-overlay", "#popup-overlay", "#lightbox-overlay", ".modal-overlay",
        ".popup-overlay", ".lightbox-overlay", ".page-overlay", ".interstitial", ".splash-screen",
        ".loading-overlay", '[class*="overlay"][class*="modal"]',
        '[style*="position: fixed"][style*="z-index"][style*="background"]',
    ],
}

# Signs of a page still loading.
PLACEHOLDER_SOURCE = r"(?i)placeholder|loading|spinner|lazy|blank|data:image/gif|data:image/png;base64,ivbor|1x1|pixel"
SPINNERS = [
    ".spinner", ".loading-spinner", ".loader", ".loading", '[class*="spin"]', '[class*="loader"]',
    ".fa-spinner", ".fa-spin", '[role="progressbar"]', ".progress-circular", ".circular-progress",
    ".MuiCircularProgress-root", ".ant-spin",
]
SKELETONS = [
    ".skeleton", ".shimmer", ".placeholder", '[class*="skeleton"]', '[class*="shimmer"]',
    ".loading-placeholder", ".content-placeholder", ".MuiSkeleton-root", ".ant-skeleton",
    ".react-loading-skeleton",
]
OVERLAYS = [
    ".modal", ".popup", ".overlay", ".dialog", '[role="dialog"]', '[aria-modal="true"]',
    ".cookie-banner", ".cookie-consent", ".gdpr", ".newsletter-popup", ".promo-modal",
    "#onetrust-banner-sdk", ".interstitial",
]
BLOCKING_OVERLAYS = [".modal", '[role="dialog"]', ".overlay"]
PLACEHOLDER_TEXT = r"(?i)^(loading\.{0,3}|please wait\.{0,3}|-{2,}|\.{3,}|\$-{1,}|tbd|n/a|coming soon)$"
PLACEHOLDER_TEXT_HOLDERS = [
    ".price", ".product-price", '[class*="price"]', ".stock", ".availability", "h1", "h2",
    ".product-title", ".product-name",
]
