"""Fixed values for insights, scores and hypotheses."""

SEVERITIES = ["critical", "high", "medium", "low"]
CATEGORIES = ["cta", "form", "trust", "value_prop", "navigation", "friction", "heuristic"]
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITY_DEDUCTION = {"critical": 25, "high": 15, "medium": 5, "low": 2}
SEVERITY_PRIORITY = {"critical": 10, "high": 8, "medium": 5, "low": 2}
SEVERITY_IMPACT = {"critical": "high", "high": "high", "medium": "medium", "low": "low"}

# Category weight in the overall score, in tenths. Others count 8.
CATEGORY_WEIGHT_TENTHS = {"cta": 12, "form": 11, "trust": 10, "value_prop": 10, "navigation": 9, "custom": 8}
OTHER_WEIGHT_TENTHS = 8

# Category -> metric that a test would watch. Others use the last one.
CATEGORY_METRIC = {
    "cta": "Click-through rate (CTR)",
    "form": "Form completion rate",
    "trust": "Conversion rate",
    "value_prop": "Bounce rate",
    "navigation": "Pages per session",
    "custom": "Conversion rate",
}

# Business type -> insight types that matter most to it.
CRITICAL_TYPES = {
    "ecommerce": ["no_cta_above_fold", "no_search_ecommerce", "no_security_badge", "form_field_overload",
                  "no_trust_above_fold", "missing_add_to_cart", "checkout_friction"],
    "saas": ["vague_cta_text", "unclear_value_prop", "no_trust_above_fold", "form_field_overload",
             "missing_pricing", "no_social_proof"],
    "banking": ["no_security_badge", "no_trust_above_fold", "form_field_overload", "missing_field_label",
                "compliance_missing"],
    "insurance": ["no_security_badge", "no_trust_above_fold", "form_field_overload", "unclear_value_prop",
                  "no_guarantees"],
    "travel": ["no_trust_above_fold", "form_field_overload", "no_search_ecommerce", "unclear_value_prop",
               "no_reviews"],
    "media": ["vague_cta_text", "unclear_value_prop", "headline_too_long", "no_value_prop"],
    "other": [],
}

# Business type -> word in an insight -> severity steps it adds.
SEVERITY_BOOSTS = {
    "ecommerce": {"cart": 2, "checkout": 2, "add_to_cart": 2, "product": 1, "price": 1, "payment": 2,
                  "shipping": 1, "trust": 1, "security": 2, "badge": 1, "form": 1},
    "saas": {"trial": 2, "pricing": 2, "signup": 2, "demo": 1, "value_prop": 1, "headline": 1, "cta": 1,
             "form": 1},
    "banking": {"security": 2, "trust": 2, "authentication": 2, "account": 1, "transfer": 2, "payment": 2,
                "form": 1},
    "insurance": {"quote": 2, "form": 1, "trust": 1, "security": 1, "value_prop": 1},
    "travel": {"booking": 2, "reservation": 2, "checkout": 2, "form": 1, "price": 1},
    "media": {"subscribe": 2, "newsletter": 1, "navigation": 1, "cta": 1},
    "other": {},
}

# Heuristic family -> insight category. Others are 'heuristic'.
HEURISTIC_CATEGORY = {
    "PDP-LAYOUT": "friction", "PDP-IMAGE": "value_prop", "PDP-PRICE": "trust", "PDP-DESC": "value_prop",
    "PDP-SPEC": "value_prop", "PDP-REVIEW": "trust", "PDP-SELECT": "form", "PDP-CTA": "cta",
    "PDP-MOBILE": "friction", "PDP-UTILITY": "navigation",
}
# Heuristic family -> element type whose presence contradicts a claim of absence.
HEURISTIC_ELEMENT = {
    "PDP-PRICE": "price", "PDP-CTA": "cta", "PDP-IMAGE": "image", "PDP-REVIEW": "review",
    "PDP-SELECT": "variant", "PLP-CTA": "cta", "PLP-PRICE": "price", "PLP-GRID": "image",
}
ABSENCE_CLAIM = (
    r"(?i)\bno\s+(?:visible|clear|obvious|prominent)?\s*(?:price|cta|button|image|review|rating|variant|selector)"
    r"|\bnot\s+(?:found|present|visible|displayed|shown|available)"
    r"|\babsent\b|\bmissing\b|\bcannot\s+(?:find|see|locate|identify)|\bnowhere\b"
)

# Words a status may be given as.
STATUS_WORDS = {
    "pass": "pass", "passed": "pass", "fail": "fail", "failed": "fail", "partial": "partial",
    "partially": "partial", "not_applicable": "not_applicable", "n/a": "not_applicable",
    "na": "not_applicable",
}
STRICT_EXTRA_STATUS = {"not applicable": "not_applicable"}

# Our wording of why two runs differ.
DISCREPANCY_CAUSES = {
    "missed": "the optimized run missed an issue",
    "invented": "the optimized run reports an issue the baseline does not",
    "fail_partial": "degree of failure differs, likely from viewport filtering",
    "pass_partial": "borderline verdict",
    "confidence": "confidence shift, likely from batching",
    "other": "minor difference",
}
