"""Fixed values for the audit rules."""

WEAK_CTA = r"(?i)^(click\s*here|submit|learn\s*more|read\s*more|more|continue|next)$"
GENERIC_HEADLINE = r"(?i)^(welcome|home|homepage|untitled|page\s*\d*|about|about us|our company|hello|hi)$"
FRICTION_HEADLINE = r"(?i)^(welcome|home|homepage|about)$"
FIELD_TAGS = ["input", "select", "textarea"]
SPECIFIC_INPUT_TYPES = ["email", "password", "tel", "number", "date", "url", "search"]
ERROR_WORDS = ["error", "alert", "invalid", "validation"]
TRUST_WORDS = {
    "no_reviews": ["review", "testimonial", "rating", "stars", "feedback", "customer-say"],
    "no_security_badge": ["trust-badge", "security-seal", "secure", "ssl", "verified", "badge"],
    "no_guarantees": ["guarantee", "warranty", "money-back", "refund", "risk-free"],
    "no_certifications": ["certification", "accredited", "certified", "approved", "award"],
}
MAIN_NAV_WORDS = ["nav", "navigation", "main-nav", "primary-nav", "site-nav", "navbar"]
BREADCRUMB_WORDS = ["breadcrumb", "crumbs", "bread-crumb"]
SEARCH_WORDS = ["search", "site-search", "searchbox", "search-form"]
HOME_WORDS = ["home", "logo", "brand", "site-logo"]
MAX_CTAS, MAX_FIELDS, MAX_HEADLINE_WORDS, MAX_NAV_DEPTH, MIN_TARGET_AREA = 5, 5, 10, 3, 1600

# Rule -> (category, severity, issue, recommendation). Categories and severities are fixed values,
# the texts are ours. {n} and {text} stand for the measured count and the quoted text.
RULES = {
    "weak_cta_text": ("cta", "medium", 'Weak call to action: "{text}"', "Say what the visitor gets, not just to click"),
    "short_cta_text": ("cta", "low", 'Call to action too short: "{text}"', "Name the action and its benefit"),
    "no_cta_text": ("cta", "medium", "Call to action without text", "Add a visible text or an aria-label"),
    "small_click_target": ("cta", "medium", "Click target too small ({text})", "Make it at least 44x44px"),
    "missing_cta": ("cta", "high", "No call to action above the fold", "Put a clear call to action in the first screen"),
    "cta_overload": ("cta", "medium", "Too many calls to action ({n})", "Keep two or three primary actions"),
    "form_field_overload": ("form", "high", "Form has {n} fields", "Ask only for what is needed or split the form"),
    "missing_field_label": ("form", "medium", "Field without label or placeholder", "Label every field"),
    "missing_input_type": ("form", "medium", "Input without a specific type", "Set email, tel, number or another type"),
    "no_required_indicator": ("form", "low", "Required field is not marked", "Mark required fields with an asterisk"),
    "no_error_container": ("form", "low", "Form has no place for error messages", "Add a message area near the fields"),
    "no_submit_button": ("form", "high", "Form has no submit button", "Add a submit button that names the action"),
    "no_trust_above_fold": ("trust", "medium", "No trust signal above the fold", "Show ratings or badges by the main action"),
    "no_reviews": ("trust", "low", "No reviews or testimonials", "Add customer reviews or ratings"),
    "no_security_badge": ("trust", "medium", "No security badge", "Show security seals near payment and forms"),
    "no_guarantees": ("trust", "low", "No guarantee or warranty", "Offer and show a guarantee"),
    "no_certifications": ("trust", "low", "No certification or award", "Show certifications that apply"),
    "missing_h1": ("value_prop", "high", "Page has no main heading", "Add one heading that states the main benefit"),
    "multiple_h1": ("value_prop", "medium", "Page has {n} main headings", "Keep one main heading"),
    "generic_headline": ("value_prop", "medium", 'Generic main heading: "{text}"', "State a concrete benefit"),
    "headline_too_long": ("value_prop", "low", "Main heading has {n} words", "Cut it to ten words or fewer"),
    "no_subheadline": ("value_prop", "low", "Main heading without a second one", "Support it with a second heading"),
    "no_main_nav": ("navigation", "high", "No main navigation", "Add a nav element with clear links"),
    "no_breadcrumbs": ("navigation", "low", "No breadcrumbs away from the home page", "Add breadcrumbs"),
    "no_search": ("navigation", "medium", "No site search", "Add a search field"),
    "deep_nav_nesting": ("navigation", "low", "Navigation nests {n} levels", "Flatten it to three levels or fewer"),
    "no_home_link": ("navigation", "low", "No link to the home page", "Link the logo or add a home link"),
    "friction_cta": ("cta", "high", "No call to action above the fold", "Put a call to action in the first screen"),
    "friction_form": ("form", "high", "Form has {n} fields", "Ask only for what is needed"),
    "friction_trust": ("trust", "medium", "No trust signal above the fold", "Show proof by the main action"),
    "friction_value": ("value_prop", "high", "No main heading", "Add a heading that states the main benefit"),
    "friction_nav": ("navigation", "medium", "No site search", "Add a search field"),
}
