"""Fixed values for step logs and collected viewports."""

READ_ONLY_TOOLS = ["extract_text", "get_ax_tree", "capture_viewport", "get_screenshot"]
TARGETING_TOOLS = ["click", "type_text", "select_option", "hover", "drag_and_drop"]
MAX_ELEMENT_RETRIES = 3
# Failure -> what to do next. A missing element ends the run at the third failure in a row.
FAILURE_STRATEGY = {
    "ELEMENT_NOT_FOUND": "REPLAN", "ACTION_HAD_NO_EFFECT": "REPLAN_WITH_DIAGNOSTIC",
    "BUDGET_EXCEEDED": "TERMINATE", "WRONG_PAGE": "REPLAN", "FORM_ERROR": "REPLAN_WITH_DIAGNOSTIC",
    "REDIRECT_LOOP": "TERMINATE", "PAGE_CRASHED": "TERMINATE",
}
LOOP_VISITS = 3
CACHE_SECONDS = 1800
CACHE_PATTERNS = 10

# Limits of a collected viewport.
MAX_BLANK, MAX_PLACEHOLDER, MAX_LAZY, MAX_TEXT_PLACEHOLDER, MIN_LOAD_RATIO = 2, 3, 5, 2, 0.7
EXPECTED_TYPES = ["price", "cta", "gallery", "variant"]
IMPORTANT_TYPES = ["cta", "price", "value_prop"]
SEGMENT_OVERLAP, VIEWPORT_OVERLAP = 100, 120
TILE_HEIGHT, TILE_OVERLAP, MAX_TILES = 1800, 100, 5
ANALYSIS_STEPS = 8
IMAGE_TOKENS = 85
