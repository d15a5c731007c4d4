"""The built-in knowledge of what a good page does. ``sources.knowledge.read_heuristics`` loads another set, with a text and
checkpoints for each item; here an item has its category's advice."""

# Page type, category, id and severity of each item.
HEURISTICS = [
    ("pdp", "Layout & Structure", "PDP-LAYOUT-001", "high"),
    ("pdp", "Layout & Structure", "PDP-LAYOUT-002", "high"),
    ("pdp", "Layout & Structure", "PDP-LAYOUT-003", "medium"),
    ("pdp", "Layout & Structure", "PDP-LAYOUT-004", "high"),
    ("pdp", "Product Imagery & Media", "PDP-IMAGE-001", "high"),
    ("pdp", "Product Imagery & Media", "PDP-IMAGE-002", "medium"),
    ("pdp", "Product Imagery & Media", "PDP-IMAGE-003", "high"),
    ("pdp", "Product Imagery & Media", "PDP-IMAGE-004", "medium"),
    ("pdp", "Pricing & Cost Transparency", "PDP-PRICE-001", "critical"),
    ("pdp", "Pricing & Cost Transparency", "PDP-PRICE-002", "medium"),
    ("pdp", "Pricing & Cost Transparency", "PDP-PRICE-003", "high"),
    ("pdp", "Pricing & Cost Transparency", "PDP-PRICE-004", "medium"),
    ("pdp", "Description & Value Proposition", "PDP-DESC-001", "high"),
    ("pdp", "Description & Value Proposition", "PDP-DESC-002", "high"),
    ("pdp", "Description & Value Proposition", "PDP-DESC-003", "medium"),
    ("pdp", "Specifications & Details", "PDP-SPEC-001", "medium"),
    ("pdp", "Specifications & Details", "PDP-SPEC-002", "low"),
    ("pdp", "Specifications & Details", "PDP-SPEC-003", "medium"),
    ("pdp", "Reviews & Social Proof", "PDP-REVIEW-001", "high"),
    ("pdp", "Reviews & Social Proof", "PDP-REVIEW-002", "high"),
    ("pdp", "Reviews & Social Proof", "PDP-REVIEW-003", "medium"),
    ("pdp", "Reviews & Social Proof", "PDP-REVIEW-004", "medium"),
    ("pdp", "Selection & Configuration", "PDP-SELECT-001", "high"),
    ("pdp", "Selection & Configuration", "PDP-SELECT-002", "high"),
    ("pdp", "Selection & Configuration", "PDP-SELECT-003", "high"),
    ("pdp", "CTA & Purchase Confidence", "PDP-CTA-001", "critical"),
    ("pdp", "CTA & Purchase Confidence", "PDP-CTA-002", "high"),
    ("pdp", "CTA & Purchase Confidence", "PDP-CTA-003", "high"),
    ("pdp", "CTA & Purchase Confidence", "PDP-CTA-004", "high"),
    ("pdp", "Mobile Usability", "PDP-MOBILE-001", "high"),
    ("pdp", "Mobile Usability", "PDP-MOBILE-002", "high"),
    ("pdp", "Mobile Usability", "PDP-MOBILE-003", "high"),
    ("pdp", "Utility & Secondary Actions", "PDP-UTILITY-001", "low"),
    ("pdp", "Utility & Secondary Actions", "PDP-UTILITY-002", "low"),
    ("pdp", "Utility & Secondary Actions", "PDP-UTILITY-003", "medium"),
    ("plp", "Layout & Grid", "PLP-GRID-001", "high"),
    ("plp", "Layout & Grid", "PLP-GRID-002", "high"),
    ("plp", "Layout & Grid", "PLP-GRID-003", "low"),
    ("plp", "Layout & Grid", "PLP-GRID-004", "medium"),
    ("plp", "Layout & Grid", "PLP-GRID-005", "medium"),
    ("plp", "Filtering & Sorting", "PLP-FILTER-001", "high"),
    ("plp", "Filtering & Sorting", "PLP-FILTER-002", "high"),
    ("plp", "Filtering & Sorting", "PLP-FILTER-003", "high"),
    ("plp", "Filtering & Sorting", "PLP-FILTER-004", "medium"),
    ("plp", "Filtering & Sorting", "PLP-FILTER-005", "medium"),
    ("plp", "Product Cards", "PLP-CARD-001", "critical"),
    ("plp", "Product Cards", "PLP-CARD-002", "high"),
    ("plp", "Product Cards", "PLP-CARD-003", "medium"),
    ("plp", "Product Cards", "PLP-CARD-004", "medium"),
    ("plp", "Product Cards", "PLP-CARD-005", "low"),
    ("plp", "Navigation & Breadcrumbs", "PLP-NAV-001", "high"),
    ("plp", "Navigation & Breadcrumbs", "PLP-NAV-002", "medium"),
    ("plp", "Navigation & Breadcrumbs", "PLP-NAV-003", "medium"),
    ("plp", "Mobile Usability", "PLP-MOBILE-001", "high"),
    ("plp", "Mobile Usability", "PLP-MOBILE-002", "high"),
    ("plp", "Mobile Usability", "PLP-MOBILE-003", "high"),
    ("plp", "Pagination & Loading", "PLP-PAGE-001", "high"),
    ("plp", "Pagination & Loading", "PLP-PAGE-002", "high"),
    ("plp", "Pagination & Loading", "PLP-PAGE-003", "high"),
    ("plp", "Pagination & Loading", "PLP-PAGE-004", "medium"),
]

# Advice of our own for a category.
ADVICE = {
    "Layout & Structure": "Put what visitors decide on first and keep the order of the page easy to follow",
    "Product Imagery & Media": "Let pictures answer what a visitor would check in a shop",
    "Pricing & Cost Transparency": "Show what the visitor will pay before they have to ask",
    "Description & Value Proposition": "Say in plain words what the visitor gains",
    "Specifications & Details": "Make facts easy to find and to compare",
    "Reviews & Social Proof": "Let other customers speak, with numbers and in full",
    "Selection & Configuration": "Make each choice, and what it changes, visible at once",
    "CTA & Purchase Confidence": "Keep the main action easy to find, to reach and to trust",
    "Mobile Usability": "Design for a thumb and a small screen first",
    "Utility & Secondary Actions": "Let helpful extras step back behind the main task",
    "Layout & Grid": "Arrange items so that the eye can scan them evenly",
    "Filtering & Sorting": "Help visitors narrow a long list without losing their place",
    "Product Cards": "Give each card what is needed to choose or to skip it",
    "Navigation & Breadcrumbs": "Tell visitors where they are and where they can go",
    "Pagination & Loading": "Make it clear how much there is, and load it without surprises",
}


def heuristic_rows():
    """(page_type, category, heuristic_id, severity, principle) of every built-in item."""
    for page_type, category, heuristic_id, severity in HEURISTICS:
        yield page_type, category, heuristic_id, severity, ADVICE[category]


# Categories judged together.
CATEGORY_BATCHES = [
    ["Layout & Structure", "Mobile Usability"],
    ["Pricing & Cost Transparency", "Description & Value Proposition"],
    ["Reviews & Social Proof", "Selection & Configuration"],
    ["Product Imagery & Media", "Specifications & Details"],
    ["CTA & Purchase Confidence", "Utility & Secondary Actions"],
]

# Category -> (wanted viewports or None for all, most viewports). Others take all.
VIEWPORT_NEEDS = {
    "Layout & Structure": (None, 6),
    "Mobile Usability": ([0, 1, 2], 3),
    "Pricing & Cost Transparency": ([0, 1, 2, 3], 4),
    "Description & Value Proposition": (None, 4),
    "Reviews & Social Proof": (None, 4),
    "Selection & Configuration": ([0, 1, 2], 3),
    "Product Imagery & Media": ([0, 1, 2], 3),
    "Specifications & Details": (None, 4),
    "CTA & Purchase Confidence": (None, 4),
    "Utility & Secondary Actions": (None, 5),
}
