"""String functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.elements import INTENT_WORDS
from ..rules.insights import HEURISTIC_CATEGORY, STATUS_WORDS, STRICT_EXTRA_STATUS
from .lookup import map_value

SPACES = r"\s+"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_text(text: Column) -> Column:
    return F.lower(squeeze(text))


def truncate_text(text: Column, limit: int) -> Column:
    """Collapse spaces, then cut to ``limit`` characters with a closing '...'."""
    clean = squeeze(text)
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.substring(clean, 1, limit - 3), F.lit("...")))


def count_words(text: Column) -> Column:
    clean = squeeze(text)
    return F.when(F.coalesce(clean, F.lit("")) == "", 0).otherwise(F.size(F.split(clean, " ")))


def title_case(name: Column) -> Column:
    """snake_case to words; the first letter of each goes up, the rest stays."""
    pieces = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda w: F.when(w.rlike(r"^\w"), F.concat(
        F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), "")


def id_to_type(heuristic_id: Column) -> Column:
    return F.replace(F.lower(heuristic_id), F.lit("-"), F.lit("_"))


def heuristic_prefix(heuristic_id: Column) -> Column:
    return F.substring_index(heuristic_id, "-", 2)


def insight_category(heuristic_id: Column) -> Column:
    return map_value(heuristic_prefix(heuristic_id), HEURISTIC_CATEGORY, "heuristic")


def default_recommendation(recommendation: Column, status: Column, principle: Column) -> Column:
    given = F.nullif(recommendation, F.lit(""))
    return F.coalesce(given, F.concat(
        F.when(status == "partial", F.lit("Review and improve: ")).otherwise(F.lit("Address issue: ")),
        F.coalesce(principle, F.lit(""))))


def default_element(tag: Column, index: Column, text: Column) -> Column:
    """tag[index] "text", or N/A when nothing is referenced."""
    quoted = F.when(F.coalesce(text, F.lit("")) != "",
                    F.concat(F.lit(' "'), F.substring(text, 1, 30), F.lit('"'))).otherwise(F.lit(""))
    return F.coalesce(F.concat(tag, F.lit("["), index.cast("string"), F.lit("]"), quoted), F.lit("N/A"))


def normalize_status(status: Column, strict: bool) -> Column:
    """Known spellings of a status. Unknown ones are NULL (strict) or not_applicable (lenient)."""
    word = F.lower(F.trim(status))
    if strict:
        return map_value(word, {**STATUS_WORDS, **STRICT_EXTRA_STATUS})
    return map_value(word, STATUS_WORDS, "not_applicable")


def plain_refs(text: Column) -> Column:
    """Unique [5]-style indices, ascending."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("bigint"))))


def viewport_refs(text: Column) -> Column:
    """[v0-5]-style references in order, as struct(viewport_index, element_index, ref)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(\[v\d+-\d+\])"), F.lit(1))
    return F.transform(found, lambda r: F.struct(
        F.regexp_extract(r, r"(\d+)-", 1).cast("int").alias("viewport_index"),
        F.regexp_extract(r, r"-(\d+)", 1).cast("bigint").alias("element_index"), r.alias("ref")))


def relabel_refs(text: Column, viewport_index: Column) -> Column:
    """[5] in a text becomes [vK-5]."""
    label = F.concat(F.lit("[v"), viewport_index.cast("string"), F.lit("-$1]"))
    return F.regexp_replace(text, F.lit(r"\[(\d+)\]"), label)


def viewport_ref(viewport_index: Column, element_index: Column) -> Column:
    return F.format_string("[v%d-%d]", viewport_index, element_index)


def kept_sections(text: Column, wanted: Column) -> Column:
    """The viewport sections of a text whose numbers are wanted, with a blank line between. A text without section marks, or
    with nothing wanted, stays whole."""
    mark = r"(?m)^--- Viewport-\d+ \(scroll: \d+px\) ---$"
    number = lambda part: F.regexp_extract(part, r"^--- Viewport-(\d+) \(scroll: \d+px\) ---", 1).try_cast("int")
    kept = F.filter(F.split(text, f"(?={mark})"), lambda part: F.coalesce(F.array_contains(wanted, number(part)), F.lit(False)))
    trimmed = F.transform(kept, lambda part: F.regexp_replace(part, r"\s+$", ""))
    return F.when((F.size(wanted) == 0) | ~text.rlike(mark), text).otherwise(F.array_join(trimmed, "\n\n"))


def focus_area(text: Column) -> Column:
    word = F.regexp_replace(F.lower(text), r"[-\s]", "_")
    return F.when(word.contains("above") | word.contains("fold"), "above_fold").otherwise("full_page")


def bounded_pattern(word: str) -> str:
    return rf"(^|[-_]){word}([-_]|$)"


def word_boundary_match(value: Column, word: str) -> Column:
    """The value is the word, or holds it bounded by '-' or '_'."""
    return F.coalesce(F.lower(value).rlike(bounded_pattern(word)), F.lit(False))


def intent_words(intent: str):
    return INTENT_WORDS.get(intent, [intent])


def text_intent(text: Column, intent: str) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return low.rlike(r"\b(" + "|".join(intent_words(intent)) + r")\b")


def word_set(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[^\w\s]", "")
    return F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))


def word_similarity(a: Column, b: Column) -> Column:
    """Common words over all words of two texts; 1 for equal texts, 0 when either is empty."""
    x, y = word_set(a), word_set(b)
    every = F.size(F.array_union(x, y))
    return (F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0)
            .when(every == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / every))
