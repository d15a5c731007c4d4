"""Element selectors of the rule tables as column conditions over ``tag`` and ``attrs``.

Conditions read the columns that ``prepared`` adds, so that a map is searched and lower-cased once per row
and not once per rule, and they use no lambda, so that Spark compiles them.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import any_of

_PART = re.compile(r'#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:\*?="([^"]*)")?( i)?\]|^([a-z][\w]*)')
EDGE = "\u0001"


def attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_attr(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def prepared(nodes: DataFrame) -> DataFrame:
    """Nodes with the lower-case attributes that rules test. ``unprepared`` drops them again."""
    low = nodes.withColumns({"_class": F.lower(attr("class")), "_id": F.lower(attr("id")), "_role": F.lower(attr("role")),
                             "_label": F.lower(attr("aria-label")), "_text": F.lower("text")})
    spaced = F.concat(F.lit(" "), F.regexp_replace("_class", r"\s+", " "), F.lit(" "))
    # Edge marks let plain contains find whole words: around ' ', '-', '_' of classes, at word ends of text.
    return low.withColumns({
        "_tokens": spaced, "_class_words": F.regexp_replace(spaced, "([ _-])", f"{EDGE}$1{EDGE}"),
        "_text_words": F.concat(F.lit(EDGE), F.regexp_replace("_text", r"(\W+)", f"{EDGE}$1{EDGE}"), F.lit(EDGE))})


PREPARED = ["_class", "_id", "_role", "_label", "_text", "_tokens", "_class_words", "_text_words"]
_COLUMN = {"class": "_class", "id": "_id", "role": "_role", "aria-label": "_label"}


def unprepared(nodes: DataFrame) -> DataFrame:
    return nodes.drop(*PREPARED)


def lowered(name: str) -> Column:
    return F.col(_COLUMN[name]) if name in _COLUMN else F.lower(attr(name))


def class_word(word: str) -> str:
    """What ``_class_words`` holds when a class is the word or holds it bounded by '-' or '_'."""
    return EDGE + re.sub("([_-])", EDGE + r"\1" + EDGE, word) + EDGE


def text_word(phrase: str) -> str:
    return EDGE + re.sub(r"(\W+)", EDGE + r"\1" + EDGE, phrase) + EDGE


def has_class_word(word: str) -> Column:
    return F.col("_class_words").contains(class_word(word))


def class_strength(word: str) -> Column:
    """Strength of the first class that holds a word: 0.95 when it is the word, 0.85 when it is bounded in it."""
    bounded, exact = class_word(word), f"{EDGE} {class_word(word)} {EDGE}"
    at = F.instr("_class_words", bounded)
    return F.when(F.col("_class_words").contains(bounded),
                  F.when(F.instr("_class_words", exact) + 2 == at, 0.95).otherwise(0.85))


def parts(selector: str):
    """(kind, name, wanted value) of each simple part: tag, id, class, has, equals, contains."""
    for m in _PART.finditer(selector.replace('" i]', '"]')):
        id_, cls, name, value, _, tag = m.groups()
        if id_:
            yield "id", "id", id_.lower()
        elif cls:
            yield "class", "class", cls.lower()
        elif tag:
            yield "tag", "tag", tag
        elif value is None:
            yield "has", name, None
        else:
            yield ("contains" if "*=" in m.group(0) else "equals"), name, value.lower()


def matches(selector: str) -> Column:
    """Condition for one selector over prepared nodes, ignoring case in values."""
    def one(kind, name, value):
        if kind == "tag":
            return F.col("tag") == value
        if kind == "has":
            return has_attr(name)
        if kind == "class":
            return F.col("_tokens").contains(f" {value} ")
        return lowered(name).contains(value) if kind == "contains" else lowered(name) == value
    return reduce(lambda a, b: a & b, [one(*p) for p in parts(selector)])


def any_selector(selectors) -> Column:
    return any_of(matches(s) for s in selectors)
