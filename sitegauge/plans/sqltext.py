"""Fixed values as SQL text, for the checking SQL."""


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def case(expr: str, values: dict, default=None) -> str:
    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in values.items())
    return f"(CASE {expr} {arms} ELSE {literal(default)} END)"


def rows(alias: str, columns: str, data) -> str:
    """(VALUES ...) alias(columns)"""
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in data)
    return f"(VALUES {body}) {alias}({columns})"


def in_list(values) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {literal(w)})" for w in words) + ")"


NODE_COLUMN = {"class": "class_attr", "id": "id_attr", "role": "role_attr", "type": "type_attr",
               "name": "name_attr", "href": "href_attr", "aria-label": "label_attr", "src": "src_attr",
               "placeholder": "placeholder_attr"}


def selector(sel: str) -> str:
    """Selector as a condition over the flat derived node table; attributes it lacks are absent."""
    from ..functions.selectors import parts

    def one(kind, name, value):
        if kind == "tag":
            return f"tag = {literal(value)}"
        column = NODE_COLUMN.get(name)
        if column is None:
            return "FALSE"
        if kind == "has":
            return f"{column} <> ''"
        if kind == "class":
            return f"list_contains(string_split(lower({column}), ' '), {literal(value)})"
        return f"contains(lower({column}), {literal(value)})" if kind == "contains" else f"lower({column}) = {literal(value)}"
    return "(" + " AND ".join(one(*p) for p in parts(sel)) + ")"


def any_selector(selectors) -> str:
    return "(" + " OR ".join(selector(s) for s in selectors) + ")"
