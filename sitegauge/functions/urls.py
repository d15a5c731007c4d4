"""URL functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.pages import HOME_PATHS, URL_SIGNALS
from .lookup import hits

_ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def domain_of(url: Column) -> Column:
    """Lower-case host without a leading 'www.'; '' when there is none."""
    return F.coalesce(F.regexp_replace(host_of(url), r"^www\.", ""), F.lit(""))


def path_pattern(url: Column) -> Column:
    """Path of an absolute URL ('/' when empty), NULL when the URL has no host."""
    path = F.try_parse_url(F.trim(url), F.lit("PATH"))
    return F.when(host_of(url).isNotNull(), F.when(path == "", "/").otherwise(path))


def normalize_url(url: Column) -> Column:
    """Without fragment and one closing slash, all lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/$", ""))


def is_homepage(url: Column, paths=tuple(HOME_PATHS)) -> Column:
    return F.coalesce(path_pattern(url).isin(*paths), F.lit(False))


def url_signal_conditions(url: Column) -> dict:
    low = F.lower(url)
    return {name: low.rlike(pattern) for name, pattern in URL_SIGNALS.items()}


def url_signals(url: Column) -> Column:
    return hits(url_signal_conditions(url))


def url_error(url: Column) -> Column:
    """Why a URL cannot be audited, NULL when it can."""
    text = F.trim(url)
    scheme = F.lower(F.regexp_extract(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return (F.when(F.coalesce(text, F.lit("")) == "", "empty")
            .when(~text.rlike(_ABSOLUTE), "invalid format")
            .when(~scheme.isin("http", "https"), "bad protocol")
            .when(F.coalesce(host_of(url), F.lit("")) == "", "no host"))
