"""String and array columns: keys, slugs, tags, tokens, keywords, corpora."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and blank strings."""
    return F.when(F.trim(c) != "", c)


def record_key(owner: Column, name: Column) -> Column:
    return F.lower(F.concat_ws("/", owner, name))


def slugify(c: Column) -> Column:
    """Lower case, & as "and", runs of other characters as one dash; "other-general" if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", "and"), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(slug == "", "other-general").otherwise(slug)


def normalise_tags(tags: Column) -> Column:
    """Unwrap elements that are JSON arrays of strings, trim, drop blanks, keep the first spelling of each tag."""

    def unwrap(x: Column) -> Column:
        x = F.trim(x)
        return F.when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array(x))).otherwise(F.array(x))

    flat = F.filter(F.transform(F.flatten(F.transform(tags, unwrap)), F.trim), lambda x: x.isNotNull() & (x != ""))
    first = F.aggregate(
        flat,
        F.array().cast("array<string>"),
        lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x))),
    )
    return F.when(tags.isNull(), F.array().cast("array<string>")).otherwise(first)


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def keyword_pattern(keyword: str) -> str:
    """A pattern that finds a keyword between token bounds in lower-cased text.

    No letter or digit before; digits but no letters behind; separators inside are interchangeable; keywords of four or
    more characters may have a plural s. Neither look-ahead nor look-behind, so Java and RE2 agree on it.
    """
    pieces = [p for p in re.split(r"[\s\-_./]+", keyword.lower()) if p]
    core = "[^a-z0-9]+".join(re.sub(r"([^a-z0-9])", r"\\\1", p) for p in pieces) or re.sub(r"([^a-z0-9])", r"\\\1", keyword.lower())
    return f"(^|[^a-z0-9]){core}{'s?' if len(keyword) >= 4 else ''}([^a-z]|$)"


def has_keyword(c: Column, keyword: str) -> Column:
    """Whether lower-cased text has a keyword; only texts that hold its longest piece meet the pattern."""
    piece = max(re.split(r"[\s\-_./]+", keyword.lower()), key=len)
    found = c.rlike(keyword_pattern(keyword))
    return c.contains(F.lit(piece)) & found if piece else found


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_of(patterns: Iterable[str]) -> str:
    """One pattern that is found, whatever the case, where any of some is; word bounds before words are tested once for all."""
    patterns = list(patterns)
    bound = [p[2:] for p in patterns if p.startswith(r"\b") and "|" not in p]
    rest = [p for p in patterns if not (p.startswith(r"\b") and "|" not in p)]
    return "(?i)" + "|".join([*([rf"\b(?:{'|'.join(bound)})"] if bound else []), *rest])


def lexicon_tags(corpus: Column, lexicon: dict[str, list[str]], most: int = 4) -> Column:
    """Labels, in the order of the lexicon, of which any pattern is found; the first ``most``.

    One pattern of all labels tells the texts that have none, so that only the others are searched for each label.
    """

    def found(text: Column) -> Column:
        hits = [F.when(text.rlike("(?i)" + "|".join(patterns)), F.lit(label)) for label, patterns in lexicon.items()]
        some = F.slice(F.filter(F.array(*hits), lambda x: x.isNotNull()), 1, most)
        return F.when(text.rlike(any_of(p for patterns in lexicon.values() for p in patterns)), some).otherwise(F.array().cast("array<string>"))

    return once(corpus, found) if lexicon else F.array().cast("array<string>")


def hook(description: Column, given: Column | None = None, card: Column | None = None) -> Column:
    """First 90 characters of the hook or description; a card's sentence if both are blank."""
    text = F.coalesce(*([blank_to_null(given)] if given is not None else []), blank_to_null(description))
    cut = F.substring(text, 1, 90)
    return F.coalesce(cut, card) if card is not None else F.coalesce(cut, F.lit(""))


def keyword_list(subsystem: Column, artifact: Column, domain: Column, *lists: Column, topics: Column) -> Column:
    """Labels, then lists, then the first six topics; the first occurrence of each counts."""
    return F.array_distinct(F.concat(F.array(subsystem, artifact, domain), *lists, F.slice(topics, 1, 6)))


#: Fixed value: commands that install a package.
INSTALL = (
    r"(?i)\b(pip3? install|npm (?:install|ci|i )|yarn add|pnpm add|cargo install|go get|brew install|apt(-get)? install|gem install|"
    r"helm install|kubectl apply|docker (?:pull|run)|composer require|conda install|poetry install)\b"
)


def has_install(c: Column) -> Column:
    return F.coalesce(c.rlike(INSTALL), F.lit(False)).cast("int")


def search_corpus(*columns: Column) -> Column:
    """Lower-cased columns with single spaces between; arrays by their elements."""
    return F.lower(F.concat_ws(" ", *columns))


def array_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))
