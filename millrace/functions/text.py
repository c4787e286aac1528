"""String functions as Column expressions, all on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.btrim(c, F.lit(WHITE))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def nonblank(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def line_count(c: Column) -> Column:
    """Lines that aren't blank; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, "\n"), lambda x: strip(x) != "")), F.lit(0))


def char_count(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0))


def examples(texts: Column) -> Column:
    """Texts as Example 1:, Example 2: and so on, a blank line between them."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def singular(c: Column) -> Column:
    return F.regexp_replace(c, "s$", "")


def section(c: Column, first: str, second: str, empty_if_missing: bool, reverse: bool = False, drop_first_line: bool = False) -> Column:
    """The stripped text between ``first`` (its last place if ``reverse``) and the next ``second``, or the end."""

    def without_line(body: Column) -> Column:
        line = F.substring_index(body, "\n", 1)
        short = F.contains(body, F.lit("\n")) & ~F.contains(line, F.lit("{")) & (F.length(strip(line)) < 10)
        return F.when(short, body.substr(F.length(line) + 2, F.length(body))).otherwise(body)

    def found(x: Column) -> Column:
        body = F.substring_index(x, first, -1) if reverse else x.substr(F.locate(first, x) + len(first), F.length(x))
        body = F.substring_index(body, second, 1)
        if drop_first_line:
            body = once(body, without_line)
        return F.when(F.contains(x, F.lit(first)), body).otherwise(F.lit("") if empty_if_missing else x)

    return strip(once(c, found))


def after_tag(c: Column, tag: str) -> Column:
    """Between the first and the second ``tag``, or after it; the text itself where it has none."""
    quoted = F.lit("\\Q" + tag + "\\E")
    return F.when(F.contains(c, F.lit(tag)), strip(F.get(F.split(c, quoted), 1))).otherwise(c)


def without_block(c: Column, opening: str, closing: str) -> Column:
    return F.regexp_replace(c, F.lit(f"(?s)\\Q{opening}\\E.*?\\Q{closing}\\E"), F.lit(""))


def braces(c: Column) -> Column:
    """From the first { to the last }; empty where there is no such pair."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def brackets(c: Column) -> Column:
    """From the first [ to the last ]; empty where there is no such pair."""
    return F.regexp_extract(c, r"(?s)\[.*\]", 0)


def first_tokens(c: Column, n: int) -> Column:
    """At most ``n`` white-space tokens."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def optional(c: Column) -> Column:
    """Blank and text, or nothing where it is null or empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" "), c)).otherwise("")


def fill(template: str, **values: Column) -> Column:
    """The template with each {name} replaced once; values are never searched for names."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), F.coalesce(values[name], F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def decimal_comma(c: Column, digits: int = 4) -> Column:
    return F.translate(F.format_string(f"%.{digits}f", c.cast("double")), ".", ",")


def answer_head(c: Column) -> Column:
    """First line, up to ``)``, up to ``:``."""
    return F.substring_index(F.substring_index(F.substring_index(c, "\n", 1), ")", 1), ":", 1)
