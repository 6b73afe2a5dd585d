"""Patterns and text measures. Digits and white space are those of Unicode, as the rules were written for."""

from __future__ import annotations

NUM = r"\d+(?:\.\d+)?"
#: What page scans call a number's range sign, and the dashes that stand in for it.
WAVES, DASHES = "～~", "-－–—"


def quoted(text: str) -> str:
    """text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(text: str) -> str:
    """A regular expression as a SQL literal, Unicode-aware."""
    return quoted("(?U)" + text)


def all_matches(text: str, regex: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {pattern(regex)}, {group})"


def plain_lower(text: str) -> str:
    """A-Z in lower case, for texts of plain characters: lower() asks the Unicode library for each, which took half of all rules' time."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def bare(text: str) -> str:
    """Without spaces."""
    return f"replace({text}, ' ', '')"


def decimals(text: str) -> str:
    """The most decimals of a number in text, after digits that recognition split are joined; 0 without any."""
    joined = f"regexp_replace({text}, {pattern('(?<=[0-9])[ 　]+(?=[0-9])')}, '')"
    return f"if(contains({text}, '.'), coalesce(array_max(transform({all_matches(joined, chr(92) + 'd+' + chr(92) + '.(' + chr(92) + 'd+)', 1)}, x -> length(x))), 0), 0)"


def value_kind(text: str) -> str:
    """'verdict', 'measured' or null."""
    t = bare(text)
    number = rf"^[Φφ]?{NUM}(\s*[～~]\s*[Φφ]?{NUM})?[a-zA-Z℃%/]*$"
    return f"(CASE WHEN {t} IN ('合格', '不合格', '符合', '合各') THEN 'verdict' WHEN rlike({t}, {pattern(number)}) THEN 'measured' END)"


def fingerprint(text: str) -> str:
    """16 hexadecimal digits of the white-space-free text; '' under 20 characters."""
    # plain spaces and ends of lines go without an expression, which is only for what is left of white space
    most = f"replace(replace({text}, ' ', ''), '\\n', '')"
    bare_ = f"transform(array({most}), x -> if(rlike(x, {pattern(chr(92) + 's')}), regexp_replace(x, {pattern(chr(92) + 's+')}, ''), x))"
    return f"transform({bare_}, x -> CASE WHEN length(x) < 20 THEN '' ELSE substring(sha1(encode(x, 'UTF-8')), 1, 16) END)[0]"


def plain_digits(text: str) -> str:
    """Full-width digits and points as plain ones."""
    return f"translate({text}, '０１２３４５６７８９．', '0123456789.')"


def number(text: str, kind: str = "INT") -> str:
    """The value of a run of digits, full-width ones included; null if there is none or it is too large.

    An empty text never reaches try_cast, which would make and drop an exception for it, at 20 times the cost of the match."""
    return f"try_cast(get(filter(array({plain_digits(text)}), d -> d <> ''), 0) AS {kind})"


def safe_name(text: str) -> str:
    """A file name: 32 plain characters and six digits of the whole name's digest."""
    return f"concat(left(regexp_replace({text}, '[^A-Za-z0-9_-]+', '_'), 32), '_', left(sha1(encode({text}, 'UTF-8')), 6))"


def escaped(text: str) -> str:
    """For HTML."""
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {quoted(c)}, {quoted(name)})"
    return text
