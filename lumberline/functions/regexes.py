"""Users' regular expressions, which a linear-time engine would take, for Java's.

Look-around, back-references, atomic groups and possessive quantifiers are refused; (?P<name> becomes (?<name>; $ at the end of the
text only; classes are Unicode's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import REGEX_BYTES

_PIECE = re.compile(
    r"(?P<escape>\\(?:[pP]\{[^}]*\}|x\{[0-9A-Fa-f]+\}|u\{[0-9A-Fa-f]+\}|.))"
    r"|(?P<group>\(\?(?:P?<(?P<name>[A-Za-z_][A-Za-z0-9_.\[\]]*)>|(?P<flags>[imsUux]*(?:-[imsUux]+)?)(?P<end>[:)])|))"
    r"|(?P<posix>\[:\^?[a-z]+:\])|(?P<open>\[\^?\]?)|(?P<close>\])|(?P<quantifier>(?:[*+?]|\{\d+(?:,\d*)?\})[+?]?)|(?P<dollar>\$)|(?P<other>.)",
    re.S,
)
# POSIX classes and the escapes that both engines know.
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
ESCAPES = set("dDsSwWbBAzntrfav0123456789") | set(r"\.+*?()|[]{}^$#&-~/ ,:;=!<>@%\"'`_")


class Regex:
    """java: the pattern for Spark; names: names of its groups, in order (group numbers from 1, None without a name)."""

    def __init__(self, pattern: str, most: int = REGEX_BYTES):
        if len(pattern.encode()) > most:
            raise ValueError(f"regular expression longer than {most} bytes")
        out, self.names, depth, inside, multiline = [], [], 0, 0, False
        for m in _PIECE.finditer(pattern):
            text = m[0]
            if m["escape"]:
                out.append(self._escape(text, inside))
            elif inside:
                if m["posix"]:
                    name = text.strip("[:]^")
                    if name not in POSIX:
                        raise ValueError(f"invalid regular expression: unknown class {text}")
                    text = ("\\P{" if "^" in text else "\\p{") + POSIX[name] + "}"
                elif m["open"]:
                    inside += 1
                elif m["close"]:
                    inside -= 1
                out.append(text)
            elif m["open"]:
                inside += 1
                out.append(text.replace("]", "\\]"))
            elif m["group"]:
                if m["name"]:
                    self.names.append(m["name"])
                    depth += 1
                    text = "("
                elif m["end"]:
                    multiline |= "m" in (m["flags"] or "").split("-")[0]
                    depth += m["end"] == ":"
                    text = text.replace("U", "")
                else:
                    raise ValueError("invalid regular expression: look-around is not supported")
                out.append(text)
            elif text == "(":
                self.names.append(None)
                depth += 1
                out.append(text)
            elif text == ")":
                depth -= 1
                out.append(text)
                if depth < 0:
                    break
            elif m["quantifier"]:
                if text.endswith("+") and len(text) > 1:
                    raise ValueError("invalid regular expression: possessive quantifiers are not supported")
                out.append(text)
            else:
                out.append(r"\z" if m["dollar"] and not multiline else text)
        if depth or inside:
            raise ValueError("invalid regular expression: unbalanced brackets")
        self.java = "(?U)" + "".join(out)
        try:
            re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\x\{[^}]*\}", "x", "".join(out).replace(r"\z", r"\Z").replace("&&", "&")))
        except re.error as e:
            if "global flags" not in str(e):
                raise ValueError(f"invalid regular expression: {e}") from None

    @staticmethod
    def _escape(text: str, inside: int) -> str:
        if text[1] in "123456789" and not inside:
            raise ValueError("invalid regular expression: back-references are not supported")
        if text[1] == "u" and text[2:3] == "{":
            return "\\x" + text[2:]
        if text[1] in "kKGZQERHVhXN" or text[1].isalpha() and text[1] not in "dDsSwWbBAzntrfavpPxu":
            raise ValueError(f"invalid regular expression: unrecognised escape {text}")
        return "\\x0B" if text == "\\v" else text


def check(pattern: str, most: int = REGEX_BYTES) -> Regex:
    return Regex(pattern, most)


def matches(column: Column, pattern: str, most: int = REGEX_BYTES) -> Column:
    """Whether the pattern occurs anywhere."""
    return column.rlike(Regex(pattern, most).java)


def matches_whole(column: Column, pattern: str) -> Column:
    return column.rlike(Regex(f"^(?:{pattern})$").java)


def replacement(text: str) -> str:
    """$1, ${1} and $$ of a replacement for Java's."""
    out = []
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)|\\|.", text, re.S):
        name = m[1] or m[2]
        if m[0] == "$$":
            out.append(r"\$")
        elif name:
            out.append(f"${name}" if name.isdigit() else "")
        else:
            out.append("\\\\" if m[0] == "\\" else "\\$" if m[0] == "$" else m[0])
    return "".join(out)


def named_replacement(text: str, names: list[str | None]) -> str:
    """The same where groups may be meant by name."""
    at = {n: i + 1 for i, n in enumerate(names) if n}
    return replacement(re.sub(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)", lambda m: f"${{{at[m[1] or m[2]]}}}" if (m[1] or m[2]) in at else "", text))


def replaced(column: Column, pattern: str, by: str) -> Column:
    r = Regex(pattern)
    return F.regexp_replace(column, r.java, named_replacement(by, r.names))
