"""Search text: words, "phrases", prefix*, OR groups and exclusions.

Words are ANDed; OR (upper case) starts another group; NOT x and -x exclude from all groups; AND says nothing new. A quote without
its end runs to the end of the text, a lone - is no operator, and NUL separates words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r'(?P<minus>-(?=\S))?(?:"(?P<phrase>[^"]*)"?(?P<stars>\**)|(?P<word>\S+))')
_BLANK = re.compile(r"\s+|-(?=\s|\Z)")


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool = False


@dataclass
class Search:
    any_of: list[list[Term]] = field(default_factory=list)
    none_of: list[Term] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.any_of or self.none_of)


def parse(text: str) -> Search:
    text = text.replace("\0", " ")
    found, group, negate, at = Search(), [], False, 0
    while at < len(text):
        if blank := _BLANK.match(text, at):
            negate = negate and "-" not in blank[0]
            at = blank.end()
            continue
        m = _TOKEN.match(text, at)
        at = m.end()
        out, negate = negate or m["minus"] is not None, False
        if m["word"] is not None:
            word = m["word"]
            if not out and word in ("OR", "NOT", "AND"):
                if word == "OR" and group:
                    found.any_of.append(group)
                    group = []
                negate = word == "NOT"
                continue
            term = Term(word.rstrip("*").strip(), word.endswith("*"))
        else:
            term = Term(m["phrase"].strip(), bool(m["stars"]))
        if term.text:
            (found.none_of if out else group).append(term)
    if group:
        found.any_of.append(group)
    return found
