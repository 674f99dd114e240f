"""Visible text of HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content isn't shown, and elements that begin and end a line.
HIDDEN = "script style title template noembed noframes iframe xmp".split()
BLOCK = (
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul"
).split()

#: What is no text: a comment, a tag, a declaration.  An equals sign may be followed by a quoted value, in which ">" ends no
#: tag.  What the text's end cuts off is none either.  No part is matched twice.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
      | <(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)
      | <(?:[!?]|/[^A-Za-z>])[^>]*+(?:>|\Z)
      | </>""",
    re.S | re.X,
)
SPACE = re.compile(r"[ \t\n\f\r]+")


def visible_text(page: str | None) -> str | None:
    """The lines of a page: markup, comments and hidden elements gone, character references resolved, white space
    collapsed (kept inside ``pre`` and ``textarea``), empty lines left out.  Null stays null."""
    if page is None:
        return None
    lines: list[str] = []
    line: list[str] = []
    pre = as_is = 0

    def say(text: str) -> None:
        nonlocal as_is
        text = html.unescape(text)
        if not pre:
            line.append(SPACE.sub(" ", text))
            return
        first, *others = text.split("\n")
        line.append(first)
        as_is |= first.strip() != ""
        for other in others:
            end()
            line.append(other)
            as_is |= other.strip() != ""

    def end() -> None:
        nonlocal as_is
        text = "".join(line)
        text = text.rstrip() if as_is else SPACE.sub(" ", text).strip(" ")
        if text:
            lines.append(text)
        line.clear()
        as_is = 0

    at = 0
    while found := TOKEN.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if name in BLOCK:
            end()
        if name == "pre":
            pre = max(0, pre - 1) if found["close"] else pre + 1
        elif not found["close"] and (name in HIDDEN or name == "textarea"):
            closing = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            until = closing.start() if closing else len(page)
            if name == "textarea":
                pre += 1
                say(page[at:until])
                pre -= 1
            at = until
    say(page[at:])
    end()
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text)
