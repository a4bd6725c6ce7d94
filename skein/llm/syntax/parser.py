"""One parser per language: lexer, tables, first unrecoverable error."""

from __future__ import annotations

import bisect
import re
from functools import lru_cache
from typing import NamedTuple

from . import grammars, lexers
from .run import first_error
from .tables import Grammar, build

LANGUAGES = ("python", "javascript", "typescript", "go", "rust", "java")
#: Extension -> language.
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java"}


class SyntaxFault(NamedTuple):
    line: int
    column: int
    token: str


def _grammar(language: str) -> str:
    text = getattr(grammars, language.upper())
    if language == "rust":  # a leaf of a token tree is any token but a bracket
        tokens = [t for t in Grammar(text + "\nleaf : NAME").terminals if t not in ("'('", "')'", "'['", "']'", "'{'", "'}'")]
        text += "\nleaf : " + " | ".join(tokens)
    return text


@lru_cache(maxsize=2)
def make_tables(languages: tuple[str, ...] = LANGUAGES) -> dict[str, dict]:
    return {name: build(_grammar(name)) for name in languages}


def _strict(kinds: list[str], text: str, places: list[int]) -> bool:
    """Is a script strict as a whole: a module, or one that begins with the directive?"""
    if text[places[0] :].startswith(("'use strict'", '"use strict"')):
        return True
    depth = 0
    for i, k in enumerate(kinds):
        if k in ("{", "(", "["):
            depth += 1
        elif k in ("}", ")", "]"):
            depth -= 1
        elif not depth and (k == "export" or k == "import" and kinds[i + 1 : i + 2] not in (["("], ["."])) and (not i or kinds[i - 1] not in (".", "?.")):
            return True
    return False


class Parser:
    def __init__(self, language: str, tables: dict):
        self.lex = lexers.lex_js if language in ("javascript", "typescript") else getattr(lexers, f"lex_{language}")
        self.tables = tables
        ids = tables["terminals"]
        self.ids = {(t.strip("'") if t[0] == "'" else "\0" + t): i for t, i in ids.items() if t != "$"}
        self.ids |= {word: -1 for word in grammars.RESERVED[language]}
        self.name = ids["NAME"]
        self.asi = ids.get("ASI", -1)
        self.sloppy_with = ids.get("WITH", -1)
        self.skip_bom = language != "python"

    def check(self, text: str) -> SyntaxFault | None:
        """The first error that no reading of the text survives, or None."""
        if self.skip_bom and text.startswith("﻿"):
            text = text[1:]
        kinds, places, lines = self.lex(text)
        get, name = self.ids.get, self.name
        if self.sloppy_with >= 0 and "with" in kinds and not _strict(kinds, text, places):
            get = (self.ids | {"with": self.sloppy_with}).get
        terms = []
        for k in kinds:
            i = get(k)
            if i is None:
                c = k[0]
                i = name if c.isalpha() or c in "_$\\" else -1
            terms.append(i)
        n = len(kinds)
        may = None
        if self.asi >= 0:
            may = lambda i: i >= n or kinds[i] == "}" or lines[i]
        at = first_error(self.tables, terms, self.asi, may)
        if at < 0:
            return None
        place = places[at] if at < n else len(text)
        breaks = [m.start() for m in re.finditer("\n", text)]
        line = bisect.bisect_left(breaks, place)
        return SyntaxFault(line + 1, place - (breaks[line - 1] + 1 if line else 0) + 1, text[place : place + 40].split("\n")[0] if at < n else "")


@lru_cache(maxsize=None)
def parsers() -> dict[str, Parser]:
    tables = make_tables()
    return {name: Parser(name, tables[name]) for name in LANGUAGES}
