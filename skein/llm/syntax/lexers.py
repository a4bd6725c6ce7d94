"""Lexers of the bundled languages.

Each gives three parallel lists: token texts or class names, places in the
text, and whether a line end comes before.  A class name is upper case and
starts with ``\\0``; what no rule matches becomes the class ``\\0ERROR``.
"""

from __future__ import annotations

import re
import unicodedata

NAME, NUMBER, STRING, CHAR, ERROR = "\0NAME", "\0NUMBER", "\0STRING", "\0CHAR", "\0ERROR"
Tokens = tuple[list[str], list[int], list[bool]]

_ID = r"[^\W\d]\w*"


def _ops(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


# --- Java, Go, Rust: one master pattern each ---------------------------------

_JAVA = re.compile(
    r"(?P<ws>[ \t\f]+)|(?P<nl>\r\n?|\n)|(?P<com>//[^\r\n]*|/\*(?s:.*?)\*/)"
    r"|(?P<num>(?:0[xX](?:[0-9a-fA-F][0-9a-fA-F_]*)?(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01][01_]*|\d[\d_]*(?:\.(?:\d[\d_]*)?)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?)"
    r"|(?P<name>(?:[^\W\d]|\$)[\w$]*)"
    r'|(?P<str>"""[ \t\f]*(?:\r\n?|\n)(?s:(?:[^\\]|\\.)*?)"""|"(?!"")(?:[^"\\\r\n]|\\.)*"|""(?!"))'
    r"|(?P<chr>'(?:[^'\\\r\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    rf"|(?P<op>{_ops('-> :: ... ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << ( ) { } [ ] ; , . @ = > < ! ~ ? : + - * / & | ^ % ')})"
)
_GO = re.compile(
    r"(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<com>//[^\n]*|/\*(?s:.*?)\*/)"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?)"
    rf"|(?P<name>{_ID})"
    r'|(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`)'
    r"|(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    rf"|(?P<op>{_ops('<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ ( ) { } [ ] ; , . : = < > ! + - * / % & | ^ ~')})"
)
_RUST = re.compile(
    r"(?P<ws>[ \t\f]+)|(?P<nl>\r\n|\n|\r)|(?P<com>//[^\n]*)|(?P<deep>/\*)"
    r"|(?P<str>[bc]?r(?P<h>#*)\"(?s:.*?)\"(?P=h)|[bc]?\"(?:[^\"\\]|\\(?s:.))*\")"
    r"|(?P<chr>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')"
    rf"|(?P<life>'{_ID})"
    r"|(?P<num>0x[0-9a-fA-F_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?)"
    rf"|(?P<name>r#{_ID}|{_ID})"
    rf"|(?P<op>{_ops('..= ... .. -> => :: && || == != <= >= += -= *= /= %= ^= &= |= ( ) { } [ ] ; , . : = < > ! + - * / % & | ^ @ # $ ? ~ _')})"
)


def _plain(pattern: re.Pattern, text: str, semicolons: bool = False, nested: bool = False) -> Tokens:
    kinds, places, lines = [], [], []
    at, n, nl = 0, len(text), False
    match = pattern.match
    ends = {NAME, NUMBER, STRING, CHAR, "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
    last = ""

    def line(place: int) -> None:
        if semicolons and (last in ends or last[:1].isalpha() and last not in _GO_WORDS):
            kinds.append(";")
            places.append(place)
            lines.append(False)

    while at < n:
        m = match(text, at)
        if not m:
            kinds.append(ERROR)
            places.append(at)
            lines.append(nl)
            return kinds, places, lines
        kind, at, start = m.lastgroup, m.end(), at
        if kind == "ws":
            continue
        if kind == "nl" or kind == "com" and "\n" in m[0]:
            nl = True
            line(start)
            last = ""
            continue
        if kind == "com":
            continue
        if kind == "deep":
            depth = 1
            while depth:
                a, b = text.find("/*", at), text.find("*/", at)
                if b < 0:
                    kinds.append(ERROR)
                    places.append(start)
                    lines.append(nl)
                    return kinds, places, lines
                if 0 <= a < b:
                    depth, at = depth + 1, a + 2
                else:
                    depth, at = depth - 1, b + 2
            continue
        if kind == "h":
            kind = "str"
        if kind == "num":
            tok = NUMBER
            if at < n and (text[at].isalnum() or text[at] == "_"):
                tok = ERROR
        else:
            tok = {"str": STRING, "chr": CHAR, "life": "\0LIFE"}.get(kind, m[0])
        kinds.append(tok)
        places.append(start)
        lines.append(nl)
        nl = False
        last = tok
    line(n)
    return kinds, places, lines


_GO_WORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
) - {"break", "continue", "fallthrough", "return"}


def lex_java(text: str) -> Tokens:
    return _plain(_JAVA, text)


def lex_go(text: str) -> Tokens:
    return _plain(_GO, text, semicolons=True)


def lex_rust(text: str) -> Tokens:
    if text.startswith("#!") and not text.startswith("#!["):
        text = "//" + text[2:]
    return _plain(_RUST, text)


# --- JavaScript and TypeScript -----------------------------------------------

_JS = re.compile(
    "(?P<ws>[ \\t\\v\\f\\u00a0\\ufeff\\u2000-\\u200a\\u3000]+)|(?P<nl>\\r\\n|[\\n\\r\\u2028\\u2029])"
    r"|(?P<com>//[^\n\r  ]*|/\*(?s:.*?)\*/)"
    r"|(?P<num>0[xX][0-9a-fA-F][0-9a-fA-F_]*n?|0[bB][01][01_]*n?|0[oO][0-7][0-7_]*n?|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"
    r"|(?P<name>#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"""|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|(?s:.)))*"|'(?:[^'\\\n\r]|\\(?:\r\n|(?s:.)))*')"""
    rf"|(?P<op>\?\.(?!\d)|{_ops('>>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= >= ++ -- << && || ?? += -= *= /= %= &= |= ^= ** { } ( ) [ ] . ; , < > + - * / % & | ^ ! ~ ? : = @')})"
    r"|(?P<tpl>`)"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JS_TPL = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)")
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_HEADERS = frozenset("if while for with".split())


def lex_js(text: str) -> Tokens:
    kinds, places, lines = [], [], []
    at, n, nl = 0, len(text), False
    if text.startswith("#!"):
        at = len(text.split("\n", 1)[0])
    match = _JS.match
    prev, before = "", ""  # the last token and the one before
    parens: list[bool] = []  # does the ) of this ( end a statement header
    braces: list[str] = []  # "b"lock, "o"bject, "t"emplate
    header_end = block_end = False

    def put(tok: str, place: int) -> None:
        nonlocal nl, prev, before
        kinds.append(tok)
        places.append(place)
        lines.append(nl)
        nl = False
        before, prev = prev, tok

    def template(start: int, open_tok: str, full: str) -> int:
        m = _JS_TPL.match(text, at)
        if not m:
            put(ERROR, start)
            return n
        if m[1] == "`":
            put(full, start)
        else:
            put(open_tok, start)
            braces.append("t")
        return m.end()

    while at < n:
        m = match(text, at)
        if not m:
            put(ERROR, at)
            break
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "ws":
            continue
        if kind == "nl":
            nl = True
            continue
        if kind == "com":
            nl = nl or "\n" in m[0]
            continue
        if kind == "tpl":
            at = template(start, "\0THEAD", "\0TFULL")
            continue
        tok = m[0]
        if kind == "num":
            put(ERROR if at < n and (text[at].isalnum() or text[at] in "_$") or tok[0] == "0" and len(tok) > 1 and tok[1] == "_" else NUMBER, start)
        elif kind == "str":
            put(STRING, start)
        elif kind == "name":
            put("\0PRIVATE" if tok[0] == "#" else tok, start)
        else:
            if tok[0] == "/" and tok in ("/", "/="):
                operand = prev in (NAME, NUMBER, STRING, "]", "\0REGEX", "\0TFULL", "\0TTAIL", "++", "--") or prev[:1].isalpha() and prev not in _BEFORE_REGEX or prev[:1] in "_$" and prev != ""
                if prev == ")":
                    operand = not header_end
                elif prev == "}":
                    operand = not block_end
                if not operand:
                    r = _JS_REGEX.match(text, start)
                    if not r:
                        put(ERROR, start)
                        break
                    at = r.end()
                    put("\0REGEX", start)
                    continue
            if tok == "(":
                parens.append(prev in _HEADERS and before != ".")
            elif tok == ")":
                header_end = parens.pop() if parens else False
            elif tok == "{":
                block = prev in ("", ")", ";", "{", "=>", "else", "do", "try", "finally") or prev == "}" and block_end or prev[:1].isalpha() and prev not in _BEFORE_REGEX or prev == ":" and False
                braces.append("b" if block else "o")
            elif tok == "}":
                shape = braces.pop() if braces else "b"
                if shape == "t":
                    r = _JS_TPL.match(text, at)
                    if not r:
                        put(ERROR, start)
                        break
                    at = r.end()
                    if r[1] == "`":
                        put("\0TTAIL", start)
                    else:
                        put("\0TMID", start)
                        braces.append("t")
                    continue
                block_end = shape == "b"
            # No line end may come before ++ and --, nor between return and its value.
            if tok in ("++", "--") and nl and (prev in (")", "]", "}") or prev[:1].isalnum() or prev[:1] in "_$\0" and prev != ""):
                put("\0ASI", start)
            put(tok, start)
            continue
        if nl is False and len(kinds) > 1 and lines[-1] and kinds[-2] in ("return", "break", "continue") and (len(kinds) < 3 or kinds[-3] not in (".", "?.")):
            kinds.insert(-1, "\0ASI")
            places.insert(-1, start)
            lines.insert(-1, False)
    return kinds, places, lines


# --- Python --------------------------------------------------------------------

_PY = re.compile(
    r"(?P<ws>[ \t\f]+)|(?P<join>\\\r?\n)|(?P<nl>\r\n?|\n)|(?P<com>#[^\r\n]*)"
    r"|(?P<str>(?P<pre>[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?P<q>\"\"\"|'''|\"|'))"
    rf"|(?P<name>{_ID})"
    r"|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*)"
    rf"|(?P<op>{_ops('**= //= >>= <<= ... -> := == != <= >= << >> ** // += -= *= /= %= &= |= ^= @= ( ) [ ] { } , : . ; @ = + - * / % & | ^ ~ < > !')})"
)
_PY_AFTER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_PY_STR = {
    q + kind: re.compile({"'": r"(?:[^'\\\r\n]|\\(?:\r\n|(?s:.)))*'", '"': r'(?:[^"\\\r\n]|\\(?:\r\n|(?s:.)))*"', "'''": r"(?s:(?:[^\\]|\\.)*?)'''", '"""': r'(?s:(?:[^\\]|\\.)*?)"""'}[q])
    for q in ("'", '"', "'''", '"""')
    for kind in ("",)
}


def lex_python(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    if text.startswith("﻿"):
        text = text[1:]
    at, n = 0, len(text)
    depth: list[str] = []
    indents, alts = [0], [0]
    match = _PY.match
    # f-strings under way: quote, raw, bracket depth where the field began, in a format spec
    fields: list[list] = []
    fresh = True

    def put(tok: str, place: int) -> None:
        kinds.append(tok)
        places.append(place)

    def fail(place: int) -> Tokens:
        put(ERROR, place)
        return kinds, places, [False] * len(kinds)

    def ftext(i: int) -> int:
        """Literal text of the f-string on top up to a field or its end; -1 if it never ends."""
        quote, raw, _, spec = fields[-1]
        while i < n:
            c = text[i]
            if c == "\\" and not spec:
                if not raw and text.startswith("\\N{", i):
                    i = text.find("}", i)
                    if i < 0:
                        return -1
                    i += 1
                else:
                    i += 1 if raw and text[i + 1 : i + 2] in "{}" else 2
            elif not spec and text.startswith(quote, i):
                put("\0FEND", i)
                fields.pop()
                return i + len(quote)
            elif spec and c == "}":
                fields[-1][3] = False
                depth.pop()
                put("}", i)
                return ftext(i + 1)
            elif c == "{":
                if not spec and text.startswith("{{", i):
                    i += 2
                    continue
                put("{", i)
                depth.append("f")
                if spec:
                    fields.append([quote, raw, len(depth), False])
                    fields[-1].append("nested")
                else:
                    fields[-1][2] = len(depth)
                return i + 1
            elif c == "}":
                if text.startswith("}}", i):
                    i += 2
                    continue
                return -1
            elif c in "\r\n" and len(quote) == 1:
                return -1
            elif spec and text.startswith(quote, i):
                return -1
            else:
                i += 1
        return -1

    while at < n:
        if fresh and not depth:
            # The indentation of a logical line.
            col = alt = 0
            i = at
            while i < n and text[i] in " \t\f":
                if text[i] == " ":
                    col, alt = col + 1, alt + 1
                elif text[i] == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                else:
                    col = alt = 0
                i += 1
            if i >= n or text[i] in "#\r\n":
                if i < n and text[i] == "#":
                    while i < n and text[i] not in "\r\n":
                        i += 1
                at = i + 2 if text.startswith("\r\n", i) else i + 1
                continue
            if col == indents[-1]:
                if alt != alts[-1]:
                    return fail(i)
            elif col > indents[-1]:
                if alt <= alts[-1]:
                    return fail(i)
                indents.append(col)
                alts.append(alt)
                put("\0INDENT", i)
            else:
                while col < indents[-1]:
                    indents.pop()
                    alts.pop()
                    put("\0DEDENT", i)
                if col != indents[-1] or alt != alts[-1]:
                    return fail(i)
            at, fresh = i, False
        m = match(text, at)
        if not m:
            return fail(at)
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "q" or kind == "pre":
            kind = "str"
        if kind in ("ws", "com"):
            continue
        if kind == "join":
            if at >= n:
                return fail(start)
            continue
        if kind == "nl":
            if not depth:
                put("\0NEWLINE", start)
                fresh = True
            continue
        if kind == "name":
            if not m[0].isascii() and not unicodedata.normalize("NFKC", m[0]).isidentifier():
                return fail(start)
            put(m[0], start)
        elif kind == "num":
            if at < n and (text[at].isalnum() or text[at] == "_") and not _PY_AFTER.match(text, at):
                return fail(start)
            put(NUMBER, start)
        elif kind == "str":
            prefix, quote = (m["pre"] or "").lower(), m["q"]
            if "f" in prefix:
                put("\0FSTART", start)
                fields.append([quote, "r" in prefix, -1, False])
                at = ftext(at)
                if at < 0:
                    return fail(start)
            else:
                s = _PY_STR[quote].match(text, at)
                if not s:
                    return fail(start)
                put("\0BYTES" if "b" in prefix else STRING, start)
                at = s.end()
        else:
            tok = m[0]
            inside = fields and depth and depth[-1] == "f" and len(depth) == fields[-1][2]
            if inside and tok in (":", ":=", "!", "}"):
                if tok == "}":
                    depth.pop()
                    put("}", start)
                    if len(fields[-1]) > 4:
                        fields.pop()
                    at = ftext(at)
                    if at < 0:
                        return fail(start)
                    continue
                if tok in (":", ":="):
                    put("\0FSPEC", start)
                    fields[-1][3] = True
                    at = ftext(start + 1)
                    if at < 0:
                        return fail(start)
                    continue
                put("!", start)
                continue
            if inside and tok == "!=" and text[at : at + 1] != "":
                pass
            if tok in "([{":
                depth.append(tok)
            elif tok in ")]}":
                if not depth or depth.pop() != {")": "(", "]": "[", "}": "{"}[tok]:
                    return fail(start)
            elif tok == "!":
                return fail(start)
            put(tok, start)
    if depth or fields:
        return fail(n)
    if not fresh:
        put("\0NEWLINE", n)
    for _ in indents[1:]:
        put("\0DEDENT", n)
    return kinds, places, [False] * len(kinds)
