"""Garbled text from a wrong character encoding: find the spans and restore them.

What a letter or sign becomes when one encoding is read as another is computed
beforehand for all pairs of encodings and put into multi-pattern automata, and
only the spans they match are turned back; text beside a span stays as it is,
byte for byte.

* UTF-8 read as single bytes: the garbled sequence of every letter and sign of
  the known alphabets.  A matched run is turned back as a whole where it
  decodes, else word by word, else sequence by sequence.
* Two-byte Japanese read as single bytes: the garbled sequence of every kana
  and known kanji.  A span goes from match to match as far as it decodes.
* One single-byte encoding read as another: here a garbled letter is one other
  letter, so the patterns are garbled letters with the neighbour on either
  side that clean sentences know.  The spans are words: only a word with a
  letter where no known language puts it is turned, by the pair of encodings
  that makes its letters stand well.  A word that stands well as it is goes
  along only where it becomes a known word, or is enclosed by turned words or
  beside one of another script, and reads as well turned.
* Lost characters, which cannot be turned back (complete = false): replacement
  and control characters, what is left of a sequence whose other bytes were
  dropped, and signs that never stand between two letters.  One replacement
  character alone in quotation marks is a mention, not a case.

Restoring repeats until nothing more is found, so text garbled any number of
times comes back.  It ends, as each round makes a line shorter, or leaves it
as long and more of its letters standing well.
The surroundings are learned from all of a table of clean sentences.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import latest, spread

SINGLE = ("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
DOUBLE = ("cp932", "euc_jp")
#: All pairs (true, wrong) of two single-byte encodings, and of a two-byte one read as a single-byte one.
SWAPS = tuple((true, wrong) for true in SINGLE for wrong in SINGLE if true != wrong)
WIDE = tuple((true, wrong) for wrong in SINGLE for true in DOUBLE)
SIGNS = "–—‘’‚“”„…•‹›€£¥§©®°±µ¶·«»¿¡ªº¹²³×÷½¼¾†‡™→←⇒≤≥≠Δ✓│└├─🚀 "
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœšžąćęłńóśźżčďěňřťůőűăâîșțğış"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_ALPHABET = frozenset(LATIN + CYRILLIC)
#: Clean words of common loans and capital words, beside the given sentences.
LOANS = "naïve café résumé façade coördinate jalapeño Zürich à la carte MAÑANA ÜBERSICHT NÃO AÇÃO ATENÇÃO PADRÃO MIGRAÇÃO LIMITAÇÕES ÀÇÃO ŁĄCZA Â l'arrêt"
KANA = "".join(map(chr, [*range(0x3041, 0x3094), *range(0x30A1, 0x30F5), 0x30FC, 0x3001, 0x3002, 0x300C, 0x300D]))

_ODD = re.compile(r"[^\t\n\r -~]")
_LOST = re.compile("�")
_MENTION = re.compile("([\"'`])�\\1")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x80-\x84\x86-\x9f]")
#: Between two letters none of these stands in plain text.
_INSIDE = re.compile(r"(?<=[^\W\d_])[─-▟⌐⌠⌡≡≤≥≈∞∂∑∏√∫Ω∩ⁿ∙°±²³¹¤¦¨¸¬¯½¼¾£¥¢§¶©®†‡‰¿¡„‚‹›«»˙ˇ˘˝˛€](?=[^\W\d_])")
_WORD = re.compile(r"[^\t-\r ]*[^\t-\r -~][^\t-\r ]*")
#: Other ASCII than letters counts as the edge of a word.
_PLAIN = {i: chr(i).lower() if chr(i).isalpha() else "^" for i in range(128)}
_RUN = re.compile(r"[^\t\n\r -~]+(?: [^\t\n\r -~]+)*")


def _mixed(c: str, beside: str) -> bool:
    """Does a letter stand beside one of another script?"""
    own = "Ѐ" <= c <= "ӿ"
    return any(x.isalpha() and ("Ѐ" <= x <= "ӿ") != own for x in beside)


def _bytes_to_chars(encoding: str) -> list[str]:
    """What each byte becomes; bytes without a character become C1 controls, as browsers do."""
    return [bytes([b]).decode(encoding, "replace").replace("�", chr(b)) for b in range(256)]


def _decoders() -> dict[str, list[str]]:
    return {e: _bytes_to_chars(e) for e in SINGLE}


def garbled_sequences() -> dict[str, list[tuple[str, str, str]]]:
    """garbled sequence -> [(letter, true encoding, wrong encoding)] for all pairs with a multi-byte true encoding."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    letters = {"�", *SIGNS, *LATIN, *LATIN.upper(), *CYRILLIC, *CYRILLIC.upper(), *KANA}
    letters = sorted(c for c in letters if len(c) == 1)
    for wrong, table in _decoders().items():
        for c in letters:
            data = c.encode("utf-8")
            if len(data) < 2:
                continue
            variants = {"".join(table[b] for b in data)}
            # Undefined bytes may also have been dropped.
            variants.add("".join(table[b] for b in data if not _CONTROL.match(table[b])))
            # A no-break space may have become a blank.
            variants |= {v.replace("\xa0", " ") for v in variants if v[:-1].isascii() is False}
            for v in variants:
                if len(v) > 1:
                    out.setdefault(v, []).append((c, "utf-8", wrong))
    return out


def _facts(text: str) -> tuple[set[str], set[str], set[str]]:
    """What one clean text tells: neighbours of letters, known kanji, and words with a letter beyond ASCII."""
    near: set[str] = set()
    words = {w for w in re.findall(r"[^\W\d_]+", text.lower()) if not w.isascii()}
    low = "^" + re.sub(r"[^\w]|\d|_", "^", text.lower()) + "^"
    for i in range(1, len(low) - 1):
        if low[i] > "\x7f":
            near.add(low[i - 1 : i + 2])
            near.add(low[i - 1 : i + 1])
            near.add(low[i : i + 2] + ">")
    return near, {c for c in text if "㐀" <= c <= "鿿"}, words


class Knowledge:
    """Which letters stand next to which in clean text, and where signs may stand."""

    def __init__(self, clean: Iterable[str], facts: Iterable[Iterable[str]] = ((), (), ())):
        """From clean texts, and from the facts that others told."""
        self.near, self.kanji, self.words = map(set, facts)
        for text in [*clean, LOANS]:
            for mine, told in zip((self.near, self.kanji, self.words), _facts(text)):
                mine |= told

    def fits(self, line: str, i: int) -> bool:
        c = line[i]
        left = line[i - 1] if i else " "
        right = line[i + 1] if i + 1 < len(line) else " "
        if c.isalpha() and c not in "ªºµΔﬂ":
            if "ぁ" <= c <= "ヿ":
                return True
            if c > "⺀":
                return c in self.kanji
            a = left.lower() if left.isalpha() else "^"
            b = right.lower() if right.isalpha() else "^"
            x = c.lower()
            if c.isupper() and left.islower():
                return False
            return a + x + b in self.near or (a + x in self.near and x + b + ">" in self.near)
        if c in "–—→⇒≤≥≠Δ·•":
            return left == " " and right in " \n"
        if c in "“„‘«‹":
            return left in " (\n[" and (right.isalnum() or right in "`_")
        if c in "”»›":
            return (left.isalnum() or left in "_`.!?") and not right.isalnum()
        if c == "’":
            return left.isalpha() and (right.isalpha() or right in " ,.")
        if c == "…":
            return not right.isalnum() and left != right or left == " " and right == " "
        if c == "€":
            return left.isdigit() or right.isdigit() or left == " " and line[max(0, i - 2)].isdigit()
        if c in "£¥$":
            return right.isdigit() and not left.isalnum()
        if c in "§¶©®™":
            return left in " \n(" and right in " \n)0123456789" or right == " "
        if c in "±":
            return right.isdigit() and left == " "
        if c in "µ":
            return right == "m" and left == " "
        if c == "°":
            return right == "C" and left in " 0123456789"
        if c in "、。「」・":
            return left > "⿿" or right > "⿿"
        if c in "│├└─":
            return left in " ─├└\n" and right in " ─\n"
        return not left.isalpha() and not right.isalpha() and ord(c) > 0x2190 and not 0x2500 <= ord(c) < 0x25A0 and c != "�" and not 0xE000 <= ord(c) < 0xF900


def _automaton(patterns: dict[str, int]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for s, mask in patterns.items():
        out.add_word(s, (len(s), mask))
    out.make_automaton()
    return out


def wide_sequences(know: Knowledge) -> dict[str, int]:
    """garbled sequence -> bit set of WIDE pairs: two-byte kana and kanji read as single bytes."""
    out: dict[str, int] = {}
    tables = _decoders()
    for true in DOUBLE:
        for c in [*KANA, *sorted(know.kanji)]:
            try:
                data = c.encode(true)
            except UnicodeEncodeError:
                continue
            if len(data) == 2:
                for p, (t, wrong) in enumerate(WIDE):
                    if t == true:
                        s = "".join(tables[wrong][b] for b in data)
                        out[s] = out.get(s, 0) | 1 << p
    return out


def swapped_neighbours(know: Knowledge) -> dict[str, int]:
    """Two neighbours, one at least garbled -> bit set of SWAPS pairs that may have made them.

    ASCII letters are lower case and all other ASCII is ``^``, as in the text searched.
    """
    out: dict[str, int] = {}
    tables = _decoders()
    bytes_of = {e: {c: b for b, c in reversed(list(enumerate(t)))} for e, t in tables.items()}
    beside = [(n[0], n[1]) for n in know.near if len(n) == 2 or n[2] == ">"]
    # Either letter in either case, but no capital after a small one.
    cased = {(x, y) for a, b in beside for x, y in ((a, b), (a.upper(), b), (a.upper(), b.upper()), (a, b.upper() if a == "^" else b)) if len(x) == len(y) == 1}
    cased = sorted({tuple(c.lower() if c < "\x80" else c for c in pair) for pair in cased})
    signs = sorted({c for c in SIGNS if c > "\x7f"})
    for p, (true, wrong) in enumerate(SWAPS):
        known, read = bytes_of[true], tables[wrong]
        turn = {c: read[known[c]] for c in {*(c for pair in cased for c in pair), *signs} if c in known}
        for a, b in cased:
            x, y = turn.get(a), turn.get(b)
            if x is not None and y is not None and (x != a or y != b):
                out[x + y] = out.get(x + y, 0) | 1 << p
        marks = {turn[c] for c in signs if turn.get(c, c) != c}
        for g in marks:
            for c in "^abcdefghijklmnopqrstuvwxyz":
                out[c + g] = out.get(c + g, 0) | 1 << p
                out[g + c] = out.get(g + c, 0) | 1 << p
    return out


class _Word:
    """A blank-separated piece of a line with an odd character in it."""

    def __init__(self, mender: Mender, line: str, a: int, b: int, bad: set[int]):
        self.a, self.b, self.text = a, b, line[a:b]
        self.odd = [i for i, c in enumerate(self.text) if c > "\x7f"]
        self.bad = any(a + i in bad for i in self.odd)
        self.stands = self.score(mender, line, {})

    def score(self, mender: Mender, line: str, to: dict[int, str]) -> float:
        left = line[max(0, self.a - 2) : self.a]
        return mender._score(left + self.text.translate(to) + line[self.b : self.b + 1], [len(left) + i for i in self.odd])

    def beside(self, other: _Word, mender: Mender, line: str, to: dict[int, str]) -> bool:
        """Does this word, which stands well as it is, go along with a turned one next to it?

        It does if it is without ASCII letters, one blank away, and becomes of the script that the other becomes, which it is not yet.
        """
        if abs(other.a - self.b) > 1 and abs(self.a - other.b) > 1 or any("a" <= c.lower() <= "z" for c in self.text):
            return False
        own, mine, theirs = (_scripts(x) for x in (self.text, self.text.translate(to), other.text.translate(to)))
        return mine == theirs != own and self.score(mender, line, to) == len(self.odd)


def _scripts(text: str) -> set[bool]:
    return {"Ѐ" <= c <= "ӿ" for c in text if c.isalpha() and c > "\x7f"}


class Mender:
    def __init__(self, clean: Iterable[str], facts: Iterable[Iterable[str]] = ((), (), ())):
        import ahocorasick

        self.know = Knowledge(clean, facts)
        self.sequences = garbled_sequences()
        self.automaton = ahocorasick.Automaton()
        for s, meanings in self.sequences.items():
            self.automaton.add_word(s, (s, meanings))
        self.automaton.make_automaton()
        tables = _decoders()
        self.back = {w: {ch: b for b, ch in reversed(list(enumerate(t)))} for w, t in tables.items()}
        #: What one odd character may have been, where the bytes after it were dropped.
        self.stumps: dict[str, set[str]] = {}
        for w, t in tables.items():
            for c in sorted(x for x in {*SIGNS, *LATIN, *LATIN.upper()} if len(x) == 1 and x > "\x7f"):
                kept = [t[b] for b in c.encode("utf-8") if not _CONTROL.match(t[b])]
                if len(kept) == 1:
                    self.stumps.setdefault(kept[0], set()).add(c)
        self.pairs: list[dict[str, str]] = []
        for true, wrong in SWAPS:
            self.pairs.append({tables[wrong][b]: tables[true][b] for b in range(128, 256) if tables[wrong][b] != tables[true][b] and not _CONTROL.match(tables[true][b])})
        self.swaps = _automaton(swapped_neighbours(self.know))
        self.wide = _automaton(wide_sequences(self.know))

    # -- multi-byte text read as single bytes

    def _unread(self, run: str, wrong: str) -> str | None:
        """The run as UTF-8 from its bytes in ``wrong``, if it is that."""
        back = self.back[wrong]
        data = bytearray()
        for c in run:
            b = 32 if c == " " else back.get(c)
            if b is None:
                return None
            data.append(b)
        try:
            return bytes(data).decode("utf-8")
        except UnicodeDecodeError:
            try:  # a no-break space may have become a blank
                return bytes(data).replace(b"\xc3 ", b"\xc3\xa0").replace(b"\xc2 ", b"\xc2\xa0").decode("utf-8")
            except UnicodeDecodeError:
                return None

    def _mean(self, line: str, a: int, part: str, b: int) -> float:
        """How well ``part`` stands in the place of line[a:b], 0 to 1."""
        around = line[max(0, a - 1) : a] + part + line[b : b + 1]
        odd = [i for i, c in enumerate(around) if c > "\x7f"]
        return self._score(around, odd) / len(odd) if odd else 1.0

    def _run_back(self, line: str, a: int, b: int, inside: list) -> str | None:
        """line[a:b] read in the encoding that its sequences and its letters speak for most; None if it decodes in none."""
        best, most = None, -1.0
        votes = self._votes(inside)
        for wrong in sorted(votes, key=lambda w: (-votes[w], SINGLE.index(w))):
            got = self._unread(line[a:b], wrong)
            if got is not None and got != line[a:b]:
                well = self._mean(line, a, got, b)
                if well > most:
                    best, most = got, well
        return best

    @staticmethod
    def _votes(inside: list) -> dict[str, int]:
        votes: dict[str, int] = {}
        for _, s, meanings in inside:
            for _, _, wrong in meanings:
                votes[wrong] = votes.get(wrong, 0) + len(s)
        return votes

    def _piecewise(self, line: str, a: int, b: int, hits: dict) -> str:
        """line[a:b] with each known sequence turned back, longest first."""
        votes = self._votes([h for i in range(a, b) for h in hits.get(i, ())])
        if not votes:
            return line[a:b]
        wrong = max(votes, key=lambda w: votes[w])
        piece, i = [], a
        while i < b:
            fit = max(((e, s, ms) for e, s, ms in hits.get(i, ()) if e <= b and any(w == wrong for _, _, w in ms)), key=lambda h: h[0], default=None)
            if fit:
                piece.append(next(c for c, _, w in fit[2] if w == wrong))
                i = fit[0]
            else:
                piece.append(line[i])
                i += 1
        return "".join(piece)

    def _sequences(self, line: str) -> tuple[str, int, bool]:
        """The line with its garbled runs turned back, how many there were, and whether all came back."""
        hits: dict[int, list[tuple[int, str, list]]] = {}
        for end, (s, meanings) in self.automaton.iter(line):
            hits.setdefault(end - len(s) + 1, []).append((end + 1, s, meanings))
        if not hits:
            return line, 0, True
        out, at, found, whole = [], 0, 0, True
        for m in _RUN.finditer(line):
            a, b = m.span()
            b += line[b - 1 : b + 1] in self.sequences
            run = line[a:b]
            inside = [h for i in range(a, b) for h in hits.get(i, ())]
            if not inside:
                continue
            best = self._run_back(line, a, b, inside)
            if best is None and " " in run:
                parts, i = [], a
                for word in run.split(" "):
                    own = [h for k in range(i, i + len(word)) for h in hits.get(k, ())]
                    parts.append((self._run_back(line, i, i + len(word), own) if own else word) or self._piecewise(line, i, i + len(word), hits))
                    whole = whole and not (own and self._run_back(line, i, i + len(word), own) is None)
                    i += len(word) + 1
                best = " ".join(parts)
            elif best is None:
                best = self._piecewise(line, a, b, hits)
                whole = False
            if best == run:
                continue
            # A run of letters that might stand here has to gain by being turned back.
            if sum(c.isalpha() or c == " " for c in run) >= 0.8 * len(run) and not _CONTROL.search(run) and (now := self._mean(line, a, run, b)) >= 0.3 and now + 0.2 > self._mean(line, a, best, b):
                continue
            out += [line[at:a], best]
            at, found = b, found + 1
        return "".join([*out, line[at:]]), found, whole

    def _wide(self, line: str) -> str | None:
        """Two-byte Japanese read as single bytes: the line with its garbled spans turned back."""
        anchors: dict[int, dict[int, None]] = {}
        for end, (n, mask) in self.wide.iter(line):
            while mask:
                p = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                anchors.setdefault(p, {})[end - n + 1] = None
        best: list[tuple[int, int, int, str]] = []
        for p, at in anchors.items():
            if len(at) >= 3:
                best += self._wide_spans(line, WIDE[p], sorted(at))
        out, end = [], len(line)
        taken = [False] * len(line)
        chosen = []
        for kana, a, b, got in sorted(best, key=lambda x: (-x[0], x[1])):
            if not any(taken[a:b]):
                taken[a:b] = [True] * (b - a)
                chosen.append((a, b, got))
        if not chosen:
            return None
        out, at = [], 0
        for a, b, got in sorted(chosen):
            out += [line[at:a], got]
            at = b
        return "".join([*out, line[at:]])

    def _wide_spans(self, line: str, pair: tuple[str, str], anchors: list[int]) -> list[tuple[int, int, int, str]]:
        """(kana, start, end, text) of the stretches around the anchors that decode to mostly known Japanese."""
        true, wrong = pair
        back = self.back[wrong]

        def at(i: int) -> tuple[str, int] | None:
            """The character that begins at i and how many it takes, if one of two bytes or half width does."""
            if i >= len(line) or line[i] <= "\x7f" or (lead := back.get(line[i])) is None:
                return None
            for n in (2, 1):
                try:
                    more = [lead] if n == 1 else [lead, back[line[i + 1]] if line[i + 1] > "\x7f" else ord(line[i + 1])]
                    got = bytes(more).decode(true)
                except (UnicodeDecodeError, LookupError, ValueError):
                    continue
                if len(got) == 1 and got > "\x7f":
                    return got, n
            return None

        out, done, known = [], 0, set(anchors)
        for a in anchors:
            if a < done:
                continue
            # Left of the anchor, what leads to it character by character.
            leads, start, i = {a}, a, a - 1
            while i >= done and not line[i].isspace() and a - i <= 2 + (a - start):
                c = at(i)
                if c and i + c[1] in leads and line[i] > "\x7f" and c[1] == 2:
                    leads.add(i)
                    start = i
                i -= 1
            # To the right as far as it decodes; past plain text only to a stretch with an anchor of its own.
            parts, i = [], start
            while i < len(line):
                begun, text, held = i, [], False
                while c := at(i):
                    held = held or i in known
                    text.append(c[0])
                    i += c[1]
                if text and held:
                    odd = [k for k in range(begun, i) if line[k] > "\x7f"]
                    if sum(self.know.fits(line, k) for k in odd) < 0.6 * len(odd):  # else it reads well as it is
                        parts.append((begun, i, "".join(text)))
                    elif parts:
                        break
                elif text:
                    break
                if i < len(line):
                    if line[i] > "\x7f":
                        break
                    i += 1
            done = max(done, i if not parts else parts[-1][1])
            if not parts:
                continue
            start, end = parts[0][0], parts[-1][1]
            got, last = "", start
            for begun, over, text in parts:
                got, last = got + line[last:begun] + text, over
            odd = [k for k, c in enumerate(got) if c > "\x7f"]
            kana = sum("ぁ" <= c <= "ヿ" or c in "、。" for c in got)
            well = sum(self.know.fits(got, k) for k in odd)
            torn = start and line[start - 1] > "\x7f" or end < len(line) and line[end] > "\x7f"
            before = [k for k in range(start, end) if line[k] > "\x7f"]
            if kana >= (6 if torn else 3) and well >= (0.9 if torn else 0.6) * len(odd) and sum(self.know.fits(line, k) for k in before) < 0.4 * len(before):
                out.append((kana, start, end, got))
        return out

    def _two_bytes(self, text: str) -> str | None:
        """UTF-16 read as single bytes, where every letter of ASCII has a NUL beside it."""
        best, most = None, 0.5
        for wrong in SINGLE:
            data = [self.back[wrong].get(c) for c in text]
            if None in data:
                continue
            for true in ("utf-16-le", "utf-16-be"):
                try:
                    got = bytes(data).decode(true)
                except UnicodeDecodeError:
                    continue
                odd = [i for i, c in enumerate(got) if c > "\x7f"]
                well = (len(got) - len(odd) + sum(self.know.fits(got, i) for i in odd)) / len(got)
                if well > most and not _CONTROL.search(got):
                    best, most = got, well
        return best

    def _score(self, line: str, odd: list[int]) -> float:
        """1 for each odd character that stands well, less for a letter that is at least one of an alphabet."""
        total = 0.0
        for i in odd:
            c = line[i]
            if c <= "\x7f" or self.know.fits(line, i):
                total += 1
            elif c.lower() in _ALPHABET and not (c.isupper() and i and line[i - 1].islower()) and not _mixed(c, line[i - 1 : i] + line[i + 1 : i + 2]):
                total += 0.4
        return total

    def _swapped(self, line: str) -> str | None:
        """One single-byte encoding read as another: the line with its garbled words turned back."""
        odd = [i for i, c in enumerate(line) if c > "\x7f"]
        bad = {i for i in odd if not self.know.fits(line, i)}
        if not bad:
            return None
        mask = 0
        for end, (_, m) in self.swaps.iter(f"^{line.translate(_PLAIN)}^"):
            if end - 1 in bad or end - 2 in bad:
                mask |= m
        if not mask:
            return None
        before = self._score(line, odd)
        words = [_Word(self, line, m.start(), m.end(), bad) for m in _WORD.finditer(line)]
        ill = [w for w in words if w.bad]
        letters = tuple(sorted({line[i] for i in odd}))
        seen = {letters}
        best, most = None, 0.55
        for p, to in enumerate(self.pairs):
            if not mask >> p & 1:
                continue
            turned = tuple(to.get(c, c) for c in letters)
            if turned in seen or min(turned) <= "\x7f":
                continue
            seen.add(turned)
            map_ = {ord(c): x for c, x in zip(letters, turned)}
            after = line.translate(map_)
            now = self._score(after, odd)
            # Either the pair explains all odd letters of the line, or the words it turns are told clearly.
            if now > before + most and now >= 0.7 * len(odd):
                best, most = (map_, None), now - before
                continue
            gains = [(w, w.score(self, line, map_) - w.stands) for w in ill]
            better = [(w, g) for w, g in gains if g > 0]
            gain, n = sum(g for _, g in better), sum(len(w.odd) for w, _ in better)
            if gain > most and sum(w.stands + g for w, g in better) >= 0.95 * n and (gain >= 2.0 and (len(better) >= 2 or not any(w.stands for w, _ in better)) or all(self._known(w.text.translate(map_)) for w, _ in better)):
                best, most = (map_, {w.a for w, _ in better}), gain
        if best is None:
            return None
        map_, only = best
        turned = [w.bad and (w.a in only if only is not None else w.score(self, line, map_) >= w.stands) for w in words]
        # A word that may be right but is not known goes along only with words that cannot be right, and not past one that the pair would damage.
        firm = [t and w.stands < 0.4 * len(w.odd) - 1e-9 for w, t in zip(words, turned)]
        if only is None and any(firm):
            near = [False] * len(words)
            for order in (range(len(words)), range(len(words) - 1, -1, -1)):
                open_ = False
                for k in order:
                    w = words[k]
                    open_ = firm[k] or open_ and (w.bad and w.score(self, line, map_) > w.stands or w.text.translate(map_) == w.text or w.score(self, line, map_) == len(w.odd))
                    near[k] = near[k] or open_
            turned = [t and n for t, n in zip(turned, near)]
        for order in (range(len(words)), range(len(words) - 1, -1, -1)):
            last = None
            for k in order:
                w = words[k]
                if not turned[k] and not w.bad and last is not None:
                    turned[k] = w.beside(words[last], self, line, map_)
                last = k if turned[k] else None
        if any(turned):
            turned = [t or not w.bad and self._known(w.text.translate(map_)) and not self._known(w.text) for w, t in zip(words, turned)]
        known = [k for k, t in enumerate(turned) if t]
        for a, b in zip(known, known[1:]):
            inner = words[a + 1 : b]
            if inner and all(not w.bad and w.text.translate(map_) != w.text and w.score(self, line, map_) == len(w.odd) for w in inner):
                turned[a + 1 : b] = [True] * len(inner)
        out, at = [], 0
        for w, t in zip(words, turned):
            if t:
                out += [line[at : w.a], w.text.translate(map_)]
                at = w.b
        got = "".join([*out, line[at:]])
        return got if got != line and self._score(got, odd) > before else None

    def _known(self, word: str) -> bool:
        parts = [p for p in re.findall(r"[^\W\d_]+", word.lower()) if not p.isascii()]
        return bool(parts) and all(p in self.know.words for p in parts)

    def _dropped(self, line: str) -> bool:
        """Whether the odd characters are what is left of sequences whose other bytes were dropped."""
        odd = [i for i, c in enumerate(line) if c > "\x7f"]
        bad = {i for i in odd if not self.know.fits(line, i)}
        if not bad or sum(line[i] in self.stumps for i in odd) < 2 or any(line[i] not in self.stumps for i in bad):
            return False
        near = self.know.near

        def explained(i: int) -> bool:
            left, right = line[i - 1 : i].lower() if i else "", line[i + 1 : i + 2].lower()
            a, b = left if left.isalpha() else "^", right if right.isalpha() else "^"
            for c in self.stumps[line[i]]:
                x = c.lower()
                if self.know.fits(line[max(0, i - 2) : i] + c + line[i + 1 : i + 2], min(i, 2)) or x.isalpha() and (i - 1 in bad or a + x in near) and (i + 1 in bad or x + b + ">" in near):
                    return True
            return False

        return all(map(explained, bad))

    def mend(self, text: str) -> tuple[bool, str, bool]:
        """(is garbled, restored text, all of it came back)."""
        if text.isascii() and not _CONTROL.search(text):
            return False, text, True
        garbled, whole = False, True
        if text.count("\0") >= 0.2 * len(text) > 0:
            got = self._two_bytes(text)
            if got is not None:
                garbled, text = True, got
        lines = re.split("(\n)", text)
        for k, line in enumerate(lines):
            if line.isascii() and not _CONTROL.search(line):
                continue
            partly = False
            while True:
                wide = self._wide(line)
                if wide is not None and wide != line:
                    garbled, line = True, wide
                    continue
                after, found, all_back = self._sequences(line)
                if found:
                    garbled, partly, whole, line = True, True, whole and all_back, after
                    continue
                if not line.isascii():
                    # What stays odd beside sequences turned back has rather lost bytes than been swapped.
                    if partly and self._dropped(line):
                        whole = False
                        break
                    swapped = self._swapped(line) if "\0" not in line else None
                    if swapped is not None:
                        garbled, line = True, swapped
                        continue
                    if self._dropped(line) or _INSIDE.search(line):
                        garbled, whole = True, False
                break
            lines[k] = line
            if _CONTROL.search(line):
                garbled, whole = True, False
            if "�" in _MENTION.sub("", line):
                garbled, whole = True, False
        return garbled, "".join(lines), whole


@lru_cache(maxsize=1)
def _packed(facts: tuple[tuple[str, ...], ...]) -> bytes:
    return pickle.dumps(Mender((), facts))


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> Mender:
    return pickle.loads(packed)


def _told(clean: DataFrame, clean_text: str) -> tuple[tuple[str, ...], ...]:
    """The facts of all clean texts, learned in the tasks; of these the distinct ones come to the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [set().union(*kind) for kind in zip(((), (), ()), *map(_facts, batch.column(0).to_pylist()))]
            kinds = [i for i, kind in enumerate(told) for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, type=pa.int32()), pa.array([x for kind in told for x in kind], type=pa.string())], ["kind", "fact"])

    texts = clean.select(F.col(f"`{clean_text}`").cast("string")).dropna()
    facts = texts.mapInArrow(learn, "kind int, fact string").distinct().toArrow()
    out: tuple[list[str], ...] = ([], [], [])
    for kind, fact in zip(facts["kind"].to_pylist(), facts["fact"].to_pylist()):
        out[kind].append(fact)
    return tuple(tuple(sorted(kind)) for kind in out)


def find_garbled(df: DataFrame, key: str, text: str, clean: DataFrame, clean_text: str, at: str | None = "recorded_at", restore: bool = True) -> DataFrame:
    """(key, garbled, restored, complete) per key.

    restored is the text after restoring (the text itself where nothing was
    found), complete says whether no trace is left.  A null text gives
    garbled = false and a null restored; an empty one stays empty.  Of rows
    with one key the latest ``at`` counts.  Without ``restore`` that column is
    left out, and no text is shuffled.  ``clean`` is a table of clean
    sentences; all of it is learned from, and what is kept grows with its
    alphabets and its distinct words with letters beyond ASCII.
    """
    # Some megabytes of automata, whose size depends on the alphabets and the facts alone, built once.
    sent = df.sparkSession.sparkContext.broadcast(_packed(_told(clean, clean_text)))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), (F.col(f"`{at}`") if at else F.lit(None)).cast("timestamp").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = _unpacked(sent.value)
        for batch in batches:
            got = [(False, None, True) if t is None else mender.mend(t) for t in batch.column(1).to_pylist()]
            found = [pa.array([g[i] for g in got], type=t) for i, t in enumerate((pa.bool_(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], ["key", "at", "garbled", "restored", "complete"])

    kind = dict(df.dtypes)[key]
    out = spread(rows).mapInArrow(run, f"key {kind}, at timestamp, garbled boolean, restored string, complete boolean")
    out = out if restore else out.drop("restored")
    out = latest(out, ["key"], "at").drop("at") if at else out.drop("at")
    return out.withColumnRenamed("key", key)
