"""Languages of documents and of the passages in them.

Word-first backoff: a word known from the samples is scored by its log
frequency in each language; an unseen word falls back to character n-grams,
at each place the longest one that any language knows.  The samples are a
fixed labelled table; everything else covers every document whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LONGEST = 5


class Model:
    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        at = {lang: i for i, lang in enumerate(self.languages)}
        n = len(self.languages)
        words: list[Counter] = [Counter() for _ in range(n)]
        grams: list[dict[int, Counter]] = [{k: Counter() for k in range(1, _LONGEST + 1)} for _ in range(n)]
        for lang, text in samples:
            i = at[lang]
            for w in self.words(text):
                words[i][w] += 1
                padded = f" {w} "
                for k in range(1, _LONGEST + 1):
                    for p in range(len(padded) - k + 1):
                        grams[i][k][padded[p : p + k]] += 1
        self.n = n
        self.known = self._logs(words, 0.05)
        self.grams = {k: self._logs([g[k] for g in grams], 0.05) for k in range(1, _LONGEST + 1)}
        self.memo: dict[str, tuple[float, ...]] = {}

    def _logs(self, counts: list[Counter], add: float) -> dict[str, tuple[float, ...]]:
        keys = set().union(*counts)
        totals = [sum(c.values()) + add * (len(keys) + 1) for c in counts]
        return {k: tuple(math.log((c[k] + add) / t) for c, t in zip(counts, totals)) for k in keys}

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORD.findall(text.lower().replace("’", "'"))

    def word(self, w: str) -> tuple[float, ...]:
        """Log score of one word per language."""
        got = self.memo.get(w)
        if got is not None:
            return got
        got = self.known.get(w)
        if got is None:
            padded, total, p = f" {w} ", [0.0] * self.n, 0
            while p < len(padded):
                for k in range(min(_LONGEST, len(padded) - p), 0, -1):
                    g = self.grams[k].get(padded[p : p + k])
                    if g is not None:
                        if padded[p : p + k].strip():
                            for i in range(self.n):
                                total[i] += g[i] * k / _LONGEST
                        p += max(1, k - 1) if p + k < len(padded) else k
                        break
                else:
                    p += 1
            got = tuple(total)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[w] = got
        return got

    def classify(self, text: str) -> tuple[str | None, float]:
        """The best language and its posterior; none without a word."""
        return self.classify_words(self.words(text))

    def classify_words(self, words: list[str]) -> tuple[str | None, float]:
        if not words:
            return None, 0.0
        total = list(map(sum, zip(*map(self.word, words))))
        most = max(total)
        top = total.index(most)
        return self.languages[top], 1.0 / sum(math.exp(max(-60.0, x - most)) for x in total)


# --- Running prose ---------------------------------------------------------------

_FENCE = re.compile(r"(```|~~~)")
_QUOTE = re.compile(r"^(?:\s{0,3}>\s?)+")
_BREAK = re.compile(
    r"#|={1,6}\s|[-=~*_]{3,}\s*$"  # headings and rules
    r"|(?:[-*+•‣◦]|\d{1,3}[.)]|\[[ xX]\])\s"  # lists
    r"|\||\+[-=+]{3,}"  # tables
    r"|//|/\*|\*/|\*\s|--\s|<!--|\"\"\"|'''|;;"  # comments
    r"|@@|\+\+\+\s|---\s|diff\s--git|index\s[0-9a-f]{6,}|[+-](?=\S)|[+-]\s"  # diffs
    r"|\d{2,}[-:/.T\d]*\s+\[?(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b|\[?(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\]?[:\s]"  # logs
    r"|Traceback\b|File\s\"|at\s[\w.$<>]+\(|[A-Z]\w*(?:Error|Exception|Expired|Warning)\b\s*[:(]|Caused by:"  # traces
    r"|<\|?/?\w[^<>]*\|?>"  # markup
)
_ITEM = re.compile(r"(?:[-*+•‣◦]|\d{1,3}[.)])\s")
_HEADER = re.compile(r"[\w./-]+(?:\([^)]*\))?!?:(?:\s|$)")
_CODE = re.compile(r"(?:[;{}\[(]|=>|->|\\)\s*$|^\s*[})\]]|^\s*(?:def|class|import|from|return|func|fn|pub|let|const|var|public|private|protected|static|package|use|if|for|while|else|elif|try|except|async|await|export|type|interface|struct|enum|impl|match|case|switch|raise|throw|with)\b[^.!?]*[({:=;]|\w\(\)|[=!<>]=|&&|\|\||::")
#: A code line that goes on ends in a comma after one of these.
_BRACKET = re.compile(r"[=(){}\[\]<>\"]").search
_END = re.compile(r"([.!?。！？]+)([\"'”’»)\]*_]*)")
_FULL_WIDTH = "。！？"
_CODED = re.compile(r"[`/\\_<\[]|[a-z][A-Z]").search
_INLINE = re.compile(r"`[^`]*`|https?://\S+|(?<!\S)[^\s/\\]*[/\\]\S*|\[[^\[\]]*\]\([^()]*\)|\b\w*_\w+\b|\b[a-z]+(?:[A-Z]\w*)+\b|\[[\d.]+\]|<[^<>]*>")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def passages(text: str | None) -> list[str]:
    """The paragraphs of running prose: no code, comments, headings, lists, tables, logs, traces or diffs."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            out.append(" ".join(held))
            held.clear()

    fenced = quoted = listed = False
    until = ""  # what ends a comment or string over several lines
    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", text or ""):
        body = _QUOTE.sub("", line)
        if (body != line) != quoted:
            quoted = body != line
            close()
        bare = body.strip()
        if _FENCE.match(bare):
            fenced = not fenced
            close()
            continue
        if until:
            if until in bare:
                until = ""
            continue
        opening = next((o for o in ("/*", '"""', "'''") if bare.startswith(o)), "")
        if opening and (bare.find("*/", 2) < 0 if opening == "/*" else bare.count(opening) % 2):
            until = "*/" if opening == "/*" else opening
            close()
            continue
        if listed and bare and body[:2] in ("  ", " \t"):  # an item goes on
            continue
        listed = bool(_ITEM.match(bare))
        indented = body[:1] == "\t" or body[:4] == "    "
        if fenced or not bare or indented or _BREAK.match(bare) or bare.count("|") > 1:
            close()
            continue
        ends = bare[-1] in ".!?。！？\"'”’»)*_"
        if _HEADER.match(bare) and not ends and len(bare) < 90 or (_CODE.search(bare) or bare[-1] == "," and _BRACKET(bare)) and not (ends and bare[-1] in ".!?。！？"):
            close()
            continue
        held.append(bare)
    close()
    return out


def sentences(passage: str) -> list[str]:
    """The sentences in one pass over the end marks, in time proportional to the passage.

    A sentence ends with its end marks and the quotes and brackets after them
    before a blank or the end, and after a full-width mark anywhere.  A mark
    right before other text is inside a word (a version, a name).  One before a
    closing sign with text after it ends no sentence, and what stands before
    it is none; neither is what follows the last end.
    """
    out, start, n = [], 0, len(passage)
    for m in _END.finditer(passage):
        over, end = m.end(1), m.end()
        if end < n and not passage[end].isspace():
            wide = max(passage.rfind(c, m.start(), over) for c in _FULL_WIDTH)
            if wide < 0:
                if end > over:
                    start = over
                continue
            end = wide + 1
        if s := passage[start:end].strip():
            out.append(s)
        start = over if end < over < m.end() else end
    return out


def full_sentence(sentence: str, least_words: int = 5, least_wide: int = 8) -> str | None:
    """The words of a sentence of prose, without inline code, paths and names of code; None if it is too short for one."""
    plain = _INLINE.sub(" ", sentence) if _CODED(sentence) else sentence
    if len(_WORD.findall(plain)) >= least_words or not plain.isascii() and len(_WIDE.findall(plain)) >= least_wide:
        return plain
    return None


#: ISO 639-1 code, ISO 639-3 code and English name of each language (fixed values).
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "german"), "fr": ("fra", "french"), "es": ("spa", "spanish"), "pt": ("por", "portuguese"),
    "it": ("ita", "italian"), "nl": ("nld", "dutch"), "pl": ("pol", "polish"), "ru": ("rus", "russian"), "ja": ("jpn", "japanese"),
}
_LABELS = {x: code for code, more in NAMES.items() for x in (code, *more)}


def label_language(label: str | None) -> str | None:
    """The language a label names, whatever its case or region; None if it names none of these."""
    return _LABELS.get(re.split(r"[-_]", (label or "").strip().lower(), maxsplit=1)[0].strip())


def segments(model: Model, text: str | None) -> list[tuple[str, float, int, int]]:
    """(language, confidence, full sentences, words) of each stretch of one language, in order.

    A sentence too short to be full is counted with the stretch before it and
    never makes one of its own.
    """
    out: list[list] = []
    for passage in passages(text):
        fresh = True
        for k, sentence in enumerate(sentences(passage)):
            plain = full_sentence(sentence)
            first = next((c for c in sentence if c.isalpha()), "")
            if plain is None or k == 0 and first.islower():
                if out and not fresh:
                    out[-1][3] += len(_WORD.findall(sentence))
                continue
            words = model.words(plain)
            lang, sure = model.classify_words(words)
            n = len(words) or 1
            if out and not fresh and out[-1][0] == lang:
                out[-1][1] = (out[-1][1] * out[-1][2] + sure) / (out[-1][2] + 1)
                out[-1][2] += 1
                out[-1][3] += n
            else:
                out.append([lang, sure, 1, n])
            fresh = False
    return [tuple(x) for x in out]


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(list(samples))


def language_segments(docs: DataFrame, doc_id: str, text: str, samples: DataFrame, lang: str = "lang", sample: str = "text", label: str | None = None, max_samples: int = 100_000) -> DataFrame:
    """(doc_id, label, segment, lang, confidence, n_sentences, n_words), one row per stretch of one language.

    ``label`` names a column that is carried along, so that a later comparison
    with it needs no join; without one it is null.  Null, empty and blank
    texts, and texts without a full sentence of prose, give no row.  Repeated
    documents give repeated rows.  The model is fitted on the labelled
    samples, of which at most ``max_samples`` are read, in order of language
    and text.
    """
    fitted = tuple((r[0], r[1]) for r in samples.select(F.col(f"`{lang}`").alias("l"), F.col(f"`{sample}`").alias("t")).dropna().orderBy("l", "t").limit(max_samples).collect())
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    carried = (F.col(f"`{label}`") if label else F.lit(None)).cast("string").alias("label")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), carried, F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in batches:
            found = [(key, tag, i, *s) for key, tag, t in zip(*(batch.column(k).to_pylist() for k in range(3))) for i, s in enumerate(segments(model, t))]
            columns = list(zip(*found)) if found else [()] * 7
            types = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], ["doc_id", "label", "segment", "lang", "confidence", "n_sentences", "n_words"])

    kind = dict(docs.dtypes)[doc_id]
    return spread(rows).mapInArrow(run, f"doc_id {kind}, label string, segment int, lang string, confidence double, n_sentences int, n_words int")


def labelled(column):
    """The language a label column names, as an expression."""
    first = F.trim(F.split(F.lower(F.trim(column)), "[-_]")[0])
    code = F.lit(None).cast("string")
    for key, names in NAMES.items():
        code = F.when(first.isin(key, *names), key).otherwise(code)
    return code


def missing_languages(found: DataFrame, sure: float = 0.8) -> DataFrame:
    """(doc_id, lang): languages with a full sentence in the text that the carried label does not name."""
    named = labelled(F.col("label"))
    return found.filter((F.col("confidence") >= sure) & (named.isNull() | (named != F.col("lang")))).select("doc_id", "lang").distinct()


def document_languages(docs: DataFrame, found: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, lang, confidence, n_languages, label, verdict) per document; verdict is right, wrong, missing or unknown.

    lang has the most words of prose (of equal ones the first by name), and
    confidence is the mean confidence of its words times their share.  A
    document without prose has lang = null and the verdict unknown.
    """
    per = found.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("words"), F.sum(F.col("confidence") * F.col("n_words")).alias("weight"))
    top = per.groupBy("doc_id").agg(
        F.max_by("lang", F.struct("words", F.expr("-ascii(lang) * 256 - ascii(substr(lang, 2))"))).alias("lang"), F.sum("words").alias("all_words"), F.count("*").alias("n_languages"), F.max(F.struct("words", "weight")).alias("best")
    )
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), labelled(F.col(f"`{label}`")).alias("label"))
    out = named.join(top, "doc_id", "left")
    verdict = F.when(F.col("lang").isNull(), "unknown").when(F.col("label").isNull(), "missing").when(F.col("label") == F.col("lang"), "right").otherwise("wrong")
    return out.select("doc_id", "lang", F.round(F.col("best.weight") / F.col("all_words"), 6).alias("confidence"), F.coalesce("n_languages", F.lit(0)).alias("n_languages"), "label", verdict.alias("verdict"))
