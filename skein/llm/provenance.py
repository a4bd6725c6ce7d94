"""Generated, minified, vendored and data files, by belief propagation over directory trees.

Each file gets evidence for five labels from its content and name, each
directory from its own name.  A directory's label says what its files and
subdirectories are likely to be; parent and child, and through the parent the
siblings, support each other.  The graph of one repository is a tree, so one
pass up and one pass down give the exact marginals.

Files are range-sorted once by (repo, directory components, file), which puts
every subtree into one stretch of rows; a directory or repository of any size
is cut over as many partitions as its rows need.  A directory whose subtree
lies within a partition is finished there.  Only those on the path to a
partition's first and last directory may go on in another one: their partial
sums, at most two paths a partition, are combined and passed back, and a
second scan of the partitions goes down the trees to the files.  So the number
of jobs does not depend on the depth or the size of the trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed, latest, shuffle_parts, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
_N = len(LABELS)
#: P(file label | directory label), rows by directory.
_FILE = (
    (0.66, 0.12, 0.08, 0.08, 0.06),
    (0.02, 0.92, 0.02, 0.02, 0.02),
    (0.20, 0.02, 0.74, 0.02, 0.02),
    (0.01, 0.02, 0.02, 0.93, 0.02),
    (0.30, 0.02, 0.02, 0.02, 0.64),
)
#: P(subdirectory label | directory label).
_DIR = (
    (0.980, 0.006, 0.004, 0.008, 0.002),
    (0.003, 0.994, 0.001, 0.001, 0.001),
    (0.10, 0.02, 0.84, 0.02, 0.02),
    (0.002, 0.001, 0.001, 0.995, 0.001),
    (0.30, 0.05, 0.05, 0.05, 0.55),
)
#: Files a partition of the sorted files should have at most; one task holds the numbers of that many files.
_FILES_A_PARTITION = 250_000

#: Names of directories and what they speak for, as log odds (fixed values).
DIRECTORY_NAMES = {
    "node_modules": ("vendored", 12.0), "vendor": ("vendored", 12.0), "_vendor": ("vendored", 12.0), "third_party": ("vendored", 12.0), "third-party": ("vendored", 12.0), "thirdparty": ("vendored", 12.0),
    "3rdparty": ("vendored", 12.0), "3rd_party": ("vendored", 12.0), "Godeps": ("vendored", 12.0), "bower_components": ("vendored", 12.0), "jspm_packages": ("vendored", 12.0), "site-packages": ("vendored", 12.0),
    "external": ("vendored", 9.0), "externals": ("vendored", 9.0), "deps": ("vendored", 9.0), "bundled": ("vendored", 9.0), "Pods": ("vendored", 12.0), "Carthage": ("vendored", 12.0), "vendored": ("vendored", 12.0), "subprojects": ("vendored", 3.0),
    "generated": ("generated", 9.0), "gen": ("generated", 9.0), "__generated__": ("generated", 9.0), "autogen": ("generated", 9.0), "generated-sources": ("generated", 9.0), "codegen_out": ("generated", 9.0),
    "dist": ("minified", 2.0), "min": ("minified", 2.0),
}

_MARK = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto-?generated\b(?!\s+(?:summary|names?))"
    r"|\b(?:code|file|source|class|module|output)\b[^.]{0,40}\b(?:is|was|were|has been)?\s*(?:automatically |machine[- ])?(?:generated|produced|emitted|created) by\b"
    r"|\bgenerated (?:from|by|with|using)\b.{0,80}(?:do not (?:edit|modify|change)|on every build|by hand is|changes? (?:will|may) be (?:lost|overwritten))"
    r"|\b(?:code|file) generated (?:by|from)\b|\bmachine[- ](?:made|generated|written)\b|\bmanual (?:edits|changes) (?:get|will be|are) (?:overwritten|lost)"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht von hand (?:ändern|bearbeiten)|\b(?:est|a été) (?:produit|généré|créé)\w* par\b|\bne pas (?:modifier|éditer)\b"
    r"|\bgenerado (?:automáticamente|por)\b|\bno (?:editar|modificar)\b|\bgenerato (?:automaticamente|da)\b|\bnon modificare\b|\bgerado (?:automaticamente|por)\b|\bnão (?:editar|alterar|modificar)\b"
    r"|\bautomatisch gegenereerd\b|\bniet (?:handmatig )?(?:bewerken|wijzigen)\b|\bwygenerowan\w* (?:automatycznie|przez)\b|\bnie edytować\b|\bсгенерирован\w*\b|\bне редактировать\b|自動生成",
    re.I,
)
_BY_HAND = re.compile(r"\b(?:kept|written|maintained|edited) by hand\b|\bby hand[.;]?$|\bhand[- ]?written\b|\bhelpers? for\b|\bthe files generated by\b", re.I)
_OPEN = re.compile(r"\s*(?://+[!/]?|#(?![!\[])|/\*+!?|\*+/?|<!--|--|;)\s?")
_NAME = re.compile(r"_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h)$|[._](?:gen|generated|autogen)\.\w+$|[a-z0-9]Generated\.java$|\.g\.\w+$|\.designer\.\w+$|_generated\.\w+$")
_MIN_NAME = re.compile(r"[.-]min\.(?:js|ts|css|py|go|rs|java)$|[.-](?:bundle|prod|chunk)\.\w+$|[.-][0-9a-f]{8,}\.(?:js|ts)$")
_NOTICE = re.compile(
    r"^(?P<banner>!?\s*@?(?:license\s+)?(?P<p1>[A-Za-z][\w.-]*) v?\d+\.\d+(?:\.\d+)?)\s*(?:\(|\||-|$)"
    r"|\bcopyright\b.{0,20}?(?:\d{4}(?:\s*[-,]\s*\d{4})*)\s+(?:by |the )?(?P<p2>.+?)(?:\s+(?:contributors|authors|maintainers|developers|team|project|foundation|inc)\b|[.,;(]|$)"
    r"|\bimported (?:unchanged |verbatim )?from (?:the )?(?P<p3>[\w.-]+)|\bpart of (?:the )?(?P<p4>[\w-]+)\b.{0,40}\blicen[sc]ed\b|\bthis is a third[- ]party component \(?(?P<p5>[\w.-]+)"
    r"|\bvendored (?:copy of|from) (?:the )?(?P<p6>[\w.-]+)|\bcopied (?:unchanged |verbatim )?from (?:the )?(?P<p7>[\w.-]+) (?:project|library|repository)|\bsee notice of (?P<p8>[\w-]+)",
    re.I,
)
_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_DATA = re.compile(r"\"[^\"\\\s]*\"|'[^'\\\s]*'|`[^`\\\s]*`|\"(?:[^\"\\\n]|\\[xu0-7nrt\\\"])*\"(?=\s*[,:\]})])|[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]?\w{0,3}")
_PUNCTUATION = str.maketrans("", "", " ,[](){}:;=+\t")
_IDENT = re.compile(r"[^\W\d]\w*")
_COUNTED = re.compile(r"(?<!\w)([A-Za-z_]\w*?)_?(\d{2,5})\b")
_KEYWORDS = frozenset("var let const function return for in if else new void this null true false def lambda class import from of while do switch case break static public private final int long fn pub func type package".split())


def _data_share(text: str) -> tuple[float, int]:
    """The share of non-blank characters on lines that are nearly all literal data, and their number."""
    total = data = 0
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            continue
        total += len(bare)
        taken = sum(map(len, _DATA.findall(bare)))
        if taken < 8:
            continue
        rest = len(bare.translate(_PUNCTUATION)) - taken
        if rest <= max(3, 0.15 * len(bare)):
            data += len(bare)
        elif taken > 200 and taken > 0.8 * len(bare):
            data += taken
    return (data / total if total else 0.0), data


def _short_names(text: str) -> float:
    names = [n for n in _IDENT.findall(re.sub(_STRING, "", text)) if n not in _KEYWORDS]
    return sum(len(n) <= 3 for n in names) / len(names) if len(names) >= 10 else 0.0


def _counted(text: str) -> int:
    """Longest chain of declarations numbered one after the other under one name."""
    seen: dict[str, set[int]] = {}
    for name, number in _COUNTED.findall(text):
        if number[0] == "0" or len(number) >= 3:
            seen.setdefault(name, set()).add(int(number))
    best = 0
    for numbers in seen.values():
        run, last = 0, None
        for n in sorted(numbers):
            run = run + 1 if last is not None and n == last + 1 else 1
            best, last = max(best, run), n
    return best


def comments(text: str) -> list[str]:
    """What the comments say, line by line: whole-line comments, and ``/* */`` inside a line, of any length."""
    out = []
    for line in text.split("\n"):
        m = _OPEN.match(line)
        if m:
            said = line[m.end() :]
            for close in ("*/", "-->"):
                at = said.find(close)
                if at >= 0:
                    said = said[:at]
            if said := said.strip():
                out.append(said)
        at = line.find("/*", m.end() if m else 0)
        while at >= 0 and (close := line.find("*/", at + 2)) >= 0:
            if said := line[at + 2 : close].strip(" *!\t"):
                out.append(said)
            at = line.find("/*", close + 2)
    return out


def _notices(said: list[str], repo: str) -> bool:
    """Does a comment anywhere carry another project's notice?"""
    own = re.sub(r"[\W_]+", "", (repo or "").lower())
    for line in said:
        for n in _NOTICE.finditer(line):
            project = next((p for p in (n[f"p{i}"] for i in range(1, 9)) if p), "")
            key = re.sub(r"[\W_]+", "", project.lower())
            if key and not (len(own) >= 3 and own in key or own == key):
                return True
    return False


def _marked(said: list[str]) -> bool:
    """Does a comment say that a tool wrote the file?"""
    return any(_MARK.search(line) and not _BY_HAND.search(line.replace("nicht von Hand", "")) for line in said)


class Limits(NamedTuple):
    """From which size on the shape of a text speaks for data or minified code.

    Shorter literals are constant tables, shorter lines an ordinary style, as a hand-written file may hold them.
    """

    data_characters: int = 300
    longest_line: int = 120
    mean_line: int = 70
    mean_dense_line: int = 200


def evidence(repo: str | None, path: str | None, content: str, limits: Limits = Limits()) -> list[float]:
    """Log potentials of the five labels from one file alone, from its whole text."""
    name = (path or "").rsplit("/", 1)[-1]
    out = [2.0, 0.0, -1.0, 0.8, -1.0]
    said = comments(content)
    if _marked(said):
        out[1] += 8
    if _NAME.search(name):
        out[1] += 4
    if _counted(content) >= 4:
        out[1] += 5
    if _notices(said, repo or ""):
        out[3] += 8
    share, size = _data_share(content)
    if share > 0.55 and size > limits.data_characters:
        out[4] += 8
    elif share > 0.4 and size > limits.data_characters:
        out[4] += 2
    blank = 1 - len("".join(content.split())) / len(content) if content else 0.0
    lines = [x for x in content.split("\n") if x.strip()]
    longest = max(map(len, lines), default=0)
    mean = len(content) / max(1, len(lines))
    short = _short_names(content)
    if share <= 0.55 and longest > limits.longest_line and (short > 0.6 and blank < 0.16 and mean > limits.mean_line or blank < 0.05 and mean > limits.mean_dense_line):
        out[2] += 9
    if _MIN_NAME.search(name):
        out[2] += 2 if short > 0.3 or blank < 0.1 else 0.5
    return out


def _columns(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(_N)]


_LOG_FILE, _LOG_DIR = np.log(np.array(_FILE)), np.log(np.array(_DIR))
_NAMED = {name: np.array([odds if label == speaks else 0.0 for label in LABELS]) for name, (speaks, odds) in DIRECTORY_NAMES.items()}


def _lse(terms: np.ndarray, axis: int = -1) -> np.ndarray:
    top = terms.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(terms - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _said(child: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Message to the parent: log sum over child labels of P(child | parent) times the child's belief."""
    return _lse(child[..., None, :] + table)


def _told(parent: np.ndarray, said: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Message to a child: from the parent's belief without what this child said."""
    return _lse((parent - said)[..., :, None] + table, axis=-2)


def _name_odds(directory: tuple[str, ...]) -> np.ndarray | float:
    return _NAMED.get(directory[-1], 0.0) if directory else 0.0


class _Trees:
    """The directories of one partition of the sorted files, in preorder, with what their files say.

    ``rows`` has repo, dir (joined), depth and the file potentials, in sorted
    order.  Every directory stands behind its parent, those without files too.
    """

    def __init__(self, rows: pd.DataFrame):
        self.potentials = rows[_columns("f")].to_numpy(dtype=np.float64)
        self.messages = _said(self.potentials, _LOG_FILE)
        repos, dirs, depths = rows["repo"].to_numpy(), rows["dir"].to_numpy(), rows["depth"].to_numpy()
        heads = np.flatnonzero(np.r_[True, (repos[1:] != repos[:-1]) | (dirs[1:] != dirs[:-1]) | (depths[1:] != depths[:-1])]) if len(rows) else np.empty(0, dtype=np.int64)
        self.names: list[tuple[str, tuple[str, ...]]] = []
        self.parent: list[int] = []
        at_head: list[int] = []
        path: list[int] = []
        repo, first = None, True
        for h in heads:
            parts = tuple(dirs[h].split("/")) if depths[h] else ()
            if first or repos[h] != repo:
                repo, first, path = repos[h], False, []
            keep = 0
            while keep < len(path) and keep <= len(parts) and self.names[path[keep]][1] == parts[:keep]:
                keep += 1
            del path[keep:]
            for depth in range(keep, len(parts) + 1):
                self.names.append((repo, parts[:depth]))
                self.parent.append(path[-1] if path else -1)
                path.append(len(self.names) - 1)
            at_head.append(path[-1])
        self.node = np.repeat(np.array(at_head, dtype=np.int64), np.diff(np.r_[heads, len(rows)])) if len(heads) else np.empty(0, dtype=np.int64)
        self.belief = np.zeros((len(self.names), _N))
        np.add.at(self.belief, self.node, self.messages)
        # The paths to the first and to the last directory may go on in other partitions.
        self.open = np.zeros(len(self.names), dtype=bool)
        for i in (at_head[0], at_head[-1]) if at_head else ():
            while i >= 0:
                self.open[i] = True
                i = self.parent[i]
        self.said = np.zeros((len(self.names), _N))
        for i in range(len(self.names) - 1, -1, -1):
            if not self.open[i]:
                self.belief[i] += _name_odds(self.names[i][1])
                self.said[i] = _said(self.belief[i], _LOG_DIR)
                self.belief[self.parent[i]] += self.said[i]

    def partials(self) -> list[tuple[str, list[str], list[float]]]:
        """(repo, directory, sum of what was said below it here) of the open directories."""
        return [(self.names[i][0], list(self.names[i][1]), self.belief[i].tolist()) for i in np.flatnonzero(self.open)]

    def files(self, totals: dict[tuple[str, tuple[str, ...]], np.ndarray]) -> np.ndarray:
        """The log potentials of all files with what their trees tell them; ``totals`` has the beliefs of the open directories."""
        for i in range(len(self.names)):
            if self.open[i]:
                self.belief[i] = totals[self.names[i]]
            else:
                self.belief[i] += _told(self.belief[self.parent[i]], self.said[i], _LOG_DIR)
        return self.potentials + _told(self.belief[self.node], self.messages, _LOG_FILE)


def _combined(partials: list) -> dict[tuple[str, tuple[str, ...]], np.ndarray]:
    """The beliefs of the directories that partitions share; each one's parent is among them."""
    sums: dict[tuple[str, tuple[str, ...]], np.ndarray] = {}
    for repo, directory, partial in partials:
        key = (repo, tuple(directory))
        sums[key] = sums.get(key, 0.0) + np.array(partial)
    order = sorted(sums, key=lambda k: len(k[1]))
    said = {}
    for key in reversed(order):
        sums[key] = sums[key] + _name_odds(key[1])
        if key[1]:
            said[key] = _said(sums[key], _LOG_DIR)
            sums[key[0], key[1][:-1]] = sums[key[0], key[1][:-1]] + said[key]
    for key in order:
        # The prior at the roots is that of a directory under a handwritten one.
        sums[key] = sums[key] + (_told(sums[key[0], key[1][:-1]], said[key], _LOG_DIR) if key[1] else _LOG_DIR[0])
    return sums


def _open_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if held:
        yield pd.DataFrame(_Trees(pd.concat(held, ignore_index=True)).partials(), columns=["repo", "dir", "partial"])


def _labels(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        scores = _Trees(rows).files(sent.value)
        best = scores.max(axis=1)
        # At equal belief the first label wins; sums in another order differ by rounding.
        at = (scores >= best[:, None] - 1e-9).argmax(axis=1)
        yield pd.DataFrame({"file_id": rows["file_id"], "repo": rows["repo"], "path": rows["path"], "label": np.array(LABELS)[at], "confidence": np.round(np.exp(best - _lse(scores)), 6)})

    return run


def label_files(df: DataFrame, at: str | None = "recorded_at", limits: Limits = Limits(), partitions: int | None = None) -> DataFrame:
    """(file_id, repo, path, label, confidence), one row per file with a content.

    Of rows with one file_id the latest ``at`` counts; rows with a null
    file_id or a null content drop out.  A null repo or path counts as an
    empty one.  An empty content is handwritten unless its place says
    otherwise.  At equal belief the first label of LABELS wins.  Other columns
    are never read, whatever their names.

    Collected are the directories on two paths a partition, which is bounded
    by the number of partitions and the depth of the trees.
    """
    rows = df.select(
        F.col("file_id").cast("long"), F.coalesce(F.col("repo").cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        (F.col(at) if at else F.lit(None)).cast("timestamp").alias("at"), F.col("content").cast("string"),
    ).filter("file_id is not null")
    rows = spread(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repos, paths, texts = (batch.column(i).to_pylist() for i in (1, 2, 4))
            got = [[None] * _N if t is None else evidence(r, p, t, limits) for r, p, t in zip(repos, paths, texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array([g[i] for g in got], type=pa.float64()) for i in range(_N))], ["file_id", "repo", "path", "at", *_columns("f")])

    schema = "file_id long, repo string, path string, at timestamp, " + ", ".join(f"{c} double" for c in _columns("f"))
    files = rows.mapInArrow(run, schema)
    if at:
        files = latest(files, ["file_id"], "at")
    parts = F.split(F.translate("path", "\\", "/"), "/")
    files = checkpointed(files.filter("f0 is not null").select("file_id", "repo", "path", F.slice(parts, 1, F.size(parts) - 1).alias("parts"), *_columns("f")))
    count = partitions or max(1, min(shuffle_parts(df.sparkSession), files.rdd.getNumPartitions()), -(-files.count() // _FILES_A_PARTITION))
    order = ["repo", "parts", "file_id"]
    kept = files.repartitionByRange(count, *order).sortWithinPartitions(*order)
    kept = checkpointed(kept.select("file_id", "repo", "path", F.array_join("parts", "/").alias("dir"), F.size("parts").alias("depth"), *_columns("f")))
    partials = kept.mapInPandas(_open_directories, "repo string, dir array<string>, partial array<double>").collect()
    sent = df.sparkSession.sparkContext.broadcast(_combined(partials))
    return kept.mapInPandas(_labels(sent), "file_id long, repo string, path string, label string, confidence double")
