"""Column functions: paths, texts, scores, labels, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words no task is matched by (fixed values).
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need must to of in for on with at by from as into about "
    "like through after before between under above it its this that these those i me my we our you your he she they them and but or not no if then so very just also only "
    "fix add update change make get set new"
).split()
#: File name endings that name a role (fixed values).
ROLE_SUFFIXES = "_controller _service _repo _repository _handler _manager _factory _helper _view _model _test _middleware".split()
#: Path patterns of test files (fixed values).
TEST_PATTERNS = (r"tests?/", r"_test\.\w+$", r"test_\w+\.\w+$", r"\.test\.\w+$", r"\.spec\.\w+$")
#: Hints of test paths in pull requests (fixed values).
TEST_HINTS = ("/test_", "/tests/", "/testing/", "test_", "_test.py")
#: Top directories that connect everything (fixed values).
UTILITY_DIRS = ("utils", "helpers", "common", "shared", "lib", "core")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens_estimate(text) -> Column:
    """FN01: a quarter of the characters, rounded down."""
    return F.floor(F.length(_c(text)) / 4).cast("long")


def search_tokens(text) -> Column:
    """FN03: lower-case identifiers of two or more characters, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), lambda w: F.length(w) > 1)


def task_words(text) -> Column:
    """FN04: the set of words of a task, without stop words."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), F.array(*map(F.lit, STOP_WORDS))))


def path_words(path) -> Column:
    """FN05: the set of words of three or more characters in a path."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(_c(path)), "[/_. -]+"), lambda w: F.length(w) > 2)))


def top_module(path) -> Column:
    """FN06: the first directory; null for a file at the root."""
    return F.when(F.instr(_c(path), "/") > 0, F.substring_index(_c(path), "/", 1))


def _parts(path) -> Column:
    return F.filter(F.split(F.translate(_c(path), "\\", "/"), "/"), lambda p: p != "")


def module_at(path, depth: int) -> Column:
    """FN07: the directory at a depth, or the deepest there is."""
    parts = _parts(path)
    n = F.size(parts)
    at = F.when(F.lit(depth) < n - 1, F.lit(depth + 1)).otherwise(F.greatest(F.lit(1), n - 1))
    return F.when(n == 0, "").otherwise(F.try_element_at(parts, at))


def leaf_dir(path) -> Column:
    """FN07: the innermost directory."""
    parts = _parts(path)
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))


def normal_path(path) -> Column:
    """FN08: slashes, no doubled slash, no leading ./, no trailing slash."""
    p = F.regexp_replace(F.translate(F.trim(_c(path)), "\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "/$", "")


def is_test_file(path) -> Column:
    """FN09: any of the five patterns."""
    return F.coalesce(_c(path).rlike("|".join(f"(?:{p})" for p in TEST_PATTERNS)), F.lit(False))


def is_test_path(path) -> Column:
    """FN10: the variant for pull requests."""
    p = F.lower(F.translate(_c(path), "\\", "/"))
    out = p.startswith("tests/") | p.startswith("testing/")
    for hint in TEST_HINTS:
        out = out | p.contains(hint)
    return out


def stability(commits, lines) -> Column:
    """FN11: by the mean change of a commit and the number of commits."""
    mean = _c(lines) / _c(commits)
    return F.when(_c(commits) == 0, "stable").when((_c(lines) == 0) | (mean < 10), "tweaked").when((mean > 50) | (_c(commits) > 15), "volatile").otherwise("stable")


def stability_by_count(commits) -> Column:
    """FN12: the incremental variant, by commits alone."""
    return F.when(_c(commits) >= 20, "volatile").when(_c(commits) >= 5, "tweaked").otherwise("stable")


def contract_text(trigger, coupled, confidence) -> Column:
    """FN13: what a coupling says, for a test, one directory or two modules."""
    a, b = F.substring_index(_c(trigger), "/", -1), F.substring_index(_c(coupled), "/", -1)
    percent = F.concat(F.round(_c(confidence) * 100).cast("int").cast("string"), F.lit("%"))
    parent = lambda p: F.regexp_replace(_c(p), "/?[^/]*$", "")
    tested = F.lower(_c(coupled)).contains("test") & ~F.lower(_c(trigger)).contains("test")
    return (
        F.when(tested, F.concat(F.lit("test "), b, F.lit(" follows "), a, F.lit(" in "), percent))
        .when(parent(trigger) == parent(coupled), F.concat(a, F.lit(" and "), b, F.lit(" go together in "), percent))
        .otherwise(F.concat(a, F.lit(" needs "), b, F.lit(" elsewhere in "), percent))
    )


def severity(compliance) -> Column:
    """FN14: nudge from .8, note from .5, below that retired."""
    return F.when(_c(compliance) >= 0.8, "nudge").when(_c(compliance) >= 0.5, "note").otherwise("retired")


def gravity_label(degree) -> Column:
    """FN15."""
    return F.when(_c(degree) > 50, "CRITICAL HUB").when(_c(degree) > 10, "HIGH").when(_c(degree) > 3, "MODERATE").otherwise("LOW")


def route_regex(path) -> Column:
    """FN16: variables become one segment, the rest is literal, anchored."""
    marked = F.regexp_replace(F.regexp_replace(_c(path), r"\{[^}]+\}", "\u0001"), "<[^>]+>", "\u0001")
    literal = F.regexp_replace(marked, r"([.+*?^$()\[\]{}|\\-])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("\u0001"), F.lit("[^/]+")), F.lit("$"))


def methods_match(provider, consumer) -> Column:
    """FN17."""
    return (_c(provider) == "ALL") | (_c(consumer) == "ALL") | (F.upper(_c(provider)) == F.upper(_c(consumer)))


def paths_align(provider, consumer) -> Column:
    """FN19: equal, equal without an API prefix, or a suffix by whole segments."""
    p, c = F.regexp_replace(_c(provider), "/+$", ""), F.regexp_replace(_c(consumer), "/+$", "")
    out = p == c
    for prefix in ("/api/v1", "/api/v2", "/api"):
        bare = F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 100000)).otherwise(p)
        out = out | (bare == c)
    pp, cp = F.split(p, "/"), F.split(c, "/")
    tail = F.when(F.size(cp) <= F.size(pp), F.slice(pp, F.size(pp) - F.size(cp) + 1, F.size(cp)) == cp).otherwise(False)
    return out | tail


def route_confidence(provider, regex, consumer, handler) -> Column:
    """FN18: 1.0 by pattern, 0.8 by suffix, 0.5 by the view set's name, else 0."""
    root = F.lower(F.replace(_c(handler), F.lit("ViewSet"), F.lit("")))
    semantic = _c(handler).contains("ViewSet") & (root != "") & F.contains(F.regexp_replace(F.lower(_c(consumer)), "[-_]", ""), root)
    return F.when(F.rlike(_c(consumer), _c(regex)), 1.0).when(paths_align(provider, consumer), 0.8).when(semantic, 0.5).otherwise(0.0)


def confidence_label(confidence) -> Column:
    """FN20."""
    return F.when(_c(confidence) >= 1.0, "exact").when(_c(confidence) >= 0.8, "suffix").otherwise("semantic")


def code_only(line) -> Column:
    """FN21: a line without comment and string contents; empty for a comment line."""
    bare = F.regexp_replace(_c(line), r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*'", '""')
    return F.when(F.ltrim(_c(line)).startswith("#"), "").otherwise(F.regexp_replace(bare, "#.*$", ""))


def docstring_style(text) -> Column:
    """FN28: google, sphinx, numpy or other."""
    t = _c(text)
    return (
        F.when(t.rlike(r"(?m)^\s*(Args|Returns|Raises|Yields|Examples):"), "google").when(t.rlike(r"(?m)^\s*:(param|type|returns?|rtype|raises)\s*"), "sphinx")
        .when(t.rlike(r"(?m)^\s*(Parameters|Returns|Raises)\s*\n\s*-{3,}"), "numpy").otherwise("other")
    )


def bare_decorator(text) -> Column:
    """FN29: without @ and arguments."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), "^@+", ""), r"\(.*$", ""))


def role_suffixes(stem) -> Column:
    """FN29: the known role endings of a stem, in their order."""
    return F.filter(F.array(*map(F.lit, ROLE_SUFFIXES)), lambda s: F.endswith(_c(stem), s))


def title_words(text) -> Column:
    """FN29: a name from an identifier."""
    return F.initcap(F.translate(F.regexp_replace(_c(text), "^_+", ""), "_", " "))


def stem(path) -> Column:
    return F.regexp_replace(F.substring_index(_c(path), "/", -1), r"\.[^.]*$", "")


def f_beta(precision, recall, beta2: float) -> Column:
    """FN30: 0 where both are 0."""
    p, r = _c(precision), _c(recall)
    below = F.lit(beta2) * p + r
    return F.when(below > 0, (1 + beta2) * p * r / F.when(below > 0, below)).otherwise(0.0)


def effective_score(base, ratio, resolves, touched_age_days, explicit: bool) -> Column:
    """FN32: history counts from three resolves on, a tenth more if touched within 30 days; explicit files start from a half."""
    bonus = F.when(_c(resolves) >= 3, _c(ratio) * F.when(_c(touched_age_days) < 30, 1.1).otherwise(1.0)).otherwise(0.0)
    bonus = F.coalesce(bonus, F.lit(0.0))
    return _c(base) * F.greatest(F.lit(0.5) + bonus, F.lit(0.5)) if explicit else _c(base) * (F.lit(1.0) + bonus)


def recency_factor(kind, age_days) -> Column:
    """FN33: by stability and the age of the last change; an unknown age counts as old."""
    age = F.coalesce(_c(age_days), F.lit(181.0))
    return F.when((_c(kind) == "stable") & (age > 180), 0.75).when((_c(kind) == "volatile") & (age < 7), 1.2).when((_c(kind) == "volatile") & (age < 30), 1.1).otherwise(1.0)


def usage_factor(score) -> Column:
    """FN34."""
    return F.when(_c(score) > 0.3, 1.15).when(_c(score) < -0.3, 0.85).otherwise(1.0)


def decayed(base, acknowledgements) -> Column:
    """FN35: .1 less for each acknowledgement from the fourth on, at least .3."""
    return F.when(_c(acknowledgements) <= 3, _c(base)).otherwise(F.greatest(_c(base) - 0.1 * (_c(acknowledgements) - 3), F.lit(0.3)))


def hours_ago(seconds) -> Column:
    """FN36."""
    return F.greatest(F.lit(1), F.floor(_c(seconds) / 3600)).cast("long")


def short_hash(values, length: int) -> Column:
    """FN37: of a set of strings, whatever its order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(values), "|"), 256), 1, length)


def risk(n) -> Column:
    """FN38."""
    return F.when(_c(n) <= 3, "LOW").when(_c(n) <= 10, "MEDIUM").otherwise("HIGH")


def common_dir(a, b) -> Column:
    """FN41: the deepest directory above two paths."""
    x, y = F.slice(F.split(_c(a), "/"), 1, F.size(F.split(_c(a), "/")) - 1), F.slice(F.split(_c(b), "/"), 1, F.size(F.split(_c(b), "/")) - 1)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, v: F.struct((s["n"] + F.when(s["on"] & v, 1).otherwise(0)).alias("n"), (s["on"] & v).alias("on")), lambda s: s["n"])
    return F.array_join(F.slice(x, 1, n), "/")


def mean_line_length(text) -> Column:
    """FN42."""
    lines = F.split(_c(text), "\n")
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.size(lines)


def remote_id(remote) -> Column:
    """FN44: host and path of a git remote."""
    r = F.regexp_replace(F.lower(F.trim(_c(remote))), r"\.git$", "")
    r = F.regexp_replace(r, "^(https?://|ssh://)", "")
    return F.translate(F.regexp_replace(r, "^[^@/]*@", ""), ":", "/")


def task_text(message, files) -> Column:
    """FN58: the message, or the first three directories touched."""
    dirs = F.array_sort(F.array_distinct(F.transform(files, lambda f: F.coalesce(top_module(f), F.lit("root")))))
    return F.when(F.trim(_c(message)) != "", F.trim(_c(message))).otherwise(F.concat(F.lit("Modify "), F.array_join(F.slice(dirs, 1, 3), ", ")))


def section_text(sections, name: str) -> Column:
    """FN23: the text of a section by its name, whatever the case of either; null if there is none."""
    low = F.transform_keys(_c(sections), lambda k, v: F.lower(F.trim(k)))
    return F.try_element_at(low, F.lit(name.strip().lower()))


def billed_input(fresh, written, read) -> Column:
    """FN46: input tokens that are billed: fresh ones, those written to the cache and those read from it; a null counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(x), F.lit(0)) for x in (fresh, written, read)])
