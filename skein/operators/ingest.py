"""Pipelines that compose the other operators: graph, documents, scopes, and what comes out of them.

Every stage takes and gives DataFrames; nothing is run until a result is
written.  Files have repo, path and content and are identified by
``repo:path``; a module is a repo's first directory, ``_root`` without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import checkpointed
from ..functions import scalar as S
from . import history, retrieval, structure, textops
from .prefix import running

#: Priorities of fragments by kind (fixed values); comments have their own.
PRIORITY = {"architecture": 7, "readme": 5, "module_readme": 8, "docstring": 4, "api_surface": 8}


def module_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("_root")


# --- the graph


def build_graph(files: DataFrame, routes: DataFrame | None = None, calls: DataFrame | None = None) -> dict[str, DataFrame]:
    """GR04: analyze, resolve, link, cut into modules.

    Gives ``structure`` (repo, path, imports, classes, functions, ...),
    ``edges`` (repo, src, dst: paths), ``modules`` (repo, module, n_files,
    internal, external, cohesion) and, with routes and calls, ``network``.
    """
    found = structure.file_structure(files.select("repo", "path", "content"), ["repo", "path"], "path", "content")
    raw = found.select("repo", "path", F.explode(F.array_distinct("imports")).alias("import")).filter("import <> ''")
    known = files.select("repo", "path")
    dotted = structure.resolve_imports(raw, known, "repo")
    relative = structure.resolve_relative(raw.filter(F.col("import").startswith("./") | F.col("import").startswith("../")), known, "repo").filter("target <> import")
    edges = dotted.unionByName(relative).select("repo", F.col("path").alias("src"), F.col("target").alias("dst")).filter("src <> dst").distinct()
    out = {"structure": found, "edges": edges, "modules": module_summary(files, edges)}
    if routes is not None and calls is not None:
        from .network import match_routes

        out["network"] = match_routes(routes, calls)
    return out


def module_summary(files: DataFrame, edges: DataFrame) -> DataFrame:
    """GR04: (repo, module, n_files, internal, external, cohesion) by direct edges; 1.0 without any."""
    sizes = files.groupBy("repo", module_name(F.col("path")).alias("module")).agg(F.count("*").alias("n_files"))
    a, b = module_name(F.col("src")), module_name(F.col("dst"))
    counts = edges.groupBy("repo", a.alias("module")).agg(F.count_if(a == b).alias("internal"), F.count_if(a != b).alias("external"))
    out = sizes.join(counts, ["repo", "module"], "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return out.withColumn("cohesion", F.round(F.when(total > 0, F.col("internal") / total).otherwise(1.0), 6))


# --- documents


def _cut_sections(docs: DataFrame) -> DataFrame:
    """(repo, source, kind, no, heading, body) of each part of a markdown text with a body."""
    lines = F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n")
    numbered = docs.select("repo", "source", "kind", lines.alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.when(x.startswith("#"), i)), lambda i: i.isNotNull())
    cut = numbered.select("repo", "source", "kind", "_l", F.concat(F.array(F.lit(-1)), heads).alias("_at"))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_l")))
    parts = F.zip_with("_at", ends, lambda a, b: F.struct(F.when(a < 0, "Introduction").otherwise(F.trim(F.regexp_replace(F.get("_l", a), "^#+", ""))).alias("heading"), F.trim(F.array_join(F.slice("_l", a + 2, b - a - 1), "\n"), F.lit(" \n\t")).alias("body")))
    return cut.select("repo", "source", "kind", F.posexplode(parts).alias("no", "s")).select("repo", "source", "kind", "no", "s.heading", "s.body").filter("body <> ''")


def absorb(docs: DataFrame, files: DataFrame) -> DataFrame:
    """PIPE03: (repo, module, kind, source, no, priority, content): what is written about each module, in pieces.

    ``docs`` has repo, source, kind (readme or architecture) and text; its
    sections go to the first top directory of the repo, by name, that their
    text names.  ``files`` has repo, path, docstring and content: docstrings of
    more than 20 characters and signal comments go to the file's own module.
    """
    # The top directories of a repo are few; their names meet its sections as one array.
    dirs = files.filter(F.instr("path", "/") > 0).groupBy("repo").agg(F.array_sort(F.collect_set(F.substring_index("path", "/", 1))).alias("_dirs"))
    parts = _cut_sections(docs).join(dirs, "repo", "left")
    low = F.lower(F.concat_ws(" ", "heading", "body"))
    named = parts.withColumn("_low", low).withColumn("module", F.try_element_at(F.filter(F.coalesce("_dirs", F.array().cast("array<string>")), lambda d: F.contains(F.col("_low"), F.lower(d))), F.lit(1)))
    priority = F.when(F.col("kind") == "architecture", PRIORITY["architecture"]).otherwise(PRIORITY["readme"])
    sections = named.select("repo", F.coalesce("module", F.lit("_root")).alias("module"), "kind", "source", F.col("no").cast("long").alias("no"), priority.cast("int").alias("priority"), F.concat("heading", F.lit(":\n"), F.substring("body", 1, 500)).alias("content"))
    own = module_name(F.col("path"))
    strings = files.filter(F.length("docstring") > 20).select("repo", own.alias("module"), F.lit("docstring").alias("kind"), F.col("path").alias("source"), F.lit(0).cast("long").alias("no"), F.lit(PRIORITY["docstring"]).alias("priority"), F.col("docstring").alias("content"))
    key = F.struct("repo", "path").alias("key")
    marks = textops.signal_comments(files.select(key, "content"), "key", "content")
    comments = marks.select(F.col("key.repo").alias("repo"), module_name(F.col("key.path")).alias("module"), F.lit("comment").alias("kind"), F.col("key.path").alias("source"), F.col("no").cast("long").alias("no"), F.col("priority").cast("int").alias("priority"), F.col("text").alias("content"))
    return sections.unionByName(strings).unionByName(comments.filter("content <> ''"))


def context_of(fragments: DataFrame, most_chars: int = 1500) -> DataFrame:
    """PIPE03: (repo, module, n, chars): the fragments of each module that fit the characters, by priority, source and place."""
    order = [F.desc("priority"), F.col("source"), F.col("kind"), F.col("no")]
    used = running(fragments.withColumn("_len", F.length("content")), ["repo", "module"], order, F.col("_len"), "_used", "sum")
    return used.filter(F.col("_used") <= most_chars).groupBy("repo", "module").agg(F.count("*").alias("n"), F.sum("_len").alias("chars"))


# --- scopes


def synthesize(files: DataFrame, edges: DataFrame, couplings: DataFrame, contracts: DataFrame, commits: DataFrame, documented: DataFrame, strength: float = 0.7) -> DataFrame:
    """PIPE02: (repo, module, includes, related, tags, context, tokens, confidence): a scope for each module.

    ``files`` has repo, path and tokens; ``edges`` repo, src and dst (paths);
    ``couplings`` repo, file_a, file_b and strength; ``contracts`` repo,
    trigger, coupled and confidence; ``commits`` repo, file and n;
    ``documented`` repo and module.  Includes are the module's own directory
    and the files of others that it imports or changes with.  The context has
    its contracts (5), its often changed files (10) and its dependencies, or
    one line about its size where it has none of them.
    """
    key = ["repo", "module"]
    m = lambda c: module_name(F.col(c))
    out_edges = edges.select("repo", m("src").alias("module"), m("dst").alias("dep"), F.col("dst").alias("file")).filter("module <> dep").distinct()
    both = couplings.filter(F.col("strength") >= strength)
    both = both.select("repo", F.col("file_a").alias("x"), F.col("file_b").alias("file")).unionByName(both.select("repo", F.col("file_b").alias("x"), F.col("file_a").alias("file")))
    coupled = both.withColumn("module", m("x")).filter(F.col("module") != m("file")).select("repo", "module", "file")
    includes = out_edges.select("repo", "module", "file").unionByName(coupled).distinct().groupBy(*key).agg(F.array_sort(F.collect_set("file")).alias("_files"))
    deps = out_edges.groupBy(*key).agg(F.array_sort(F.collect_set("dep")).alias("_deps"))
    users = out_edges.groupBy("repo", F.col("dep").alias("module")).agg(F.array_sort(F.collect_set(F.col("module"))).alias("_users"))

    sides = contracts.withColumn("_m", F.explode(F.array_distinct(F.array(m("trigger"), m("coupled"))))).drop("module").withColumnRenamed("_m", "module")
    first = lambda df, order, n: df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_k") <= n)
    lines = lambda df, text: df.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", text.alias("t")))), lambda x: x["t"]), "\n").alias("_t"))
    promises = lines(first(sides, [F.desc("confidence"), F.col("trigger"), F.col("coupled")], 5), F.concat(F.lit("- "), "trigger", F.lit(" -> "), "coupled")).withColumnRenamed("_t", "_contracts")
    often = files.select("repo", F.col("path").alias("file"), m("path").alias("module")).join(commits.filter("n >= 3"), ["repo", "file"])
    changed = lines(first(often, [F.desc("n"), F.col("file")], 10), F.concat(F.lit("- "), F.substring_index("file", "/", -1), F.lit(": "), F.col("n").cast("string"), F.lit(" commits"))).withColumnRenamed("_t", "_changed")

    sizes = files.groupBy("repo", m("path").alias("module")).agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))
    inside = edges.groupBy("repo", m("src").alias("module")).agg((F.count_if(m("src") == m("dst")) / F.count("*")).alias("_cohesion"))
    out = sizes
    for part in (includes, deps, users, promises, changed, inside, documented.select(*key).distinct().withColumn("_doc", F.lit(True))):
        out = out.join(part, key, "left")
    none = F.array().cast("array<string>")
    dep, used = F.coalesce("_deps", none), F.coalesce("_users", none)
    linked = F.when(F.size(dep) > 0, F.concat(F.lit("imports from: "), F.array_join(dep, ", "))), F.when(F.size(used) > 0, F.concat(F.lit("used by: "), F.array_join(used, ", ")))
    context = F.concat_ws("\n", F.concat(F.lit("## Contracts\n"), "_contracts"), F.concat(F.lit("## Stability\n"), "_changed"), F.when(F.size(dep) + F.size(used) > 0, F.lit("## Dependencies")), *linked)
    context = F.when(context == "", F.concat("module", F.lit(": "), F.col("n_files").cast("string"), F.lit(" files"))).otherwise(context)
    cohesion = F.coalesce("_cohesion", F.lit(1.0))
    confidence = F.least(cohesion + F.when(F.col("_doc"), 0.1).otherwise(0.0) + F.when(F.col("_contracts").isNotNull(), 0.1).otherwise(0.0), F.lit(1.0))
    return out.select(
        "repo", "module", F.concat(F.array(F.concat("module", F.lit("/"))), F.coalesce("_files", none)).alias("includes"), F.array_sort(F.array_union(dep, used)).alias("related"),
        F.concat(F.array(F.lower("module")), F.transform(F.slice(dep, 1, 3), F.lower)).alias("tags"), context.alias("context"), "tokens", F.round(confidence, 6).alias("confidence"),
    )


def scope_index(scopes: DataFrame, most: int = 15) -> DataFrame:
    """PIPE06: (repo, module, keywords): tags, then the words of more than two letters of the first context line, at most ``most``."""
    words = F.filter(F.split(F.lower(F.substring_index("context", "\n", 1)), r"[^a-z0-9_]+"), lambda w: F.length(w) > 2)
    return scopes.select("repo", "module", F.slice(F.array_distinct(F.concat("tags", words)), 1, most).alias("keywords"))


def ingest(files: DataFrame, docs: DataFrame, touched: DataFrame, threshold: float = 0.5, rounds: int = 2) -> dict[str, DataFrame]:
    """PIPE01: everything that is derived from a repository's files, documents and history, by name.

    ``files`` has repo, path, content and docstring; ``docs`` repo, source,
    kind and text; ``touched`` repo, commit_id, ts and file.  Gives structure,
    edges, modules, couplings, contracts, fragments, scopes, index and
    backtest.  Files that a scope misses three times or more are included,
    in at most ``rounds`` rounds.
    """
    out = build_graph(files)
    # What several stages read is derived once; it is small beside the contents.
    out["edges"], touched = checkpointed(out["edges"]), checkpointed(touched)
    out["modules"] = module_summary(files.select("repo", "path"), out["edges"])
    named = touched.select("repo", "commit_id", "file", F.concat("repo", F.lit(":"), "file").alias("_name"))
    rows = named.select("commit_id", F.col("_name").alias("file"))
    split = lambda df, a, b: df.withColumn("repo", F.substring_index(a, ":", 1)).withColumns({c: F.regexp_replace(c, "^[^:]*:", "") for c in (a, b)})
    out["couplings"] = checkpointed(split(history.couplings(rows, threshold, top=None), "file_a", "file_b"))
    out["contracts"] = checkpointed(split(history.contracts(rows, top=None), "trigger", "coupled"))
    out["fragments"] = checkpointed(absorb(docs, files))
    counts = touched.groupBy("repo", "file").agg(F.countDistinct("commit_id").alias("n"))
    tokens = files.select("repo", "path", S.tokens_estimate("content").alias("tokens"))
    scopes = synthesize(tokens, out["edges"], out["couplings"], out["contracts"], counts, out["fragments"])
    scopes = checkpointed(scopes)
    for _ in range(rounds):
        scopes = checkpointed(auto_correct(scopes, touched))
    out["scopes"], out["index"], out["backtest"] = scopes, scope_index(scopes), backtest(scopes, touched)
    return out


def _misses(scopes: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits by the module they touch first of all, as (repo, commit_id, module, file), with what the scope covers."""
    per = touched.select("repo", "commit_id", "file", module_name(F.col("file")).alias("module")).distinct()
    most = per.groupBy("repo", "commit_id", "module").agg(F.count("*").alias("_n")).groupBy("repo", "commit_id").agg(F.min_by("module", F.struct((-F.col("_n")).alias("n"), "module")).alias("scope"))
    rows = per.join(most, ["repo", "commit_id"]).join(scopes.select("repo", F.col("module").alias("scope"), "includes"), ["repo", "scope"])
    covered = F.exists("includes", lambda i: (F.endswith(i, F.lit("/")) & F.startswith(F.col("file"), i)) | (i == F.col("file")))
    rows = rows.withColumn("covered", covered)
    return rows, rows.filter(~F.col("covered"))


def auto_correct(scopes: DataFrame, touched: DataFrame, least: int = 3) -> DataFrame:
    """SET11: scopes with the files added that they missed in ``least`` commits or more."""
    _, missed = _misses(scopes, touched)
    add = missed.groupBy("repo", F.col("scope").alias("module"), "file").agg(F.count("*").alias("n")).filter(F.col("n") >= least).groupBy("repo", "module").agg(F.array_sort(F.collect_set("file")).alias("_add"))
    out = scopes.join(add, ["repo", "module"], "left")
    return out.withColumn("includes", F.array_distinct(F.concat("includes", F.coalesce("_add", F.array().cast("array<string>"))))).drop("_add")


def backtest(scopes: DataFrame, touched: DataFrame) -> DataFrame:
    """AGG21: (repo, module, commits, recall): how much of a module's commits its scope covers."""
    rows, _ = _misses(scopes, touched)
    per = rows.groupBy("repo", F.col("scope").alias("module"), "commit_id").agg((F.count_if("covered") / F.count("*")).alias("r"))
    return per.groupBy("repo", "module").agg(F.count("*").alias("commits"), F.round(F.avg("r"), 6).alias("recall"))


def lazy_module(files: DataFrame, edges: DataFrame, touched: DataFrame, repo: str, module: str) -> dict[str, DataFrame]:
    """PIPE04: what one module needs, and nothing else: its files, the files one import away, and its history."""
    own = files.filter((F.col("repo") == repo) & (module_name(F.col("path")) == module)).select("repo", "path")
    of = edges.filter(F.col("repo") == repo)
    near = of.filter(module_name(F.col("src")) == module).select("repo", F.col("dst").alias("path"), F.lit("imports").alias("link"))
    near = near.unionByName(of.filter(module_name(F.col("dst")) == module).select("repo", F.col("src").alias("path"), F.lit("imported by").alias("link")))
    mine = touched.filter((F.col("repo") == repo) & (module_name(F.col("file")) == module))
    return {"files": own, "neighbours": near.filter(module_name(F.col("path")) != module).distinct(), "history": mine.groupBy("repo", "file").agg(F.countDistinct("commit_id").alias("commits"), F.max("ts").alias("last"))}


# --- checks and evaluation over history


def check_backtest(found: DataFrame, commits: DataFrame, last: int | None = None) -> DataFrame:
    """PIPE10: (repo, commits, clean, holds, notes): what the checks would have said about each repo's last commits.

    ``found`` has commit_id and severity (one row per violation), ``commits``
    repo, commit_id and ts.  A commit without a violation is clean.
    """
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("ts"), "commit_id"))
    rows = commits.select("repo", "commit_id", "ts").distinct()
    rows = rows.withColumn("_k", rank).filter(F.col("_k") <= last) if last else rows
    said = found.groupBy("commit_id").agg(F.count_if(F.col("severity").isin("hold", "guard")).alias("h"), F.count_if(~F.col("severity").isin("hold", "guard")).alias("n"))
    out = rows.join(said, "commit_id", "left").na.fill(0, ["h", "n"])
    return out.groupBy("repo").agg(F.count("*").alias("commits"), F.count_if((F.col("h") == 0) & (F.col("n") == 0)).alias("clean"), F.sum("h").alias("holds"), F.sum("n").alias("notes"))


def corpus(commits: DataFrame, min_files: int = 2, max_files: int = 15) -> DataFrame:
    """PIPE11: (commit_id, repo, task, expected_files, expected_tests): evaluation tasks from commits of a usable size.

    ``commits`` has commit_id, repo, message and files.  A commit of tests
    only is no task; without a message the task names the directories.
    """
    files = F.array_distinct(F.array_compact(F.coalesce("files", F.array().cast("array<string>"))))
    rows = commits.select("commit_id", "repo", "message", files.alias("expected_files")).filter(F.size("expected_files").between(min_files, max_files))
    rows = rows.withColumn("expected_tests", F.filter("expected_files", lambda f: S.is_test_file(f)))
    rows = rows.filter(F.size("expected_tests") < F.size("expected_files"))
    tops = F.array_sort(F.array_distinct(F.transform(F.filter("expected_files", lambda f: ~S.is_test_file(f)), module_name)))
    task = F.when(F.trim("message") != "", F.trim("message")).otherwise(F.concat(F.lit("change "), F.array_join(tops, ", ")))
    return rows.select("commit_id", "repo", task.alias("task"), "expected_files", "expected_tests")


def bootstrap_observations(tasks: DataFrame, predicted: DataFrame) -> DataFrame:
    """PIPE11: observations from a corpus and what is predicted for each repo: (commit_id, repo, recall, precision, touched_not_predicted)."""
    rows = tasks.join(predicted.select("repo", F.col("files").alias("_p")), "repo", "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<string>")))
    hit = F.size(F.array_intersect("expected_files", "_p"))
    share = lambda of: F.round(F.when(F.size(of) > 0, hit / F.size(of)).otherwise(1.0), 3)
    return rows.select("commit_id", "repo", share("expected_files").alias("recall"), share("_p").alias("precision"), F.array_except("expected_files", "_p").alias("touched_not_predicted"))


def gates(candidate: DataFrame, baseline: DataFrame, timings: DataFrame, group: str, crashes: int = 0, scope_writes: int = 0, tolerance: float = 0.02, resolve_ms: float = 500.0, check_ms: float = 1000.0) -> DataFrame:
    """AGG25: (group, gate, value, threshold, passed): the six gates of a candidate, per group.

    Observations have the group, recall and touched_not_predicted; timings
    have operation and duration_ms and hold for all groups.  Without a
    baseline its recall counts as 0 and its share of stale contexts as 1;
    without timings a latency is 0.
    """
    stale = F.avg((F.size(F.coalesce("touched_not_predicted", F.array().cast("array<string>"))) > 0).cast("double"))
    c = candidate.groupBy(group).agg(F.avg("recall").alias("cr"), stale.alias("cs"))
    b = baseline.groupBy(group).agg(F.avg("recall").alias("br"), stale.alias("bs"))
    rows = c.join(b, group, "left").withColumns({"br": F.coalesce("br", F.lit(0.0)), "bs": F.coalesce("bs", F.lit(1.0)), "cr": F.coalesce("cr", F.lit(0.0))})
    slow = timings.groupBy("operation").agg(F.percentile("duration_ms", 0.95).alias("p95"))
    took = slow.agg(*[F.coalesce(F.max(F.when(F.col("operation") == o, F.col("p95"))), F.lit(0.0)).alias(o) for o in ("resolve", "check")])
    gate = lambda name, value, limit, ok: F.struct(F.lit(name).alias("gate"), F.round(value, 4).alias("value"), F.round(limit, 4).alias("threshold"), ok.alias("passed"))
    zero = F.lit(0.0)
    each = F.array(
        gate("correctness", F.col("cr"), F.col("br") - tolerance, F.col("cr") >= F.col("br") - tolerance), gate("freshness", F.col("cs"), F.col("bs"), F.col("cs") <= F.col("bs")),
        gate("stability", F.lit(float(crashes)), zero, F.lit(crashes == 0)), gate("resolve_latency", F.col("resolve"), F.lit(float(resolve_ms)), F.col("resolve") <= resolve_ms),
        gate("check_latency", F.col("check"), F.lit(float(check_ms)), F.col("check") <= check_ms), gate("no_worktree_churn", F.lit(float(scope_writes)), zero, F.lit(scope_writes == 0)),
    )
    return rows.join(F.broadcast(took)).select(group, F.explode(each).alias("_gate")).select(group, "_gate.*")


def fitness(passed: DataFrame, scores: DataFrame, group: str) -> DataFrame:
    """AGG25: (group, fitness): primary + 0.01 of secondary, and 0 where any gate fails."""
    all_ = passed.groupBy(group).agg(F.every("passed").alias("_ok"))
    return all_.join(scores, group).select(group, F.when(F.col("_ok"), F.round(F.col("primary") + 0.01 * F.col("secondary"), 4)).otherwise(0.0).alias("fitness"))


def replay(tasks: DataFrame, ranked: DataFrame, budget: int) -> DataFrame:
    """PIPE12: (commit_id, repo, recall, precision, n_predicted): each task against the files of its repo that fit the budget.

    ``ranked`` has repo, file, tokens and score; a repo's files are taken by
    score, then name, as in ``greedy_fill``.
    """
    took = retrieval.greedy_fill(ranked, ["repo"], [-F.col("score"), F.col("file")], "tokens", budget, "file")
    per = took.groupBy("repo").agg(F.collect_set("file").alias("files"))
    out = bootstrap_observations(tasks, per).join(per.select("repo", F.size("files").cast("long").alias("n_predicted")), "repo", "left")
    return out.na.fill(0, ["n_predicted"]).select("commit_id", "repo", "recall", "precision", "n_predicted", "touched_not_predicted")


# --- reports


def report(sections: dict[str, DataFrame], order: dict[str, list], limit: int = 10) -> str:
    """PIPE17: derived tables as one markdown text; the limit is the length of each part."""
    from ..sources.sinks import markdown_table

    return "\n\n".join(f"## {name}\n\n{markdown_table(df, order[name], limit)}" for name, df in sections.items()) + "\n"


def summary_lines(backtest_rows: DataFrame) -> DataFrame:
    """PIPE17: (repo, line): one line for a terminal about each repo's checks."""
    n = lambda c: F.col(c).cast("string")
    verdict = F.when(F.col("holds") > 0, F.concat(F.lit(", "), n("holds"), F.lit(" would have been held"))).otherwise("")
    return backtest_rows.select("repo", F.concat(n("clean"), F.lit(" of "), n("commits"), F.lit(" commits clean, "), n("notes"), F.lit(" note(s)"), verdict).alias("line"))
