"""Small configuration texts, parsed on the driver: scope files, indexes, rule files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def parse_yaml(text: str) -> dict:
    """SRC17: a subset of YAML: scalars, lists, literal blocks, maps one level deep, comments.

    Scalars stay strings; a repeated key keeps its last value; a line that
    fits nothing is an error with its number.
    """
    out: dict = {}
    lines = text.splitlines()
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        bare = _uncommented(line)
        if not bare.strip():
            continue
        m = re.match(r"^([\w.-]+)\s*:\s*(.*)$", bare)
        if not m:
            raise ValueError(f"line {i}: {line!r}")
        key, value = m[1], m[2].strip()
        if value in ("|", ">"):
            block = []
            while i < len(lines) and (not lines[i].strip() or lines[i][:1] in " \t"):
                block.append(lines[i])
                i += 1
            indent = min((len(b) - len(b.lstrip()) for b in block if b.strip()), default=0)
            body = [b[indent:].rstrip() for b in block]
            out[key] = ("\n" if value == "|" else " ").join(body).strip()
        elif value.startswith("[") and value.endswith("]"):
            out[key] = [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", value) if x.strip()]
        elif value:
            out[key] = _scalar(value)
        else:
            items, pairs = [], {}
            while i < len(lines) and (not lines[i].strip() or lines[i][:1] in " \t-"):
                inner = _uncommented(lines[i]).strip()
                i += 1
                if not inner:
                    continue
                if inner.startswith("-"):
                    items.append(_scalar(inner[1:]))
                elif (p := re.match(r"^([^:]+):\s*(.*)$", inner)):
                    pairs[p[1].strip()] = _scalar(p[2])
                else:
                    raise ValueError(f"line {i}: {lines[i - 1]!r}")
            out[key] = items if items or not pairs else pairs
    return out


def _uncommented(line: str) -> str:
    m = re.match(r"^((?:[^#\"']|\"[^\"]*\"|'[^']*'|(?<=\S)#|['\"])*?)(?:(?:^|(?<=\s))#.*)?$", line)
    return (m[1] if m else line).rstrip()


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def to_yaml(data: dict) -> str:
    """SNK07: what parse_yaml reads back to the same."""
    out = []
    for key, value in data.items():
        if isinstance(value, list):
            out += [f"{key}:", *[f"  - {_quoted(x)}" for x in value]] if value else [f"{key}: []"]
        elif isinstance(value, dict):
            out += [f"{key}:", *[f"  {k}: {_quoted(v)}" for k, v in value.items()]]
        elif "\n" in str(value):
            out += [f"{key}: |", *[f"  {x}" for x in str(value).split("\n")]]
        else:
            out.append(f"{key}: {_quoted(value)}")
    return "\n".join(out) + "\n"


def _quoted(value) -> str:
    text = str(value)
    return f'"{text}"' if text == "" or re.search(r"^[\[\-|>\"']|#|^\s|\s$", text) and '"' not in text else text


def scopes_frame(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """SRC18: scope files by path as a table (path, description, includes, excludes, tags, context)."""
    rows = []
    for path, text in sorted(texts.items()):
        d = parse_yaml(text)
        lists = [d.get(k) if isinstance(d.get(k), list) else [d[k]] if d.get(k) else [] for k in ("includes", "excludes", "tags")]
        rows.append((path, d.get("description", ""), *lists, d.get("context", "")))
    return spark.createDataFrame(rows, "path string, description string, includes array<string>, excludes array<string>, tags array<string>, context string")


def parse_items(text: str, section: str) -> list[dict]:
    """SRC26: the list of maps below ``section:``; values are scalars, ``[a, b]`` lists or block lists of scalars."""
    lines = text.splitlines()
    at = next((i for i, line in enumerate(lines) if re.match(rf"^{re.escape(section)}\s*:\s*$", _uncommented(line))), None)
    out: list[dict] = []
    key = None
    for line in lines[at + 1 :] if at is not None else []:
        bare = _uncommented(line)
        if not bare.strip():
            continue
        if bare[0] not in " \t-":
            break
        inner = bare.strip()
        m = re.match(r"^(-\s+)?([\w.-]+)\s*:\s*(.*)$", inner)
        if m and m[1] or not out:
            out.append({})
        if m:
            key, value = m[2], m[3].strip()
            listed = value.startswith("[") and value.endswith("]")
            out[-1][key] = [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", value) if x.strip()] if listed else _scalar(value) if value else []
        elif inner.startswith("-") and key is not None:
            held = out[-1].get(key)
            out[-1][key] = [*(held if isinstance(held, list) else [held]), _scalar(inner[1:])]
    return [x for x in out if x]


def _texts(value) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else [str(value)] if value not in (None, "") else []


def intents_frame(spark: SparkSession, text: str) -> DataFrame:
    """SRC26: the intents of a rule file as (directive, modules, files, target, reason)."""
    rows = [(d.get("directive", ""), _texts(d.get("modules")), _texts(d.get("files")), d.get("target"), d.get("reason")) for d in parse_items(text, "intents")]
    return spark.createDataFrame(rows, "directive string, modules array<string>, files array<string>, target string, reason string")


def conventions_frame(spark: SparkSession, text: str) -> DataFrame:
    """SRC26: the conventions of a rule file as (name, criteria, rules), criteria and rules as maps of texts."""
    rows = [(d.get("name", ""), *({k[len(p) :]: ",".join(_texts(v)) for k, v in d.items() if k.startswith(p)} for p in ("match_", "rule_"))) for d in parse_items(text, "conventions")]
    return spark.createDataFrame(rows, "name string, criteria map<string,string>, rules map<string,string>")


def voice_config(text: str) -> dict[str, str]:
    """SRC26: the voice settings of a rule file."""
    found = parse_yaml(text).get("voice", {})
    return {k: v for k, v in found.items()} if isinstance(found, dict) else {}


def assertions_frame(spark: SparkSession, text: str) -> DataFrame:
    """SRC26: the assertions of a rule file as (scope, includes, contains, constraints, reason); scope * holds everywhere."""
    rows = [
        (d.get("scope", "*"), _texts(d.get("ensure_includes")), _texts(d.get("ensure_context_contains")), str(d.get("ensure_constraints", "")).lower() == "true", d.get("reason"))
        for d in parse_items(text, "assertions")
    ]
    return spark.createDataFrame(rows, "scope string, includes array<string>, contains array<string>, constraints boolean, reason string")
