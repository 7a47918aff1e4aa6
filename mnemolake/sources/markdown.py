"""Topics as markdown: rendering, reading back, safe names, versions."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.text import slug

SECTIONS = {"fact": "Facts", "solution": "Solutions", "preference": "Preferences", "procedure": "Procedures", "strategy": "Strategies"}
HEADED = {"solution": ("problem", "fix"), "procedure": ("trigger", "steps"), "strategy": ("problem_pattern", "strategy")}
STRATEGY_FIELDS = {"Preconditions": "preconditions", "Expected signals": "expected_signals", "Failure modes": "failure_modes"}


def render(title: str, summary: str, tags: Sequence[str], confidence: float, records: Sequence[Mapping[str, str]]) -> str:
    """Front matter, then a section for each kind of record that there is."""
    out = ["---", f"title: {title}", f"summary: {summary}", f"tags: [{', '.join(tags)}]", f"confidence: {confidence:.2f}", "---", "", f"# {title}", ""]
    for kind, name in SECTIONS.items():
        own = [r for r in records if r.get("type", "fact") == kind]
        if not own:
            continue
        out += [f"## {name}", ""]
        for r in own:
            if kind == "fact":
                out.append(f"- **{r['subject']}**: {r['info']}")
            elif kind == "preference":
                out.append(f"- **{r['key']}**: {r['value']}" + (f" ({r['context']})" if r.get("context") else ""))
            else:
                head, body = HEADED[kind]
                out += [f"### {r[head]}", "", r[body]]
                out += [f"- {label}: {r[f]}" for label, f in STRATEGY_FIELDS.items() if kind == "strategy" and r.get(f)]
                out += [f"*Context: {r['context']}*"] if r.get("context") else []
                out.append("")
        out.append("")
    return "\n".join(out).rstrip() + "\n"


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The key: value lines between the first pair of --- lines, and the rest."""
    m = re.match(r"---\n(.*?)\n---\n?(.*)", text, re.DOTALL)
    if not m:
        return {}, text
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in m[1].splitlines()) if k.strip()}, m[2]


def _bullet(line: str) -> tuple[str, str] | None:
    """Label and text of a bullet that has both; stars around the label go."""
    mark, body = line[:1], line[1:].strip()
    if mark not in ("-", "*") or not line[1:2].isspace():
        return None
    label, colon, text = body[2:].partition("**:") if body.startswith("**") else body.partition(":")
    return (label.strip(), text.strip()) if colon and label.strip() and text.strip() else None


def _with_context(value: str) -> dict[str, str]:
    """A value, and what stands in brackets at its end."""
    head, open_, tail = value.removesuffix(")").rpartition(" (")
    if value.endswith(")") and open_ and tail and not set("()") & set(tail):
        return {"value": head.strip(), "context": tail.strip()}
    return {"value": value}


def _headed(kind: str, head: str, lines: list[str]) -> dict[str, str] | None:
    """The record of a heading and the lines below it."""
    record, body = {}, []
    fields = {label.lower(): f for label, f in STRATEGY_FIELDS.items()} if kind == "strategy" else {}
    for line in filter(None, lines):
        labelled = _bullet(line)
        if line.startswith("*Context:") and line.endswith("*") and line[9:-1].strip():
            record["context"] = line[9:-1].strip()
        elif labelled and labelled[0].lower() in fields:
            record[fields[labelled[0].lower()]] = labelled[1]
        else:
            body.append(line)
    first, second = HEADED[kind]
    return {"type": kind, first: head, second: "\n".join(body)} | record if head and body else None


def parse(text: str) -> list[dict[str, str]]:
    """Records of a rendered topic: bullets of the sections that have them, headings with their lines of the others."""
    kinds = {name.lower(): kind for kind, name in SECTIONS.items()}
    records: list[dict[str, str] | None] = []
    kind, head, lines = None, None, []

    def close() -> None:
        if head is not None and kind in HEADED:
            records.append(_headed(kind, head, lines))

    for line in (*map(str.strip, front_matter(text)[1].splitlines()), "## "):
        level, _, name = line.partition(" ") if line.startswith("#") else ("", "", "")
        if level == "##":
            close()
            kind, head, lines = kinds.get(name.strip().lower()), None, []
        elif level == "###" and kind in HEADED:
            close()
            head, lines = name.strip(), []
        elif kind in HEADED:
            lines.append(line)
        elif kind and (found := _bullet(line)):
            records.append({"type": kind, "subject": found[0], "info": found[1]} if kind == "fact" else {"type": kind, "key": found[0]} | _with_context(found[1]))
    return [r for r in records if r]


def parse_table(files: DataFrame, text: str = "value") -> DataFrame:
    """files with a column records: array<map<string,string>> of each rendered topic."""

    @F.pandas_udf("array<map<string,string>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([parse(t or "") for t in texts])

    return files.withColumn("records", read(text))


def topic_lines(records: DataFrame) -> DataFrame:
    """(topic_id, body): one bullet per record, in order of id."""
    line = F.struct("id", F.concat(F.lit("- **"), "record_type", F.lit("**: "), "embedding_text").alias("line"))
    return records.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))  # one topic's own records


def storage_name(filename: str, scope: Mapping[str, str | None]) -> str:
    """A name no two scopes share: the sanitised stem and a digest of the scope."""
    stem = slug(filename.removesuffix(".md"))
    digest = hashlib.sha256("|".join(f"{k}={scope.get(k) or ''}" for k in sorted(scope)).encode()).hexdigest()[:12]
    return f"{stem}__{digest}.md"


def safe_path(root: str, name: str) -> str:
    """A path inside root; anything that would leave it is refused."""
    if not name or name.startswith(("/", "\\")) or ":" in name or "\\" in name:
        raise ValueError(f"not a topic file name: {name!r}")
    path = posixpath.normpath(posixpath.join(root, name))
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"outside of {root}: {name!r}")
    return path


def version_as_of(versions: DataFrame, as_of) -> DataFrame:
    """Of each topic's kept versions the one that was current at as_of: the first superseded after it."""
    return versions.filter(F.col("superseded_at") > as_of).groupBy("topic_id").agg(F.min_by(F.struct("title", "summary", "content"), F.struct("superseded_at", "title", "summary", "content")).alias("v")).select("topic_id", "v.*")


def index_page(topics: DataFrame) -> DataFrame:
    """One section per topic, by title."""
    return topics.orderBy("title").select(F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n")).alias("value"))
