"""Prompt templates: built-in ones as column expressions, custom ones with a small renderer."""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = {
    "qa": "Answer the question from the numbered sources below. Cite them as [n]. If they do not hold the answer, say so.\n\nSources:\n{{ context }}\n\nQuestion: {{ query }}\n\nAnswer:",
    "summarize": "Summarise the numbered sources below with regard to the topic. Cite them as [n].\n\nSources:\n{{ context }}\n\nTopic: {{ query }}\n\nSummary:",
    "chat": "Go on with the conversation, using the numbered sources below. Cite them as [n].\n\n{% if history %}Conversation so far:\n{{ history }}\n\n{% endif %}Sources:\n{{ context }}\n\nuser: {{ query }}\nassistant:",
}
_TOKEN = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)
_NAME = re.compile(r"[A-Za-z_][\w.]*$")


class PromptTemplate:
    """``{{ name }}``, ``{{ name | default('x') }}``, ``{% if %}/{% else %}/{% endif %}`` and ``{% for x in xs %}``."""

    def __init__(self, text: str, name: str = "custom"):
        self.text, self.name = text, name
        self._tree, rest = self._parse(self._tokens(text), ())
        assert rest is None

    def __repr__(self) -> str:
        return f"PromptTemplate({self.name!r}, variables={sorted(self.variables())})"

    @staticmethod
    def _tokens(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        for m in _TOKEN.finditer(text):
            out.append(("text", text[at : m.start()]))
            if m[0][1] != "#":
                out.append(("value" if m[0][1] == "{" else "tag", m[0][2:-2].strip().strip("-").strip()))
            at = m.end()
        rest = text[at:]
        if "{{" in rest or "{%" in rest:
            raise ValueError("a tag is not closed")
        return [*out, ("text", rest)]

    def _parse(self, tokens: list, ends: tuple[str, ...]):
        tree = []
        while tokens:
            kind, body = tokens.pop(0)
            if kind == "text":
                tree.append(("text", body))
            elif kind == "value":
                self._check(body)
                tree.append(("value", body))
            elif body in ends:
                return tree, body
            elif m := re.match(r"if\s+(not\s+)?([\w.]+)$", body):
                yes, end = self._parse(tokens, ("else", "endif"))
                no, _ = self._parse(tokens, ("endif",)) if end == "else" else ([], end)
                tree.append(("if", m[2], bool(m[1]), yes, no))
            elif m := re.match(r"for\s+(\w+)\s+in\s+([\w.]+)$", body):
                inner, _ = self._parse(tokens, ("endfor",))
                tree.append(("for", m[1], m[2], inner))
            else:
                raise ValueError(f"unknown tag: {body!r}")
        if ends:
            raise ValueError(f"missing {ends[-1]}")
        return tree, None

    @staticmethod
    def _check(body: str) -> None:
        name, *filters = [x.strip() for x in body.split("|")]
        if not _NAME.match(name) or any(not re.match(r"default\((['\"]).*\1\)$|upper$|lower$|trim$", f) for f in filters):
            raise ValueError(f"unknown expression: {body!r}")

    @staticmethod
    def _get(name: str, values: dict):
        first, *rest = name.split(".")
        got = values.get(first)
        for part in rest:
            got = got.get(part) if isinstance(got, dict) else getattr(got, part, None)
        return got

    def _render(self, tree: list, values: dict) -> str:
        out = []
        for node in tree:
            if node[0] == "text":
                out.append(node[1])
            elif node[0] == "value":
                name, *filters = [x.strip() for x in node[1].split("|")]
                got = self._get(name, values)
                for f in filters:
                    if f.startswith("default"):
                        got = f[9:-2] if got is None else got
                    else:
                        got = {"upper": str.upper, "lower": str.lower, "trim": str.strip}[f](str(got or ""))
                out.append("" if got is None else str(got))
            elif node[0] == "if":
                out.append(self._render(node[3] if bool(self._get(node[1], values)) != node[2] else node[4], values))
            else:
                out += [self._render(node[3], {**values, node[1]: x}) for x in self._get(node[2], values) or ()]
        return "".join(out)

    def render(self, **values) -> str:
        return self._render(self._tree, values)

    def variables(self, optional: bool = True) -> set[str]:
        """Names that the template reads; without ``optional`` those with a default or only in conditions are left out."""
        found: set[str] = set()

        def walk(tree: list, own: frozenset, sure: bool) -> None:
            for node in tree:
                if node[0] == "value":
                    name = node[1].split("|")[0].strip().split(".")[0]
                    if name not in own and (optional or sure and "default" not in node[1]):
                        found.add(name)
                elif node[0] == "if":
                    if optional and node[1].split(".")[0] not in own:
                        found.add(node[1].split(".")[0])
                    walk(node[3], own, False), walk(node[4], own, False)
                elif node[0] == "for":
                    if node[2].split(".")[0] not in own:
                        found.add(node[2].split(".")[0])
                    walk(node[3], own | {node[1]}, sure)

        walk(self._tree, frozenset(), True)
        return found


def load_template(name: str) -> PromptTemplate:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}; there are {sorted(TEMPLATES)}")
    return PromptTemplate(TEMPLATES[name], name)


def load_custom_template(path: str | Path) -> PromptTemplate:
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(str(path))
    return PromptTemplate(path.read_text(encoding="utf-8"), path.stem)


def validate_template(template: PromptTemplate, required: tuple[str, ...] = ("context", "query")) -> list[str]:
    """Required variables that the template never reads."""
    return sorted(set(required) - template.variables())


def prompt(name: str, context: str | Column = "context", query: str | Column = "query", history: str | Column | None = None) -> Column:
    """A built-in prompt as an expression; null parts are empty."""
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}")
    text = TEMPLATES[name]
    block = re.search(r"\{% if history %\}(.*?)\{% endif %\}", text, re.S)
    parts: list[Column] = []

    def plain(t: str) -> None:
        for x in re.split(r"(\{\{ \w+ \}\})", t):
            known = {"{{ context }}": context, "{{ query }}": query}
            parts.append(c(known[x]) if x in known else F.lit(x))

    if block:
        plain(text[: block.start()])
        if history is not None:
            before, after = block[1].split("{{ history }}")
            parts.append(F.when(c(history) == "", "").otherwise(F.concat(F.lit(before), c(history), F.lit(after))))
        plain(text[block.end() :])
    else:
        plain(text)
    return F.concat(*parts)


def render_rows(rows: DataFrame, template: PromptTemplate, out: str = "prompt") -> DataFrame:
    """A custom template over rows: its variables are the columns of that name."""
    from ..shipping import ship

    ship(rows.sparkSession)
    text, names = template.text, sorted(template.variables() & set(rows.columns))

    @F.pandas_udf("string")
    def fill(part: pd.DataFrame) -> pd.Series:
        t = PromptTemplate(text)
        return pd.Series([t.render(**{k: (None if v is None else v) for k, v in r.items()}) for r in part.to_dict("records")])

    return rows.withColumn(out, fill(F.struct(*(names or [F.lit(0).alias("_none")]))))
