"""Tagged documents: a stack parser for SGML-like text, as a tree in Python and as rows in Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_PARTS = re.compile(r"<!.*?>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r'([^\s="]+)\s*=\s*"([^"]*)"')
_REFERENCE = re.compile(r"&(#\d+|[A-Za-z]+);")
_NAMED = {"lt": "<", "gt": ">", "amp": "&"}


def decoded(text: str) -> str:
    """Character references decoded and the text trimmed; names beyond lt, gt and amp are an error."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#":
            return chr(int(name[1:]))
        if name not in _NAMED:
            raise ValueError(f"unknown entity &{name};")
        return _NAMED[name]

    return _REFERENCE.sub(one, text).strip()


@dataclass
class Tag:
    """A tag with attributes, children and its own text."""

    name: str
    attributes: dict[str, list[str]] = field(default_factory=dict)
    children: list["Tag"] = field(default_factory=list)
    content: str = ""

    def attr(self, name: str, i: int = 0) -> str | None:
        values = self.attr_values(name)
        return values[i] if i < len(values) else None

    def attr_values(self, name: str) -> list[str]:
        return self.attributes.get(name, [])

    def all(self, name: str) -> list["Tag"]:
        return [c for c in self.children if c.name == name]

    def child(self, name: str, i: int = 0) -> "Tag | None":
        found = self.all(name)
        return found[i] if i < len(found) else None


def tag_trees(text: str, name: str | None = None) -> Iterator[Tag]:
    """Outermost tags of a text, or those of one name; every tag must be closed by its own name."""
    stack: list[Tag] = []
    at = 0
    for m in _PARTS.finditer(text):
        if stack and m.start() > at:
            stack[-1].content += text[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        if not m[1]:
            tag = Tag(m[2])
            for key, value in _ATTRIBUTE.findall(m[3]):
                tag.attributes.setdefault(key, []).append(value)
            if stack:
                stack[-1].children.append(tag)
            stack.append(tag)
            continue
        if not stack or stack[-1].name != m[2]:
            raise ValueError(f"</{m[2]}> closes {stack[-1].name if stack else 'nothing'}")
        tag = stack.pop()
        tag.content = decoded(tag.content)
        if (tag.name == name) if name else not stack:
            yield tag
    if stack:
        raise ValueError(f"<{stack[-1].name}> is not closed")


def tag_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, path (names from the root), position, attributes and content of every tag of every document."""

    def walk(tag: Tag, path: str, out: list) -> None:
        path = f"{path}/{tag.name}"
        out.append((path, [(k, v) for k, values in tag.attributes.items() for v in values[:1]], tag.content))
        for c in tag.children:
            walk(c, path, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list = []
                for tree in tag_trees(value or ""):
                    walk(tree, "", rows)
                if rows:
                    paths, attributes, contents = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(paths, pa.string()), pa.array(attributes, pa.map_(pa.string(), pa.string())), pa.array(contents, pa.string())],
                        ["id", "position", "path", "attributes", "content"])

    rows = docs.selectExpr(f"cast({id_col} as long) as id", text)
    return rows.mapInArrow(run, "id long, position int, path string, attributes map<string,string>, content string")
