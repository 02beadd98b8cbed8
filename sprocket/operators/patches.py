"""Edits in a YAML document's own text: only the characters of what is edited change; comments, order, quotes and blanks elsewhere stay byte for byte.

An edit is found by the marks of the parsed nodes and put in as a splice. The new text is then read again and must say what the old one says with the edit made; if it does not (an alias, a spelling that cannot take it), the document keeps its text and says which edit was refused.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.yaml_text import Reader, Refused, shown, typed

try:
    import yaml
except ImportError:
    yaml = None

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_./-]*( [A-Za-z0-9_./-]+)*")


def spelled(value: object) -> str:
    """A value in flow style, on one line."""
    if isinstance(value, str) and _PLAIN.fullmatch(value) and typed(value, None, True) == value:
        return value
    if isinstance(value, list):
        return f"[{', '.join(map(spelled, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{spelled(k)}: {spelled(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def _child(node: object, step: str) -> tuple[int, object, object] | None:
    """(place, key node or None, value node) of a step; the last of keys that stand twice."""
    if isinstance(node, yaml.MappingNode):
        for k in range(len(node.value) - 1, -1, -1):
            key, value = node.value[k]
            if isinstance(key, yaml.ScalarNode) and key.value == step:
                return k, key, value
    elif isinstance(node, yaml.SequenceNode) and step.isdecimal() and int(step) < len(node.value):
        return int(step), None, node.value[int(step)]
    return None


_ALIAS = re.compile(r"\s*:\s+\*[^\s,\[\]{}]+")


def _end(text: str, node: object) -> int:
    """Where a node's own text ends: a block's mark lies behind the comments that follow it."""
    if isinstance(node, yaml.CollectionNode) and not node.flow_style:
        return _entry_end(text, node, node.value[-1])
    return node.end_mark.index


def _entry_end(text: str, parent: object, entry: object) -> int:
    """Where an entry of a collection ends. An alias has the marks of what it stands for, so its own text is looked up behind its key."""
    key, value = entry if isinstance(entry, tuple) else (None, entry)
    if value.start_mark.index >= (key.end_mark.index if key is not None else parent.start_mark.index):
        return _end(text, value)
    found = None if key is None else _ALIAS.match(text, key.end_mark.index)
    if found is None:
        raise Refused("cannot be placed", None)
    return found.end()


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    return end - 1 if end > at and text[end - 1] == "\r" else end


def _entry_starts(text: str, parent: object) -> list[int]:
    """Where each entry of a block collection begins: at its key, or at its dash."""
    if isinstance(parent, yaml.MappingNode):
        return [k.start_mark.index for k, _ in parent.value]
    out, column = [], parent.start_mark.column
    for item in parent.value:
        at = item.start_mark.index
        while not (text[at] == "-" and _column(text, at) == column):
            at -= 1
        out.append(at)
    return out


def _column(text: str, at: int) -> int:
    return at - (text.rfind("\n", 0, at) + 1)


def _add(text: str, parent: object, entry: str, line: str) -> str:
    """The text with a new last entry of a collection; entry in flow style, line as a line of its own."""
    if parent.flow_style or not parent.value:
        at = parent.end_mark.index - 1
        head = text[:at].rstrip() if parent.value else text[:at]
        comma = ", " if parent.value and not head.endswith(",") else " " if parent.value else ""
        return head + comma + entry + text[at:]
    column = parent.start_mark.column if isinstance(parent, yaml.SequenceNode) else parent.value[0][0].start_mark.column
    end = _end(text, parent)
    new = "\r\n" if "\r\n" in text else "\n"
    if text[:end].endswith("\n"):  # behind a block scalar, and before the blank lines that end it
        end = text.index("\n", len(text[:end].rstrip("\r\n"))) + 1
        return text[:end] + " " * column + line + new + text[end:]
    end = _line_end(text, end)
    return text[:end] + new + " " * column + line + text[end:]


def _replace(text: str, node: object, value: str) -> str:
    start, end = node.start_mark.index, _end(text, node)
    if isinstance(node, yaml.ScalarNode) and node.style in ("|", ">"):
        inside = text[start:end]
        return text[:start] + value + inside[len(inside.rstrip("\r\n")) :] + text[end:]
    gap = " " if start and text[start - 1] in ":-" else ""
    after = " " if start == end and text[end : end + 1] not in ("", " ", "\n", "\r", ",", "]", "}") else ""
    return text[:start] + gap + value + after + text[end:]


def _remove(text: str, parent: object, k: int) -> str:
    entries = parent.value
    ends = [_entry_end(text, parent, e) for e in entries]
    if parent.flow_style:
        starts = [(e[0] if isinstance(e, tuple) else e).start_mark.index for e in entries]
        if k + 1 < len(entries):
            return text[: starts[k]] + text[starts[k + 1] :]
        return text[: ends[k - 1] if k else starts[k]] + text[ends[k] :]
    starts = _entry_starts(text, parent)
    if len(entries) == 1:
        return text[: starts[0]] + ("{}" if isinstance(parent, yaml.MappingNode) else "[]") + text[ends[0] :]
    line = text.rfind("\n", 0, starts[k]) + 1
    if text[line : starts[k]].strip(" "):  # the first of an entry that shares its line
        return text[: starts[k]] + text[starts[k + 1] :]
    end = ends[k] if text[: ends[k]].endswith("\n") else text.find("\n", ends[k]) + 1
    if not end:  # the last line has no end of its own
        return text[: max(0, line - (2 if text[:line].endswith("\r\n") else 1))]
    return text[:line] + text[end:]


def spliced(text: str, op: str, path: list[str], value: object) -> str:
    """The text with one edit: set a value (a mapping gains what is missing on the way), append to a list, or remove an entry."""
    root = yaml.compose(text, Loader=yaml.SafeLoader)
    node, parent, at = root, None, 0
    for depth, step in enumerate(path):
        found = None if node is None else _child(node, step)
        if found is None:
            if op == "remove":
                raise Refused("nothing there", None)
            rest = path[depth:]
            value = [value] if op == "append" else value
            for name in reversed(rest[1:]):
                value = {name: value}
            if node is None or (isinstance(node, yaml.ScalarNode) and node.value in ("", "~", "null")):
                whole = f"{spelled(rest[0])}: {spelled(value)}"
                if node is None:
                    return text + ("" if not text or text.endswith("\n") else "\n") + whole + "\n"
                return _replace(text, node, spelled({rest[0]: value}))
            if not isinstance(node, yaml.MappingNode):
                raise Refused("no such place", None)
            entry = f"{spelled(rest[0])}: {spelled(value)}"
            return _add(text, node, entry, entry)
        parent, (at, _, node) = node, found
    if op == "append":
        if isinstance(node, yaml.ScalarNode) and node.value in ("", "~", "null"):
            return _replace(text, node, spelled([value]))
        if not isinstance(node, yaml.SequenceNode):
            raise Refused("no list", None)
        return _add(text, node, spelled(value), f"- {spelled(value)}")
    if op == "remove":
        if parent is None:
            raise Refused("nothing there", None)
        return _remove(text, parent, at)
    return _replace(text, node, spelled(value))


def _edited(tree: object, op: str, path: list[str], value: object) -> object:
    """The same edit in the tree that a text says."""
    tree = {} if tree is None else copy.deepcopy(tree)
    here: object = tree
    for step in path[:-1]:
        if isinstance(here, list):
            here = here[int(step)]
        else:
            if here.get(step) is None:
                here[step] = {}
            here = here[step]
    last: object = int(path[-1]) if isinstance(here, list) else path[-1]
    if op == "remove":
        if last not in (range(len(here)) if isinstance(here, list) else here):
            raise Refused("nothing there", None)
        del here[last]
    elif op == "append":
        if isinstance(here, dict):
            here[last] = [*(here.get(last) or []), value]
        else:
            here[last] = [*here[last], value]
    else:
        here[last] = value
    return tree


def _same(a: object, b: object) -> bool:
    """Equal in values and their types, and in the order of keys."""
    if isinstance(a, dict) and isinstance(b, dict):
        return list(a) == list(b) and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return type(a) is type(b) and shown(a) == shown(b)


def patched(text: str | None, edits: list[dict]) -> tuple[str | None, str | None, int | None]:
    """(text, problem, number of the refused edit): all edits in order, or the text as it was."""
    if not edits:
        return text, None, None
    if yaml is None:
        return text, "no parser", edits[0]["n"]
    new = text or ""
    for e in edits:
        try:
            if e["op"] not in ("set", "append", "remove") or not e["path"]:
                raise Refused("unknown edit", None)
            value = None if e["value"] is None else json.loads(e["value"])
            want = _edited(Reader(new).document(), e["op"], e["path"], value)
            after = spliced(new, e["op"], e["path"], value)
            if not _same(Reader(after).document(), want):
                raise Refused("cannot be placed", None)
            new = after
        except Refused as r:
            return text, r.code, e["n"]
        except (yaml.YAMLError, RecursionError):
            return text, "malformed", e["n"]
        except (KeyError, IndexError, TypeError, AttributeError, ValueError):
            return text, "no such place", e["n"]
    return new, None, None


def patch(docs: DataFrame, edits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the edited text, problem and refused (n). edits: key, n (their order), op (set, append or remove), path (array of text; places in a list are digits), value (JSON). A document's edits come together or not at all; one without edits is not read."""
    lists = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "op", "path", "value"))).alias("_edits"))
    names = [c for c in docs.columns if c not in (text, "problem", "refused")]
    x = docs.select(*names, text).join(lists, key, "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [patched(t, e or []) for t, e in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)]
            more = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], [*names, text, "problem", "refused"])

    return x.select(*names, text, F.transform("_edits", lambda e: F.struct(e["n"].cast("long").alias("n"), e["op"].alias("op"), e["path"].alias("path"), e["value"].alias("value"))).alias("_edits")).mapInArrow(run, f"{kinds}, `{text}` string, problem string, refused long")
