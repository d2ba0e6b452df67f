"""What ran: the physical plan as nodes and edges, and as a Graphviz text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_nodes(df: DataFrame) -> list[tuple[int, int | None, str]]:
    """(number, parent's number, operator) of the executed plan, from its indented tree."""
    out: list[tuple[int, int | None, str]] = []
    stack: list[tuple[int, int]] = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        text = re.sub(r"^[\s:+\-*()\d]*", "", line)
        if not text:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        number = len(out)
        out.append((number, stack[-1][1] if stack else None, re.split(r"[ (\[]", text, maxsplit=1)[0]))
        stack.append((depth, number))
    return out


def to_dot(df: DataFrame) -> str:
    nodes = plan_nodes(df)
    lines = [f'  n{i} [label="{name}"];' for i, _, name in nodes] + [f"  n{i} -> n{parent};" for i, parent, _ in nodes if parent is not None]
    return "digraph plan {\n" + "\n".join(lines) + "\n}\n"
