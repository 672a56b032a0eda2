"""Templates as plain values: an ordered list of kv and table nodes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

LEAF = -1


@dataclass(frozen=True)
class Node:
    """A kv block or a table; ``child`` is the node whose rows interleave with this one's, LEAF if none."""

    type: str
    fields: tuple[str, ...]
    node_id: int = 0
    child: int = LEAF
    bid: tuple[int, ...] = field(default=())

    def __post_init__(self):
        if self.type not in ("kv", "table"):
            raise ValueError(f"a node is kv or table, not {self.type!r}")


Template = tuple[Node, ...]


def to_json(template: Template) -> str:
    return json.dumps([asdict(n) for n in template])


def from_json(text: str) -> Template:
    """Nodes of a template file; absent keys get the defaults (kv, no fields, leaf)."""
    return tuple(
        Node(n.get("type", "kv"), tuple(n.get("fields", ())), n.get("node_id", k), n.get("child", LEAF), tuple(n.get("bid", ()))) for k, n in enumerate(json.loads(text))
    )


def remove_nodes(template: Template, node_ids: list[int], by_position: bool = False) -> Template:
    """Without the nodes named by id (or list position); children that are gone become LEAF."""
    gone = {k if by_position else n.node_id for k, n in enumerate(template) if (k if by_position else n.node_id) in node_ids}
    left = [n for k, n in enumerate(template) if (k if by_position else n.node_id) not in gone]
    ids = {n.node_id for n in left}
    return tuple(n if n.child in ids else replace(n, child=LEAF) for n in left)


def modify_node(template: Template, node_id: int, type: str, fields: list[str]) -> Template:
    """With another type and fields for one node."""
    return tuple(replace(n, type=type, fields=tuple(fields)) if n.node_id == node_id else n for n in template)


def insert_node(template: Template, position: int, node: Node) -> Template:
    """With a node before a position; its id is new."""
    new = replace(node, node_id=max((n.node_id for n in template), default=-1) + 1)
    return (*template[:position], new, *template[position:])


def set_field(template: Template, node_id: int, position: int, text: str) -> Template:
    def changed(n: Node) -> Node:
        return replace(n, fields=(*n.fields[:position], text, *n.fields[position + 1 :]))

    return tuple(changed(n) if n.node_id == node_id else n for n in template)


def add_field(template: Template, node_id: int, text: str = "") -> Template:
    return tuple(replace(n, fields=(*n.fields, text)) if n.node_id == node_id else n for n in template)


def delete_field(template: Template, node_id: int, position: int) -> Template:
    return tuple(replace(n, fields=n.fields[:position] + n.fields[position + 1 :]) if n.node_id == node_id else n for n in template)


def toggle_type(template: Template, node_id: int) -> Template:
    return tuple(replace(n, type="kv" if n.type == "table" else "table") if n.node_id == node_id else n for n in template)
