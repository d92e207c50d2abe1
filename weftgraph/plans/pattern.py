"""Graph patterns: an immutable builder, compiled to roles and edges between them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from weftgraph.functions.predicates import Filter

Groups = tuple[tuple[Filter, ...], ...]


@dataclass(frozen=True)
class Role:
    name: str
    node_type: str
    properties: dict[str, Groups]
    uids: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Pattern:
    """roles by name; edges (role, edge name, role), each undirected edge once; connected."""

    root: str
    roles: dict[str, Role]
    edges: tuple[tuple[str, str, str], ...]

    def tree(self, root: str | None = None) -> tuple[list[tuple[str, str, str, bool]], list[tuple[str, str, str]]]:
        """Spanning tree from a role, parents first, as (parent, edge, child, forward), and the edges left over."""
        seen, tree, rest = {root or self.root}, [], list(self.edges)
        while True:
            step = next((e for e in rest if (e[0] in seen) != (e[2] in seen)), None)
            if step is None:
                return tree, rest
            rest.remove(step)
            a, edge, b = step
            tree.append((a, edge, b, True) if a in seen else (b, edge, a, False))
            seen |= {a, b}


@dataclass(frozen=True)
class Node:
    """One role of a pattern. Nodes of the same name are one role: filters add up, later ones replace a property's."""

    node_type: str
    name: str | None = None
    filters: tuple[tuple[str, Groups], ...] = ()
    uids: tuple[int, ...] | None = None
    edges: tuple[tuple[str, "Node"], ...] = ()

    def where(self, prop: str, *filters: Filter) -> Node:
        """These filters together; another call for the same property is an alternative."""
        known = dict(self.filters)
        known[prop] = (*known.get(prop, ()), tuple(filters))
        return replace(self, filters=tuple(known.items()))

    def none_of(self, prop: str) -> Node:
        """A property with no alternatives, which nothing matches."""
        return replace(self, filters=(*((p, g) for p, g in self.filters if p != prop), (prop, ())))

    def with_uid(self, *uids: int) -> Node:
        return replace(self, uids=(*(self.uids or ()), *uids))

    def to(self, edge: str, node: Node) -> Node:
        return replace(self, edges=(*self.edges, (edge, node)))

    def __getattr__(self, name: str):
        """with_<property>(filters...), as generated query classes offer."""
        if name.startswith("with_"):
            return lambda *filters: self.where(name.removeprefix("with_"), *filters)
        raise AttributeError(name)

    def pattern(self, reverse: dict[str, str]) -> Pattern:
        """reverse: edge name -> opposite name, so that an edge and its reverse count once."""
        roles: dict[str, Role] = {}
        edges: list[tuple[str, str, str]] = []

        def visit(node: Node) -> str:
            name = node.name or f"{node.node_type.lower()}_{sum(r.node_type == node.node_type for r in roles.values()) + 1}"
            if name in roles and roles[name].node_type != node.node_type:
                raise ValueError(f"{name} is a {roles[name].node_type}, not a {node.node_type}")
            old = roles.get(name)
            uids = node.uids if old is None or old.uids is None else old.uids if node.uids is None else (*old.uids, *node.uids)
            roles[name] = Role(name, node.node_type, {**(old.properties if old else {}), **dict(node.filters)}, uids)
            for edge, other in node.edges:
                end = visit(other)
                if (name, edge, end) not in edges and (end, reverse.get(edge), name) not in edges:
                    edges.append((name, edge, end))
            return name

        return Pattern(visit(self), roles, tuple(edges))
