"""The region tree: index spaces, partitions and field spaces as a table of nodes, and questions on it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession, types as T


@dataclass
class Node:
    id: int
    kind: str  # space or partition
    parent: int | None
    color: int | None
    depth: int
    disjoint: bool | None
    table: DataFrame | None = None


@dataclass
class Catalog:
    spark: SparkSession
    nodes: dict[int, Node] = field(default_factory=dict)
    field_spaces: dict[int, T.StructType] = field(default_factory=dict)
    regions: dict[str, tuple[int, int]] = field(default_factory=dict)
    _ids: count = field(default_factory=lambda: count(1))

    def create_index_space(self, n: int) -> int:
        return self._add("space", None, None, None, self.spark.range(n).withColumnRenamed("id", "ptr"))

    def create_partition(self, space: int, coloring: DataFrame, disjoint: bool, color: int | None = None) -> int:
        """A partition of a space; a claim to be disjoint is tested. Its subspaces are named by ``subspace``."""
        from tessera.operators.coloring import declared

        if self.nodes[space].kind != "space":
            raise ValueError("only spaces are partitioned")
        used = {n.color for n in self.nodes.values() if n.parent == space}
        return self._add("partition", space, color if color is not None else max(used, default=-1) + 1, disjoint, declared(coloring, disjoint))

    def subspace(self, partition: int, color: int) -> int:
        for n in self.nodes.values():
            if n.parent == partition and n.color == color:
                return n.id
        return self._add("space", partition, color, None, self.nodes[partition].table.where(f"color = {int(color)}").select("ptr"))

    def _add(self, kind, parent, color, disjoint, table) -> int:
        i = next(self._ids)
        self.nodes[i] = Node(i, kind, parent, color, 0 if parent is None else self.nodes[parent].depth + 1, disjoint, table)
        return i

    def destroy(self, node: int) -> None:
        """The node, all below it, and the regions on it."""
        for child in [n.id for n in self.nodes.values() if n.parent == node]:
            self.destroy(child)
        del self.nodes[node]
        self.regions = {k: v for k, v in self.regions.items() if v[0] != node}

    def create_field_space(self, **fields: str) -> int:
        i = next(self._ids)
        self.field_spaces[i] = T.StructType()
        for name, kind in fields.items():
            self.allocate_field(i, name, kind)
        return i

    def allocate_field(self, space: int, name: str, kind: str) -> None:
        if name in self.field_spaces[space].fieldNames():
            raise ValueError(f"the field {name} is there already")
        self.field_spaces[space] = T.StructType([*self.field_spaces[space].fields, T.StructField(name, T._parse_datatype_string(kind))])

    def free_field(self, space: int, name: str) -> None:
        self.field_spaces[space] = T.StructType([f for f in self.field_spaces[space].fields if f.name != name])

    def create_region(self, name: str, index_space: int, field_space: int) -> DataFrame:
        """A region's first table: every pointer with all fields null."""
        from pyspark.sql import functions as F

        self.regions[name] = (index_space, field_space)
        return self.nodes[index_space].table.select("ptr", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.field_spaces[field_space].fields])

    def path(self, node: int, ancestor: int) -> list[int]:
        """Colors from an ancestor down to a node."""
        out: list[int] = []
        while node != ancestor:
            n = self.nodes[node]
            if n.parent is None:
                raise ValueError("the one isn't below the other")
            out.append(n.color)
            node = n.parent
        return out[::-1]

    def aliased(self, a: int, b: int) -> bool:
        """Whether two nodes may share pointers, told by where their paths part."""
        x, y, below_x, below_y = a, b, None, None
        while x != y:
            nx, ny = self.nodes[x], self.nodes[y]
            if nx.depth >= ny.depth:
                below_x, x = x, nx.parent
            if ny.depth >= nx.depth:
                below_y, y = y, ny.parent
            if x is None or y is None:
                return False  # other trees
        if below_x is None or below_y is None:
            return True  # one lies within the other
        meet = self.nodes[x]
        return meet.kind == "space" or not meet.disjoint

    def table(self) -> DataFrame:
        rows = [(n.id, n.kind, n.parent, n.color, n.depth, n.disjoint) for n in self.nodes.values()]
        return self.spark.createDataFrame(rows, "node_id long, kind string, parent_id long, color long, depth int, disjoint boolean")

    def dump(self) -> list[str]:
        out: list[str] = []

        def walk(i: int) -> None:
            n = self.nodes[i]
            out.append("  " * n.depth + f"{n.kind} {n.id}" + (f" color {n.color}" if n.color is not None else ""))
            for c in sorted((c for c in self.nodes.values() if c.parent == i), key=lambda c: (c.color, c.id)):
                walk(c.id)

        for n in list(self.nodes.values()):
            if n.parent is None:
                walk(n.id)
        return out
