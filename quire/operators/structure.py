"""Edits of structure trees, one after another: each acts on what those before it left, and a refused one refuses all.

Trees and their edits are dealt out and sorted by Spark; a document's tree is walked in one task, with its children as
lists, as an edit may move anything of it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.groups import walk_groups

# The standard structure types that an edit may give.
ROLES = frozenset(
    "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot Span Quote Note Reference BibEntry Code "
    "Link Annot Ruby RB RT RP Warichu WT WP Figure Formula Form".split()
)
TOP = ""  # what holds the roots


class Refused(Exception):
    """Why an edit can't be made."""


class Tree:
    """A document's nodes by key, the children of each in order, and each node's parent."""

    def __init__(self) -> None:
        self.nodes: dict[str, dict] = {}
        self.kids: dict[str, list[str]] = {TOP: []}
        self.parent: dict[str, str] = {}
        self.used: set[str] = set()  # keys that there are or were

    def add(self, key: str, parent: str, at: int | None = None, **facts) -> None:
        self.nodes[key] = facts
        self.used.add(key)
        self.kids.setdefault(key, [])
        self.hang(key, parent, len(self.kids.setdefault(parent, [])) if at is None else at)

    def hang(self, key: str, parent: str, at: int) -> None:
        self.kids[parent].insert(at, key)
        self.parent[key] = parent

    def loose(self, key: str) -> int:
        """Take a node out of its parent's children; where it stood."""
        own = self.kids[self.parent[key]]
        at = own.index(key)
        del own[at]
        return at

    def is_content(self, key: str) -> bool:
        return self.nodes[key]["content"] is not None

    def within(self, key: str, top: str) -> bool:
        for _ in self.nodes:  # no further than there are nodes, as parents may form a ring
            if key in (TOP, top):
                break
            key = self.parent[key]
        return key == top

    def below(self, key: str) -> Iterator[str]:
        """A node and all under it, parents first."""
        rest = [key]
        while rest:
            at = rest.pop()
            if at != TOP:
                yield at
            rest += reversed(self.kids.get(at, []))

    # edits

    def _node(self, key: str, writable: bool = True) -> dict:
        if key not in self.nodes or self.is_content(key):
            raise Refused("missing")
        if writable and not self.nodes[key]["editable"]:
            raise Refused("not-editable")
        return self.nodes[key]

    def _holder(self, key: str) -> None:
        if key != TOP and not self.nodes[key]["editable"]:
            raise Refused("not-editable")

    def _role(self, role: str) -> str:
        if role not in ROLES:
            raise Refused("role")
        return role

    def role(self, e) -> None:
        node = self._node(e.key)
        node["role"] = self._role(e.value)

    def alt(self, e) -> None:
        node, text = self._node(e.key), None if e.value is None else e.value.strip()
        if text == "":
            raise Refused("alt")
        node["alt"] = text

    def scope(self, e) -> None:
        self._node(e.key)["scope"] = e.value

    def move(self, e) -> None:
        self._node(e.key)
        here, there = self.parent[e.key], e.parent or TOP
        if there != TOP:
            self._node(there, writable=False)
        if self.within(there, e.key):
            raise Refused("cycle")
        if there == TOP and here != TOP:
            raise Refused("root")
        self._holder(here)
        self._holder(there)
        self.loose(e.key)
        elements = [at for at, k in enumerate(self.kids[there]) if not self.is_content(k)]
        self.hang(e.key, there, elements[e.place] if 0 <= e.place < len(elements) else len(self.kids[there]))

    def group(self, e) -> None:
        """Put siblings under a new node that stands where the first of them stood; they keep their order."""
        if e.value in self.used:
            raise Refused("duplicate-key")
        self._role(e.role)
        if not e.keys:
            raise Refused("missing")
        self._node(e.keys[0], writable=False)
        parent = self.parent[e.keys[0]]
        self._holder(parent)
        for key in e.keys:
            self._node(key, writable=False)
            if self.parent[key] != parent:
                raise Refused("not-siblings")
            self._node(key)
        members = [k for k in self.kids[parent] if k in set(e.keys)]
        at = self.kids[parent].index(members[0])
        for key in members:
            self.loose(key)
        self.add(e.value, parent, at, role=e.role, alt=None, scope=None, lang=None, editable=True, content=None)
        for key in members:
            self.hang(key, e.value, len(self.kids[e.value]))

    def unwrap(self, e) -> None:
        """Put a node's children in its place; they take its language where they have none."""
        node = self._node(e.key)
        parent = self.parent[e.key]
        if parent == TOP:
            raise Refused("root")
        if any(map(self.is_content, self.kids[e.key])):
            raise Refused("has-content")
        at = self.loose(e.key)
        for k, child in enumerate(self.kids.pop(e.key)):
            self.nodes[child]["lang"] = self.nodes[child]["lang"] or node["lang"]
            self.hang(child, parent, at + k)
        del self.nodes[e.key], self.parent[e.key]

    def artifact(self, e) -> None:
        """Take a node and all under it out of the tree."""
        self._node(e.key, writable=False)
        if self.parent[e.key] == TOP:
            raise Refused("root")
        self._node(e.key)
        blocked = next((c for k in self.below(e.key) if (c := self.nodes[k]["content"]) in ("interactive", "in-stream")), None)
        if blocked:
            raise Refused(blocked)
        self.loose(e.key)
        for key in list(self.below(e.key)):
            del self.nodes[key], self.kids[key], self.parent[key]


EDITS = ("role", "alt", "scope", "move", "group", "unwrap", "artifact")


def replayed(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, key, parent, place, depth, role, alt, scope, lang, content, refused, refused_at) of the trees of nodes (doc_id,
    key, parent, ord, role, alt, scope, lang, editable, content) after edits (doc_id, seq, op, key, value, role, parent, place,
    keys).

    content is null for elements, else what a node's own content is (`marked`, `interactive` or `in-stream`). Edits: `role`
    and `scope` set a value, `alt` too (null: none), `move` hangs a node among the elements of a parent (null: the roots) at
    a place, `group` puts keys under a new node `value` of a role, `unwrap` puts children in a node's place, `artifact` takes
    it out. Parents come before children; place is that among siblings. A document with a refused edit is one row: why, and
    the seq. Nodes whose parent isn't there are roots.
    """
    there = nodes.select("doc_id", F.lit(0).alias("kind"), F.col("ord").cast("long").alias("at"), F.struct(*[F.col(c) for c in ("key", "parent", "role", "alt", "scope", "lang", "editable", "content")]).alias("n"))
    steps = edits.select("doc_id", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("at"), F.struct("op", "key", "value", "role", "parent", "place", "keys").alias("e"))
    both = there.unionByName(steps, allowMissingColumns=True)
    kind = dict(nodes.dtypes)["doc_id"]

    def walk(rows: Iterator) -> Iterator[tuple]:
        tree, waiting, doc = Tree(), [], None
        refused = None

        def plant() -> None:
            known = {n["key"] for n in waiting}
            for n in waiting:
                parent = n["parent"] if n["parent"] in known else TOP
                tree.add(n["key"], parent, role=n["role"], alt=n["alt"], scope=n["scope"], lang=n["lang"], editable=n["editable"], content=n["content"])
            waiting.clear()

        for r in rows:
            doc = r.doc_id
            if r.kind == 0:
                waiting.append(r.n)
                continue
            plant()
            try:
                if r.e["op"] not in EDITS:
                    raise Refused("unknown")
                getattr(tree, r.e["op"])(Edit(**r.e))
            except Refused as why:
                refused = (str(why), r.at)
                break
        plant()
        if refused:
            for _ in rows:
                pass
            yield doc, *[None] * 9, *refused
            return
        depth, place = {TOP: -1}, {k: at for own in tree.kids.values() for at, k in enumerate(own)}
        for key in tree.below(TOP):
            n, up = tree.nodes[key], tree.parent[key]
            depth[key] = depth[up] + 1
            yield doc, key, up or None, place[key], depth[key], n["role"], n["alt"], n["scope"], n["lang"], n["content"], None, None

    made = f"doc_id {kind}, key string, parent string, place int, depth int, role string, alt string, scope string, lang string, content string, refused string, refused_at long"
    return walk_groups(both, "doc_id", ["kind", "at"], walk, made)


class Edit:
    """One edit: op, key, value, role, parent, place, keys."""

    def __init__(self, **facts) -> None:
        self.__dict__.update(facts)
