"""Structure edits one after another, against a plain replay on nested lists."""

import random

from quire.operators import structure

NODE = "doc_id long, key string, parent string, ord long, role string, alt string, scope string, lang string, editable boolean, content string"
EDIT = "doc_id long, seq long, op string, key string, value string, role string, parent string, place int, keys array<string>"


class Plain:
    """A tree as [key, facts, kids] lists under a holder."""

    def __init__(self, rows):
        self.top, self.used = ["", {"editable": True, "content": None}, []], {r[0] for r in rows}
        by = {"": self.top}
        for key, parent, role, alt, scope, lang, editable, content in rows:
            by[key] = [key, {"role": role, "alt": alt, "scope": scope, "lang": lang, "editable": editable, "content": content}, []]
        for key, parent, *_ in rows:
            by[parent or ""][2].append(by[key])

    def find(self, key, at=None, above=None):
        at = at or self.top
        if at[0] == key:
            return at, above
        for kid in at[2]:
            if found := self.find(key, kid, at):
                return found
        return None

    def apply(self, op, key, value, role, parent, place, keys):
        def need(k):
            found = self.find(k) if k else None
            if not found or found[0][1]["content"]:
                raise ValueError("missing")
            return found

        def writable(n):
            if not n[1]["editable"]:
                raise ValueError("not-editable")

        if op == "group":
            if value in self.used:
                raise ValueError("duplicate-key")
            if role not in structure.ROLES:
                raise ValueError("role")
            if not keys:
                raise ValueError("missing")
            above = need(keys[0])[1]
            writable(above)
            for k in keys:
                n, up = need(k)
                if up is not above:
                    raise ValueError("not-siblings")
                writable(n)
            own = [n for n in above[2] if n[0] in keys]
            at = above[2].index(own[0])
            above[2][:] = [n for n in above[2] if n[0] not in keys]
            above[2].insert(at, [value, {"role": role, "alt": None, "scope": None, "lang": None, "editable": True, "content": None}, own])
            self.used.add(value)
            return
        n, above = need(key)
        if op == "artifact" and above is self.top:
            raise ValueError("root")
        writable(n)
        if op == "role":
            if value not in structure.ROLES:
                raise ValueError("role")
            n[1]["role"] = value
        elif op == "alt":
            if value is not None and not value.strip():
                raise ValueError("alt")
            n[1]["alt"] = value and value.strip()
        elif op == "scope":
            n[1]["scope"] = value
        elif op == "unwrap":
            if above is self.top:
                raise ValueError("root")
            if any(k[1]["content"] for k in n[2]):
                raise ValueError("has-content")
            for k in n[2]:
                k[1]["lang"] = k[1]["lang"] or n[1]["lang"]
            at = above[2].index(n)
            above[2][at : at + 1] = n[2]
        elif op == "artifact":
            def blocked(x):
                return x[1]["content"] if x[1]["content"] in ("interactive", "in-stream") else next((b for k in x[2] if (b := blocked(k))), None)

            if b := blocked(n):
                raise ValueError(b)
            above[2].remove(n)
        elif op == "move":
            there = need(parent)[0] if parent else self.top
            if self.find(there[0], n) if parent else False:
                raise ValueError("cycle")
            if there is self.top and above is not self.top:
                raise ValueError("root")
            writable(above)
            writable(there)
            above[2].remove(n)
            elements = [k for k, x in enumerate(there[2]) if not x[1]["content"]]
            there[2].insert(elements[place] if place < len(elements) else len(there[2]), n)

    def rows(self, at=None, parent=None, depth=0):
        for place, n in enumerate((at or self.top)[2]):
            f = n[1]
            yield n[0], parent, place, depth, f["role"], f["alt"], f["scope"], f["lang"], f["content"]
            yield from self.rows(n, n[0], depth + 1)


def test_edits_equal_a_plain_replay(spark):
    rng = random.Random(15)
    nodes, edits, want = [], [], {}
    reasons = set()
    for doc in range(250):
        own = []
        for k in range(rng.randrange(3, 14)):
            content = rng.choice([None] * 5 + ["marked", "interactive", "in-stream"]) if k > 1 else None
            above = [r[0] for r in own if r[7] is None]
            own.append((f"n{k}", rng.choice(above) if k else None, rng.choice(["P", "Sect", "Odd"]), None, None, rng.choice([None, "tr"]), rng.random() < 0.95, content))
        nodes += [(doc, r[0], r[1], k, *r[2:]) for k, r in enumerate(own)]
        plain, refused = Plain(own), None
        for seq in range(rng.randrange(7)):
            keys = [f"n{rng.randrange(len(own))}" for _ in range(5)]
            op = rng.choice(structure.EDITS)
            value = {"role": rng.choice(["H1", "P", "Nope"]), "alt": rng.choice([None, " a ", "  ", "b"]), "scope": rng.choice([None, "Row"]), "group": rng.choice([f"g{seq}", "n1"])}.get(op)
            siblings = [x[0] for x in (rng.choice([n for n in [plain.top, *(plain.find(k)[0] for k in keys if plain.find(k))]])[2])] or keys[:1]
            step = (op, keys[0], value, rng.choice(["Sect", "Div", "Nope"]) if op == "group" and rng.random() < 0.3 else "Sect", rng.choice([keys[1], keys[2], None]), rng.randrange(4), keys[:2] if op == "group" and rng.random() < 0.3 else rng.sample(siblings, min(len(siblings), 2)) if op == "group" and rng.random() < 0.9 else [] if op == "group" else None)
            edits.append((doc, seq, *step))
            if refused is None:
                try:
                    plain.apply(*step)
                except ValueError as why:
                    refused = (str(why), seq)
                    reasons.add(str(why))
        want[doc] = [(None,) * 9 + refused] if refused else [(*r, None, None) for r in plain.rows()]
    got = {}
    for r in structure.replayed(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edits, EDIT)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items() if v}
    assert {"missing", "not-editable", "role", "alt", "cycle", "root", "duplicate-key", "not-siblings"} <= reasons and reasons & {"has-content", "interactive", "in-stream"}


def test_a_script_by_hand(spark):
    nodes = [("d", None), ("s", "d"), ("p", "s"), ("q", "s"), ("t", "d")]
    rows = [(1, k, p, n, "P", None, None, "tr" if k == "s" else None, True, None) for n, (k, p) in enumerate(nodes)]
    edits = [(1, 0, "group", None, "g", "Div", None, None, ["q", "p"]), (1, 1, "unwrap", "s", None, None, None, None, None), (1, 2, "move", "t", None, None, "g", 1, None), (1, 3, "artifact", "q", None, None, None, None, None), (1, 4, "alt", "p", " pic ", None, None, None, None)]
    got = structure.replayed(spark.createDataFrame(rows, NODE), spark.createDataFrame(edits, EDIT)).collect()
    assert [(r.key, r.parent, r.place, r.depth, r.alt, r.lang) for r in got] == [("d", None, 0, 0, None, None), ("g", "d", 0, 1, None, "tr"), ("p", "g", 0, 2, "pic", None), ("t", "g", 1, 2, None, None)]
    ring = [(2, "a", "b", 0, "P", None, None, None, True, None), (2, "b", "a", 1, "P", None, None, None, True, None), (2, "c", "gone", 2, "P", None, None, None, True, None)]
    assert [r.key for r in structure.replayed(spark.createDataFrame(ring, NODE), spark.createDataFrame([], EDIT)).collect()] == ["c"]
