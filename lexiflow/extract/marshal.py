"""Ruby's Marshal format 4.8 as a tree of nodes, read and written without loss, and its game texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from lexiflow.extract.rows import Found
from lexiflow.extract.structured import COMMAND_TEXTS, RECORD_FIELDS
from lexiflow.functions.encoding import decode, encode

HEAD = b"\x04\x08"
FIELDS_BY_CLASS = {"RPG::" + {"Enemies": "Enemy", "Classes": "Class"}.get(k, k[:-1]): v for k, v in RECORD_FIELDS.items()}


@dataclass(eq=False, slots=True)
class Node:
    """kind is the type byte; value, items and name hold what the kind has. link marks an object seen before."""

    kind: str
    value: object = None
    items: list = field(default_factory=list)
    name: str = ""
    default: Node | None = None
    link: bool = False


class Reader:
    def __init__(self, data: bytes):
        if not data.startswith(HEAD):
            raise ValueError("not Marshal 4.8")
        self.data, self.at, self.symbols, self.objects = data, 2, [], []

    def take(self, n: int) -> bytes:
        at = self.at
        if n < 0 or at + n > len(self.data):
            raise ValueError(f"data ends at {at}")
        self.at = at + n
        return self.data[at : at + n]

    def byte(self) -> int:
        at = self.at
        if at >= len(self.data):
            raise ValueError(f"data ends at {at}")
        self.at = at + 1
        return self.data[at]

    def integer(self) -> int:
        c = self.byte()
        if 4 < c < 128:
            return c - 5
        if c < 5:
            return int.from_bytes(self.take(c), "little")
        if c < 252:
            return c - 251
        return int.from_bytes(self.take(256 - c), "little") - (1 << 8 * (256 - c))

    def symbol(self) -> str:
        kind = self.byte()
        if kind == 58:  # a colon
            self.symbols.append(self.take(self.integer()).decode("latin-1"))
            return self.symbols[-1]
        if kind == 59:  # a semicolon
            return self.symbols[self.integer()]
        raise ValueError(f"no symbol at {self.at}")

    def known(self, node: Node) -> Node:
        self.objects.append(node)
        return node

    def pairs(self, node: Node, key) -> None:
        node.items = [(key(), self.node()) for _ in range(self.integer())]

    def node(self) -> Node:
        kind = chr(self.byte())
        if kind == "o":
            node = self.known(Node(kind))
            node.name = self.symbol()
            self.pairs(node, self.symbol)
            return node
        if kind == '"':
            return self.known(Node(kind, self.take(self.integer())))
        if kind in "0TF":
            return Node(kind)
        if kind == "i":
            return Node(kind, self.integer())
        if kind in ":;":
            self.at -= 1
            return Node(":", self.symbol())
        if kind == "@":
            at = self.integer()
            return Node("@", self.objects[at], link=True)
        if kind == "I":
            inner = self.node()
            outer = Node("I", inner)
            self.pairs(outer, self.symbol)
            return outer
        if kind in "fcm":
            return self.known(Node(kind, self.take(self.integer())))
        if kind == "l":
            sign = self.take(1)
            return self.known(Node(kind, sign + self.take(2 * self.integer())))
        if kind == "[":
            node = self.known(Node(kind))
            node.items = [self.node() for _ in range(self.integer())]
            return node
        if kind in "{}":
            node = self.known(Node(kind))
            self.pairs(node, self.node)
            node.default = self.node() if kind == "}" else None
            return node
        if kind == "S":
            node = self.known(Node(kind))
            node.name = self.symbol()
            self.pairs(node, self.symbol)
            return node
        if kind == "u":
            node = Node(kind)
            node.name = self.symbol()
            node.value = self.take(self.integer())
            return self.known(node)
        if kind == "U":
            node = self.known(Node(kind))
            node.name = self.symbol()
            node.value = self.node()
            return node
        if kind in "eC":
            node = Node(kind)
            node.name = self.symbol()
            node.value = self.node()
            return node
        raise ValueError(f"type {kind!r} at {self.at}")


class Writer:
    def __init__(self):
        self.out, self.symbols, self.objects = bytearray(HEAD), {}, {}

    def integer(self, n: int) -> None:
        if n == 0 or 0 < abs(n) < 123 or n == -123:
            self.out += (0 if n == 0 else n + 5 if n > 0 else n - 5).to_bytes(1, "little", signed=True)
            return
        size = next(k for k in range(1, 5) if -(1 << 8 * k) <= n < 1 << 8 * k)
        self.out += (size if n > 0 else -size).to_bytes(1, "little", signed=True) + (n % (1 << 8 * size)).to_bytes(size, "little")

    def raw(self, data: bytes) -> None:
        self.integer(len(data))
        self.out += data

    def symbol(self, name: str) -> None:
        if name in self.symbols:
            self.out += b";"
            self.integer(self.symbols[name])
        else:
            self.symbols[name] = len(self.symbols)
            self.out += b":"
            self.raw(name.encode("latin-1"))

    def pairs(self, node: Node, key) -> None:
        self.integer(len(node.items))
        for k, v in node.items:
            key(k)
            self.node(v)

    def node(self, node: Node) -> None:
        kind = node.kind
        if kind == ":":
            return self.symbol(node.value)
        if kind == "@":
            self.out += b"@"
            return self.integer(self.objects[id(node.value)])
        self.out += kind.encode("latin-1")
        if kind in '"fcmlu[{}oSU':
            if kind != "u":
                self.objects[id(node)] = len(self.objects)
        if kind == "i":
            self.integer(node.value)
        elif kind == "I":
            self.node(node.value)
            self.pairs(node, self.symbol)
        elif kind in '"fcm':
            self.raw(node.value)
        elif kind == "l":
            self.out += node.value[:1]
            self.integer((len(node.value) - 1) // 2)
            self.out += node.value[1:]
        elif kind == "[":
            self.integer(len(node.items))
            for item in node.items:
                self.node(item)
        elif kind in "{}":
            self.pairs(node, self.node)
            if kind == "}":
                self.node(node.default)
        elif kind in "oS":
            self.symbol(node.name)
            self.pairs(node, self.symbol)
        elif kind == "u":
            self.symbol(node.name)
            self.raw(node.value)
            self.objects[id(node)] = len(self.objects)
        elif kind in "UeC":
            self.symbol(node.name)
            self.node(node.value)
        return None


def read(data: bytes) -> Node:
    return Reader(data).node()


def write(root: Node) -> bytes:
    writer = Writer()
    writer.node(root)
    return bytes(writer.out)


def plain(node: Node | None) -> Node | None:
    """A node without links and instance variables around it."""
    while node is not None and node.kind in "@I":
        node = node.value
    return node


def string(node: Node | None, hint: str | None) -> str | None:
    node = plain(node)
    return decode(node.value, hint)[0] if node is not None and node.kind == '"' else None


def scalar(node: Node) -> str:
    node = plain(node)
    return node.value.decode("latin-1") if node.kind == '"' else str(node.value)


def child(node: Node | None, step: str) -> Node | None:
    """`@name` of an object, `[n]` of an array, `{key}` of a hash."""
    node = plain(node)
    if node is None:
        return None
    if step[0] == "[":
        n = int(step[1:-1])
        return node.items[n] if node.kind == "[" and n < len(node.items) else None
    if step[0] == "{":
        return next((v for k, v in node.items if scalar(k) == step[1:-1]), None) if node.kind in "{}" else None
    return next((v for k, v in node.items if k == step), None) if node.kind in "oS" else None


def at(root: Node, path: list[str]) -> Node | None:
    for step in path:
        root = child(root, step)
    return root


def array(node: Node | None) -> list[Node]:
    node = plain(node)
    return node.items if node is not None and node.kind == "[" else []


def firsts(pairs: list[tuple]) -> dict:
    """The value of each key; the first of equal keys counts, as in child()."""
    return dict(reversed(pairs))


def texts(root: Node, rel: str, hint: str | None = None) -> Iterator[Found]:
    """Texts of maps, common events, system words and records, by the file's name.

    Each node is handed on with its path, so that no path is walked from the root again.
    """
    name = rel.replace("\\", "/").rsplit("/", 1)[-1]

    def one(node: Node | None, path: list[str], loc: str, suffix: str, engine: str) -> Iterator[Found]:
        text = string(node, hint)
        if text:
            yield Found(suffix, "rgss", text, loc, engine, path=path)

    def commands(list_: Node | None, path: list[str], place: str) -> Iterator[Found]:
        for n, command in enumerate(array(list_)):
            code = plain(child(command, "@code"))
            if code is None or code.value not in COMMAND_TEXTS:
                continue
            k, mark = COMMAND_TEXTS[code.value]
            node, here = child(child(command, "@parameters"), f"[{k}]"), [*path, f"[{n}]", "@parameters", f"[{k}]"]
            if "{}" not in mark:
                yield from one(node, here, f"{place}.l{n}{mark}", f"{place}.{n}{mark}", "rgss-map")
                continue
            if string(node, hint):  # a single text where a list may be
                yield from one(node, here, f"{place}.l{n}{mark.format(0)}", f"{place}.{n}.0", "rgss-map")
            for i, item in enumerate(array(node)):
                yield from one(item, [*here, f"[{i}]"], f"{place}.l{n}{mark.format(i)}", f"{place}.{n}.{i}", "rgss-map")

    if re.match(r"Map\d{3}\.", name, re.I):
        hash_ = plain(child(root, "@events"))
        keyed = [(scalar(k), v) for k, v in (hash_.items if hash_ is not None and hash_.kind in "{}" else [])]
        first = firsts(keyed)
        for key, _ in keyed:
            event, path = first[key], ["@events", f"{{{key}}}"]
            yield from one(child(event, "@name"), [*path, "@name"], f"Event#{key}.name", f"ev{key}.name", "rgss-map")
            for p, page in enumerate(array(child(event, "@pages"))):
                yield from commands(child(page, "@list"), [*path, "@pages", f"[{p}]", "@list"], f"ev{key}.p{p}")
    elif re.match(r"System\.", name, re.I):
        for f in ("@game_title", "@currency_unit"):
            yield from one(child(root, f), [f], f, f, "rgss-system")
        terms = child(root, "@terms")
        for f in ("@basic", "@params", "@commands"):
            for n, item in enumerate(array(child(terms, f))):
                yield from one(item, ["@terms", f, f"[{n}]"], f"terms.{f}[{n}]", f"terms.{f}.{n}", "rgss-system")
        words = plain(child(root, "@words"))
        pairs = words.items if words is not None and words.kind == "o" else []
        first = firsts(pairs)
        for k, _ in pairs:
            yield from one(first[k], ["@words", k], f"words.{k}", f"words.{k}", "rgss-system")
        messages = plain(child(terms, "@messages"))
        keyed = [(scalar(k), v) for k, v in (messages.items if messages is not None and messages.kind in "{}" else [])]
        first = firsts(keyed)
        for key, _ in keyed:
            yield from one(child(first[key], "@name"), ["@terms", "@messages", f"{{{key}}}", "@name"], f"terms.messages.{key}", f"terms.messages.{key}", "rgss-system")
    elif re.match(r"CommonEvents\.", name, re.I):
        for n, event in enumerate(array(root)):
            yield from one(child(event, "@name"), [f"[{n}]", "@name"], f"CE[{n}].name", f"ce{n}.name", "rgss-db")
            yield from commands(child(event, "@list"), [f"[{n}]", "@list"], f"ce{n}")
    else:
        for n, record in enumerate(array(root)):
            record = plain(record)
            for f in FIELDS_BY_CLASS.get(record.name, ("name",)) if record is not None and record.kind == "o" else ():
                node, path, loc, suffix = child(record, f"@{f}"), [f"[{n}]", f"@{f}"], f"{record.name}[{n}].{f}", f"{record.name}.{n}.{f}"
                yield from one(node, path, loc, suffix, "rgss-db")
                for j, item in enumerate(array(node)):
                    yield from one(item, [*path, f"[{j}]"], f"{loc}[{j}]", f"{suffix}.{j}", "rgss-db")


def marshal_entries(rel: str, data: bytes) -> list[Found]:
    return list(texts(read(bytes(data)), rel))


def patched(data: bytes, patches: list[tuple[list[str], str, str]]) -> bytes:
    """data with (path, source, target) written where source still stands; each string keeps its encoding."""
    root = read(data)
    for path, source, target in patches:
        node = plain(at(root, path))
        if node is not None and node.kind == '"':
            now, encoding, mark = decode(node.value)
            if now == source:
                node.value = encode(target, encoding, mark)
    return write(root)
