"""A small parser of warehouse SQL queries, for use inside tasks.

It reads the SELECT language that transformation models compile to (CTEs, joins, set
operations, nested queries, windows, QUALIFY, UNNEST, STRUCT/ARRAY literals, quoted and
hyphenated names, trailing commas) into trees of ``Node``. It knows no schema and runs
no query; a text outside its language raises ``SqlError``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator


class SqlError(ValueError):
    """The text is no query this parser reads."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)
      |(?P<text>[rb]{0,2}(?:'''.*?'''|\"\"\".*?\"\"\"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"))
      |(?P<quoted>`[^`]*`)
      |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
      |(?P<name>[^\W\d]\w*(?:-[^\W\d]\w*)*(?=\s*\.)|[^\W\d]\w*|@@?\w+)
      |(?P<op><=>|<>|!=|<=|>=|\|\||::|->|=>|<<|>>|[-+*/%=<>(),.\[\]{};:?&|^~])""",
    re.X | re.S | re.I,
)
#: Words that end an expression or an alias position.
_RESERVED = set(
    "select from where group having qualify window order limit offset union intersect except all distinct join inner left right full cross on using as "
    "and or not in between like ilike rlike is case when then else end by with over partition rows range exists null natural lateral tablesample pivot unpivot asc desc nulls".split()
)
_COMPARE = {"=": "eq", "==": "eq", "<=>": "eq", "!=": "neq", "<>": "neq", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}


class Node:
    """A tree node: ``kind``, ``name`` (operator, function, alias), ``kids``, and ``parts`` of a name."""

    __slots__ = ("alias", "extra", "kids", "kind", "name", "parent", "parts")

    def __init__(self, kind: str, name: str = "", kids: list[Node] | None = None, parts: list[str] | None = None, **extra: object) -> None:
        self.kind, self.name, self.kids, self.parts = kind, name, [k for k in kids or [] if k is not None], parts or []
        self.alias, self.extra, self.parent = "", extra, None
        for k in self.kids:
            k.parent = self

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.kids))


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


class Parser:
    #: Nesting that is still read; deeper texts are refused instead of exhausting the stack.
    DEEPEST = 120

    def __init__(self, text: str) -> None:
        self.toks, self.at, self.depth = tokens(text), 0, 0

    # -- tokens
    def word(self, ahead: int = 0) -> str:
        i = self.at + ahead
        if i >= len(self.toks):
            return ""
        kind, value = self.toks[i]
        return value.lower() if kind in ("name", "op") else kind

    def take(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SqlError(f"expected {word} before {self.toks[self.at : self.at + 3]}")

    def is_name(self) -> bool:
        return self.at < len(self.toks) and (self.toks[self.at][0] == "quoted" or self.toks[self.at][0] == "name" and self.word() not in _RESERVED)

    def name_parts(self, any_word: bool = False) -> list[str]:
        if self.at >= len(self.toks) or not (self.is_name() or any_word and self.toks[self.at][0] == "name"):
            raise SqlError("expected a name")
        kind, value = self.toks[self.at]
        self.at += 1
        return value.strip("`").split(".") if kind == "quoted" else [value]

    def alias(self) -> str:
        if self.take("as"):
            return self.name_parts(any_word=True)[-1]
        return self.name_parts()[-1] if self.is_name() else ""

    # -- queries
    def parse(self) -> Node:
        q = self.query()
        self.take(";")
        if self.at < len(self.toks):
            raise SqlError(f"unexpected {self.toks[self.at][1]!r}")
        return q

    def query(self) -> Node:
        self.depth += 1
        if self.depth > self.DEEPEST:
            raise SqlError("nested too deeply")
        ctes: list[Node] = []
        if self.take("with"):
            self.take("recursive")
            while True:
                name = self.name_parts()[-1]
                columns = self.name_list() if self.word() == "(" else []
                self.need("as")
                self.need("(")
                ctes.append(Node("cte", name, [self.query()], columns))
                self.need(")")
                if not self.take(",") or self.word() in ("select", "("):
                    break
        body = self.set_operation()
        order = self.order_by() if self.take("order", "by") else []
        limit = []
        while self.word() in ("limit", "offset"):
            self.at += 1
            limit.append(self.expr())
        self.depth -= 1
        return Node("query", "", [*ctes, body, *order, *limit], order=order, body=body, ctes=ctes)

    def set_operation(self) -> Node:
        left = self.query_term()
        while self.word() in ("union", "intersect") or self.word() == "except" and self.word(1) in ("all", "distinct", "select", "("):
            op = self.word()
            self.at += 1
            _ = self.take("all") or self.take("distinct")
            left = Node("set", op, [left, self.query_term()])
        return left

    def query_term(self) -> Node:
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        return self.select()

    def select(self) -> Node:
        self.need("select")
        _ = self.take("distinct") or self.take("all")
        _ = self.take("as", "struct") or self.take("as", "value")
        items = [self.item()]
        while self.take(","):
            if self.word() in ("from", "", ")", "where"):
                break
            items.append(self.item())
        parts: dict[str, list[Node]] = {k: [] for k in ("from", "where", "group_by", "having", "qualify", "window", "order_by")}
        if self.take("from"):
            parts["from"] = self.from_items()
        if self.take("where"):
            parts["where"] = [self.expr()]
        if self.take("group", "by"):
            if not self.take("all"):
                _ = self.word() in ("rollup", "cube") and self.word(1) == "(" or False
                parts["group_by"] = self.expr_list()
        if self.take("having"):
            parts["having"] = [self.expr()]
        if self.take("qualify"):
            parts["qualify"] = [self.expr()]
        if self.take("window"):
            while True:
                self.name_parts()
                self.need("as")
                parts["window"].append(self.window())
                if not self.take(","):
                    break
        if self.take("order", "by"):
            parts["order_by"] = self.order_by()
        while self.word() in ("limit", "offset"):
            self.at += 1
            self.expr()
        return Node("select", "", [*items, *[n for ns in parts.values() for n in ns]], items=items, **parts)

    def item(self) -> Node:
        if self.take("*"):
            return self.star([])
        start = self.at
        if self.is_name():  # t.* and a.b.*
            parts = self.name_parts()
            while self.take("."):
                if self.take("*"):
                    return self.star(parts)
                parts += self.name_parts(any_word=True)
            self.at = start
        e = self.expr()
        e_alias = self.alias()
        n = Node("item", e_alias, [e])
        return n

    def star(self, of: list[str]) -> Node:
        dropped, replaced = [], []
        while True:
            if self.word() in ("except", "exclude") and self.word(1) == "(":
                self.at += 1
                dropped = self.name_list()
            elif self.take("replace", "("):
                while True:
                    e = self.expr()
                    replaced.append(Node("item", self.alias(), [e]))
                    if not self.take(","):
                        break
                self.need(")")
            else:
                break
        return Node("star", of[-1] if of else "", replaced, dropped)

    def name_list(self) -> list[str]:
        self.need("(")
        names = [self.name_parts(any_word=True)[-1]]
        while self.take(","):
            names.append(self.name_parts(any_word=True)[-1])
        self.need(")")
        return names

    def from_items(self) -> list[Node]:
        out = [self.table("from")]
        while True:
            if self.take(","):
                out.append(self.table("join"))
                continue
            start = self.at
            _ = self.take("natural")
            kind = next((w for w in ("inner", "left", "right", "full", "cross") if self.take(w)), "")
            _ = self.take("outer") or self.take("semi") or self.take("anti")
            if not self.take("join"):
                self.at = start
                break
            t = self.table("join")
            out.append(t)
            if self.take("on"):
                out.append(Node("on", kind, [self.expr()]))
            elif self.take("using"):
                out.append(Node("using", kind, [], self.name_list()))
        return out

    def table(self, role: str) -> Node:
        _ = self.take("lateral")
        if self.take("("):
            if self.word() in ("select", "with", "("):
                q = self.query()
                self.need(")")
                n = Node("derived", "", [q], role=role)
            else:
                inner = self.from_items()
                self.need(")")
                n = Node("joined", "", inner, role=role)
        elif self.word() == "unnest" and self.word(1) == "(":
            self.at += 2
            e = self.expr()
            self.need(")")
            n = Node("unnest", "", [e], role=role)
        else:
            parts = self.name_parts()
            while self.take("."):
                parts += self.name_parts(any_word=True)
            if self.take("("):
                args = [] if self.word() == ")" else self.expr_list()
                self.need(")")
                n = Node("function_table", ".".join(parts), args, role=role)
            else:
                n = Node("table", parts[-1], [], parts, role=role)
        if self.take("for", "system_time", "as", "of"):
            self.expr()
        if self.take("tablesample"):
            self.at += 1
            self.skip_group()
        n.alias = self.alias()
        if n.alias and n.kind in ("derived", "unnest") and self.word() == "(":
            n.parts = self.name_list()
        if self.take("with", "offset"):
            n.extra["offset"] = self.alias()
        return n

    def skip_group(self) -> None:
        self.need("(")
        deep = 1
        while deep:
            if self.at >= len(self.toks):
                raise SqlError("open bracket")
            deep += (self.word() == "(") - (self.word() == ")")
            self.at += 1

    def order_by(self) -> list[Node]:
        out = []
        while True:
            out.append(self.expr())
            _ = self.take("asc") or self.take("desc")
            _ = self.take("nulls") and (self.take("first") or self.take("last"))
            if not self.take(","):
                return out

    def expr_list(self) -> list[Node]:
        out = [self.expr()]
        while self.take(","):
            if self.word() in (")", "", "from", "]"):
                break
            out.append(self.expr())
        return out

    # -- expressions, loosest first
    def expr(self) -> Node:
        self.depth += 1
        if self.depth > self.DEEPEST:
            raise SqlError("nested too deeply")
        e = self.conjunction()
        while self.take("or"):
            e = Node("logic", "or", [e, self.conjunction()])
        self.depth -= 1
        return e

    def conjunction(self) -> Node:
        e = self.negation()
        while self.take("and"):
            e = Node("logic", "and", [e, self.negation()])
        return e

    def negation(self) -> Node:
        if self.take("not"):
            return Node("logic", "not", [self.negation()])
        return self.comparison()

    def comparison(self) -> Node:
        e = self.sum()
        while True:
            w = self.word()
            if w in _COMPARE:
                self.at += 1
                e = Node("compare", _COMPARE[w], [e, self.sum()])
            elif w == "is":
                self.at += 1
                self.take("not")
                if self.take("distinct", "from"):
                    e = Node("compare", "eq", [e, self.sum()])
                else:
                    self.at += 1
                    e = Node("compare", "is_null", [e])
            elif w in ("in", "between", "like", "ilike", "rlike") or w == "not" and self.word(1) in ("in", "between", "like", "ilike", "rlike"):
                self.take("not")
                w = self.word()
                self.at += 1
                if w == "between":
                    low = self.sum()
                    self.need("and")
                    e = Node("compare", "between", [e, low, self.sum()])
                elif w == "in":
                    if self.take("unnest", "("):
                        e = Node("compare", "in", [e, self.expr()])
                        self.need(")")
                    else:
                        self.need("(")
                        if self.word() in ("select", "with"):
                            e = Node("compare", "in", [e, Node("subquery", "", [self.query()])])
                        else:
                            e = Node("compare", "in", [e, *([] if self.word() == ")" else self.expr_list())])
                        self.need(")")
                else:
                    _ = self.take("any") or self.take("all")
                    e = Node("compare", "like", [e, self.sum()])
            else:
                return e

    def sum(self) -> Node:
        e = self.product()
        while self.word() in ("+", "-", "||", "&", "|", "^", "<<", ">>"):
            op = self.word()
            self.at += 1
            e = Node("arithmetic", op, [e, self.product()])
        return e

    def product(self) -> Node:
        e = self.unary()
        while self.word() in ("*", "/", "%"):
            op = self.word()
            self.at += 1
            e = Node("arithmetic", op, [e, self.unary()])
        return e

    def unary(self) -> Node:
        if self.word() in ("-", "+", "~"):
            op = self.word()
            self.at += 1
            return Node("arithmetic", op, [self.unary()])
        return self.postfix(self.primary())

    def postfix(self, e: Node) -> Node:
        while True:
            if self.take("["):
                e = Node("index", "", [e, self.expr()])
                self.need("]")
            elif self.word() == "." and e.kind != "literal":
                self.at += 1
                name = "*" if self.take("*") else self.name_parts(any_word=True)[-1]
                e = Node("field", name, [e])
            elif self.take("::"):
                e = Node("function", "cast", [e], type=self.type_name())
            elif self.take("at", "time", "zone"):
                e = Node("function", "attimezone", [e, self.primary()])
            else:
                return e

    def type_name(self) -> str:
        parts = self.name_parts(any_word=True)
        if self.word() == "(":
            self.skip_group()
        if self.take("<"):
            deep = 1
            while deep and self.at < len(self.toks):
                deep += (self.word() == "<") - (self.word() == ">") - 2 * (self.word() == ">>")
                self.at += 1
        return parts[-1]

    def primary(self) -> Node:
        if self.at >= len(self.toks):
            raise SqlError("text ends inside an expression")
        kind, value = self.toks[self.at]
        w = self.word()
        if kind in ("text", "number"):
            self.at += 1
            return Node("literal", value)
        if w == "(":
            self.at += 1
            if self.word() in ("select", "with"):
                e = Node("subquery", "", [self.query()])
            else:
                es = self.expr_list()
                e = es[0] if len(es) == 1 else Node("tuple", "", es)
            self.need(")")
            return e
        if w in ("[", "array") and (w == "[" or self.word(1) in ("[", "<", "(")):
            if w == "array":
                self.at += 1
                if self.take("<"):
                    self.at -= 1
                    self.at -= 1
                    self.type_name()
                if self.take("("):
                    e = Node("function", "array", [Node("subquery", "", [self.query()])])
                    self.need(")")
                    return e
            self.need("[")
            es = [] if self.word() == "]" else self.expr_list()
            self.need("]")
            return Node("function", "array", es)
        if w == "*":
            self.at += 1
            return Node("literal", "*")
        if w == "case":
            self.at += 1
            kids = [] if self.word() == "when" else [self.expr()]
            while self.take("when"):
                kids.append(self.expr())
                self.need("then")
                kids.append(self.expr())
            if self.take("else"):
                kids.append(self.expr())
            self.need("end")
            return Node("function", "case", kids)
        if w == "exists" and self.word(1) == "(":
            self.at += 2
            q = self.query()
            self.need(")")
            return Node("exists", "", [Node("subquery", "", [q])])
        if w in ("null", "true", "false"):
            self.at += 1
            return Node("literal", w)
        if w == "interval":
            self.at += 1
            e = self.primary()
            if self.is_name():
                self.at += 1
            return Node("literal", "interval", [e])
        if w in ("date", "timestamp", "datetime", "time", "numeric", "json") and self.word(1) == "text":
            self.at += 2
            return Node("literal", w)
        if w in ("?", ":") or kind == "name" and value.startswith("@"):
            self.at += 1
            return Node("literal", value)
        if w == "{":
            raise SqlError("template text")
        callable_word = w in ("left", "right", "if", "offset", "range") or w not in _RESERVED
        if kind == "name" and self.word(1) == "(" and callable_word:
            self.at += 1
            return self.call(value)
        if w == "struct" and self.word(1) == "<":
            self.type_name()
            return self.call("struct") if self.word() == "(" else Node("literal", "struct")
        if not self.is_name():
            raise SqlError(f"unexpected {value!r}")
        parts = self.name_parts()
        while self.word() == "." and self.word(1) != "*":
            self.at += 1
            parts += self.name_parts(any_word=True)
            if self.word() == "(":
                return self.call(".".join(parts))
        return Node("column", parts[-1], [], parts)

    def call(self, name: str) -> Node:
        self.need("(")
        key = name.lower()
        kids: list[Node] = []
        if key in ("cast", "safe_cast", "try_cast"):
            kids = [self.expr()]
            self.need("as")
            self.type_name()
            if self.take("format"):
                kids.append(self.expr())
        elif key == "extract":
            self.at += 1
            if self.word() == "(":
                self.skip_group()
            self.need("from")
            kids = [self.expr()]
            if self.take("at", "time", "zone"):
                kids.append(self.expr())
        elif self.word() in ("select", "with"):
            kids = [Node("subquery", "", [self.query()])]
        elif self.word() != ")":
            _ = self.take("distinct") or self.take("all")
            while True:
                e = self.expr()
                if self.take("=>"):
                    e = self.expr()
                if self.take("as"):
                    self.name_parts(any_word=True)
                kids.append(e)
                if not self.take(","):
                    break
            _ = (self.take("ignore") or self.take("respect")) and self.need("nulls")
            if self.take("having"):
                self.at += 1
                kids.append(self.expr())
            if self.take("order", "by"):
                kids += self.order_by()
            if self.take("limit"):
                self.expr()
        self.need(")")
        _ = (self.take("ignore") or self.take("respect")) and self.need("nulls")
        if self.take("filter", "("):
            self.need("where")
            kids.append(self.expr())
            self.need(")")
        over = None
        if self.take("over"):
            over = self.window() if self.word() == "(" else Node("window", self.name_parts()[-1])
        return Node("function", key.replace("_", ""), [*kids, *([over] if over else [])], over=over)

    def window(self) -> Node:
        self.need("(")
        named = self.name_parts()[-1] if self.is_name() and self.word() not in ("rows", "range", "groups") else ""
        partition = self.expr_list() if self.take("partition", "by") else []
        order = self.order_by() if self.take("order", "by") else []
        while self.word() != ")":
            if self.at >= len(self.toks):
                raise SqlError("open window")
            self.at += 1
        self.need(")")
        return Node("window", named, [*partition, *order], partition=partition, order=order)


def parse(text: str) -> Node:
    """The query in ``text``; SqlError if it is none, also for texts nested too deeply."""
    try:
        return Parser(text).parse()
    except RecursionError as e:  # pragma: no cover - DEEPEST comes first
        raise SqlError("nested too deeply") from e
    except IndexError as e:
        raise SqlError("text ends early") from e
