"""A lexer and parser for Java 17 declarations, statements and expressions that keeps source spans.

Nodes are dicts-free small objects: kind, start, end (character offsets), kids and named parts. Expressions keep their
source text, because conditions are compared as text. What the parser cannot read becomes an ``error`` node up to the next
statement end, so one odd construct never loses a file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<num>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|[(){}\[\];,.@=<>!~?:+\-*/&|^%])|(?P<bad>.)""",
    re.S | re.X,
)
# fixed values
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed non".split())
PRIMITIVES = frozenset("int long short byte char boolean float double void var".split())
BINARY = [{"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">="}, {"<<", ">>", ">>>"}, {"+", "-"}, {"*", "/", "%"}]
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class Node:
    __slots__ = ("kind", "start", "end", "parts", "kids")

    def __init__(self, kind: str, start: int, end: int = -1, **parts) -> None:
        self.kind, self.start, self.end, self.parts = kind, start, end, parts
        self.kids: list[Node] = []

    def __getitem__(self, key: str):
        return self.parts.get(key)


class ParseError(Exception):
    pass


class Parser:
    def __init__(self, text: str) -> None:
        self.text = text
        self.toks: list[tuple[str, str, int, int]] = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup != "ws"]
        self.toks.append(("eof", "", len(text), len(text)))
        self.i = 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.errors: list[str] = []

    # --- positions and tokens ---

    def place(self, at: int) -> tuple[int, int]:
        """(line from 1, column from 0)."""
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1]

    def source(self, n: Node) -> str:
        return self.text[n.start : n.end]

    @property
    def tok(self) -> str:
        return self.toks[self.i][1]

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    def ahead(self, k: int = 1) -> str:
        return self.toks[min(self.i + k, len(self.toks) - 1)][1]

    def at(self) -> int:
        return self.toks[self.i][2]

    def last(self) -> int:
        return self.toks[self.i - 1][3] if self.i else 0

    def take(self, want: str | None = None) -> str:
        kind, t, *_ = self.toks[self.i]
        if kind == "eof" or want is not None and t != want:
            raise ParseError(f"line {self.place(self.at())[0]}: expected {want or 'a token'}, found {t or 'the end'}")
        self.i += 1
        return t

    def opt(self, *want: str) -> bool:
        if self.kind != "eof" and self.tok in want and self.kind in ("op", "id"):
            self.i += 1
            return True
        return False

    def name(self) -> str:
        if self.kind != "id":
            raise ParseError(f"line {self.place(self.at())[0]}: expected a name, found {self.tok}")
        return self.take()

    def skip_balanced(self) -> None:
        """Past the bracket that closes the one here."""
        close, depth = {"(": ")", "{": "}", "[": "]"}, 0
        while self.kind != "eof":
            t = self.take()
            if self.toks[self.i - 1][0] != "op":
                continue
            if t in close:
                depth += 1
            elif t in close.values():
                depth -= 1
                if depth <= 0:
                    return

    # --- declarations ---

    def unit(self) -> Node:
        n = Node("unit", 0, len(self.text), package=None)
        while self.kind != "eof":
            begin = self.i
            try:
                mods = self.modifiers()
                if self.tok == "package" and self.kind == "id":
                    p = Node("package", mods["start"] if mods["annotations"] else self.at())
                    self.take()
                    p.parts["name"] = self.qualified()
                    self.take(";")
                    p.end = self.last()
                    n.parts["package"] = n.parts["package"] or p["name"]
                    n.kids.append(p)
                elif self.tok == "import" and self.kind == "id":
                    p = Node("import", self.at())
                    self.take()
                    static = self.opt("static")
                    name = self.qualified()
                    star = self.opt("*")
                    self.take(";")
                    p.parts |= {"name": name.rstrip("."), "static": static, "star": star}
                    p.end = self.last()
                    n.kids.append(p)
                elif self.opt(";"):
                    pass
                elif self.type_ahead():
                    n.kids.append(self.type_decl(mods))
                else:
                    raise ParseError(f"line {self.place(self.at())[0]}: unexpected {self.tok}")
            except ParseError as e:
                self.recover(str(e), begin)
        return n

    def recover(self, message: str, begin: int) -> None:
        self.errors.append(message)
        self.i = max(self.i, begin)
        while self.kind != "eof" and self.tok not in (";", "}"):
            if self.tok == "{" and self.kind == "op":
                self.skip_balanced()
                return
            self.i += 1
        if self.kind != "eof" and (self.tok == ";" or self.i == begin):
            self.i += 1

    def qualified(self) -> str:
        out = self.name()
        while self.tok == "." and self.kind == "op":
            self.take()
            out += "."
            if self.kind == "id":
                out += self.name()
            else:
                break
        return out

    def modifiers(self) -> Node:
        n = Node("modifiers", self.at(), names=[], annotations=[])
        while True:
            if self.tok == "@" and self.kind == "op" and self.ahead() != "interface":
                a = Node("annotation", self.at())
                self.take()
                a.parts["name"] = self.qualified()
                if self.tok == "(" and self.kind == "op":
                    self.skip_balanced()
                a.end = self.last()
                n["annotations"].append(a)
            elif self.tok == "non" and self.ahead() == "-":
                self.i += 3
            elif self.kind == "id" and self.tok in MODIFIERS and not (self.tok == "default" and self.ahead() in (":", "->")) and not (self.tok == "sealed" and self.ahead() not in MODIFIERS | {"class", "interface", "abstract"}) and not (self.tok == "synchronized" and self.ahead() == "("):
                n["names"].append(self.take())
            else:
                n.parts["start"] = n.start
                n.end = self.last()
                return n

    def type_ahead(self) -> bool:
        if self.tok == "@" and self.ahead() == "interface":
            return True
        if self.kind != "id":
            return False
        return self.tok in ("class", "interface", "enum") or self.tok == "record" and self.toks[self.i + 1][0] == "id" and self.ahead(2) in ("(", "<")

    def type_params(self) -> None:
        if self.tok == "<" and self.kind == "op":
            depth = 0
            while self.kind != "eof":
                t = self.take()
                depth += t == "<"
                depth -= t == ">"
                if depth <= 0:
                    return

    def type_decl(self, mods: Node) -> Node:
        at = self.opt("@")
        word = self.take()
        n = Node("annotation_type" if at else word, mods.start, mods=mods, extends=[], implements=[], params=None)
        n.parts["name"] = self.name()
        self.type_params()
        if word == "record" and not at:
            n.parts["params"] = self.params()
        while self.kind == "id" and self.tok in ("extends", "implements", "permits"):
            which = self.take()
            found = [self.type_()]
            while self.opt(","):
                found.append(self.type_())
            if which != "permits":
                n.parts[which] = n.parts[which] + found
        self.take("{")
        if word == "enum":
            self.enum_constants(n)
        self.body(n)
        n.end = self.last()
        return n

    def enum_constants(self, n: Node) -> None:
        while self.tok not in (";", "}"):
            mods = self.modifiers()
            c = Node("enum_constant", mods.start, mods=mods)
            c.parts["name"] = self.name()
            if self.tok == "(":
                self.skip_balanced()
            if self.tok == "{":
                self.skip_balanced()
            c.end = self.last()
            n.kids.append(c)
            if not self.opt(","):
                break
        self.opt(";")

    def body(self, n: Node) -> None:
        while not (self.tok == "}" and self.kind == "op"):
            if self.kind == "eof":
                raise ParseError(f"{n['name']}: no closing brace")
            begin = self.i
            try:
                self.member(n)
            except ParseError as e:
                self.recover(str(e), begin)
        self.take("}")

    def member(self, owner: Node) -> None:
        if self.opt(";"):
            return
        mods = self.modifiers()
        if self.tok == "{" and self.kind == "op":
            n = Node("initializer", mods.start)
            n.parts["body"] = self.block()
            n.end = self.last()
            owner.kids.append(n)
            return
        if self.type_ahead():
            owner.kids.append(self.type_decl(mods))
            return
        self.type_params()
        if self.kind == "id" and self.tok == owner["name"] and self.ahead() in ("(", "{"):
            n = Node("constructor", mods.start, mods=mods, name=self.take(), type=None)
            n.parts["params"] = self.params() if self.tok == "(" else owner["params"] or []
            self.rest_of_method(n, owner)
            return
        kind = self.type_()
        name = self.name()
        if self.tok == "(":
            n = Node("method", mods.start, mods=mods, name=name, type=kind)
            n.parts["params"] = self.params()
            self.rest_of_method(n, owner)
            return
        n = Node("field", mods.start, mods=mods, type=kind, names=[])
        while True:
            n["names"].append(name)
            while self.tok == "[":
                self.skip_balanced()
            if self.opt("="):
                n.kids.append(self.array_init() if self.tok == "{" else self.expression())
            if not self.opt(","):
                break
            name = self.name()
        self.take(";")
        n.end = self.last()
        owner.kids.append(n)

    def rest_of_method(self, n: Node, owner: Node) -> None:
        while self.tok == "[":
            self.skip_balanced()
        n.parts["throws"] = []
        if self.opt("throws"):
            n["throws"].append(self.type_())
            while self.opt(","):
                n["throws"].append(self.type_())
        if self.opt("default"):
            while self.tok != ";":
                self.skip_balanced() if self.tok in "({" else self.take()
        n.parts["body"] = self.block() if self.tok == "{" else None
        if n["body"] is None:
            self.take(";")
        n.end = self.last()
        owner.kids.append(n)

    def params(self) -> list[tuple[str, str]]:
        """(type text, name) of each parameter."""
        out = []
        self.take("(")
        while self.tok != ")":
            self.modifiers()
            kind = self.type_()
            self.modifiers()
            kind += "..." if self.opt("...") else ""
            name = self.name() if self.kind == "id" else ""
            while self.opt("."):
                name += "." + self.name()
            while self.tok == "[":
                self.skip_balanced()
                kind += "[]"
            out.append((kind, name))
            if not self.opt(","):
                break
        self.take(")")
        return out

    def type_(self) -> str:
        begin = self.at()
        while self.tok == "@":
            self.modifiers()
        if self.opt("?"):
            if self.opt("extends", "super"):
                self.type_()
            return self.text[begin : self.last()]
        self.name()
        self.type_args()
        while self.tok == "." and self.toks[self.i + 1][0] == "id":
            self.take()
            self.name()
            self.type_args()
        while self.tok == "[" and self.ahead() == "]":
            self.i += 2
        while self.tok == "&" and self.kind == "op":
            self.take()
            self.type_()
        return self.text[begin : self.last()]

    def type_args(self) -> None:
        if self.tok != "<" or self.kind != "op":
            return
        self.take()
        if self.opt(">"):
            return
        while True:
            self.type_()
            if not self.opt(","):
                break
        self.take(">")

    def try_parse(self, f):
        """f's result, or None with the place restored."""
        begin = self.i
        try:
            return f()
        except ParseError:
            self.i = begin
            return None

    # --- statements ---

    def block(self) -> Node:
        n = Node("block", self.at())
        self.take("{")
        while not (self.tok == "}" and self.kind == "op"):
            if self.kind == "eof":
                raise ParseError("no closing brace")
            n.kids.append(self.safe_statement())
        self.take("}")
        n.end = self.last()
        return n

    def safe_statement(self) -> Node:
        begin = self.i
        try:
            return self.statement()
        except ParseError as e:
            n = Node("error", self.toks[begin][2])
            self.i = begin
            self.recover(str(e), begin)
            n.end = self.last()
            return n

    def statement(self) -> Node:
        t, begin = self.tok, self.at()
        if self.kind == "op" and t == "{":
            return self.block()
        if self.kind == "op" and t == ";":
            self.take()
            return Node("empty", begin, self.last())
        f = getattr(self, f"stmt_{t}", None) if self.kind == "id" else None
        if f and not (t in ("yield", "assert") and self.ahead() in ("=", ".", "(", "++", "--") and t == "yield"):
            n = Node(t, begin)
            f(n)
            n.end = self.last()
            return n
        if self.kind == "id" and self.ahead() == ":" and t not in ("default", "case"):
            n = Node("labeled", begin, label=self.take())
            self.take(":")
            n.parts["body"] = self.safe_statement()
            n.end = self.last()
            return n
        if self.kind == "id" and (t in MODIFIERS and t not in ("default", "synchronized") or self.type_ahead()) or t == "@":
            mark = self.i
            mods = self.modifiers()
            if self.type_ahead():
                n = Node("local_class", begin, decl=self.type_decl(mods))
                n.end = self.last()
                return n
            self.i = mark
        if (n := self.try_parse(self.local)) is not None:
            return n
        n = Node("expr", begin)
        n.parts["value"] = self.expression()
        self.take(";")
        n.end = self.last()
        return n

    def local(self, end: str | None = ";") -> Node:
        n = Node("local", self.at(), names=[], values=[])
        self.modifiers()
        n.parts["type"] = self.type_()
        while True:
            n["names"].append(self.name())
            while self.tok == "[":
                self.skip_balanced()
            if self.tok not in ("=", ",", ";", ":", ")"):
                raise ParseError("not a declaration")
            value = None
            if self.opt("="):
                value = self.array_init() if self.tok == "{" else self.expression()
            n["values"].append(value)
            if not self.opt(","):
                break
        if end:
            self.take(end)
        n.end = self.last()
        return n

    def array_init(self) -> Node:
        n = Node("array_init", self.at())
        self.take("{")
        while self.tok != "}":
            n.kids.append(self.array_init() if self.tok == "{" else self.expression())
            if not self.opt(","):
                break
        self.take("}")
        n.end = self.last()
        return n

    def condition(self) -> Node:
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def stmt_if(self, n: Node) -> None:
        self.take()
        n.parts |= {"cond": self.condition(), "then": self.safe_statement(), "else": None}
        if self.opt("else"):
            n.parts["else"] = self.safe_statement()

    def stmt_while(self, n: Node) -> None:
        self.take()
        n.parts |= {"cond": self.condition(), "body": self.safe_statement()}

    def stmt_do(self, n: Node) -> None:
        self.take()
        n.parts["body"] = self.safe_statement()
        self.take("while")
        n.parts["cond"] = self.condition()
        self.opt(";")

    def stmt_for(self, n: Node) -> None:
        self.take()
        self.take("(")
        each = self.try_parse(lambda: (self.local(None), self.take(":"))[0])
        if each is not None:
            n.kind = "foreach"
            n.parts |= {"var": each["names"][0], "over": self.expression()}
        else:
            n.parts["init"] = []
            if not self.opt(";"):
                if (d := self.try_parse(self.local)) is not None:
                    n["init"].append(d)
                else:
                    n["init"].append(self.expression())
                    while self.opt(","):
                        n["init"].append(self.expression())
                    self.take(";")
            n.parts["cond"] = None if self.tok == ";" else self.expression()
            self.take(";")
            n.parts["update"] = []
            while self.tok != ")":
                n["update"].append(self.expression())
                if not self.opt(","):
                    break
        self.take(")")
        n.parts["body"] = self.safe_statement()

    def _value(self, n: Node) -> None:
        self.take()
        n.parts["value"] = None if self.tok == ";" else self.expression()
        self.take(";")

    stmt_return = stmt_throw = stmt_yield = _value

    def stmt_assert(self, n: Node) -> None:
        self.take()
        n.parts["value"] = self.expression()
        if self.opt(":"):
            n.kids.append(self.expression())
        self.take(";")

    def _jump(self, n: Node) -> None:
        self.take()
        n.parts["label"] = self.name() if self.kind == "id" else None
        self.take(";")

    stmt_break = stmt_continue = _jump

    def stmt_synchronized(self, n: Node) -> None:
        self.take()
        n.parts |= {"lock": self.condition(), "body": self.block()}

    def stmt_try(self, n: Node) -> None:
        self.take()
        n.parts |= {"resources": [], "catches": [], "finally": None}
        if self.opt("("):
            while self.tok != ")":
                r = self.try_parse(lambda: self.local(None))
                n["resources"].append(r if r is not None else self.expression())
                if not self.opt(";"):
                    break
            self.take(")")
        n.parts["body"] = self.block()
        while self.opt("catch"):
            self.take("(")
            self.modifiers()
            self.type_()
            while self.opt("|"):
                self.type_()
            self.name()
            self.take(")")
            n["catches"].append(self.block())
        if self.opt("finally"):
            n.parts["finally"] = self.block()

    def stmt_switch(self, n: Node) -> None:
        self.take()
        n.parts |= {"subject": self.condition(), "groups": []}
        self.switch_body(n)

    def switch_body(self, n: Node) -> None:
        """groups: (labels as text, None for default; arrow; statements)."""
        self.take("{")
        while self.tok != "}":
            labels: list[str | None] = []
            if self.opt("default"):
                labels.append(None)
            else:
                self.take("case")
                while True:
                    begin = self.at()
                    if self.opt("default"):
                        labels.append(None)
                    else:
                        depth = 0
                        while self.kind != "eof" and not (depth == 0 and self.tok in (",", ":", "->") and self.kind == "op"):
                            depth += self.tok in ("(", "[") and self.kind == "op"
                            depth -= self.tok in (")", "]") and self.kind == "op"
                            self.take()
                        labels.append(self.text[begin : self.last()])
                    if not self.opt(","):
                        break
            arrow = self.opt("->")
            if not arrow:
                self.take(":")
            body: list[Node] = []
            if arrow:
                if self.tok == "{" or self.tok == "throw":
                    body.append(self.safe_statement())
                else:
                    e = Node("expr", self.at())
                    e.parts["value"] = self.expression()
                    self.take(";")
                    e.end = self.last()
                    body.append(e)
            else:
                while self.tok not in ("case", "default", "}") or self.tok == "default" and self.ahead() not in (":", "->"):
                    body.append(self.safe_statement())
            n["groups"].append((labels, arrow, body))
        self.take("}")

    # --- expressions ---

    def expression(self) -> Node:
        begin = self.at()
        if (lam := self.lambda_()) is not None:
            return lam
        left = self.ternary()
        op = self.tok
        if op in ASSIGN and self.kind == "op":
            self.take()
            n = Node("assign", begin, op=op, target=left, value=self.expression())
            n.end = self.last()
            return n
        return left

    def shift_op(self) -> str:
        """>> and >>> are single > tokens, since generics end with them."""
        t = self.toks
        out, k = self.tok, self.i
        if out != ">":
            return out
        while k + 1 < len(t) and t[k + 1][2] == t[k][3] and t[k + 1][1] == ">" and len(out) < 3:
            k += 1
            out += t[k][1]
        return out

    @staticmethod
    def op_width(op: str) -> int:
        return {">>": 2, ">>>": 3}.get(op, 1)

    def lambda_(self) -> Node | None:
        begin = self.at()
        if self.kind == "id" and self.ahead() == "->":
            self.i += 2
        elif self.tok == "(" and self.kind == "op":
            k, depth = self.i, 0
            while k < len(self.toks):
                depth += self.toks[k][1] == "(" and self.toks[k][0] == "op"
                depth -= self.toks[k][1] == ")" and self.toks[k][0] == "op"
                k += 1
                if depth == 0:
                    break
            if k >= len(self.toks) or self.toks[k][1] != "->" or self.toks[k][0] != "op":
                return None
            self.i = k + 1
        else:
            return None
        n = Node("lambda", begin)
        n.kids.append(self.block() if self.tok == "{" else self.expression())
        n.end = self.last()
        return n

    def ternary(self) -> Node:
        begin = self.at()
        cond = self.binary(0)
        if self.tok == "?" and self.kind == "op":
            self.take()
            a = self.expression()
            self.take(":")
            n = Node("ternary", begin)
            n.kids = [cond, a, self.lambda_() or self.ternary()]
            n.end = self.last()
            return n
        return cond

    def binary(self, level: int) -> Node:
        if level == len(BINARY):
            return self.unary()
        begin = self.at()
        left = self.binary(level + 1)
        while True:
            if level == 6 and self.kind == "id" and self.tok == "instanceof":
                self.take()
                self.modifiers()
                self.type_()
                if self.tok == "(":
                    self.skip_balanced()
                elif self.kind == "id" and self.tok not in ("instanceof",):
                    self.name()
                n = Node("instanceof", begin)
                n.kids = [left]
                n.end = self.last()
                left = n
                continue
            op = self.shift_op() if self.tok == ">" else self.tok
            if op == "<" and self.ahead() == "<" and self.toks[self.i + 1][2] == self.toks[self.i][3]:
                op = "<<"
            if self.kind != "op" or op not in BINARY[level]:
                return left
            self.i += 2 if op == "<<" else self.op_width(op)
            n = Node("binary", begin, op=op)
            n.kids = [left, self.lambda_() or self.binary(level + 1)]
            n.end = self.last()
            left = n

    def unary(self) -> Node:
        begin = self.at()
        if self.kind == "op" and self.tok in ("!", "-", "+", "~", "++", "--"):
            n = Node("unary", begin, op=self.take())
            n.kids = [self.unary()]
            n.end = self.last()
            return n
        if self.tok == "(" and self.kind == "op" and (cast := self.try_parse(self.cast)) is not None:
            return cast
        return self.postfix()

    def cast(self) -> Node:
        n = Node("cast", self.at())
        self.take("(")
        kind = self.type_()
        self.take(")")
        plain = kind in PRIMITIVES or kind.endswith("[]") and kind.rstrip("[]") in PRIMITIVES
        if not plain and not (self.kind in ("id", "str", "num") and self.tok != "instanceof" or self.kind == "op" and self.tok in ("(", "!", "~")):
            raise ParseError("not a cast")
        n.kids = [self.lambda_() or self.unary()]
        n.end = self.last()
        return n

    def args(self) -> list[Node]:
        out = []
        self.take("(")
        while self.tok != ")":
            out.append(self.expression())
            if not self.opt(","):
                break
        self.take(")")
        return out

    def postfix(self) -> Node:
        begin = self.at()
        e = self.primary()
        while True:
            if self.tok == "." and self.kind == "op":
                self.take()
                self.type_args()
                if self.tok == "new" and self.kind == "id":
                    inner = self.creation()
                    inner.kids.insert(0, e)
                    inner.start = begin
                    e = inner
                    continue
                name = self.name()
                if self.tok == "(":
                    n = Node("call", begin, receiver=e, name=name)
                    n.kids = [e, *self.args()]
                    n.parts["args"] = n.kids[1:]
                else:
                    n = Node("field_access", begin, object=e, name=name)
                    n.kids = [e]
            elif self.tok == "[" and self.kind == "op":
                self.take()
                n = Node("index", begin)
                n.kids = [e]
                if self.tok != "]":
                    n.kids.append(self.expression())
                self.take("]")
            elif self.tok in ("++", "--") and self.kind == "op":
                n = Node("unary", begin, op=self.take(), post=True)
                n.kids = [e]
            elif self.tok == "::" and self.kind == "op":
                self.take()
                self.type_args()
                n = Node("reference", begin, name=self.name())
                n.kids = [e]
            else:
                return e
            n.end = self.last()
            e = n

    def primary(self) -> Node:
        begin, t = self.at(), self.tok
        if self.kind in ("str", "num"):
            self.take()
            return Node("literal", begin, self.last())
        if self.kind == "op" and t == "(":
            self.take()
            n = Node("paren", begin)
            n.kids = [self.expression()]
            self.take(")")
            n.end = self.last()
            return n
        if self.kind != "id":
            raise ParseError(f"line {self.place(begin)[0]}: unexpected {t or 'end'}")
        if t == "new":
            return self.creation()
        if t == "switch":
            n = Node("switch_expr", begin, groups=[])
            self.take()
            n.parts["subject"] = self.condition()
            self.switch_body(n)
            n.kids = [n["subject"], *(s for _, _, b in n["groups"] for s in b)]
            n.end = self.last()
            return n
        if t in ("true", "false", "null"):
            self.take()
            return Node("literal", begin, self.last())
        # a generic or array type before :: or .class
        if self.ahead() in ("<", "[") and (ref := self.try_parse(self.type_reference)) is not None:
            return ref
        self.take()
        if self.tok == "(" and self.kind == "op":
            n = Node("call", begin, receiver=None, name=t)
            n.kids = self.args()
            n.parts["args"] = list(n.kids)
            n.end = self.last()
            return n
        return Node("name", begin, self.last())

    def type_reference(self) -> Node:
        n = Node("type", self.at())
        self.type_()
        n.end = self.last()
        if self.tok == "::" or self.tok == "." and self.ahead() == "class":
            return n
        raise ParseError("not a type")

    def creation(self) -> Node:
        n = Node("new", self.at())
        self.take("new")
        self.modifiers()
        begin = self.at()
        self.name()
        self.type_args()
        while self.tok == "." and self.kind == "op":
            self.take()
            self.name()
            self.type_args()
        n.parts["type"] = self.text[begin : self.last()]
        if self.tok == "(":
            n.kids = self.args()
            n.parts["args"] = list(n.kids)
            if self.tok == "{" and self.kind == "op":
                inner = Node("class", self.at(), name="", mods=None, extends=[], implements=[], params=None)
                self.take("{")
                self.body(inner)
                inner.end = self.last()
                n.parts["body"] = inner
                n.kids.append(inner)
        else:
            n.kind = "new_array"
            while self.tok == "[":
                self.take()
                if self.tok != "]":
                    n.kids.append(self.expression())
                self.take("]")
            if self.tok == "{":
                n.kids.append(self.array_init())
        n.end = self.last()
        return n


def children(n: Node):
    """All nodes directly below, statements' parts among them, in source order."""
    out = list(n.kids)
    for v in n.parts.values():
        stack = [v]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if all(x is not k for k in out):
                    out.append(x)
            elif isinstance(x, (list, tuple)):
                stack.extend(x)
    return sorted(out, key=lambda k: (k.start, -k.end))


def walk(n: Node):
    """n and all below it, in source order."""
    stack = [n]
    while stack:
        k = stack.pop()
        yield k
        stack.extend(reversed(children(k)))


def parse(text: str) -> tuple[Node, Parser]:
    p = Parser(text)
    return p.unit(), p
