"""From tokens to syntax trees, by recursive descent."""

from __future__ import annotations

from . import nodes as n
from .diagnostics import Diagnostic, Span
from .lexer import RESERVED, Token

COMPARISONS = ("=", "<>", "!=", "<", "<=", ">", ">=")
#: Words that end a table reference rather than name it.
_NO_ALIAS = RESERVED | {"for", "window", "returning", "conflict", "do"}
#: Nested constructs that are read before the query is refused.
DEPTH = 120


class Stop(Exception):
    """The text cannot be read on."""


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def fail(self, message: str, token: Token | None = None):
        raise Stop(Diagnostic("SQL100", message, (token or self.now).span))

    def step(self) -> Token:
        token = self.now
        if token.kind != "end":
            self.at += 1
        return token

    def is_word(self, *words: str) -> bool:
        return self.now.word() in words

    def words_ahead(self, *words: str) -> bool:
        return all(self.ahead(k).word() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        """Take these words if they come next, all of them."""
        if not self.words_ahead(*words):
            return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> Token:
        start = self.now
        if not self.take(*words):
            self.fail(f"{' '.join(words).upper()} is expected.")
        return start

    def is_op(self, *ops: str) -> bool:
        return self.now.kind == "operator" and self.now.text in ops

    def take_op(self, op: str) -> bool:
        if self.is_op(op):
            self.at += 1
            return True
        return False

    def need_op(self, op: str) -> Token:
        if not self.is_op(op):
            self.fail(f"{op!r} is expected.")
        return self.step()

    def since(self, start: Token) -> Span:
        return start.span.to(self.tokens[max(self.at - 1, 0)].span) if self.at else start.span

    def name(self, reserved: bool = False) -> n.Name:
        t = self.now
        if t.kind == "name" or t.kind == "word" and (reserved or t.text.lower() not in RESERVED):
            self.step()
            return n.Name(t.text, t.kind == "name", t.span)
        self.fail("A name is expected.")

    def names(self) -> list[n.Name]:
        self.need_op("(")
        out = [self.name()]
        while self.take_op(","):
            out.append(self.name())
        self.need_op(")")
        return out

    def listed(self, read) -> list:
        out = [read()]
        while self.take_op(","):
            out.append(read())
        return out

    # statements

    def single(self) -> n.Statement:
        out = self.statement()
        self.take_op(";")
        if self.now.kind != "end":
            self.fail("One statement is expected; there is text behind it.")
        return out

    def statement(self) -> n.Statement:
        start, ctes, recursive = self.now, [], False
        if self.take("with"):
            recursive = self.take("recursive")
            ctes = self.listed(self.cte)
        if self.is_word("insert"):
            body = self.insert()
        elif self.is_word("update"):
            body = self.update()
        elif self.is_word("delete"):
            body = self.delete()
        elif self.is_word("truncate"):
            body = self.truncate()
        else:
            body = self.query()
        return n.Statement(self.since(start), ctes, recursive, body)

    def cte(self) -> n.Cte:
        start = self.now
        name = self.name()
        columns = self.names() if self.is_op("(") else []
        self.need("as")
        self.take("not", "materialized") or self.take("materialized")
        self.need_op("(")
        query = self.statement()
        self.need_op(")")
        return n.Cte(self.since(start), name, columns, query)

    def query(self) -> n.Query:
        self.deeper()
        start = self.now
        first, rest = self.term(), []
        while self.is_word("union", "intersect", "except"):
            op = self.step().text.lower()
            all_ = self.take("all")
            if not all_:
                self.take("distinct")
            rest.append((op, all_, self.term()))
        out = n.Query(self.since(start), first, rest)
        if self.take("order", "by"):
            out.order = self.listed(self.order_item)
        self.limits(out)
        while self.is_word("for"):
            self.lock(out)
        out.span = self.since(start)
        self.depth -= 1
        return out

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            self.fail("The query is nested too deeply.")

    def term(self):
        if self.take_op("("):
            out = self.query()
            self.need_op(")")
            return out
        if self.is_word("values"):
            return self.values()
        return self.select()

    def values(self) -> n.Values:
        start = self.need("values")
        return n.Values(self.since(start), self.listed(self.row))

    def row(self) -> list[n.Node]:
        self.need_op("(")
        out = self.listed(self.cell)
        self.need_op(")")
        return out

    def cell(self) -> n.Node:
        if self.is_word("default"):
            return n.Default(self.step().span)
        return self.expression()

    def limits(self, out: n.Query) -> None:
        for _ in range(2):
            if self.take("limit"):
                if not self.take("all"):
                    out.limit = self.expression()
            elif self.take("offset"):
                out.offset = self.expression()
                self.take("row") or self.take("rows")
            elif self.is_word("fetch"):
                self.step()
                if not (self.take("first") or self.take("next")):
                    self.fail("FIRST or NEXT is expected.")
                start = self.now
                out.limit = n.Literal(start.span, "int", 1) if self.is_word("row", "rows") else self.expression()
                if not (self.take("row") or self.take("rows")):
                    self.fail("ROWS is expected.")
                self.need("only")

    def lock(self, out: n.Query) -> None:
        self.need("for")
        if not (self.take("update") or self.take("no", "key", "update") or self.take("share") or self.take("key", "share")):
            self.fail("UPDATE or SHARE is expected.")
        if self.take("of"):
            out.locks += self.listed(self.name)
        self.take("nowait") or self.take("skip", "locked")

    def select(self) -> n.Select:
        start = self.need("select")
        distinct, on = False, []
        if self.take("distinct"):
            if self.take("on"):
                self.need_op("(")
                on = self.listed(self.expression)
                self.need_op(")")
            else:
                distinct = True
        else:
            self.take("all")
        out = n.Select(start.span, self.listed(self.select_item), distinct, on)
        if self.take("from"):
            out.sources = self.listed(self.source)
        if self.take("where"):
            out.where = self.expression()
        if self.take("group", "by"):
            out.group = self.listed(self.expression)
        if self.take("having"):
            out.having = self.expression()
        if self.take("window"):
            out.windows = self.listed(self.named_window)
        out.span = self.since(start)
        return out

    def select_item(self) -> n.SelectItem:
        start = self.now
        expr = self.expression(star=True)
        alias = None
        if self.take("as"):
            alias = self.name(reserved=True)
        elif self.now.kind == "name" or self.now.kind == "word" and self.now.text.lower() not in _NO_ALIAS:
            alias = self.name()
        return n.SelectItem(self.since(start), expr, alias)

    def named_window(self):
        name = self.name()
        self.need("as")
        return name, self.window_spec()

    def window_spec(self) -> n.WindowSpec:
        start = self.need_op("(")
        base, partition, order, frame = None, [], [], None
        if self.now.kind in ("word", "name") and not self.is_word("partition", "order", "rows", "range", "groups"):
            base = self.name()
        if self.take("partition", "by"):
            partition = self.listed(self.expression)
        if self.take("order", "by"):
            order = self.listed(self.order_item)
        if self.is_word("rows", "range", "groups"):
            words, depth = [], 0
            while self.now.kind != "end" and (depth or not self.is_op(")")):
                depth += self.is_op("(") - self.is_op(")")
                words.append("'" + self.now.text.replace("'", "''") + "'" if self.now.kind == "string" else self.now.text)
                self.step()
            frame = " ".join(words)
        self.need_op(")")
        return n.WindowSpec(self.since(start), base, partition, order, frame)

    def order_item(self) -> n.OrderItem:
        start = self.now
        expr = self.expression()
        descending = self.take("desc") or (self.take("asc") and False)
        nulls = None
        if self.take("nulls"):
            if not self.is_word("first", "last"):
                self.fail("FIRST or LAST is expected.")
            nulls = self.step().text.lower()
        return n.OrderItem(self.since(start), expr, bool(descending), nulls)

    # tables

    def source(self):
        item, joins = self.from_item(), []
        while (join := self.join()) is not None:
            joins.append(join)
        return item, joins

    def join(self) -> n.Join | None:
        start = self.now
        natural = self.take("natural")
        kind = None
        for word in ("inner", "left", "right", "full", "cross"):
            if self.is_word(word):
                kind = word
                self.step()
                if word in ("left", "right", "full"):
                    self.take("outer")
                break
        if kind is None and not natural and not self.is_word("join"):
            return None
        self.need("join")
        kind = kind or "inner"
        item = self.from_item()
        out = n.Join(self.since(start), kind, item, natural=natural)
        if kind != "cross" and not natural:
            if self.take("on"):
                out.on = self.expression()
            elif self.take("using"):
                out.using = self.names()
            else:
                self.fail("ON or USING is expected.")
        out.span = self.since(start)
        return out

    def alias(self, needed: bool = False) -> tuple[n.Name | None, list[n.Name]]:
        alias = None
        if self.take("as"):
            alias = self.name()
        elif self.now.kind == "name" or self.now.kind == "word" and self.now.text.lower() not in _NO_ALIAS:
            alias = self.name()
        if alias is None and needed:
            self.fail("A derived table needs an alias.")
        return alias, self.names() if alias is not None and self.is_op("(") else []

    def from_item(self) -> n.FromItem:
        start = self.now
        lateral = self.take("lateral")
        if self.is_op("("):
            self.step()
            query = self.statement()
            self.need_op(")")
            alias, columns = self.alias(needed=True)
            return n.QueryItem(self.since(start), alias, columns, query, lateral)
        if self.now.kind == "word" and self.ahead().kind == "operator" and self.ahead().text == "(" and self.now.text.lower() not in RESERVED:
            name = self.step().text.lower()
            self.need_op("(")
            args = [] if self.is_op(")") else self.listed(self.expression)
            self.need_op(")")
            alias, columns = self.alias()
            return n.FunctionItem(self.since(start), alias, columns, name, args)
        path = self.path()
        if self.is_op("("):
            self.fail("A table function takes no schema.")
        alias, columns = self.alias()
        return n.TableItem(self.since(start), alias, columns, path)

    def path(self) -> list[n.Name]:
        out = [self.name()]
        while self.take_op("."):
            out.append(self.name(reserved=True))
        return out

    # changes

    def target(self) -> n.TableItem:
        start = self.now
        path = self.path()
        alias = None
        if self.take("as"):
            alias = self.name()
        elif self.now.kind == "name" or self.now.kind == "word" and self.now.text.lower() not in _NO_ALIAS:
            alias = self.name()
        return n.TableItem(self.since(start), alias, [], path)

    def insert(self) -> n.Insert:
        start = self.need("insert", "into")
        table = self.target()
        columns = self.names() if self.is_op("(") and not self.ahead().word() in ("select", "with", "values") else []
        rows = query = None
        if self.take("default", "values"):
            pass
        elif self.is_word("values"):
            rows = self.values().rows
        else:
            query = self.statement()
        conflict = self.conflict() if self.is_word("on") else None
        returning = self.returning()
        return n.Insert(self.since(start), table, columns, rows, query, conflict, returning)

    def conflict(self) -> n.Conflict:
        start = self.need("on", "conflict")
        columns, where, constraint = [], None, None
        if self.is_op("("):
            columns = self.names()
            if self.take("where"):
                where = self.expression()
        elif self.take("on", "constraint"):
            constraint = self.name()
        self.need("do")
        if self.take("nothing"):
            return n.Conflict(self.since(start), columns, where, constraint, None, None)
        self.need("update", "set")
        assignments = self.listed(self.assignment)
        update_where = self.expression() if self.take("where") else None
        return n.Conflict(self.since(start), columns, where, constraint, assignments, update_where)

    def assignment(self) -> n.Assignment:
        start = self.now
        column = self.name()
        self.need_op("=")
        return n.Assignment(self.since(start), column, self.cell())

    def update(self) -> n.Update:
        start = self.need("update")
        table = self.target()
        self.need("set")
        assignments = self.listed(self.assignment)
        sources = self.listed(self.source) if self.take("from") else []
        where = self.expression() if self.take("where") else None
        returning = self.returning()
        return n.Update(self.since(start), table, assignments, sources, where, returning)

    def delete(self) -> n.Delete:
        start = self.need("delete", "from")
        table = self.target()
        sources = self.listed(self.source) if self.take("using") else []
        where = self.expression() if self.take("where") else None
        returning = self.returning()
        return n.Delete(self.since(start), table, sources, where, returning)

    def truncate(self) -> n.Truncate:
        start = self.need("truncate")
        self.take("table")
        self.take("only")
        tables = self.listed(lambda: n.TableItem(self.now.span, None, [], self.path()))
        self.take("restart", "identity") or self.take("continue", "identity")
        self.take("cascade") or self.take("restrict")
        return n.Truncate(self.since(start), tables)

    def returning(self) -> list[n.SelectItem]:
        return self.listed(self.select_item) if self.take("returning") else []

    # expressions, the loosest binding first

    def expression(self, star: bool = False) -> n.Node:
        self.deeper()
        if star and self.is_op("*"):
            out = n.Star(self.step().span, [])
        else:
            out = self.or_()
        self.depth -= 1
        return out

    def _left(self, read, *words: str) -> n.Node:
        start = self.now
        out = read()
        while self.is_word(*words):
            op = self.step().text.lower()
            right = read()
            out = n.Binary(self.since(start), op, out, right)
        return out

    def or_(self) -> n.Node:
        return self._left(self.and_, "or")

    def and_(self) -> n.Node:
        return self._left(self.not_, "and")

    def not_(self) -> n.Node:
        start = self.now
        if self.take("not"):
            self.deeper()
            arg = self.not_()
            self.depth -= 1
            return n.Unary(self.since(start), "not", arg)
        return self.comparison()

    def comparison(self) -> n.Node:
        start = self.now
        out = self.concat()
        while True:
            if self.is_op(*COMPARISONS):
                op = self.step().text
                op = "<>" if op == "!=" else op
                if self.is_word("any", "some", "all") and self.ahead().text == "(":
                    which = "all" if self.step().text.lower() == "all" else "any"
                    self.need_op("(")
                    array = self.expression()
                    self.need_op(")")
                    out = n.Quantified(self.since(start), op, which, out, array)
                else:
                    right = self.concat()
                    out = n.Binary(self.since(start), op, out, right)
                continue
            if self.is_op("~", "~*", "!~", "!~*", "@>", "<@", "&&"):
                op = self.step().text
                right = self.concat()
                out = n.Binary(self.since(start), op, out, right)
                continue
            if self.take("is"):
                negated = self.take("not")
                if self.take("distinct", "from"):
                    other = self.concat()
                    out = n.Is(self.since(start), out, "distinct", negated, other)
                elif self.is_word("null", "true", "false", "unknown"):
                    what = self.step().text.lower()
                    out = n.Is(self.since(start), out, what, negated)
                else:
                    self.fail("NULL, TRUE, FALSE, UNKNOWN or DISTINCT FROM is expected.")
                continue
            mark, negated = self.at, self.take("not")
            if self.is_word("like", "ilike"):
                op = self.step().text.lower()
                right = self.concat()
                out = n.Binary(self.since(start), ("not " if negated else "") + op, out, right)
            elif self.take("in"):
                self.need_op("(")
                if self.is_word("select", "with", "values"):
                    query = self.statement()
                    self.need_op(")")
                    out = n.In(self.since(start), out, None, query, negated)
                else:
                    values = self.listed(self.expression)
                    self.need_op(")")
                    out = n.In(self.since(start), out, values, None, negated)
            elif self.take("between"):
                low = self.concat()
                self.need("and")
                high = self.concat()
                out = n.Between(self.since(start), out, low, high, negated)
            else:
                self.at = mark
                return out

    def _ops(self, read, *ops: str) -> n.Node:
        start = self.now
        out = read()
        while self.is_op(*ops):
            op = self.step().text
            right = read()
            out = n.Binary(self.since(start), op, out, right)
        return out

    def concat(self) -> n.Node:
        return self._ops(self.json, "||")

    def json(self) -> n.Node:
        return self._ops(self.sum, "->", "->>", "#>", "#>>")

    def sum(self) -> n.Node:
        return self._ops(self.product, "+", "-")

    def product(self) -> n.Node:
        return self._ops(self.unary, "*", "/", "%", "^")

    def unary(self) -> n.Node:
        start = self.now
        if self.is_op("+", "-"):
            op = self.step().text
            self.deeper()
            arg = self.unary()
            self.depth -= 1
            return n.Unary(self.since(start), op, arg)
        return self.postfix()

    def postfix(self) -> n.Node:
        start = self.now
        out = self.primary()
        while True:
            if self.take_op("::"):
                name, span = self.type_name()
                out = n.Cast(self.since(start), out, name, span)
            elif self.is_op("["):
                self.step()
                index = self.expression()
                self.need_op("]")
                out = n.Subscript(self.since(start), out, index)
            else:
                return out

    def type_name(self) -> tuple[str, Span]:
        start = self.now
        words = [self.name(reserved=True).text]
        while self.take_op("."):
            words[-1] += "." + self.name(reserved=True).text
        many = {("double", "precision"), ("character", "varying"), ("time", "without", "time", "zone"), ("timestamp", "without", "time", "zone"), ("time", "with", "time", "zone"), ("timestamp", "with", "time", "zone")}
        for parts in many:
            if words[0].lower() == parts[0] and all(self.ahead(k).word() == w for k, w in enumerate(parts[1:])):
                self.at += len(parts) - 1
                words = list(parts)
                break
        text = " ".join(words)
        if self.take_op("("):
            numbers = []
            while not self.is_op(")"):
                if self.now.kind not in ("number", "word") and not self.is_op(","):
                    self.fail("A type's modifier is expected.")
                numbers.append(self.step().text)
            self.step()
            text += "(" + "".join(numbers) + ")"
        while self.is_op("[") and (self.ahead().text == "]" or self.ahead().kind == "number"):
            self.step()
            if self.now.kind == "number":
                self.step()
            self.need_op("]")
            text += "[]"
        return text, self.since(start)

    def primary(self) -> n.Node:
        t = self.now
        if t.kind == "number":
            self.step()
            return n.Literal(t.span, "decimal" if "." in t.text else "int", t.text)
        if t.kind == "string":
            self.step()
            return n.Literal(t.span, "string", t.text)
        if t.kind == "parameter":
            self.step()
            return n.Parameter(t.span, t.text)
        if self.take_op("("):
            if self.is_word("select", "with", "values"):
                query = self.statement()
                self.need_op(")")
                return n.Scalar(self.since(t), query)
            out = self.expression()
            self.need_op(")")
            return out
        word = t.word()
        if word in ("true", "false"):
            self.step()
            return n.Literal(t.span, "bool", word == "true")
        if word == "null":
            self.step()
            return n.Literal(t.span, "null", None)
        if word == "case":
            return self.case()
        if word == "cast" and self.ahead().text == "(":
            self.step()
            self.need_op("(")
            arg = self.expression()
            self.need("as")
            name, span = self.type_name()
            self.need_op(")")
            return n.Cast(self.since(t), arg, name, span)
        if word == "exists":
            self.step()
            self.need_op("(")
            query = self.statement()
            self.need_op(")")
            return n.Exists(self.since(t), query)
        if word == "array" and self.ahead().text == "[":
            self.step()
            self.need_op("[")
            items = [] if self.is_op("]") else self.listed(self.expression)
            self.need_op("]")
            return n.ArrayLiteral(self.since(t), items)
        if word == "extract" and self.ahead().text == "(":
            self.step()
            self.need_op("(")
            part = self.step().text.lower()
            self.need("from")
            arg = self.expression()
            self.need_op(")")
            return n.Extract(self.since(t), part, arg)
        if word in ("date", "time", "timestamp", "timestamptz", "interval") and self.ahead().kind == "string":
            self.step()
            return n.Literal(self.since(t).to(self.now.span), word, self.step().text)
        if word in ("current_date", "current_timestamp", "localtime", "localtimestamp", "current_user", "session_user", "current_role", "current_catalog", "current_schema") and self.ahead().text != ".":
            self.step()
            if word in ("current_timestamp", "localtime", "localtimestamp") and self.take_op("("):
                if self.now.kind != "number":
                    self.fail("A precision is expected.")
                self.step()
                self.need_op(")")
            return n.Call(self.since(t), word, [])
        if t.kind in ("word", "name") and (t.kind == "name" or word not in RESERVED or word in ("left", "right") and self.ahead().text == "("):
            if t.kind == "word" and self.ahead().kind == "operator" and self.ahead().text == "(":
                return self.call()
            return self.reference()
        self.fail("An expression is expected.")

    def reference(self) -> n.Node:
        start = self.now
        path = [self.name()]
        while self.is_op("."):
            self.step()
            if self.is_op("*"):
                self.step()
                return n.Star(self.since(start), path)
            path.append(self.name(reserved=True))
        return n.ColumnRef(self.since(start), path)

    def call(self) -> n.Call:
        start = self.step()
        self.need_op("(")
        out = n.Call(start.span, start.text.lower(), [])
        if self.is_op("*"):
            self.step()
            out.star = True
        elif not self.is_op(")"):
            out.distinct = self.take("distinct")
            if not out.distinct:
                self.take("all")
            out.args = self.listed(self.expression)
        self.need_op(")")
        if self.words_ahead("filter") and self.ahead().text == "(":
            self.step()
            self.need_op("(")
            self.need("where")
            out.condition = self.expression()
            self.need_op(")")
        if self.take("over"):
            out.over = self.window_spec() if self.is_op("(") else self.name()
        out.span = self.since(start)
        return out

    def case(self) -> n.Case:
        start = self.need("case")
        subject = None if self.is_word("when") else self.expression()
        branches = []
        while self.take("when"):
            condition = self.expression()
            self.need("then")
            branches.append((condition, self.expression()))
        if not branches:
            self.fail("WHEN is expected.")
        default = self.expression() if self.take("else") else None
        self.need("end")
        return n.Case(self.since(start), subject, branches, default)


def parse(tokens: list[Token]) -> tuple[n.Statement | None, list[Diagnostic]]:
    """The one statement, or what keeps it from being read."""
    try:
        return Parser(tokens).single(), []
    except Stop as stop:
        return None, [stop.args[0]]
    except RecursionError:
        return None, [Diagnostic("SQL100", "The query is nested too deeply.", tokens[0].span)]
