"""Methods, call sites and measures of source texts, by one pass of a pushdown scanner over each file.

A pattern cuts a text into tokens, of which comments and literals are dropped. A stack of open brackets knows what each stands for: the body of a type, of a
method, of a lambda or of a class without a name, a block, or arguments. Four kinds of site are told: calls, ``new``, lambdas and method references.
Declarations of fields, parameters and variables are told with the stretch of text in which they hold.
A site belongs to the method of the innermost named type that is written in that type's body; what lambdas, nameless and local classes in it hold is its own.

Files are scanned in Arrow batches, each by itself; a file that doesn't close its brackets gives what was read. Null and empty texts have no methods.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|[^\s\w]', re.S)
COMMENTS = {"//", "/*"}
NAMING = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")  # what a name begins with; asked of each word, so not by a pattern
ENDS = {"=", ";", ",", ")", ":"}  # what follows a declared name
TYPES = {"class", "interface", "enum", "record"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "throw", "assert", "do", "else", "case", "new", "instanceof", "yield"}
BRANCHES = {"if", "for", "catch", "case", "default"}
METHODS = "path string, type string, method string, n_params int, line int, loc int, complexity int, is_public boolean, sites array<struct<kind:string,receiver:string,name:string,line:int,lambdas:int,at:int>>"
#: Words before a name that aren't its type.
NO_TYPE = NOT_CALLED | TYPES | {"package", "import", "extends", "implements", "throws", "goto", "break", "continue", "final", "static", "public", "private", "protected", "super", "this", "var_", "permits"}
PLACED = "path string, receiver string, at int, type string, method string, kind string, name string, line int, lambdas int, annotations array<string>, stop int"


class Scanner:
    """The state of one file's scan."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens: list[re.Match] = []
        self.words: list[str] = []  # of tokens; a literal is an empty one
        for m in TOKEN.finditer(text):
            w = m[0]
            if w[0] != "/" or w[:2] not in COMMENTS:
                self.tokens.append(m)
                self.words.append(w if w[0] not in "\"'" else '""')
        self.open: list[dict] = []  # brackets: what they stand for, their method and how many lambdas are around
        self.found: list[dict] = []
        self.declared_: list[dict] = []
        self.waiting: list[dict] = []  # parameters whose body hasn't begun
        self.method: dict | None = None
        self.lambdas = 0

    def line(self, n: int) -> int:
        return bisect_left(self.breaks, self.tokens[n].start()) + 1

    def word(self, n: int) -> str:
        return self.words[n] if 0 <= n < len(self.words) else ""

    def site(self, kind: str, receiver: str | None, name: str | None, n: int) -> None:
        if self.method is not None:
            self.method["sites"].append((kind, receiver, name, self.line(n), self.lambdas, self.tokens[n].start()))

    def matching(self, n: int) -> int:
        """The place of the bracket that closes the round one at ``n``."""
        depth = 0
        for k in range(n, len(self.words)):
            depth += (self.words[k] == "(") - (self.words[k] == ")")
            if not depth:
                return k
        return len(self.words)

    def params(self, n: int) -> int:
        """How many parameters stand between the brackets from ``n`` on; commas in type arguments and annotations don't count."""
        end, depth, commas = self.matching(n), 0, 0
        for k in range(n + 1, end):
            depth += (self.words[k] in "<([{") - (self.words[k] in ">)]}")
            commas += self.words[k] == "," and not depth
        return commas + 1 if end > n + 1 else 0

    def type_name(self, n: int) -> str | None:
        """The type whose body the brace at ``n`` opens, if its head is of a named type."""
        for k in range(n - 1, -1, -1):
            w = self.words[k]
            if w in ";{}" and w:
                return None
            if w in TYPES and self.word(k - 1) not in (".", "::"):
                return self.word(k + 1)
        return None

    def head_of_method(self, n: int) -> int | None:
        """The place of a method's name, if the brace at ``n`` opens its body: ``name(...)``, with exceptions or not."""
        k = n - 1
        while k >= 0 and (self.words[k][0] in NAMING or self.words[k] in ".,"):
            k -= 1
        if k < 0 or self.words[k] != ")" or (k < n - 1 and self.words[k + 1] != "throws"):
            return None
        depth = 0
        for j in range(k, -1, -1):
            depth += (self.words[j] == ")") - (self.words[j] == "(")
            if not depth:
                return j - 1 if j and self.words[j - 1][0] in NAMING else None
        return None

    def opened(self, n: int) -> None:
        w = self.words[n]
        held = {"bracket": w, "kind": "block", "lambdas": self.lambdas, "method": self.method, "do": w == "{" and self.word(n - 1) == "do", "declared": [], "start": self.tokens[n].start()}
        if w == "{":
            in_type = bool(self.open) and self.open[-1]["kind"] == "type"
            name = self.type_name(n) if self.method is None else None
            head = self.head_of_method(n) if in_type else None
            if name:
                held |= {"kind": "type", "name": name}
            elif head is not None:
                start = head
                while start > 0 and self.words[start - 1] not in (";", "{", "}"):
                    start -= 1
                self.method = {"type": next(o["name"] for o in reversed(self.open) if o["kind"] == "type"), "method": self.words[head], "n_params": self.params(head + 1), "line": self.line(head), "is_public": "public" in self.words[start:head], "complexity": 1, "sites": [], "at": self.tokens[n].start()}
                held |= {"kind": "method"}
            elif self.word(n - 1) == "->" and not self.case_arrow(n - 1):
                held |= {"kind": "lambda"}
            held["declared"], self.waiting = self.waiting, []
        self.open.append(held)

    def end(self, held: dict, n: int) -> None:
        """What was declared in a bracket holds up to its end; in round ones, for the body that follows."""
        if held["bracket"] == "(" and held["declared"]:
            self.waiting += held["declared"]
        else:
            for d in held["declared"]:
                d["stop"] = self.tokens[n].start()

    def declaration(self, n: int) -> None:
        """A name after a type and before ``=``, ``;``, ``,``, ``)`` or ``:`` is declared."""
        k, inner = n - 1, 0
        while k >= 0 and (self.words[k] in ("]", "[", ".") or self.words[k] == ">" or inner):  # arrays, dots of a variable number, type arguments
            inner += (self.words[k] == ">") - (self.words[k] == "<")
            k -= 1
        type_ = self.word(k)
        if type_[:1] not in NAMING or type_ in NO_TYPE or not self.open or self.word(n - 1) == "." and self.word(n - 2) != ".":
            return
        start, inner = k, 0
        while start > 0 and (inner or self.words[start - 1] not in (";", "{", "}", "(", ",")):  # over the arguments of annotations
            inner += (self.words[start - 1] == ")") - (self.words[start - 1] == "(")
            start -= 1
        names = [self.words[j + 1] for j in range(start, k) if self.words[j] == "@"]
        holder = self.open[-1]
        holder["declared"].append({"name": self.words[n], "type": type_, "annotations": names, "start": holder["start"] if holder["kind"] == "type" else self.tokens[n].start(), "stop": len(self.text)})
        self.declared_.append(holder["declared"][-1])

    def case_arrow(self, n: int) -> bool:
        """Whether an arrow belongs to a label of a switch."""
        for k in range(n - 1, -1, -1):
            if self.words[k] in ("case", "default"):
                return True
            if self.words[k] in (";", "{", "}", "(", "->"):
                return False
        return False

    def closed(self, n: int) -> None:
        pairs = {")": "(", "]": "[", "}": "{"}
        while self.open and self.open[-1]["bracket"] == "->":  # a lambda without braces ends here
            self.end(self.open[-1], n)
            self.lambdas = self.open.pop()["lambdas"]
        if not self.open or self.open[-1]["bracket"] != pairs[self.words[n]]:
            return
        held = self.open.pop()
        self.end(held, n)
        if held["kind"] == "method" and self.method is not None:
            body = self.text[self.method.pop("at") : self.tokens[n].end()]
            self.method["loc"] = sum(1 for x in body.split("\n") if x.strip())
            self.found.append(self.method)
        self.method, self.lambdas, self.done = held["method"], held["lambdas"], held["do"]
        if self.open and self.open[-1]["bracket"] == "->" and self.words[n] == "}" and held["kind"] == "lambda":
            self.end(self.open[-1], n)
            self.lambdas = self.open.pop()["lambdas"]

    def scan(self) -> list[dict]:
        self.done = False  # whether the last bracket closed the body of a do
        for n, (before, w, after) in enumerate(zip(["", *self.words], self.words, [*self.words[1:], ""], strict=False)):
            if w[0] in NAMING:
                if after in ENDS and w not in NO_TYPE and (before[:1] in NAMING or before in (">", "]", ".")) and not (after == "=" and self.word(n + 2) == "="):
                    self.declaration(n)
                if self.method is not None:
                    self.named(n, w, before, after)
            elif w in (",", ";"):
                while self.open and self.open[-1]["bracket"] == "->":
                    self.end(self.open[-1], n)
                    self.lambdas = self.open.pop()["lambdas"]
                if w == ";" and not (self.open and self.open[-1]["bracket"] == "("):  # parameters of a method without a body, or of one statement
                    for d in self.waiting:
                        d["stop"] = self.tokens[n].start()
                    self.waiting = []
            elif w in ("(", "[", "{"):
                self.opened(n)
            elif w in (")", "]", "}"):
                self.closed(n)
                continue
            elif w == "->" and not self.case_arrow(n):
                self.site("LAMBDA", None, None, n)
                self.open.append({"bracket": "->", "kind": "arrow", "lambdas": self.lambdas, "method": self.method, "do": False, "declared": self.waiting, "start": self.tokens[n].start()})
                self.waiting = []
                self.lambdas += 1
            elif w == "::":
                self.site("METHOD_REF", before if re.match(r"[\w$]", before) else None, after, n)
            self.done = self.done and w == "}"
        return self.found

    def named(self, n: int, w: str, before: str, after: str) -> None:
        if w in BRANCHES and not (w == "default" and after not in (":", "->")):
            self.method["complexity"] += 1
        elif w == "while" and not (before == "}" and self.done):
            self.method["complexity"] += 1
        elif w == "new":
            k = n + 1
            while self.word(k)[:1] in NAMING or self.word(k) == ".":
                k += 1
            name = self.word(k - 1)
            depth = 0
            while self.word(k) == "<" or depth:  # type arguments
                depth += (self.word(k) == "<") - (self.word(k) == ">")
                k += 1
                if k >= len(self.words):
                    break
            if self.word(k) == "(":
                self.site("NEW", None, name, n)
        elif after == "(" and w not in NOT_CALLED and w not in BRANCHES and w != "while" and before not in ("new", "@") and not self.in_new(n) and not self.declared(n):
            receiver = self.word(n - 2) if before == "." and re.match(r"[\w$]", self.word(n - 2)) else None
            self.site("CALL", receiver, w, n)

    def in_new(self, n: int) -> bool:
        """Whether a name is the last of a qualified type after ``new``."""
        k = n - 1
        while self.word(k) == "." and re.match(r"[\w$]", self.word(k - 1)):
            k -= 2
        return self.word(k) == "new"

    def declared(self, n: int) -> bool:
        """Whether a name before brackets is a method that a nameless or local class declares: a type stands before it and a body after it."""
        before = self.word(n - 1)
        if not (before[:1] in NAMING and before not in NOT_CALLED or before in ("]", ">")):
            return False
        end = self.matching(n + 1)
        return self.word(end + 1) in ("{", "throws")


def methods_in(text: str | None) -> list[dict]:
    """Methods of one text, in the order in which they end."""
    return Scanner(text).scan() if text else []


def scanned(files: DataFrame) -> DataFrame:
    """``METHODS`` of files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, m["type"], m["method"], m["n_params"], m["line"], m["loc"], m["complexity"], m["is_public"], [dict(zip(("kind", "receiver", "name", "line", "lambdas", "at"), s, strict=True)) for s in m["sites"]]) for p, t in zip(b["path"], b["text"], strict=True) for m in methods_in(t)]
            yield pd.DataFrame(rows, columns=["path", "type", "method", "n_params", "line", "loc", "complexity", "is_public", "sites"])

    return files.select("path", "text").mapInPandas(run, METHODS)


def placed(files: DataFrame) -> DataFrame:
    """``PLACED`` of files (path, text), by one scan of each: a row a site with a receiver, and a row a declaration (that with a ``stop``) of such a name.

    For a declaration ``type`` is what it is declared with and ``at`` where it begins to hold; what only sites have is null.
    """
    schema = to_arrow_schema(StructType.fromDDL(PLACED))

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for p, t in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = Scanner(t or "")
                own = [(p, receiver, at, m["type"], m["method"], kind, name, line, lambdas, None, None) for m in s.scan() for kind, receiver, name, line, lambdas, at in m["sites"] if receiver is not None]
                names = {r[1] for r in own}
                rows += own
                rows += [(p, d["name"], d["start"], d["type"], None, None, None, None, None, d["annotations"], d["stop"]) for d in s.declared_ if d["name"] in names]
                if len(rows) >= 10_000:
                    yield arrow(rows)
                    rows = []
        if rows:
            yield arrow(rows)

    return files.select("path", "text").mapInArrow(run, PLACED)


def resolved(files: DataFrame) -> DataFrame:
    """Call sites with the declaration of their receiver: the last to begin of those of its name that hold at the site; nulls without one.

    An as-of join over nested stretches: sites and declarations of a file and a name meet in one group, and each site takes the latest start among the stretches
    that it is within. Both sides come from one scan, as scanning is most of the work.
    """
    declared = F.col("stop").isNotNull()
    both = placed(files).groupBy("path", "receiver").agg(
        F.collect_list(F.when(~declared, F.struct("type", "method", "kind", "name", "line", "lambdas", "at"))).alias("sites"),
        F.collect_list(F.when(declared, F.struct("at", "stop", F.col("type").alias("receiver_type"), "annotations"))).alias("declared"),
    )
    last = lambda s: F.array_max(F.filter("declared", lambda d: (d["at"] <= s["at"]) & (s["at"] < d["stop"])))
    x = both.select("path", "receiver", F.explode(F.transform("sites", lambda s: F.struct(s.alias("s"), last(s).alias("d")))).alias("x"))
    return x.select("path", "x.s.type", "x.s.method", "x.s.kind", "receiver", "x.s.name", "x.s.line", "x.s.lambdas", "x.s.at", "x.d.receiver_type", "x.d.annotations")


def sites(methods: DataFrame) -> DataFrame:
    """One row a site: ``path, type, method, kind, receiver, name, line, lambdas, at``; in ``lambdas`` nested ones are counted."""
    return methods.select("path", "type", "method", F.explode("sites").alias("s")).select("path", "type", "method", "s.*")
