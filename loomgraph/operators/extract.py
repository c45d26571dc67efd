"""Extraction of imports, exports, functions, classes, methods and references from source text.

Imports follow the line fold of the import scanner exactly.  The others read the lexical shape of a text
(`functions.lexical`): comments, strings and templates are no code there, and each pair of brackets has its own text, in
which the pairs inside it are only numbers.  So a declaration is a short pattern wherever it stands and over however many
lines its head goes: those of a file are read from the text outside all brackets, members from a class's own text, and
what a number stands for says where parameters and bodies end.  All of this happens inside the row of a file, in native
expressions; nothing is shuffled.  Types are those written in the text, inferred ones stay null; functions inside
functions are not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexical import lexed
from ..functions.paths import last_segment, normalize_import_source, resolve_path_alias

_QUOTED = r"""['"]"""


def record(**parts: Column) -> Column:
    """A struct of named parts; names given by alias get lost in lambdas inside lambdas."""
    return F.named_struct(*(x for name, part in parts.items() for x in (F.lit(name), part)))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def groups(text: Column, pattern: str, n: int) -> Column:
    """array of the first match and its groups 1 to n, empty where they are missing; null where nothing matches."""
    parts = "\x02".join(f"${i}" for i in range(n + 1))
    whole = F.regexp_extract(text, pattern, 0)
    return let(whole, lambda m: F.when(m != "", F.split(F.regexp_replace(m, pattern, parts), "\x02", -1)))


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def function_id(parent: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", parent, F.lit("fn"), name, line.cast("string"))


def class_id(parent: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", parent, F.lit("class"), name, line.cast("string"))


def method_id(parent: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", parent, F.lit("method"), name, line.cast("string"))


def brace_delta(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))


def extract_import_statements(content: Column) -> Column:
    """array<string>: statements that a line starting with `import ` opens and a line with a quote closes, when braces
    are closed too; lines are trimmed and joined by a space."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("open"), F.lit(0).alias("depth"))

    def step(acc: Column, line: Column) -> Column:
        opens = ~acc["open"] & line.startswith("import ")
        active = acc["open"] | opens
        now = F.when(opens, line).when(acc["open"], F.concat_ws(" ", acc["now"], line)).otherwise("")
        depth = F.when(opens, brace_delta(line)).when(acc["open"], acc["depth"] + brace_delta(line)).otherwise(0)
        whole = acc["open"] | line.rlike(rf"(from|import)\s+{_QUOTED}")
        closed = active & (depth <= 0) & (line.contains("'") | line.contains('"')) & whole
        return F.struct(
            F.when(closed, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"),
            F.when(closed, "").otherwise(now).alias("now"),
            (active & ~closed).alias("open"),
            F.when(closed, 0).otherwise(depth).cast("int").alias("depth"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["done"])


def parse_import_statement(statement: Column) -> Column:
    """struct(source, names) of one statement; null for type-only imports and for what names no source."""
    source = F.regexp_extract(statement, rf"from\s+{_QUOTED}([^'\"]+){_QUOTED}", 1)
    side = F.regexp_extract(statement, rf"^import\s+{_QUOTED}([^'\"]+){_QUOTED}", 1)
    default = F.regexp_extract(statement, r"import\s+(\w+)(?:\s*,|\s+from)", 1)
    inner = F.split(F.regexp_extract(statement, r"\{([^}]+)\}", 1), ",")
    items = F.transform(inner, lambda x: F.regexp_extract(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^(\w+)(?:\s+as\s+\w+)?$", 1))
    named = F.filter(items, lambda x: x != "")
    first = F.when((default != "") & (default != "type"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    names = F.when(statement.rlike(r"import\s+\*\s+as\s+\w+"), F.array(F.lit("*"))).otherwise(F.array_distinct(F.concat(first, named)))
    none = F.array().cast("array<string>")
    parsed = F.when(source != "", F.struct(source.alias("source"), names.alias("names"))).when(side != "", F.struct(side.alias("source"), none.alias("names")))
    return F.when(~statement.rlike(r"import\s+type\s"), parsed)


def scan_imports(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """scan_id, source (normalised), name: names that the files (scan_id, file_path, content) import."""
    statements = files.select("scan_id", "file_path", F.explode(extract_import_statements(F.col("content"))).alias("statement"))
    parsed = statements.select("scan_id", "file_path", parse_import_statement(F.col("statement")).alias("p")).where("p is not null")
    rows = resolve_path_alias(parsed.select("scan_id", "file_path", "p.source", "p.names"), aliases)
    target = normalize_import_source(F.col("resolved"), F.col("file_path"))
    return rows.select("scan_id", target.alias("source"), F.explode("names").alias("name")).distinct()


def extract_imports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports, import_items); items come default first, then the namespace, then the named ones."""
    rows = files.select("scan_id", file_id(F.col("file_path")).alias("file_id"), "file_path", F.posexplode(extract_import_statements(F.col("content"))).alias("stmt_ord", "s"))
    s = F.col("s")
    source = F.coalesce(F.nullif(F.regexp_extract(s, rf"from\s+{_QUOTED}([^'\"]+){_QUOTED}", 1), F.lit("")), F.regexp_extract(s, rf"^import\s+{_QUOTED}([^'\"]+){_QUOTED}", 1))
    head = F.regexp_replace(s, r"^import\s+type\s+(?!from\b)", "import ")
    default = F.regexp_extract(head, r"^import\s+(\w+)(?:\s*,|\s+from)", 1)
    space = F.regexp_extract(head, r"\*\s+as\s+(\w+)", 1)
    item = lambda name, alias, d, n: F.struct(name.alias("name"), alias.alias("alias"), F.lit(d).alias("is_default"), F.lit(n).alias("is_namespace"))
    none = F.lit(None).cast("string")
    parts = F.filter(F.transform(F.split(F.regexp_extract(head, r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_replace(x, r"^\s*(type\s+)?|\s+$", "")), lambda x: x != "")
    named = F.transform(parts, lambda x: item(F.regexp_extract(x, r"^(\w+)", 1), F.nullif(F.regexp_extract(x, r"\sas\s+(\w+)$", 1), F.lit("")), False, False))
    kind = "array<struct<name:string,alias:string,is_default:boolean,is_namespace:boolean>>"
    empty = F.array().cast(kind)
    items = F.concat(
        F.when(default != "", F.array(item(default, none, True, False))).otherwise(empty), F.when(space != "", F.array(item(space, none, False, True))).otherwise(empty), named.cast(kind)
    )
    full = rows.select("scan_id", "file_id", "file_path", "stmt_ord", source.alias("source"), s.rlike(r"^import\s+type\s+(?!from\b)").alias("is_type_only"), items.alias("items"))
    imports = full.select("scan_id", "file_id", "file_path", "stmt_ord", "source", "is_type_only", F.size("items").alias("n_items"))
    return imports, full.select("scan_id", "file_id", "stmt_ord", F.posexplode("items").alias("item_ord", "i")).select("scan_id", "file_id", "stmt_ord", "item_ord", "i.*")


# Fixed patterns of the language, over text in which brackets, strings and templates are numbers between their marks.
_ID = r"[A-Za-z_$][\w$]*"
_GENERIC = r"(?:<(?:=>|[^<>;]|<(?:=>|[^<>;]|<[^<>;]*>)*>)*>)?"
#: A written type up to a body: it ends in what a type can end in, so that a brace behind it is the body.
_TYPED = r"(?:\s*:\s*((?:=>|[^;=])*?(?:[\w$)\]}'\"`]|(?<!=)>)))?"
_FUNCTION = rf"(?s)^\s*(export\s+)?(default\s+)?(?:declare\s+)?(async\s+)?function\b\s*\*?\s*({_ID})?\s*{_GENERIC}\s*\(\x01(\d+)\)(?:{_TYPED}\s*\{{\x01(\d+)\}}|\s*:\s*([^;{{}}\n=]+))?"
_VARIABLES = r"^\s*(export\s+)?(?:declare\s+)?(?:const|let|var)\s"
_DECLARATOR = rf"(?s)^\s*(?:(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+|,\s*)({_ID})"
_ARROW = _DECLARATOR + rf"\s*(?::.*?)?=\s*(async\s+)?{_GENERIC}\s*(?:\(\x01(\d+)\)|({_ID}))(?:\s*:\s*((?:[^={{}};]|\{{\x01\d+\}})+?))?\s*=>\s*(?:\{{\x01(\d+)\}}|(.+?)\s*(?:;|(?<![=+*/?:&|,.<>-])\n(?!\s*[.?:&|+*/=<>-])|$))"
_CLASS = rf"(?s)^\s*(export\s+)?(default\s+)?(?:declare\s+)?(?:abstract\s+)?class\b\s*(?!extends\b|implements\b)({_ID})?\s*{_GENERIC}(?:\s*extends\s+([\w$.]+(?:\(\x01\d+\))?)\s*{_GENERIC})?(?:\s*implements\s+((?:[^{{}}]|\{{\x01\d+\}}(?=\s*[>,]))+?))?\s*\{{\x01(\d+)\}}"
_OTHER = rf"(?s)^\s*export\s+(default\s+)?(?:declare\s+)?(?:const\s+)?(interface|type|enum|namespace|module)\s+({_ID})"
_BINDING = rf"(?s)^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|const|let|var|interface|type|enum)\b\s*\*?\s*({_ID})"
_LIST = r"(?s)^\s*export\s*(type\s*)?(?:\{\x01(\d+)\}|(\*)(?:\s*as\s+[\w$]+)?)(?:\s*from\s*['\"]\x01(\d+)['\"])?"
_DEFAULT = rf"(?s)^\s*export\s+default\s+(?!(?:async\s+)?function\b|(?:abstract\s+)?class\b|interface\b)(?:({_ID})\s*(?:;|\n|$)|(.*?=>)?)"
#: Where a statement that declares, imports or exports begins: behind the end of another, not inside an expression.
_STATEMENT = r"(?<=^|[;\n}])(?<![=,?:|&(+*<-]\s{0,40}\n)(?=[ \t]*(?:export|declare|abstract|async|function|class|const|let|var|interface|type|enum|namespace|module|import)\b)"
_NEXT_DECLARATOR = rf"(?=,\s*{_ID}\s*(?::[^=,;]*)?=(?![=>]))"
_MODIFIERS = r"((?:@[\w$.]+(?:\(\x01\d+\))?\s*)*(?:(?:public|private|protected|static|abstract|override|readonly|declare|accessor|async)\s+)*)"
_METHOD = rf"(?s)^\s*{_MODIFIERS}\*?\s*(#?{_ID})\s*[?!]?\s*{_GENERIC}\s*\(\x01(\d+)\)(?:{_TYPED}\s*\{{\x01(\d+)\}}|\s*:\s*([^;{{}}\n=]+))?"
_PROPERTY = rf"(?s)^\s*{_MODIFIERS}(#?{_ID})\s*[?!]?\s*(?::\s*((?:=>|[^=;\n])+?))?\s*(?:=(?!>)|;|\n|$)"
#: Where a member begins: behind the end of another, not where a line goes on.
_MEMBER = r"(?<=^|[;\n}])(?<![=,?:|&(+*<.-]\s{0,40}\n)(?=[ \t]*(?:@|\*|#|[A-Za-z_$]))(?<!@[\w$.]{1,60}(?:\(\x01\d{1,9}\))?\s{0,40}\n)"
_CHILD = r"[(\[{'\"`]\x01(\d+)[)\]}'\"`]"


def _opt(text: Column, pattern: str, group: int) -> Column:
    """A group of a match; null for none and for the empty one."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def _nest(number: Column) -> Column:
    return F.get(F.col("nests"), number.try_cast("int"))


def cut(own: Column, at: Column, line: Column, boundary: str) -> Column:
    """array of struct(text, at, line): an own text cut where the boundary (of no width) matches, with the place and the line
    in the file at which each piece begins; at, line: where the own text does."""
    lines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    start = record(at=at.cast("int"), line=line.cast("int"), done=F.array().cast("array<struct<text:string,at:int,line:int>>"))

    def step(acc: Column, text: Column) -> Column:
        last = _nest(F.regexp_extract(text, rf"(?s)^.*{_CHILD}", 1))
        rest = F.when(last.isNotNull(), F.regexp_replace(text, rf"(?s)^.*{_CHILD}", "")).otherwise(text)
        return record(at=(F.coalesce(last["end_at"] + 1, acc["at"]) + F.length(rest)), line=(F.coalesce(last["end_line"], acc["line"]) + lines(rest)), done=F.concat(acc["done"], F.array(record(text=text, at=acc["at"], line=acc["line"]))))

    return F.aggregate(F.split(own, boundary), start, step, lambda acc: acc["done"])


def _begins(piece: Column) -> tuple[Column, Column]:
    """(place, line) of the first character of a piece that is no white space."""
    blank = F.regexp_extract(piece["text"], r"(?s)^((?:\s|,)*)", 1)
    return piece["at"] + F.length(blank), piece["line"] + F.length(blank) - F.length(F.replace(blank, F.lit("\n"), F.lit("")))


def written(text: Column) -> Column:
    """An own text with what its numbers stand for, as in the file."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(_CHILD), F.lit(1)))

    def put(acc: Column, number: Column) -> Column:
        n = _nest(number)
        source = F.substring(F.col("content"), n["at"], n["end_at"] - n["at"] + 1)
        close = F.when(n["mark"] == "(", ")").when(n["mark"] == "[", "]").when(n["mark"] == "{", "}").otherwise(n["mark"])
        return F.replace(acc, F.concat(n["mark"], F.lit("\x01"), number, close), source)

    return F.aggregate(numbers, text, put)


def _inside(nest: Column) -> Column:
    """What stands between the marks of a nest, as in the file."""
    return F.substring(F.col("content"), nest["at"] + 1, F.greatest(nest["end_at"] - nest["at"] - 1, F.lit(0)))


def statements(files: DataFrame) -> DataFrame:
    """scan_id, file_path, content, own, nests, cut: the statements outside all brackets (array of text, at, line)."""
    return lexed(files).withColumn("cut", cut(F.col("own"), F.lit(1), F.lit(1), _STATEMENT))


def _bindings() -> Column:
    """array of struct(kind, name): what a file's statements declare outside all brackets."""
    names = lambda s: F.transform(_declarators(s), lambda d: record(kind=F.lit("variable"), name=F.regexp_extract(d["text"], _DECLARATOR, 1)))
    kind = lambda s: F.regexp_extract(s["text"], _BINDING, 1)
    one = lambda s: F.array(record(kind=kind(s), name=F.regexp_extract(s["text"], _BINDING, 2)))
    none = F.array().cast("array<struct<kind:string,name:string>>")
    each = F.transform("cut", lambda s: F.when(s["text"].rlike(_VARIABLES), names(s)).when(kind(s) != "", one(s)).otherwise(none))
    return F.filter(F.flatten(each), lambda b: b["name"] != "")


def _declarators(statement: Column) -> Column:
    """The declarators of a statement of variables."""
    return cut(statement["text"], statement["at"], statement["line"], _NEXT_DECLARATOR)


def _listed(statement: Column) -> Column:
    """array of struct(name, alias) of the braces of an export statement."""
    inner = F.regexp_replace(_nest(F.regexp_extract(statement["text"], _LIST, 2))["own"], r"\s+", " ")
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(x, r"^\s*(type )?|\s+$", "")), lambda x: x.rlike(r"^[\w$]"))
    named = F.transform(parts, lambda x: record(name=F.regexp_extract(x, r"^([\w$]+)", 1), alias=_opt(x, r" as ([\w$]+)$", 1)))
    return F.coalesce(named, F.array().cast("array<struct<name:string,alias:string>>"))


def _local_list(statement: Column) -> Column:
    return (F.regexp_extract(statement["text"], _LIST, 2) != "") & (F.regexp_extract(statement["text"], _LIST, 4) == "")


def _exported_names() -> Column:
    """array of names of the file's own that a list or a default exports, apart from their declaration."""
    listed = F.transform(F.filter("cut", _local_list), lambda s: F.transform(_listed(s), lambda n: n["name"]))
    default = F.transform("cut", lambda s: F.regexp_extract(s["text"], _DEFAULT, 1))
    return F.array_distinct(F.concat(F.flatten(listed), F.filter(default, lambda n: n != "")))


def extract_exports(files: DataFrame) -> DataFrame:
    """scan_id, file_id, file_path, exp_ord, name, alias, is_default, is_type_only, kind, source.

    A file's table of bindings (kind and name of each declaration) says what lists and defaults export: `export { f as g }`
    is an export g of f's kind, `export { f as default }` and `export default f` are default exports f.  Names of a list
    that the file doesn't declare are imported ones, and are left out.  Declarations come first, re-exports last.
    """
    rows = statements(files).withColumn("bound", _bindings())
    kind_of = lambda n: F.get(F.filter("bound", lambda b: b["name"] == n), F.lit(0))["kind"]
    plain = lambda k: F.when(k.isin("function", "class", "interface", "type", "enum"), k).otherwise("variable")
    shape = "array<struct<name:string,alias:string,is_default:boolean,is_type_only:boolean,kind:string,source:string>>"
    out = lambda name, default, kind, alias=F.lit(None), typed=None, source=F.lit(None): record(
        name=name, alias=alias.cast("string"), is_default=default, is_type_only=(kind.isin("interface", "type") if typed is None else typed), kind=kind, source=source.cast("string"))
    none, no = F.array().cast(shape), F.lit(False)

    def variables(s: Column) -> Column:
        many = F.transform(_declarators(s), lambda d: out(F.regexp_extract(d["text"], _DECLARATOR, 1), no, F.lit("variable")))
        pattern = _nest(F.regexp_extract(s["text"], r"^\s*export\s+(?:const|let|var)\s*[{\[]\x01(\d+)[}\]]", 1))["own"]
        taken = F.filter(F.transform(F.split(pattern, ","), lambda x: F.regexp_extract(x, rf"^\s*(?:[\w$]+\s*:\s*)?(?:\.\.\.)?({_ID})", 1)), lambda x: x != "")
        return F.coalesce(F.transform(taken, lambda x: out(x, no, F.lit("variable"))), F.filter(many, lambda v: v["name"] != ""))

    def listed(s: Column) -> Column:
        each = F.transform(_listed(s), lambda n: record(n=n, kind=kind_of(n["name"])))
        name = lambda n: F.when(n["alias"] == "default", n["name"]).otherwise(F.coalesce(n["alias"], n["name"]))
        return F.transform(F.filter(each, lambda x: x["kind"].isNotNull()), lambda x: out(name(x["n"]), F.coalesce(x["n"]["alias"] == "default", no), plain(x["kind"])))

    def declared(s: Column) -> Column:
        text = s["text"]
        is_export = text.rlike(r"^\s*export\b")
        one = lambda name, default, kind: F.array(out(F.coalesce(_some(name), F.lit("default")), default != "", kind))
        named = let(groups(text, _FUNCTION, 4), lambda g: F.when(g[1] != "", one(g[4], g[2], F.lit("function"))))
        classed = let(groups(text, _CLASS, 3), lambda g: F.when(g[1] != "", one(g[3], g[2], F.lit("class"))))
        other = let(groups(text, _OTHER, 3), lambda g: F.when(g.isNotNull(), one(g[3], g[1], plain(g[2]))))
        bare = let(groups(text, _DEFAULT, 2), lambda g: F.when(g[1] != "", F.array(out(g[1], F.lit(True), plain(F.coalesce(kind_of(g[1]), F.lit("variable")))))).when(
            g.isNotNull(), F.array(out(F.lit("default"), F.lit(True), F.when(g[2] != "", "function").otherwise("variable")))))
        found = F.when(text.rlike(_VARIABLES), variables(s)).when(_local_list(s), listed(s)).otherwise(F.coalesce(named, classed, other, bare, none))
        return F.when(is_export, found).otherwise(none).cast(shape)

    def again(s: Column) -> Column:
        text, source = s["text"], _nest(F.regexp_extract(s["text"], _LIST, 4))["own"]
        typed = F.regexp_extract(text, _LIST, 1) != ""
        star = F.array(out(F.lit("*"), no, F.lit("reexport"), typed=typed, source=source))
        many = F.transform(_listed(s), lambda n: out(n["name"], no, F.lit("reexport"), n["alias"], typed, source))
        return F.when(source.isNull(), none).when(F.regexp_extract(text, _LIST, 3) == "*", star).otherwise(many).cast(shape)

    rows = rows.withColumn("found", F.concat(F.flatten(F.transform("cut", declared)), F.flatten(F.transform("cut", again))))
    rows = rows.select("scan_id", file_id(F.col("file_path")).alias("file_id"), "file_path", F.posexplode("found").alias("exp_ord", "e"))
    return rows.select("scan_id", "file_id", "file_path", "exp_ord", "e.*")


def lines_with_depth(files: DataFrame) -> DataFrame:
    """scan_id, file_path, line (from 1), text, delta, depth (braces open after the line)."""
    rows = files.select("scan_id", "file_path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    rows = rows.select("scan_id", "file_path", (F.col("pos") + 1).alias("line"), "text", brace_delta(F.col("text")).alias("delta"))
    return rows.withColumn("depth", F.sum("delta").over(W.partitionBy("scan_id", "file_path").orderBy("line")))


# One parameter: no comma outside brackets.
_ONE = r"((?:=>|[^,(){}\[\]<>=]+|=|\([^()]*\)|\{[^{}]*\}|\[[^\[\]]*\]|<[^<>]*(?:<[^<>]*>[^<>]*)*>)++)"
_NAME = r"^(?:\.\.\.)?([\w$]+|\{[^{}]*\}|\[[^\[\]]*\])"
_TYPE = r"^(?:\.\.\.)?(?:[\w$]+|\{[^{}]*\}|\[[^\[\]]*\])\??\s*:\s*([^=]+(?:=>[^=]*)*)"


def _params(text: Column) -> Column:
    """array of struct(name, type, is_optional, default_value) of a parameter list's own text, all as written; a parameter
    with a default or of the rest is optional."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(_ONE), F.lit(1)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    some = lambda p, pattern: F.nullif(F.trim(F.regexp_extract(p, pattern, 1)), F.lit(""))
    default = lambda p: some(p, r"(?s)(?<![=!<>])=(?![=>])\s*(.*)$")
    return F.transform(
        parts,
        lambda p: record(name=written(F.regexp_extract(p, _NAME, 1)), type=written(some(p, _TYPE)), is_optional=(p.rlike(_NAME + r"\s*\?") | p.startswith("...") | default(p).isNotNull()), default_value=written(default(p))),
    )


# Fixed words of the language.
_KEYWORDS = (
    "await async break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in "
    "instanceof interface let new null of package private protected public return static super switch this throw true try type typeof undefined var void while with yield "
    "string number boolean any unknown never object as keyof readonly infer is"
).split()


_BEHAVIORAL = "struct<summary:string,source:string,analyzed_at:timestamp,flags:struct<" + ",".join(f"{f}:boolean" for f in (
    "databaseRead", "databaseWrite", "httpCall", "fileRead", "fileWrite", "sendsNotification", "modifiesGlobalState", "hasSideEffects")) + ">>"
_FOUND = "struct<line:int,end_line:int,at:int,end_at:int,name:string,own_export:boolean,is_async:boolean,parameters:string,return_type:string,body:int,code:string,visibility:string,is_static:boolean>"


def slice_function_source(content: Column, line: Column, end_line: Column) -> Column:
    """Lines line..end_line (from 1) of a text; empty for no text."""
    return F.coalesce(F.array_join(F.slice(F.split(content, "\n"), line, F.greatest(end_line - line + 1, F.lit(0))), "\n"), F.lit(""))


_WORD = r"(?<![.\w$#\x01])([A-Za-z_$][\w$]*+)"
_ONE_TYPE = rf"(?:(?:keyof|typeof|readonly|unique)\s+)*(?:[\w$.]+{_GENERIC}|\{{\x01\d+\}}|\(\x01\d+\)(?:\s*=>\s*[\w$.]+)?|\[\x01\d+\]|['\"`]\x01\d+['\"`])(?:\[\x01\d+\])*"
_SOME_TYPE = rf"{_ONE_TYPE}(?:\s*[|&]\s*{_ONE_TYPE})*"
_BOUND = rf"(?:{_ID}|\{{\x01\d+\}}|\[\x01\d+\])"
#: Type positions of an own text, and what stays of each.
_TYPES = (
    (rf"\binterface\s+{_ID}[^{{;]*\{{\x01\d+\}}", ""), (rf"\btype\s+{_ID}\s*{_GENERIC}\s*=(?!=)\s*\|?\s*{_SOME_TYPE}", ""), (rf"\b(?:as|satisfies)\s+(?:const\b|{_SOME_TYPE})", ""),
    (rf"\b(const|let|var)\s+({_BOUND})\s*!?\s*:\s*{_SOME_TYPE}", "$1 $2"), (rf"(\(\x01\d+\))\s*:\s*(?:asserts\s+)?(?:{_ID}\s+is\s+)?{_SOME_TYPE}(?=\s*(?:=>|\{{\x01))", "$1"), (rf"(?<=[\w$]){_GENERIC.removesuffix('?')}(?=\s*[(`]\x01)", ""),
)
_PARAMETER_TYPE = (rf"((?:^|,)\s*(?:(?:public|private|protected|readonly)\s+)*{_BOUND})\s*\??\s*:\s*{_SOME_TYPE}", "$1")
#: Keys and methods' names of an object.
_KEYS = ((rf"((?:^|,)\s*)(?:{_ID}|['\"]\x01\d+['\"]|\d+)\s*:(?!:)", "$1"), (rf"((?:^|,)\s*)(?:(?:async|get|set)\s+)?\*?\s*{_ID}\s*(?=\(\x01\d+\)\s*\{{\x01)", "$1"))
#: Round brackets with the block behind them: what stands before, their number, the block's; those of an arrow without a
#: block; a single name of an arrow.
_WITH_BLOCK = r"(?:\b(if|while|switch|for|with|catch)\s*(?:await\s*)?)?\(\x01(\d+)\)\s*(?:=>\s*)?\{\x01(\d+)\}"
_ARROW_LIST, _ARROW_NAME = r"\(\x01(\d+)\)\s*=>(?!\s*\{\x01)", rf"(?<![.\w$])({_ID})\s*=>"
_LOCAL = rf"\b(?:const|let|class|enum|function\s*\*?|,)\s*({_ID})(?=\s*(?:[=;:(<{{\n,]|extends|of\b|in\b|$))"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """array of structs g1..gn of all matches."""
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(n)]
    return F.arrays_zip(*(e.alias(f"g{i + 1}") for i, e in enumerate(each)))


def _without(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, stays in rules:
        text = F.regexp_replace(text, pattern, stays)
    return text


def with_references(rows: DataFrame, root: Column, first: Column, last: Column, inside: Column, exclude: Column, name: str = "references") -> DataFrame:
    """rows with the distinct names that a piece of code uses: not keywords, properties, keys, types or excluded names, nor
    those that the code declares itself where they are used.

    root: its own text, standing between the places first and last of the file; inside: the nests of that stretch, with
    their ids, which follow one another.  Scopes are the nests: a declaration holds in the nest where it stands and in all inside, parameters in their brackets and the
    body; a name is looked up by the intervals that hold the place of its use.  Nests that only types mention are not read.
    """
    nest = record(id=F.lit(""), mark=F.lit(""), at=first, end_at=last, own=root)
    inner = F.transform(inside, lambda n: record(id=n["id"].cast("string"), mark=n["mark"], at=n["at"], end_at=n["end_at"], own=F.when(n["mark"].isin("'", '"'), "").otherwise(n["own"])))
    rows = rows.withColumn("_n", F.concat(F.array(nest), F.coalesce(inner, F.array().cast("array<struct<id:string,mark:string,at:int,end_at:int,own:string>>"))))
    plain = lambda n: _without(n["own"], (r"\.\.\.", " "), *_TYPES)
    rows = rows.withColumn("_t", F.transform("_n", lambda n: record(id=n["id"], mark=n["mark"], at=n["at"], end_at=n["end_at"], text=plain(n))))
    # nests follow one another, the root first: a number says where its nest is
    by_id = lambda i: F.when(i == "", F.get("_t", F.lit(0))).otherwise(F.get("_t", i.try_cast("int") - F.get("_t", F.lit(1))["id"].try_cast("int") + 1))
    rows = rows.withColumn("_b", F.flatten(F.transform("_t", lambda n: F.transform(_groups(n["text"], _WITH_BLOCK, 3), lambda g: record(word=g["g1"], p=g["g2"], b=g["g3"], at=n["at"], end_at=n["end_at"])))))
    rows = rows.withColumn("_a", F.flatten(F.transform("_t", lambda n: F.transform(F.regexp_extract_all(n["text"], F.lit(_ARROW_LIST), F.lit(1)), lambda p: record(word=F.lit(""), p=p, b=n["id"], at=n["at"], end_at=n["end_at"])))))
    # lists of parameters are read without their types
    lists = F.transform(F.filter(F.concat("_b", "_a"), lambda b: b["word"].isin("", "catch")), lambda b: b["p"])
    rows = rows.withColumn("_p", lists)
    rows = rows.withColumn("_t", F.transform("_t", lambda n: F.when(F.array_contains("_p", n["id"]), n.withField("text", _without(n["text"], _PARAMETER_TYPE))).when(n["mark"] == "{", n.withField("text", _without(n["text"], *_KEYS))).otherwise(n)))
    names = lambda text: F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))
    bare = lambda text: F.regexp_replace(text, r"=(?!>)[^,]*", "")
    declared = lambda n, a, b: F.transform(n, lambda x: record(name=x, first=a, last=b))

    def bound(number: Column) -> Column:
        """Names that a list or pattern binds, those of patterns inside included."""
        outer = by_id(number)
        return let(outer, lambda o: F.flatten(F.transform(F.filter("_t", lambda n: (n["at"] >= o["at"]) & (n["end_at"] <= o["end_at"]) & n["mark"].isin("(", "{", "[")), lambda n: names(bare(n["text"])))))

    def of_block(b: Column) -> Column:
        looped = F.regexp_extract_all(by_id(b["p"])["text"], F.lit(rf"\b(?:const|let|var)\s+({_ID})"), F.lit(1))
        own = F.when(b["word"] == "for", looped).when(b["word"].isin("", "catch"), bound(b["p"])).otherwise(F.array().cast("array<string>"))
        p, body = by_id(b["p"]), by_id(b["b"])
        return F.concat(declared(own, p["at"], p["end_at"]), declared(own, body["at"], body["end_at"]))

    local = F.flatten(F.transform("_t", lambda n: F.concat(
        declared(F.regexp_extract_all(n["text"], F.lit(rf"\b(?:const|let|class|enum|function\s*\*?)\s+({_ID})"), F.lit(1)), n["at"], n["end_at"]),
        declared(F.regexp_extract_all(n["text"], F.lit(rf"\bvar\s+({_ID})"), F.lit(1)), first, last),
        declared(F.flatten(F.transform(F.regexp_extract_all(n["text"], F.lit(r"\b(?:const|let|var)\s*[{\[]\x01(\d+)[}\]]"), F.lit(1)), bound)), n["at"], n["end_at"]),
        declared(F.regexp_extract_all(n["text"], F.lit(_ARROW_NAME), F.lit(1)), n["at"], n["end_at"]),
    )))
    rows = rows.withColumn("_d", F.concat(local, F.flatten(F.transform(F.concat("_b", "_a"), of_block))))
    mentioned = F.concat(F.array(F.lit("")), F.flatten(F.transform("_t", lambda n: F.regexp_extract_all(n["text"], F.lit(_CHILD), F.lit(1)))))
    rows = rows.withColumn("_m", F.array_except(F.transform("_t", lambda n: n["id"]), mentioned)).withColumn("_dead", F.filter("_t", lambda n: F.array_contains("_m", n["id"])))
    live = F.filter("_t", lambda n: ~F.exists("_dead", lambda d: (d["at"] <= n["at"]) & (n["end_at"] <= d["end_at"])))
    # only names that are declared anywhere are looked up
    rows = rows.withColumn("_o", F.array_distinct(F.transform("_d", lambda d: d["name"]))).withColumn("_live", live)
    hidden = lambda n, x: F.exists("_d", lambda d: (d["name"] == x) & (d["first"] <= n["at"]) & (n["end_at"] <= d["last"]))
    used = F.transform("_live", lambda n: let(names(n["text"]), lambda all_: F.concat(F.array_except(all_, F.col("_o")), F.filter(F.array_intersect(all_, F.col("_o")), lambda x: ~hidden(n, x)))))
    out = F.array_except(F.array_except(F.array_distinct(F.flatten(used)), F.array(*map(F.lit, _KEYWORDS))), exclude)
    return rows.withColumn(name, out).drop("_n", "_t", "_b", "_a", "_p", "_d", "_m", "_dead", "_o", "_live")


def _end(text: Column, at: Column, line: Column) -> tuple[Column, Column]:
    """(place, line) of the last character of an own text that begins at a place and line."""
    last = _nest(F.regexp_extract(text, rf"(?s)^.*{_CHILD}", 1))
    rest = F.when(last.isNotNull(), F.regexp_replace(text, rf"(?s)^.*{_CHILD}", "")).otherwise(text)
    breaks = F.length(rest) - F.length(F.replace(rest, F.lit("\n"), F.lit("")))
    return F.coalesce(last["end_at"], at - 1) + F.length(rest), F.coalesce(last["end_line"], line) + breaks


def _found(piece: Column, whole: Column, name: Column, own_export: Column, is_async: Column, parameters: Column, return_type: Column, body: Column, code: Column, visibility: Column, is_static: Column) -> Column:
    at, line = _begins(piece)
    end_at, end_line = _end(F.regexp_replace(whole, r"[;\s]+$", ""), piece["at"], piece["line"])
    return record(
        line=line, end_line=end_line, at=at, end_at=end_at, name=name, own_export=own_export, is_async=is_async, parameters=parameters, return_type=return_type, body=body.try_cast("int"), code=code, visibility=visibility,
        is_static=is_static,
    ).cast(_FOUND)


def _some(group: Column) -> Column:
    return F.nullif(F.trim(group), F.lit(""))


def _function(s: Column, g: Column) -> Column:
    """g: the groups of _FUNCTION, the whole match first."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    kind = F.coalesce(_some(g[6]), _some(g[8]))
    return _found(s, g[0], F.coalesce(_some(g[4]), F.lit("anonymous")), g[1] != "", g[3] != "", _nest(g[5])["own"], written(kind), g[7], none, none, no)


def _arrow(s: Column, d: Column, g: Column) -> Column:
    exported = F.regexp_extract(s["text"], _VARIABLES, 1) != ""
    return _found(d, g[0], g[1], exported, g[2] != "", F.coalesce(_nest(g[3])["own"], g[4]), written(_some(g[5])), g[6], _some(g[7]), F.lit(None).cast("string"), F.lit(False))


def _method(m: Column, g: Column) -> Column:
    kind = F.coalesce(_some(g[4]), _some(g[6]))
    none = F.lit(None).cast("string")
    return _found(m, g[0], g[2], F.lit(False), g[1].rlike(r"\basync\b"), _nest(g[3])["own"], written(kind), g[5], none, _visibility(g[1]), g[1].rlike(r"\bstatic\b"))


def _visibility(modifiers: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(modifiers, r"\b(private|protected)\b", 1), F.lit("")), F.lit("public"))


def _functions_of(rows: DataFrame, parent: Column, class_parent: Column, order: list[str], make_id) -> DataFrame:
    """Rows of found functions f (with content and nests of their files) as rows of the functions table."""
    f, body = F.col("f"), _nest(F.col("f.body"))
    numbered = F.transform("nests", lambda n, i: record(id=i, mark=n["mark"], at=n["at"], end_at=n["end_at"], own=n["own"]))
    first, last = F.coalesce(body["at"], f["at"]), F.coalesce(body["end_at"], f["end_at"])
    number = F.col("f.body")
    inner = F.when(number.isNotNull(), F.slice(numbered, number + 2, body["last"] - number)).otherwise(F.filter(numbered, lambda n: (n["at"] >= f["at"]) & (n["end_at"] <= f["end_at"])))
    root = F.coalesce(body["own"], f["code"], F.lit(""))
    rows = rows.select(
        "scan_id", "file_path", *order, "exported_names", parent.alias("parent_file_id"), class_parent.alias("parent_class_id"), f["line"].alias("line"), f["end_line"].alias("end_line"), f["name"].alias("name"), f["own_export"].alias("own_export"),
        f["is_async"].alias("is_async"), f["return_type"].alias("return_type"), f["visibility"].alias("visibility"), f["is_static"].alias("is_static"), _params(F.coalesce(f["parameters"], F.lit(""))).alias("params"),
        F.substring("content", f["at"], f["end_at"] - f["at"] + 1).alias("source"), root.alias("root"), first.alias("first"), last.alias("last"), inner.alias("inside"),
    )
    bound = F.flatten(F.transform("params", lambda p: F.regexp_extract_all(p["name"], F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1))))  # a pattern binds several names
    rows = with_references(rows, F.col("root"), F.col("first"), F.col("last"), F.col("inside"), bound)
    exported = F.col("own_export") | (F.col("parent_class_id").isNull() & F.array_contains("exported_names", F.col("name")))
    owner = F.coalesce("parent_class_id", "parent_file_id")
    return rows.select(
        "scan_id", make_id(owner, F.col("name"), F.col("line")).alias("function_id"), "name", "file_path", "line", "end_line", "parent_file_id", "parent_class_id", (F.row_number().over(W.partitionBy("scan_id", "file_path", "parent_class_id").orderBy(*order))).alias("fn_ord"),
        "params", "return_type", exported.alias("is_exported"), "is_async", "source", "references", F.lit(None).cast(_BEHAVIORAL).alias("behavioral"), "visibility", "is_static",
    )


def extract_functions(files: DataFrame) -> DataFrame:
    """Top-level functions and arrow constants: scan_id, function_id, name, file_path, line, end_line, parent_file_id,
    parent_class_id (null), fn_ord, params, return_type, is_exported (by its declaration, a list or a default), is_async,
    source, references, behavioral (null)."""
    none = F.array().cast(f"array<{_FOUND}>")
    arrows = lambda s: F.filter(F.transform(_declarators(s), lambda d: let(groups(d["text"], _ARROW, 7), lambda g: F.when(g.isNotNull(), _arrow(s, d, g)))), lambda f: f.isNotNull())
    plain = lambda s: let(groups(s["text"], _FUNCTION, 8), lambda g: F.when(g.isNotNull(), F.array(_function(s, g))))
    found = F.flatten(F.transform("cut", lambda s: F.when(s["text"].rlike(_VARIABLES), arrows(s)).otherwise(F.coalesce(plain(s), none))))
    rows = statements(files).select("scan_id", "file_path", "content", "nests", _exported_names().alias("exported_names"), F.posexplode(found).alias("ord", "f"))
    return _functions_of(rows, file_id(F.col("file_path")), F.lit(None).cast("string"), ["ord"], function_id).drop("visibility", "is_static")


def _class_rows(files: DataFrame) -> DataFrame:
    """A row a class: the parts of its head, its nest and its members."""
    heads = F.filter(F.transform("cut", lambda s: record(s=s, g=groups(s["text"], _CLASS, 6))), lambda h: h["g"].isNotNull())
    rows = statements(files).select("scan_id", "file_path", "content", "nests", _exported_names().alias("exported_names"), F.explode(heads).alias("h"))
    g = lambda i: F.col("h.g")[i]
    at, line = _begins(F.col("h.s"))
    implements = F.filter(F.transform(F.split(F.coalesce(written(_some(g(5))), F.lit("")), r",(?![^<>]*>)"), lambda p: F.trim(p)), lambda x: x != "")
    name = F.coalesce(_some(g(3)), F.lit("anonymous"))
    rows = rows.select(
        "scan_id", "file_path", "content", "nests", "exported_names", name.alias("name"), line.alias("line"), (g(1) != "").alias("own_export"), written(_some(g(4))).alias("extends"), implements.alias("implements"), _nest(g(6)).alias("body"),
    )
    rows = rows.withColumn("parent_file_id", file_id(F.col("file_path"))).withColumn("class_id", class_id(F.col("parent_file_id"), F.col("name"), F.col("line")))
    rows = rows.withColumn("end_line", F.col("body.end_line")).withColumn("is_exported", F.col("own_export") | F.array_contains("exported_names", F.col("name")))
    members = F.transform(cut(F.col("body.own"), F.col("body.at") + 1, F.col("body.line"), _MEMBER), lambda m: record(m=m, g=groups(m["text"], _METHOD, 6)))
    return rows.withColumn("members", members)


def _is_method(member: Column) -> Column:
    """A method with a body, or an abstract one; constructors and accessors are none."""
    g = member["g"]
    return g.isNotNull() & ~g[2].isin("constructor", "function", "if", "for", "while", "switch", "catch", "return") & ((g[5] != "") | g[1].rlike(r"\babstract\b"))


def extract_methods(files: DataFrame) -> DataFrame:
    """The methods of all classes as rows of the functions table (see `extract_functions`), with parent_class_id,
    visibility and is_static; fn_ord counts inside the class."""
    rows = _class_rows(files).select("scan_id", "file_path", "content", "nests", "exported_names", "class_id", F.posexplode(F.transform(F.filter("members", _is_method), lambda x: _method(x["m"], x["g"]))).alias("ord", "f"))
    return _functions_of(rows, file_id(F.col("file_path")), F.col("class_id"), ["ord"], method_id)


def all_functions(files: DataFrame) -> DataFrame:
    """Top-level functions and methods: the functions table of a scan."""
    return extract_functions(files).unionByName(extract_methods(files).drop("visibility", "is_static"))


def extract_classes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with their methods' ids and properties, methods: class_id, method_id, name, line, visibility, is_static, is_async)."""
    rows = _class_rows(files)

    def property_of(m: Column, g: Column) -> Column:
        return record(line=_begins(m)[1], name=g[2], type=written(_some(g[3])), visibility=_visibility(g[1]), is_static=g[1].rlike(r"\bstatic\b"), is_readonly=g[1].rlike(r"\breadonly\b"))

    def listed(x: Column) -> Column:
        line, modifiers, name = _begins(x["m"])[1], x["g"][1], x["g"][2]
        return record(method_id=method_id(F.col("class_id"), name, line), name=name, line=line, visibility=_visibility(modifiers), is_static=modifiers.rlike(r"\bstatic\b"), is_async=modifiers.rlike(r"\basync\b"))

    rows = rows.withColumn("listed", F.transform(F.filter("members", _is_method), listed))
    properties = F.transform(F.filter("members", lambda x: x["g"].isNull()), lambda x: let(groups(x["m"]["text"], _PROPERTY, 3), lambda g: F.when(g.isNotNull(), property_of(x["m"], g))))
    rows = rows.withColumn("properties", F.filter(properties, lambda p: p.isNotNull()))
    order = F.row_number().over(W.partitionBy("scan_id", "file_path").orderBy("line", F.col("body.at")))
    classes = rows.select(
        "scan_id", "class_id", "file_path", "line", "end_line", "name", "is_exported", "extends", "implements", "parent_file_id", order.alias("cls_ord"), F.transform("listed", lambda m: m["method_id"]).alias("methods"), "properties",
    )
    return classes, rows.select("scan_id", "class_id", F.explode("listed").alias("m")).select("scan_id", "class_id", "m.*")


_IMPORT = r"(?s)^\s*import\b[^;'\"]*(?:['\"]\x01\d+['\"])?[^;\n]*;?"
_TYPE_STATEMENT = r"(?s)^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:interface\b[^{]*\{\x01\d+\}|(?:const\s+)?(?:enum|namespace|module)\b[^{]*\{\x01\d+\}|type\s.*?(?:;|(?<![=|&:>])\n(?!\s*[|&?:])|$))"


def extract_top_level_references(files: DataFrame, functions: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """scan_id, file_path, names: names that statements outside functions, classes, imports, exports and types use, values
    of constants included; imported names are left out.  functions, classes: not needed any more."""
    def of_declarator(d: Column) -> Column:
        value = F.regexp_replace(d["text"], _DECLARATOR + r"\s*!?(?:\s*:(?:=>|[^=;])*?)?(?:=(?!>)|(?=;|\n|$))", " ")
        return F.when(d["text"].rlike(_ARROW), F.regexp_replace(d["text"], _ARROW, "; ")).otherwise(value)

    def free(s: Column) -> Column:
        text = s["text"]
        gone = lambda pattern: F.regexp_replace(text, pattern, " ")
        return (
            F.when(text.rlike(_FUNCTION), gone(_FUNCTION)).when(text.rlike(_CLASS), gone(_CLASS)).when(text.rlike(r"^\s*import\b(?!\s*\()"), gone(_IMPORT)).when(text.rlike(_TYPE_STATEMENT), gone(_TYPE_STATEMENT))
            .when(text.rlike(_LIST), gone(_LIST)).when(text.rlike(r"^\s*export\s+default\b"), gone(r"(?s)^\s*export\s+default\b.*?(?:;|\n|$)")).when(text.rlike(_VARIABLES), F.array_join(F.transform(_declarators(s), of_declarator), "; ")).otherwise(text)
        )

    # what the statements declare together holds for the whole file, but uses of it count: only imports are left out
    taken = F.flatten(F.transform(extract_import_statements(F.col("content")), lambda s: F.regexp_extract_all(s, F.lit(r"(\w+)"), F.lit(1))))
    rows = statements(files).select("scan_id", "file_path", taken.alias("taken"), F.array_join(F.transform("cut", free), "\n").alias("root"), F.length("content").alias("n"), F.transform("nests", lambda n, i: record(id=i, mark=n["mark"], at=n["at"], end_at=n["end_at"], own=n["own"])).alias("nests"))
    return with_references(rows, F.col("root"), F.lit(0), F.coalesce("n", F.lit(0)) + 1, F.col("nests"), F.col("taken"), "names").select("scan_id", "file_path", "names")


def file_rows(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """scan_id, file_id, name, file_path, end_line, functions and classes (ids in order)."""
    functions = functions.where("parent_class_id is null") if "parent_class_id" in functions.columns else functions
    ids = lambda df, i, o: df.groupBy("scan_id", F.col("parent_file_id").alias("file_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(o, i))), lambda s: s[i]).alias(i + "s"))
    base = files.select("scan_id", file_id(F.col("file_path")).alias("file_id"), last_segment(F.col("file_path")).alias("name"), "file_path", F.size(F.split("content", "\n")).alias("end_line"))
    out = base.join(ids(functions, "function_id", "fn_ord"), ["scan_id", "file_id"], "left").join(ids(classes, "class_id", "cls_ord"), ["scan_id", "file_id"], "left")
    none = F.array().cast("array<string>")
    return out.select(*base.columns, F.coalesce("function_ids", none).alias("functions"), F.coalesce("class_ids", none).alias("classes"))


def parse_file(files: DataFrame, path: str | None = None) -> DataFrame:
    """The row of one file with its functions and classes, or those of all files."""
    some = files if path is None else files.where(F.col("file_path") == path)
    return file_rows(some, extract_functions(some), extract_classes(some)[0])
