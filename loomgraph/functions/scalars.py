"""Scalar functions over findings, functions and analyses: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seven effects a function can have, in the order of the flags; the eighth flag, has_side_effects, is implied.
EFFECTS = ("databaseRead", "databaseWrite", "httpCall", "fileRead", "fileWrite", "sendsNotification", "modifiesGlobalState")
FLAGS = (*EFFECTS, "hasSideEffects")

# Lanes in their order, and the words in a function's code that tell each effect.
EFFECT_GROUPS = ("database", "network", "filesystem", "notification", "state", "pure", "unknown")
EFFECT_WORDS = {
    "databaseRead": r"\b(select|find|findOne|query|getBy)\b",
    "databaseWrite": r"\b(insert|update|delete|save|create)\b",
    "httpCall": r"\b(fetch|axios|http)\b",
    "fileRead": r"\b(readFile|createReadStream|readFileSync)\b",
    "fileWrite": r"\b(writeFile|createWriteStream|writeFileSync)\b",
    "sendsNotification": r"\b(sendMail|sendEmail|notify|sms|push)\b",
    "modifiesGlobalState": r"\bglobal\b|process\.env\s*=",
}
LEVEL_RANKS = {"error": 3, "warning": 2, "info": 1}
COMMON_GLOBALS = (
    "console process global globalThis window document setTimeout setInterval clearTimeout clearInterval "
    "Promise Array Object String Number Boolean Symbol Map Set WeakMap WeakSet Date RegExp Error "
    "JSON Math Intl Reflect Proxy Buffer require module exports __dirname __filename"
).split()
ENTRY_NAMES = r"(?i)^(main|index|app|init.*|setup.*|bootstrap.*|handler|middleware|router)$"
TRUNCATED = "\n// ... truncated"


def classify_effect(behavioral: Column) -> Column:
    """The lane of a function: the first effect in order of priority; null means not analysed."""
    f = lambda name: F.coalesce(behavioral["flags"][name], F.lit(False))
    return (
        F.when(behavioral.isNull(), "unknown")
        .when(f("databaseRead") | f("databaseWrite"), "database")
        .when(f("httpCall"), "network")
        .when(f("fileRead") | f("fileWrite"), "filesystem")
        .when(f("sendsNotification"), "notification")
        .when(f("modifiesGlobalState") | f("hasSideEffects"), "state")
        .otherwise("pure")
    )


def infer_flags(code: Column) -> Column:
    """struct of the eight flags, told from the code's words."""
    seen = {name: F.coalesce(code.rlike(f"(?i){pattern}"), F.lit(False)) for name, pattern in EFFECT_WORDS.items()}
    some = F.lit(False)
    for c in seen.values():
        some |= c
    return F.struct(*(c.alias(n) for n, c in seen.items()), some.alias("hasSideEffects"))


def truthy(value: Column) -> Column:
    """A JSON value's truth as JavaScript has it; missing values are false."""
    kind = F.schema_of_variant(value)
    text, number = value.cast("string"), F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind.isin("VOID", "NULL"), F.lit(False))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), (number != 0) & ~F.isnan(number))
        .otherwise(value.isNotNull()),
        F.lit(False),
    )


def normalize_analysis(raw: Column) -> Column:
    """struct(ok, summary of at most 150 characters, flags) from a JSON answer; not ok without an object or a summary."""
    v = F.try_parse_json(raw)
    summary = F.try_variant_get(v, "$.summary", "variant")
    is_text = F.coalesce(F.schema_of_variant(summary) == "STRING", F.lit(False))
    text = F.try_variant_get(v, "$.summary", "string")
    ok = is_text & (F.trim(F.coalesce(text, F.lit(""))) != "")
    flag = {n: truthy(F.try_variant_get(v, f"$.flags.{n}", "variant")) for n in FLAGS}
    some = F.lit(False)
    for c in flag.values():
        some |= c
    flags = F.struct(*(flag[n].alias(n) for n in EFFECTS), some.alias("hasSideEffects"))
    return F.struct(ok.alias("ok"), F.when(ok, text.substr(1, 150)).alias("summary"), F.when(ok, flags).alias("flags"))


def build_prompt(name: Column, code: Column, path: Column, most: int = 2000) -> Column:
    """The question about a function, its code cut at `most` characters."""
    cut = F.when(F.length(code) > most, F.concat(code.substr(1, most), F.lit(TRUNCATED))).otherwise(code)
    return F.concat(F.lit("Analyze this function:\n\nFile: "), path, F.lit("\nFunction: "), name, F.lit("\n\n```typescript\n"), cut, F.lit("\n```"))


def content_hash(code: Column) -> Column:
    return F.substring(F.sha2(code, 256), 1, 16)


def finding_identity(source: Column, category: Column, nodes: Column) -> Column:
    """What a finding is called in every scan."""
    return F.concat_ws("|", source, category, F.array_join(F.array_sort(nodes), ","))


def level_rank(level: Column) -> Column:
    out = F.lit(0)
    for name, rank in LEVEL_RANKS.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def folder_node_id(folder: Column) -> Column:
    return F.concat(F.lit("folder:"), folder)


def is_folder_node_id(node: Column) -> Column:
    return node.startswith("folder:")


def folder_of_node_id(node: Column) -> Column:
    return F.when(is_folder_node_id(node), F.substring(node, 8, 1 << 30))


def active_flags(flags: Column) -> Column:
    """Names of the effects that are set, without the implied flag."""
    return F.filter(F.array(*(F.when(flags[n], F.lit(n)) for n in EFFECTS)), lambda x: x.isNotNull())


def cycle_is_runtime_harmless(cycle: Column, own_types: Column) -> Column:
    """Whether a hop of a reported cycle is type-only; without hops the violation's own types tell."""
    hop = F.exists(cycle, lambda h: F.coalesce(F.array_contains(h["dependencyTypes"], "type-only"), F.lit(False)))
    own = F.coalesce(F.array_contains(own_types, "type-only"), F.lit(False))
    return F.when(F.coalesce(F.size(cycle), F.lit(0)) > 0, hop).otherwise(own)


def is_common_global(name: Column) -> Column:
    return name.isin(*COMMON_GLOBALS)


def is_entry_point_name(name: Column) -> Column:
    return name.rlike(ENTRY_NAMES) | name.startswith("_")


def matches_search(query: str, *columns: Column) -> Column:
    """Case-insensitive substring of any column; an empty query fits all."""
    hit = F.lit(not query)
    for c in columns:
        hit |= F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return hit


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob with ** * ? and {a,b}."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            depth += (c == "{") - (c == "}")
            out += {"*": "[^/]*", "?": "[^/]", "{": "(", "}": ")"}.get(c) or ("|" if c == "," and depth else "\\" + c if c in ".+()[]^$|\\" else c)
            i += 1
    return f"^{out}$"


def matches_globs(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)
