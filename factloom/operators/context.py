"""Source files that belong to an operation of a contract, by evidence in their paths and texts.

An inverted index brings an operation together with just the files that can score: those with a word of its name or of its
route, or with one of its terms in the path (by its first three characters).  Texts are read again for these pairs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import candidate_source, regex_escaped, search_tokens
from factloom.sources.delimiters import code_text
from factloom.sources.tables import durable

# Weights, the least score and lead, and the shapes of declarations and registrations; {} is the name.
WEIGHTS = {"handler_declaration": 240, "symbol_reference": 25, "full_route_literal": 100, "leaf_route_literal": 45, "http_method_registration": 25}
FILE_TERM, TEXT_TERM, FILE_ROUTE, TEXT_ROUTE, ALL_ROUTE, ROUTE_FOLDER = 30, 6, 40, 4, 10, 10
LEAST, LEAD, MOST = 25, 30, 4
DECLARATIONS = [
    r"\b(?:async\s+)?def\s+{}\s*\(", r"\b(?:async\s+)?function\s+{}\s*\(", r"\bfun\s+{}\s*\(", r"\bfunc\s+(?:\([^\n)]{{1,120}}\)\s*)?{}\s*\(",
    r"\b(?:pub\s+)?(?:async\s+)?fn\s+{}\s*(?:<[^\n>]{{1,128}}>)?\s*\(", r"(?:^|\n)[ \t]*(?:(?:public|protected|private|static|final|override|suspend)\s+)+[^\n;{{}}=()]{{0,180}}?\b{}\s*\(",
]
_ARGS, _RETURNS = r"\((?:[^();]|\([^();]*\))*\)", r"(?:[ \t]*:[ \t]*[A-Za-z_$][\w.$<>\[\]| &?,]{{0,180}})?"
JS_DECLARATIONS = [
    r"\b(?:const|let|var)\s+{}\s*=\s*(?:async\b\s*)?(?:function\b|(?:" + _ARGS + _RETURNS + r"|[A-Za-z_$][\w$]*)\s*=>)", r"(?:^|\n)[ \t]*(?:async\s+)?{}[ \t]*" + _ARGS + _RETURNS + r"[ \t]*\{{",
]
JS_FILE = r"(?i)\.(?:[cm]?js|jsx|ts|tsx)$"
REGISTRATIONS = {
    "GET": r"""(?i)@(?:app|router|api|bp)\.get\s*\(|@GetMapping\s*\(|\.get\s*\(\s*["']""", "POST": r"""(?i)@(?:app|router|api|bp)\.post\s*\(|@PostMapping\s*\(|\.post\s*\(\s*["']""",
    "PUT": r"(?i)@(?:app|router|api|bp)\.put\s*\(|@PutMapping\s*\(", "PATCH": r"(?i)@(?:app|router|api|bp)\.patch\s*\(|@PatchMapping\s*\(", "DELETE": r"(?i)@(?:app|router|api|bp)\.delete\s*\(|@DeleteMapping\s*\(",
}
ROUTE_FOLDERS = r"(?:^|/)(routes?|controllers?|api|views|endpoints|handlers)(/|$)"
_WORD = r"[a-z0-9_$]+"


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({_WORD})"), F.lit(1)))


def _holds(text: str, word: Column) -> Column:
    """Does the text have the word, whatever the case, with nothing of a name beside it?"""
    return F.regexp_like(F.col(text), F.concat(F.lit("(?i)(?:^|[^a-z0-9_$])"), regex_escaped(word), F.lit("(?:$|[^a-z0-9_$])")))


def _any(text: str, shapes: list[str], name: Column) -> Column:
    """Does the text have one of the shapes with the name in it?"""
    made = []
    for shape in shapes:
        before, after = shape.format("\0").split("\0")
        made.append(F.concat(F.lit(before), name, F.lit(after)))
    return F.regexp_like(F.col(text), F.concat_ws("|", *made))


def scored(operations: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, operation_id, path, score, signals, term_hits) of operations (repo, operation_id, verb, path) and the source files of
    their repository (repo, path, text) that score LEAST or more.  Comments count for nothing and strings for routes only; of a
    path that occurs twice the least text counts; a null text is an empty one; null names and routes have no files."""
    source = files.where(candidate_source(F.col("path"))).groupBy("repo", F.col("path").alias("file")).agg(F.min("text").alias("text"))
    source = durable(source.select("repo", "file", code_text(F.coalesce("text", F.lit("")), strings=True).alias("clean"), code_text(F.coalesce("text", F.lit("")), strings=False).alias("bare")), broadcast=False)
    full = F.regexp_replace("path", r"/+$", "")
    full = F.when(full == "", "/").otherwise(full)
    leaf = F.coalesce(F.try_element_at(F.filter(F.split(full, "/"), lambda x: x != ""), F.lit(-1)), F.lit(""))
    ops = operations.where("operation_id IS NOT NULL AND path IS NOT NULL").select("repo", "operation_id", "verb", full.alias("full"), leaf.alias("leaf"), search_tokens(F.col("operation_id")).alias("terms"), search_tokens(F.col("path")).alias("route")).distinct()

    first = lambda c: F.get(_words(c), F.lit(0))
    word = lambda c: F.concat(F.lit("w:"), c)
    gram = lambda c: F.concat(F.lit("p:"), c)
    wanted = F.concat(
        F.array(word(first(F.col("operation_id"))), word(first(F.col("full"))), word(F.when(~F.startswith("leaf", F.lit("{")), first(F.col("leaf")))), F.when(F.size(_words(F.col("full"))) == 0, F.lit("q:"))),
        F.transform(F.array_union("terms", "route"), lambda t: gram(F.substring(t, 1, 3))))
    keys = ops.select("repo", "operation_id", "full", "verb", F.explode(F.array_distinct(F.filter(wanted, lambda k: k.isNotNull()))).alias("key"))
    path = F.lower("file")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(path) - 2)), lambda i: gram(F.substr(path, i, F.lit(3))))
    quoted = F.when(F.col("clean").rlike("[\"']/[\"']"), F.lit("q:"))
    index = source.select("repo", "file", F.explode(F.array_distinct(F.filter(F.concat(F.transform(_words(F.col("clean")), word), grams, F.array(quoted)), lambda k: k.isNotNull()))).alias("key"))
    pairs = keys.join(index, ["repo", "key"]).select("repo", "operation_id", "full", "verb", "file").distinct()

    rows = pairs.join(ops, ["repo", "operation_id", "full", "verb"]).join(source, ["repo", "file"]).withColumn("low", F.lower("file"))
    name = regex_escaped(F.col("operation_id"))
    declared = _any("bare", DECLARATIONS, name) | (F.col("file").rlike(JS_FILE) & _any("bare", JS_DECLARATIONS, name))
    literal = lambda c: F.regexp_like(F.col("clean"), F.concat(F.lit("(?i)[\"']"), regex_escaped(c), F.lit("[\"']")))
    has_leaf = (F.col("leaf") != "") & ~F.startswith("leaf", F.lit("{"))
    verb = F.create_map(*(F.lit(x) for pair in REGISTRATIONS.items() for x in pair))
    one = {
        "handler_declaration": declared, "symbol_reference": ~declared & _holds("bare", F.col("operation_id")), "full_route_literal": literal(F.col("full")),
        "leaf_route_literal": ~literal(F.col("full")) & has_leaf & (literal(F.col("leaf")) | literal(F.concat(F.lit("/"), F.col("leaf")))),
        "http_method_registration": F.coalesce(F.regexp_like(F.col("clean"), F.try_element_at(verb, F.col("verb"))), F.lit(False)),
    }
    rows = rows.select("repo", "operation_id", "verb", "full", "file", "low", "route", *(c.alias(n) for n, c in one.items()), *(
        F.filter(c, f).alias(n) for n, c, f in (
            ("file_terms", "terms", lambda t: F.contains(F.col("low"), t)), ("text_terms", "terms", lambda t: _holds("clean", t)),
            ("file_route", "route", lambda t: F.contains(F.col("low"), t)), ("text_route", "route", lambda t: _holds("clean", t)))))
    points = sum((F.when(F.col(n), w).otherwise(0) for n, w in WEIGHTS.items()), F.lit(0))
    points = points + F.size("file_terms") * FILE_TERM + F.size("text_terms") * TEXT_TERM + F.size("file_route") * FILE_ROUTE + F.size("text_route") * TEXT_ROUTE
    points = points + F.when((F.size("route") > 0) & (F.size("file_route") == F.size("route")), ALL_ROUTE).otherwise(0) + F.when(F.col("low").rlike(ROUTE_FOLDERS), ROUTE_FOLDER).otherwise(0)
    signals = F.concat(F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in WEIGHTS)), lambda s: s.isNotNull()), F.transform("file_terms", lambda t: F.concat(F.lit("filename_operation:"), t)), F.transform("file_route", lambda t: F.concat(F.lit("filename_route:"), t)))
    strong = F.col("handler_declaration") | F.col("symbol_reference") | F.col("full_route_literal") | F.col("leaf_route_literal") | (F.size("file_terms") + F.size("file_route") > 0)
    out = rows.where(strong).select("repo", "operation_id", "verb", F.col("full").alias("route"), F.col("file").alias("path"), points.cast("long").alias("score"), signals.alias("signals"), F.size("text_terms").cast("long").alias("term_hits"))
    return out.where(F.col("score") >= LEAST)


def selected(found: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(files, verdicts) of scored().  files: the `most` best of each operation with their rank, ties to the smaller path.  verdicts:
    repo, operation_id, verb, route, matched, gap between the first two, ambiguous (a gap under LEAD), confidence and the reasons for which the
    selection is not complete."""
    key = ["repo", "operation_id", "verb", "route"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "path"))
    files = found.withColumn("rank", rank).where(F.col("rank") <= max(most, 2))
    counts = found.groupBy(*key).agg(F.count("*").alias("matched"))
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    top = files.groupBy(*key).agg((at(1, "score") - at(2, "score")).alias("gap"), at(1, "signals").alias("signals")).join(counts, key)
    has = lambda s: F.array_contains("signals", s)
    clear = F.coalesce(F.col("gap") >= LEAD, F.lit(True))
    literal = has("full_route_literal") | has("leaf_route_literal")
    confidence = F.when(has("handler_declaration"), F.when(clear, "high").otherwise("medium")).when(has("http_method_registration") & literal, "medium").otherwise("low")
    top = top.withColumns({"ambiguous": ~clear, "confidence": confidence})
    reasons = F.filter(F.array(
        F.when(F.col("matched") > most, F.lit("ranked_candidates_truncated")), F.when(F.col("confidence") == "low", F.lit("no_confirmed_declaration")),
        F.when(F.col("ambiguous"), F.lit("ambiguous_top_scores")), F.when(~has("handler_declaration"), F.lit("no_confirmed_handler_declaration"))), lambda r: r.isNotNull())
    return files.where(F.col("rank") <= most), top.select(*key, "matched", "gap", "ambiguous", "confidence", reasons.alias("incomplete_reasons"))
