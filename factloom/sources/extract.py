"""Facts from source text by built-in regular expressions, a row of a table for each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import common_prefix
from factloom.sources.delimiters import groups, masked
from factloom.sources.tables import durable

# Fixed values: (framework, pattern, does it name the verb).
ROUTE_PATTERNS = [
    ("express", r"""(?i)app\.(get|post|put|patch|delete)\(\s*["'`]([^"'`]+)["'`]""", True),
    ("express-router", r"""(?i)(?<!@)router\.(get|post|put|patch|delete)\(\s*["'`]([^"'`]+)["'`]""", True),
    ("flask", r"""@app\.route\(\s*["']([^"']+)["']""", False),
    ("fastapi", r"""(?i)@router\.(get|post|put|patch|delete)\(\s*["']([^"']+)["']""", True),
]


def generic_routes(files: DataFrame, text: str) -> DataFrame:
    """files without their text, with framework, verb ('?' where the pattern names none) and path, a row a match."""
    def hits(framework: str, pattern: str, verb: bool) -> Column:
        whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        part = lambda m, i: F.regexp_extract(m, pattern, i)
        return F.transform(whole, lambda m: F.struct(F.lit(framework).alias("framework"), (F.upper(part(m, 1)) if verb else F.lit("?")).alias("verb"), part(m, 2 if verb else 1).alias("path")))

    return files.withColumn("_r", F.explode(F.concat(*(hits(*p) for p in ROUTE_PATTERNS)))).drop(text).select("*", "_r.*").drop("_r")


def grouped_routes(routes: DataFrame, file: str, path: str) -> DataFrame:
    """(file, prefix, routes): the leading segments that all routes of a file share.

    Two routes tell the prefix of any number: the least and the greatest, segment by segment.
    """
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    ends = routes.groupBy(file).agg(F.min(parts).alias("a"), F.max(parts).alias("b"), F.count("*").alias("routes"))
    joined = lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    return ends.select(file, common_prefix(F.array(joined("a"), joined("b"))).alias("prefix"), "routes")


_NAME = r"(?:\"?\w+\"?\s*\.\s*)?\"?(\w+)\"?"  # a schema is dropped
_CREATE = rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*"
_ALTER = rf"(?is)ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_NAME}\s+ADD\s+"
_ADD = _ALTER + r"COLUMN\s+(?:IF\s+NOT\s+EXISTS\s+)?\"?(\w+)\"?"
_REFERENCES = rf"REFERENCES\s+{_NAME}\s*(?:\(\s*\"?(\w+)\"?\s*\))?"
_KEY = r"FOREIGN\s+KEY\s*\(\s*\"?(\w+)\"?\s*\)\s*"
_ADD_FK = _ALTER + r"CONSTRAINT\s+\"?\w+\"?\s+" + _KEY + _REFERENCES
_FK = rf"(?is)^(?:CONSTRAINT\s+\"?\w+\"?\s+)?{_KEY}{_REFERENCES}"
_NOT_A_COLUMN = r"(?i)^(CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|EXCLUDE|LIKE)\b"


def ddl_facts(files: DataFrame, sql: str) -> DataFrame:
    """files with kind (column or fk), table, name, parent (table.column of a foreign key, the table alone where it does not say
    the column), parent_table, parent_column, and ordinal, the place of the fact among the file's.

    CREATE TABLE, ALTER TABLE ADD COLUMN and ADD CONSTRAINT FOREIGN KEY count; names lose quotes and tables their schema.
    Parentheses nest to any depth; comments and strings hold no facts; keys of several columns give none.  A table whose
    parentheses do not close before the next one begins is passed over.  Repeated rows each give theirs; a null text gives none.
    """
    get = F.regexp_extract
    rows = durable(files.withColumn("_row", F.monotonically_increasing_id()), broadcast=False)  # read several times: the numbers must stay
    known = rows.withColumn("_code", masked(F.col(sql), "sql"))
    fact = lambda kind, t, name, parent=F.lit(""), column=F.lit(""): F.struct(F.lit(kind).alias("kind"), t.alias("table"), name.alias("name"), F.nullif(parent, F.lit("")).alias("parent_table"), F.nullif(column, F.lit("")).alias("parent_column"))
    each = lambda c: F.transform(c, lambda m, i: F.struct(i.cast("long").alias("n"), m.alias("fact")))

    x, name = F.col("text"), get("head", rf"(?is){_CREATE}", 1)
    inline, column = rf"(?is)\b{_REFERENCES}", get(x, r'^"?(\w+)"?', 1)
    plain = ~x.rlike(_NOT_A_COLUMN) & (column != "")
    of_item = F.filter(F.array(
        F.when(plain, fact("column", name, column)),
        F.when(plain & x.rlike(inline), fact("fk", name, column, get(x, inline, 1), get(x, inline, 2))),
        F.when(x.rlike(_FK), fact("fk", name, get(x, _FK, 1), get(x, _FK, 2), get(x, _FK, 3)))), lambda f: f.isNotNull())
    items = groups(known, ["_row"], F.col("_code"), _CREATE)
    made = items.select("_row", F.lit(1).alias("_step"), "at", "item", F.explode(each(of_item)).alias("f"))
    all_ = lambda pattern: F.regexp_extract_all("_code", F.lit(f"({pattern})"), F.lit(1))
    added = F.transform(all_(_ADD), lambda m: fact("column", get(m, _ADD, 1), get(m, _ADD, 2)))
    bound = F.transform(all_(_ADD_FK), lambda m: fact("fk", get(m, _ADD_FK, 1), get(m, _ADD_FK, 2), get(m, _ADD_FK, 3), get(m, _ADD_FK, 4)))
    later = [known.select("_row", F.lit(step).alias("_step"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("item"), F.explode(each(c)).alias("f")) for step, c in ((2, added), (3, bound))]
    facts = made.unionByName(later[0]).unionByName(later[1])
    ordinal = F.row_number().over(Window.partitionBy("_row").orderBy("_step", "at", "item", "f.n")).cast("long")
    parent = F.nullif(F.concat_ws(".", "parent_table", "parent_column"), F.lit(""))
    return rows.join(facts.select("_row", ordinal.alias("ordinal"), "f.fact.*"), "_row").drop("_row").withColumn("parent", parent)


# Where the tools keep their files, the first tool with a file before the second.
MIGRATION_TOOLS = {"flyway": r"(^|/)db/migration/.*\.sql$", "liquibase": r"(^|/)db/changelog/.*\.(xml|yaml|yml|sql)$"}


def migration_tool(path: Column) -> Column:
    """The tool whose migrations stand at a path; null for other files."""
    first, *rest = MIGRATION_TOOLS.items()
    tool = F.when(path.rlike(first[1]), first[0])
    for name, pattern in rest:
        tool = tool.when(path.rlike(pattern), name)
    return tool


def migrations(files: DataFrame, repo: str, path: str, sql: str) -> tuple[DataFrame, DataFrame]:
    """(repos, tables).  repos: repo, tool (none, flyway, liquibase) and the sorted files of that tool, for every repo.  tables:
    repo, file, version (numbers of a name like V1_2__x.sql, else empty), table, sorted distinct columns, and foreign keys in
    order of the text, for each file of the repo's tool that is SQL; files of one table are not merged."""
    at = files.withColumn("_tool", migration_tool(F.col(path)))
    has = [F.bool_or(F.coalesce(F.col("_tool") == t, F.lit(False))) for t in MIGRATION_TOOLS]
    chosen = at.groupBy(repo).agg(F.coalesce(*(F.when(h, t) for h, t in zip(has, MIGRATION_TOOLS)), F.lit("none")).alias("tool"))
    own = at.where("_tool IS NOT NULL").join(chosen, repo).where("_tool = tool")
    listed = own.groupBy(repo).agg(F.array_sort(F.collect_set(path)).alias("files"))
    repos = chosen.join(listed, repo, "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    facts = ddl_facts(own.where(F.col(path).rlike(r"\.sql$")).select(repo, path, sql), sql)
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "fk", F.struct("ordinal", F.col("name").alias("column"), F.col("parent_table").alias("references_table"), F.col("parent_column").alias("references_column"))))),
                       lambda x: x.dropFields("ordinal"))
    tables = facts.groupBy(repo, path, "table").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "column", F.col("name")))).alias("columns"), keys.alias("foreign_keys"))
    number = F.split(F.regexp_extract(path, r"(?:^|/)V([0-9]+(?:[._][0-9]+)*)__[^/]*$", 1), "[._]")
    return repos, tables.withColumn("version", F.transform(F.filter(number, lambda x: x != ""), lambda x: x.cast("long")))


def schema_states(tables: DataFrame, repo: str, path: str) -> DataFrame:
    """(repo, table, columns, foreign_keys, files) after all migrations of tables (as migrations() gives them): columns by the
    version that first has them, then the name; foreign keys of later versions behind earlier ones, each once."""
    order = F.struct("version", path)
    cols = tables.withColumn("c", F.explode("columns")).groupBy(repo, "table", "c").agg(F.min(order).alias("o"))
    cols = cols.groupBy(repo, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]).alias("columns"))
    keys = tables.select(repo, "table", order.alias("o"), F.posexplode("foreign_keys").alias("n", "k")).groupBy(repo, "table", "k").agg(F.min(F.struct("o", "n")).alias("o"))
    keys = keys.groupBy(repo, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]).alias("foreign_keys"))
    files = tables.groupBy(repo, "table").agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x[path]).alias("files"))
    return files.join(cols, [repo, "table"], "left").join(keys, [repo, "table"], "left")
