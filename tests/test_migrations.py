"""Masks, balanced groups and migrations against a plain character-by-character reader."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.sources import delimiters, extract


def plain_items(text):
    """(head, [items]) of each CREATE TABLE whose parenthesis closes before the next one begins."""
    out = []
    heads = list(re.finditer(r'CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"?(\w+)"?\s*\(', text, re.I))
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        depth, parts, start = 0, [], m.end()
        for i in range(m.end() - 1, after):
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            if depth == 1 and text[i] == "," or depth == 0:
                parts.append(text[start:i].strip())
                start = i + 1
            if depth == 0:
                out.append((m[1], [p for p in parts if p]))
                break
    return out


def plain_facts(text):
    code = re.sub(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out = []
    ref = r'REFERENCES\s+"?(\w+)"?\s*(?:\(\s*"?(\w+)"?\s*\))?'
    for name, items in plain_items(code):
        for x in items:
            if re.match(r"(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|CONSTRAINT)\b", x, re.I):
                if m := re.match(rf'(?:CONSTRAINT\s+\w+\s+)?FOREIGN\s+KEY\s*\(\s*"?(\w+)"?\s*\)\s*{ref}', x, re.I):
                    out.append(("fk", name, m[1], m[2], m[3]))
                continue
            if not (c := re.match(r'"?(\w+)"?', x)):
                continue
            c = c[1]
            out.append(("column", name, c, None, None))
            if m := re.search(ref, x, re.I):
                out.append(("fk", name, c, m[1], m[2]))
    for m in re.finditer(r'ALTER\s+TABLE\s+"?(\w+)"?\s+ADD\s+COLUMN\s+(?:IF\s+NOT\s+EXISTS\s+)?"?(\w+)"?', code, re.I):
        out.append(("column", m[1], m[2], None, None))
    for m in re.finditer(rf'ALTER\s+TABLE\s+"?(\w+)"?\s+ADD\s+CONSTRAINT\s+"?\w+"?\s+FOREIGN\s+KEY\s*\(\s*"?(\w+)"?\s*\)\s*{ref}', code, re.I):
        out.append(("fk", m[1], m[2], m[3], m[4]))
    return out


def random_ddl(r):
    pick = r.choice
    deep = lambda n: f"({deep(n - 1)} + (a, b))" if n else "x"
    column = lambda k: pick([
        f"c{k} VARCHAR(255)", f'"C{k}" NUMERIC(10, 2) CHECK (p > {deep(r.randrange(9))})', f"c{k} text DEFAULT 'a,b) ('' --'", f"c{k} uuid REFERENCES p{k}", f"c{k} int references \"q\" ( id )",
        f"PRIMARY KEY (c{k}, d)", f"FOREIGN KEY (c{k}) REFERENCES r{k}(\"z\")", f"FOREIGN KEY (a, b) REFERENCES r{k}(z, y)", f"CONSTRAINT n{k} CHECK (a IN (1, 2))", f"c{k} int -- note, (", f"/* ( , */ c{k} int", f"CONSTRAINT f{k} FOREIGN KEY (c{k}) REFERENCES s (t)", ""])
    statement = lambda k: pick([
        f"CREATE TABLE t{k} (\n {', \n'.join(column(i) for i in range(r.randrange(1, 6)))}\n);", f"create table if not exists \"T{k}\"({column(k)}\n)", f"ALTER TABLE t{k} ADD COLUMN IF NOT EXISTS n{k} int;",
        f"ALTER TABLE \"t{k}\" ADD CONSTRAINT x FOREIGN KEY (a) REFERENCES b;", f"ALTER TABLE t{k} ADD CONSTRAINT x FOREIGN KEY ( a ) REFERENCES b (c);", "-- CREATE TABLE no (a int);\n", f"CREATE TABLE open{k} (a int, (b", ")", "SELECT 'CREATE TABLE s (q int)';"])
    return "\n".join(statement(k) for k in range(r.randrange(0, 7)))


def test_facts_match_a_plain_reader(spark):
    r = random.Random(11)
    texts = [None, "", ")", "(" * 50, "CREATE TABLE t (" + "f(" * 60 + ")" * 60 + " int, b int)", *(random_ddl(r) for _ in range(150))]
    texts += texts[-3:]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, sql string, at int").repartition(3)
    got = extract.ddl_facts(df, "sql").orderBy("id", "ordinal").collect()
    for i, t in enumerate(texts):
        assert [(g["kind"], g["table"], g["name"], g["parent_table"], g["parent_column"]) for g in got if g["id"] == i] == plain_facts(t or ""), t


@pytest.mark.parametrize(("language", "text", "want"), [
    ("sql", "a 'x''y' -- z\nb /* c\nd */ e 'open", "a        " + " " * 4 + "\nb " + " " * 4 + "\n     e      "),
    ("c", 'f("a\\"b") // c\n/* d */ g(\'e\')', "f(      )     \n        g(   )"),
    ("hash", "a # b\n\"\"\"c\nd\"\"\" e 'f'", "a    \n    \n     e    "),
])
def test_masks_keep_length_and_lines(spark, language, text, want):
    assert spark.range(1).select(delimiters.masked(F.lit(text), language).alias("m")).first()["m"] == want and len(want) == len(text)


FILES = [
    ("a", "src/main/resources/db/migration/V1__t.sql", "CREATE TABLE widgets (id UUID PRIMARY KEY, organization_id UUID);"),
    ("a", "src/main/resources/db/migration/V2__fk.sql", "ALTER TABLE widgets ADD CONSTRAINT fk FOREIGN KEY (organization_id) REFERENCES organizations (id);"),
    ("a", "src/main/resources/db/migration/V10__s.sql", "ALTER TABLE widgets ADD COLUMN status VARCHAR(32) DEFAULT 'active';\nALTER TABLE widgets ADD COLUMN a int;"),
    ("a", "src/main/resources/db/migration/V9__s.sql", "ALTER TABLE widgets ADD COLUMN late int;"),
    ("a", "db/changelog/x.sql", "CREATE TABLE no (a int);"), ("b", "db/changelog/master.yaml", "databaseChangeLog:\n"), ("b", "db/changelog/c.sql", "CREATE TABLE b (z int, y int REFERENCES q);"), ("c", "src/a.sql", "CREATE TABLE no (a int);"),
]


def test_migration_tools_tables_and_states(spark):
    repos, tables = extract.migrations(spark.createDataFrame(FILES, "repo string, path string, sql string"), "repo", "path", "sql")
    assert {r["repo"]: (r["tool"], r["files"]) for r in repos.collect()} == {
        "a": ("flyway", sorted(p for r, p, _ in FILES[:4])), "b": ("liquibase", ["db/changelog/c.sql", "db/changelog/master.yaml"]), "c": ("none", [])}
    got = {(r["repo"], r["path"].rsplit("/", 1)[-1]): (r["version"], r["table"], r["columns"], [tuple(k) for k in r["foreign_keys"]]) for r in tables.collect()}
    assert got == {
        ("a", "V1__t.sql"): ([1], "widgets", ["id", "organization_id"], []), ("a", "V2__fk.sql"): ([2], "widgets", [], [("organization_id", "organizations", "id")]),
        ("a", "V10__s.sql"): ([10], "widgets", ["a", "status"], []), ("a", "V9__s.sql"): ([9], "widgets", ["late"], []), ("b", "c.sql"): ([], "b", ["y", "z"], [("y", "q", None)])}
    state = {r["table"]: (r["columns"], [tuple(k) for k in r["foreign_keys"] or []], len(r["files"])) for r in extract.schema_states(tables, "repo", "path").collect()}
    assert state == {"widgets": (["id", "organization_id", "late", "a", "status"], [("organization_id", "organizations", "id")], 4), "b": (["y", "z"], [("y", "q", None)], 1)}
