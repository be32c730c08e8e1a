"""Files of operations against a plain scorer that tries every file."""

import random
import re

import pytest

from factloom.functions.text import STOP_WORDS
from factloom.operators import context


def tokens(x):
    return list(dict.fromkeys(y for y in (t.lower() for t in re.split(r"[^a-zA-Z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x))) if len(y) >= 3 and y not in STOP_WORDS))


def code(text, strings):
    out, mode, quote, i = [], "code", "", 0
    while i < len(text):
        c, three = text[i], text[i : i + 3]
        if mode == "code":
            end = {"//": "\n", "/*": "*/"}.get(text[i : i + 2]) or ("\n" if c == "#" else three if three in ('"""', "'''") else None)
            if end or c in "'\"`":
                j = text.find(end, i + (1 if c == "#" else 3 if end == three else 2)) if end else i + 1
                if end:
                    j = len(text) if j < 0 else j + (0 if end == "\n" else len(end))
                else:
                    while j < len(text) and text[j] != c:
                        j += 2 if text[j] == "\\" else 1
                    j = min(j + 1, len(text))
                piece = text[i:j]
                out.append(piece if strings and not end else re.sub(r"[^\n]", " ", piece))
                i = j
                continue
        out.append(c)
        i += 1
    return "".join(out)


def plain(op, verb, route, path, text):
    clean, bare, low = code(text, True), code(text, False), path.lower()
    word = lambda t, where: re.search(rf"(?:^|[^a-z0-9_$]){re.escape(t)}(?=$|[^a-z0-9_$])", where, re.I)
    quoted = lambda t: re.search(f"[\"']{re.escape(t)}[\"']", clean, re.I)
    name, points, signals = re.escape(op), 0, []
    shapes = context.DECLARATIONS + (context.JS_DECLARATIONS if re.search(context.JS_FILE, path) else [])
    if any(re.search(s.format(name), bare) for s in shapes):
        signals.append("handler_declaration")
    elif word(op, bare):
        signals.append("symbol_reference")
    full = route.rstrip("/") or "/"
    leaf = ([x for x in full.split("/") if x] or [""])[-1]
    if quoted(full):
        signals.append("full_route_literal")
    elif leaf and not leaf.startswith("{") and (quoted(leaf) or quoted("/" + leaf)):
        signals.append("leaf_route_literal")
    if verb in context.REGISTRATIONS and re.search(context.REGISTRATIONS[verb], clean):
        signals.append("http_method_registration")
    points += sum(context.WEIGHTS[s] for s in signals)
    hits = 0
    for kind, terms, file_points, text_points in (("operation", tokens(op), 30, 6), ("route", tokens(route), 40, 4)):
        for t in terms:
            if t in low:
                points += file_points
                signals.append(f"filename_{kind}:{t}")
            if word(t, clean):
                points += text_points
                hits += kind == "operation"
    points += 10 * bool(tokens(route) and all(t in low for t in tokens(route))) + 10 * bool(re.search(context.ROUTE_FOLDERS, low))
    strong = any(s in ("handler_declaration", "symbol_reference", "full_route_literal", "leaf_route_literal") or s.startswith("filename_") for s in signals)
    return (points, signals, hits) if strong and points >= 25 else None


LINES = [
    "def listWidgets(a):", "async function listWidgets(", "const listWidgets = async (a, b): Foo => {", "listWidgets(x) {", "  public static Foo listWidgets(", "x = listWidgets(1)", "# listWidgets", "// '/widgets/{id}'", "@app.get('/widgets')",
    'r.get("/api/widgets/")', '"""listWidgets\n/widgets"""', "'a\\'listWidgets'", "`/widgets`", "router.post('/widgets/{id}')", "@GetMapping(\"bolts\")", "widgets bolts", "fn drop_bolt<T>(", "def drop_bolt (", "drop_bolt.call()", "'/'", "/* drop_bolt", "*/", "''' drop_bolt", "'''",
]
OPS = [("listWidgets", "GET", "/api/widgets"), ("drop_bolt", "DELETE", "/bolts/{id}/"), ("get.widget:v2", "POST", "/"), ("zzz", "TRACE", "/widgets/{id}"), ("listWidgets", "POST", "/widgets/{id}")]
PATHS = ["src/widgets.py", "src/Widget/routes/a.ts", "api/bolts.js", "lib/dropper.rb", "handlers/x.go", "y.mjs", "test/widgets.py", "docs/widgets.py", "src/list.txt", ".hidden/widgets.py"]


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(4)
    files = [("one", f"{k}/{p}", "\n".join(r.choices(LINES, k=r.randrange(0, 7)))) for k in range(25) for p in PATHS] + [("one", "none/widgets.py", None), ("two", "src/widgets.py", "def listWidgets():")]
    files += files[:3]
    ops = [("one", *o) for o in OPS] + [("two", *OPS[0]), ("two", *OPS[0]), ("one", None, "GET", "/x")]
    rows = context.scored(spark.createDataFrame(ops, "repo string, operation_id string, verb string, path string"), spark.createDataFrame(files, "repo string, path string, text string"))
    return files, rows


def test_scores_match_a_plain_scorer(found):
    files, rows = found
    source = [f for f in dict.fromkeys(files) if re.search(r"\.(py|ts|js|rb|go|mjs)$", f[1]) and not re.search(r"(^|/)(test|docs)/|(^|/)\.", f[1])]
    want = {(repo, o, v, route.rstrip("/") or "/", p): s for repo, ops in (("one", OPS), ("two", OPS[:1])) for o, v, route in ops for r, p, t in source if r == repo and (s := plain(o, v, route, p, t or ""))}
    got = {(r["repo"], r["operation_id"], r["verb"], r["route"], r["path"]): (r["score"], r["signals"], r["term_hits"]) for r in rows.collect()}
    assert [(k, got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)] == []


def test_selections_tell_their_gap(found):
    _, rows = found
    files, verdicts = context.selected(rows)
    by = {}
    for r in rows.collect():
        by.setdefault((r["repo"], r["operation_id"], r["verb"]), []).append((-r["score"], r["path"], r["signals"]))
    for v in verdicts.collect():
        ranked = sorted(by[v["repo"], v["operation_id"], v["verb"]])
        gap = ranked[1][0] - ranked[0][0] if len(ranked) > 1 else None
        assert (v["matched"], v["gap"], v["ambiguous"]) == (len(ranked), gap, gap is not None and gap < 30)
        assert v["confidence"] in (("medium" if v["ambiguous"] else "high",) if "handler_declaration" in ranked[0][2] else ("medium", "low"))
        assert ("ranked_candidates_truncated" in v["incomplete_reasons"]) == (len(ranked) > 4)
    for r in files.collect():
        assert sorted(by[r["repo"], r["operation_id"], r["verb"]])[r["rank"] - 1][:2] == (-r["score"], r["path"])
