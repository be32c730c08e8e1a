"""Verification of bindings, annotations and profiles, and what keeps them from being ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import key_type
from factloom.sources.tables import durable

# Fixed values.
CUTOVER_CHECKS = {
    "ownership_scope_clean": "ownership-scope-not-clean", "legacy_baseline_pinned": "legacy-baseline-not-pinned", "lossless_bridge_verified": "lossless-bridge-not-verified",
    "semantic_parity_verified": "semantic-parity-not-verified", "pinned_corpus_verified": "pinned-corpus-not-verified", "exact_head_ci_green": "exact-head-ci-not-green",
    "identity_interface_frozen": "identity-interface-not-frozen", "capability_interface_frozen": "capability-interface-not-frozen", "independent_review_accepted": "independent-review-not-accepted",
    "nested_test_discovery_integrated": "nested-test-discovery-not-integrated",
}
LANG_ANNOTATIONS = ["Deprecated", "FunctionalInterface", "Override", "SafeVarargs", "SuppressWarnings"]


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose conditions hold, in their order, joined by commas; a null condition does not hold."""
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in pairs)), lambda x: x.isNotNull()), ",")


def verified_bindings(bindings: DataFrame, live: DataFrame, default_schema: str) -> DataFrame:
    """bindings (schema, name, pk array, declared key type) against live tables (schema, name, pk, pk_source, pk_type): table
    and key status, key type status, the effective key type and whether the read by key is verified."""
    at = lambda c: F.coalesce(c, F.lit(default_schema))
    seen = live.where("name IS NOT NULL").groupBy(at(F.col("schema")).alias("_s"), F.col("name").alias("_n")).agg(
        F.count("*").alias("_hits"), F.max("pk").alias("_pk"), F.max("pk_source").alias("_src"), F.max("pk_type").alias("_type"))
    rows = bindings.join(seen, (at(F.col("schema")) == F.col("_s")) & (F.col("name") == F.col("_n")), "left")
    single = F.coalesce(F.col("_hits") == 1, F.lit(False))
    table = F.when(F.col("name").isNull(), "unknown").when(F.col("_hits").isNull(), "missing").when(F.col("_hits") > 1, "ambiguous").otherwise("verified")
    same = F.coalesce((F.col("pk") == F.col("_pk")) & (F.size("pk") > 0), F.lit(False))
    key = F.when(~single | ~F.coalesce(F.col("_src") == "live", F.lit(False)), "unknown").when(same, "verified").otherwise("mismatch")
    observed = F.when((key == "verified") & (F.size("_pk") == 1), key_type(F.col("_type")))
    declared, known = key_type(F.col("key_type")), F.coalesce(observed != "unknown", F.lit(False))
    agree = (declared == observed) | ((declared == "non-uuid") & (observed != "uuid"))
    typed = F.when(key != "verified", "unknown").when(declared == "unknown", F.when(known, "observed").otherwise("unknown")).when(~known, "source-only").when(agree, "verified").otherwise("mismatch")
    effective = (
        F.when(key != "verified", F.coalesce("key_type", F.lit("unknown"))).when(declared == "unknown", F.when(known, observed).otherwise("unknown"))
        .when(known & agree & (declared == "non-uuid"), observed).otherwise(declared)
    )
    return rows.select(*bindings.columns, table.alias("table_status"), key.alias("key_status"), typed.alias("key_type_status"), effective.alias("effective_key_type"), ((key == "verified") & (typed != "mismatch")).alias("verified"))


def binding_blockers(admitted: Column, entity: Column, table: Column, pk: Column, candidate: Column, verified: Column) -> Column:
    """What keeps a persistence binding from certification, in order; empty: it may be read."""
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    return codes(
        (~F.coalesce(admitted, F.lit(False)), "persistence-target-not-admitted"), (empty(entity), "entity-binding-missing"), (empty(table), "physical-table-unknown"),
        (F.coalesce(F.size(pk) < 1, F.lit(True)), "primary-key-unknown"), (~F.coalesce(candidate, F.lit(False)), "read-by-primary-key-not-candidate"), (~F.coalesce(verified, F.lit(False)), "read-by-primary-key-not-verified"),
    )


def binding_certificate(resources: DataFrame, conflicts: DataFrame, provider: str) -> DataFrame:
    """(provider, status, blocked, conflicts) of resources (provider, blockers) and open conflicts (provider)."""
    open_ = conflicts.groupBy(provider).agg(F.count("*").alias("conflicts"))
    rows = resources.groupBy(provider).agg(F.count_if(F.col("blockers") != "").alias("blocked")).join(open_, provider, "full_outer").fillna(0, ["blocked", "conflicts"])
    return rows.select(provider, F.when((F.col("blocked") == 0) & (F.col("conflicts") == 0), "runtime-read-verified").otherwise("partial-or-blocked").alias("status"), "blocked", "conflicts")


def cutover(checks: Column) -> Column:
    """(ready, blockers, unknown) of a map of named checks: one that is absent or null blocks; unknown names are listed."""
    blockers = codes(*((~F.coalesce(F.try_element_at(checks, F.lit(n)), F.lit(False)), code) for n, code in CUTOVER_CHECKS.items()))
    unknown = F.array_join(F.array_sort(F.array_except(F.map_keys(checks), F.array(*map(F.lit, CUTOVER_CHECKS)))), ",")
    return F.struct(((blockers == "") & (unknown == "")).alias("ready"), blockers.alias("blockers"), unknown.alias("unknown"))


# The steps at which a runtime report fails, in order; a pair of fields that must be equal, and the code.
REPORT_PAIRS = [
    ("source_ref", "runtime-report-source-ref-mismatch"), ("openapi_ref", "runtime-report-openapi-ref-mismatch"), ("binding_hash", "runtime-report-binding-hash-mismatch"),
    ("profile_hash", "runtime-report-profile-mismatch"), ("nonce", "runtime-report-attempt-mismatch"), ("oracle_hash", "runtime-report-oracle-evidence-mismatch"),
    ("candidate_hash", "runtime-report-candidate-evidence-mismatch"),
]


def promotion(decisions: DataFrame, key: str, context: DataFrame, fields: list[str]) -> DataFrame:
    """(key, source_blockers, runtime_blocker, source_ready, runtime_ready): every blocker of an endpoint's source as (code, field,
    state, reason), and the first one of its runtime as (code, state, reason).

    decisions: key, field, state, value, reason.  context, one row for each key: audited; binding (source_state, source_reason,
    runtime_state, runtime_reason and the fields of REPORT_PAIRS); report (supported, state, reason and the same fields), null if
    none; observed (state, reason and expected: operation_id, method, path), null if none."""
    held = decisions.where(F.col("field").isin(fields)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("state", "value", "reason")))).alias("_f"))
    rows = context.join(held, key, "left")
    of = lambda f: F.try_element_at("_f", F.lit(f))
    b, r, o = F.col("binding"), F.col("report"), F.col("observed")
    text = lambda c, default: F.coalesce(c, F.lit(default))
    none = F.lit(None).cast("string")
    blocker = lambda code, state=none, reason=none: F.struct(F.lit(code).alias("code"), state.alias("state"), reason.alias("reason"))
    source = lambda code, field, state, reason: F.struct(F.lit(code).alias("code"), field.alias("field"), state.alias("state"), reason.alias("reason"))
    blockers = F.filter(F.array(
        F.when(~F.coalesce("audited", F.lit(False)), source("openapi-context-not-attached", none, none, none)),
        F.when(~F.coalesce(b["source_state"] == "bound", F.lit(False)), source("source-spec-binding-not-bound", none, text(b["source_state"], "unknown"), text(b["source_reason"], "missing-binding-state"))),
        *(F.when(~F.coalesce(of(f)["state"] == "resolved", F.lit(False)), source("route-field-not-resolved", F.lit(f), text(of(f)["state"], "missing"), text(of(f)["reason"], "field-missing"))) for f in fields),
    ), lambda x: x.isNotNull())
    first = F.when(~F.coalesce(b["runtime_state"] == "bound", F.lit(False)), blocker("runtime-binding-not-bound", text(b["runtime_state"], "unknown"), text(b["runtime_reason"], "missing-runtime-binding-state")))
    first = first.when(r.isNull(), blocker("runtime-report-not-supplied")).when(~F.coalesce(r["supported"], F.lit(False)), blocker("runtime-report-version-unsupported"))
    first = first.when(~F.coalesce(r["state"] == "ready", F.lit(False)), blocker("runtime-report-not-ready", text(r["state"], "unknown"), text(r["reason"], "runtime-report-state-missing")))
    for name, code in REPORT_PAIRS:
        first = first.when(~r[name].eqNullSafe(b[name]), blocker(code))
    first = first.when(o.isNull(), blocker("runtime-endpoint-result-missing"))
    first = first.when(~F.coalesce(o["state"] == "observed", F.lit(False)), blocker("runtime-route-not-observed", o["state"], text(o["reason"], "runtime-route-state-missing")))
    resolved = F.forall(F.array(*map(F.lit, fields)), lambda f: F.coalesce(F.try_element_at("_f", f)["state"] == "resolved", F.lit(False)))
    first = first.when(~resolved, blocker("runtime-expected-route-unavailable"))
    same = [o[n].eqNullSafe(of(f)["value"]) for n, f in zip(("operation_id", "method", "path"), fields)]
    for ok in same:
        first = first.when(~ok, blocker("runtime-expected-route-mismatch"))
    out = rows.select(key, blockers.alias("source_blockers"), first.alias("runtime_blocker"))
    good = F.size("source_blockers") == 0
    return out.withColumn("source_ready", good).withColumn("runtime_ready", good & F.col("runtime_blocker").isNull())


def evidence_bound(evidence: DataFrame, bound: DataFrame, graph: str) -> DataFrame:
    """(graph, role, fits) for every bound ref (graph, role, ref): it is the one ref of its role in the graph's evidence."""
    refs = evidence.where("ref IS NOT NULL AND ref <> ''").groupBy(graph, "role").agg(F.min("ref").alias("_a"), F.max("ref").alias("_b"))
    rows = bound.join(refs, [graph, "role"], "left")
    return rows.select(graph, "role", F.coalesce((F.col("_a") == F.col("ref")) & (F.col("_b") == F.col("ref")), F.lit(False)).alias("fits"))


def case_faults(expected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, kind, name, fault) of a consumer's results (key, pack, kind, name, outcome, observed) against the cases of the pack
    it used (pack, kind, name, want): duplicate, unexpected, missing, not-passed or mismatch; want is a pattern for negative cases."""
    got = results.groupBy(key, "kind", "name").agg(F.count("*").alias("n"), F.min("outcome").alias("lo"), F.max("outcome").alias("hi"), F.min("observed").alias("observed"))
    want = results.select(key, "pack").distinct().join(expected.select("pack", "kind", "name", "want").distinct(), "pack").drop("pack")
    rows = want.join(got, [key, "kind", "name"], "full_outer")
    held = F.when(F.col("kind") == "negative", F.regexp_like("observed", F.col("want"))).otherwise(F.col("observed") == F.col("want"))
    fault = (
        F.when(F.col("n") > 1, "duplicate").when(F.col("want").isNull(), "unexpected").when(F.col("n").isNull(), "missing")
        .when((F.col("lo") != "pass") | (F.col("hi") != "pass"), "not-passed").when(~F.coalesce(held, F.lit(False)), "mismatch")
    )
    return rows.select(key, "kind", "name", fault.alias("fault")).where("fault IS NOT NULL")


def conformance(profile: DataFrame, actual: DataFrame, exact: DataFrame, item: list[str]) -> DataFrame:
    """(entity, items, code) of profile and actual rows (entity, items), nulls being values: missing-or-mismatched, and
    unexpected for the entities (entity) that must match exactly."""
    a, b = (x.select("entity", *item).distinct() for x in (profile, actual))
    there = b.select("entity").distinct()
    missing = a.join(there, "entity", "left_semi").exceptAll(b).withColumn("code", F.lit("missing-or-mismatched"))
    extra = b.exceptAll(a).join(exact.select("entity").distinct(), "entity", "left_semi").withColumn("code", F.lit("unexpected"))
    absent = a.select("entity").distinct().join(there, "entity", "left_anti").select("entity", *(F.lit(None).cast(profile.schema[i].dataType).alias(i) for i in item), F.lit("entity-missing").alias("code"))
    return missing.unionByName(extra).unionByName(absent)


def annotation_names(uses: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """uses (file, package, name) with status, fqn, basis and the sorted candidates.  A dotted name stands for itself; else explicit imports, a type of
    the same package and wildcard imports (file, name; those end in .*) are the candidates: one resolves, several conflict,
    none leaves the language's own.  types (fqn) that are declared twice count for none."""
    uses = uses.select("file", "package", "name").distinct()
    known = types.groupBy("fqn").agg(F.count("*").alias("_n")).where("_n = 1").select("fqn")
    last = F.regexp_extract("import", r"([^.]+)$", 1)
    lines = imports.select("file", F.col("name").alias("import")).distinct()
    explicit = uses.join(lines.where(~F.endswith("import", F.lit(".*"))).withColumn("name", last), ["file", "name"]).select("file", "package", "name", F.col("import").alias("fqn"), F.lit(1).alias("rank"))
    own = F.when(F.col("package") != "", F.concat("package", F.lit("."), "name")).otherwise(F.col("name"))
    local = uses.select("*", own.alias("fqn"), F.lit(2).alias("rank")).join(known, "fqn", "left_semi").select("file", "package", "name", "fqn", "rank")
    wild = lines.where(F.endswith("import", F.lit(".*"))).select("file", F.expr("substr(import, 1, length(import) - 2)").alias("_p"))
    wild = uses.join(wild, "file").select("file", "package", "name", F.concat("_p", F.lit("."), "name").alias("fqn"), F.lit(3).alias("rank")).join(known, "fqn", "left_semi").select("file", "package", "name", "fqn", "rank")
    proven = explicit.unionByName(local).unionByName(wild).groupBy("file", "package", "name").agg(F.min("fqn").alias("lo"), F.max("fqn").alias("hi"), F.min("rank").alias("rank"), F.array_sort(F.collect_set("fqn")).alias("all"))
    rows = uses.join(proven, ["file", "package", "name"], "left")
    dotted, one, many, lang = F.contains("name", F.lit(".")), F.col("lo") == F.col("hi"), F.col("lo") != F.col("hi"), F.col("name").isin(LANG_ANNOTATIONS)
    status = F.when(dotted | one, "resolved").when(many, "conflict").when(lang, "resolved").otherwise("unknown")
    fqn = F.when(dotted, F.col("name")).when(one, F.col("lo")).when(many, None).when(lang, F.concat(F.lit("java.lang."), "name"))
    # Bases.
    basis = (
        F.when(dotted, "written-qualified").when(one & (F.col("rank") == 1), "explicit-import").when(one & (F.col("rank") == 2), "same-package-project-type").when(one, "wildcard-project-type")
        .when(many, "multiple-proven-candidates").when(lang, "java-lang").otherwise("insufficient-static-evidence")
    )
    tried = F.when(one | many & ~dotted, F.col("all")).when(fqn.isNotNull(), F.array(fqn)).otherwise(F.array().cast("array<string>"))
    tried = F.when(dotted, F.array("name")).otherwise(tried)
    return rows.select("file", "package", "name", status.alias("status"), fqn.alias("fqn"), basis.alias("basis"), tried.alias("candidates"))


def annotation_paths(nodes: DataFrame, edges: DataFrame, depth: int = 8) -> DataFrame:
    """(node, status, edges, cycles) of the meta-annotations above each node (node) over edges (src, dst): every path counts for
    itself, up to the depth; cycle before partial (a known annotation lies deeper) before resolved."""
    known = durable(nodes.select("node").distinct())
    steps = durable(edges.select("src", "dst").join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.select(F.col("node").alias("dst"), F.lit(True).alias("_known")), "dst", "left"))
    paths, found = known.select("node", F.array("node").alias("stack")), None
    for level in range(depth + 1):
        walked = paths.join(steps, F.element_at("stack", -1) == F.col("src")).select("node", "stack", "dst", F.coalesce("_known", F.lit(False)).alias("_known"))
        walked = durable(walked.withColumn("_cycle", F.col("_known") & F.array_contains("stack", F.col("dst"))))
        deep = F.lit(level == depth)
        here = walked.groupBy("node").agg(F.count_if(~deep).alias("edges"), F.count_if(F.col("_cycle") & ~deep).alias("cycles"), F.coalesce(F.bool_or(F.col("_known") & deep), F.lit(False)).alias("cut"))
        found = here if found is None else found.unionByName(here)
        paths = walked.where("_known AND NOT _cycle").select("node", F.array_append("stack", F.col("dst")).alias("stack"))
    total = found.groupBy("node").agg(F.sum("edges").alias("edges"), F.sum("cycles").alias("cycles"), F.bool_or("cut").alias("cut"))
    rows = known.join(total, "node", "left").fillna(0, ["edges", "cycles"])
    return rows.select("node", F.when(F.col("cycles") > 0, "cycle").when(F.coalesce("cut", F.lit(False)), "partial").otherwise("resolved").alias("status"), "edges", "cycles")


def transaction_faults(log: DataFrame, key: str, order: str) -> DataFrame:
    """log (status, reason, region, fresh_region) with the fault of each step: proposed comes first, then approved, applied,
    rolled_back; approving and rolling back need a reason, approving and applying an unchanged region."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(order))
    may = (
        F.when(F.col("status") == "proposed", before.isNull()).when(F.col("status") == "approved", before.isNotNull())
        .when(F.col("status") == "applied", before == "approved").when(F.col("status") == "rolled_back", before == "applied").otherwise(False)
    )
    blank = F.coalesce(F.trim("reason") == "", F.lit(True))
    fault = F.when(~F.coalesce(may, F.lit(False)), "wrong-state").when(F.col("status").isin("approved", "rolled_back") & blank, "no-reason").when(F.col("status").isin("approved", "applied") & ~F.col("region").eqNullSafe(F.col("fresh_region")), "stale")
    return log.withColumn("fault", fault)


def package_review(trust: Column) -> Column:
    """(ready, blocker) of an adapter package by the trust in its digest; ready for review never means executable."""
    return F.struct((trust == "allowed").alias("ready"), F.when(trust == "revoked", "package-digest-revoked").when(trust != "allowed", "package-digest-untrusted").alias("blocker"))


def tallied(entries: DataFrame, kind: str, value: Column, read: Column) -> DataFrame:
    """(kind, runs, errors, found) of corpus entries: one that cannot be read is an error of its own and stops no other."""
    return entries.groupBy(kind).agg(F.count("*").alias("runs"), F.count_if(~F.coalesce(read, F.lit(False))).alias("errors"), F.coalesce(F.sum(F.when(read, value)), F.lit(0)).cast("long").alias("found"))


def grouped_rules(rules: DataFrame, resource: str, field: str, rest: list[str]) -> DataFrame:
    """The distinct rules of each resource with their place among them by field."""
    rows = rules.select(resource, field, *rest).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(resource).orderBy(field, *rest)).cast("long"))
