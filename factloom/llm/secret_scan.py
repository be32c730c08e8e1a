"""Secret scan with multipart credential linking.

Native: the executors run built-in expressions only.  Base spans (assignments, access identifiers, hex strings) always
count.  Weak candidates (bare random-looking strings, account names, endpoints) count only where complementary parts
stand within `scope` code points: an interval join of parts on (row, bin of the position), with the distance as condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sieved, written

#: kind, role, order in ties, pattern (Java and RE2 alike), what a match must also satisfy (`m` is the match)
_KEYS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_LEAD = """["']?\\x20*[:=]\\x20*["']?"""
ASSIGN = _KEYS + _LEAD + "([A-Za-z0-9+/_.=-]+)"
KINDS = (
    ("assign", "secret", 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, "^(?:" + ASSIGN + ")$", 2)) >= 6),
    ("access", "id", 1, "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    ("hex", "secret", 2, "[0-9a-f]{24,}", lambda m: F.lit(True)),
    # weak kinds: reported only when linked
    ("string", "secret", 3, "[A-Za-z0-9+/]{40,}={0,2}", lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
    ("account", "id", 4, """([Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]_?[Ii][Dd])["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9@_.-]{3,}""", lambda m: F.lit(True)),
    ("endpoint", "endpoint", 5, """[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+""", lambda m: F.lit(True)),
)
BASE = ("assign", "access", "hex")
#: What a base or weak span must contain; literal text that every match has, to pass over most rows cheaply.
_MAY = """(text rlike '[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]_?[Ii][Dd]'
 OR contains(text, 'AKIA') OR contains(text, '://') OR text rlike '[0-9a-f]{24}' OR text rlike '[A-Za-z0-9+/]{40}')"""


def _key():
    """Rows with equal ids are told apart by their texts; equal rows share a key and get the same result."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256)


def candidates(docs: DataFrame) -> DataFrame:
    """(k, kind, role, ord, start, end) of every match of every kind, in code points, end exclusive."""
    rows = docs.select(_key().alias("k"), "text").where(_MAY).dropDuplicates(["k"])
    kinds = F.explode(F.array(*(
        F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(n).alias("ord"),
                 F.split("text", pattern, -1).alias("between"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))
        for kind, role, n, pattern, _ in KINDS
    )))
    each = rows.select("k", kinds.alias("c")).where("size(c.found) > 0").select(
        "k", "c.kind", "c.role", "c.ord", F.posexplode(F.arrays_zip("c.between", "c.found")).alias("i", "p")
    ).where("p.found IS NOT NULL").select(
        "k", "kind", "role", "ord", "i", F.length("p.between").cast("long").alias("gap"), F.length("p.found").cast("long").alias("n"), F.col("p.found").alias("m")
    )
    upto = Window.partitionBy("k", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.lit(False)
    for kind, _, _, _, test in KINDS:
        fits = F.when(F.col("kind") == kind, test(F.col("m"))).otherwise(fits)
    return each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).where(fits).select(
        "k", "kind", "role", "ord", (F.col("end") - F.col("n")).alias("start"), "end"
    )


def linked(spans: DataFrame, scope: int = 300) -> DataFrame:
    """Base spans, and the weak spans whose complementary parts start within `scope` of their start.

    A string needs an identifier, an account a secret, an endpoint both.  Each part is entered in its own bin and its two
    neighbours, so that the join is an equi-join on (row, bin) and reads a bounded stretch of one text for each key.  A
    string inside a base span of its own is that span, and is left out.
    """
    base = spans.where(F.col("kind").isin(*BASE))
    weak = spans.where(~F.col("kind").isin(*BASE))
    inside = base.select("k", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    at = F.floor(F.col("start") / scope)
    covered = inside.withColumn("bin", F.explode(F.sequence(F.floor(F.col("b_start") / scope), F.floor((F.col("b_end") - 1) / scope))))
    weak = weak.withColumn("bin", at)
    weak = weak.where("kind = 'endpoint'").unionByName(
        weak.where("kind <> 'endpoint'").alias("w").join(
            covered.alias("c"), F.expr("w.k = c.k AND w.bin = c.bin AND c.b_start <= w.start AND w.start < c.b_end"), "left_anti")
    )
    part = spans.select("k", "role", F.col("start").alias("p_start"), F.explode(F.array(at - 1, at, at + 1)).alias("bin"))
    near = "w.k = p.k AND w.bin = p.bin AND abs(w.start - p.p_start) <= " + str(scope)

    def beside(rows: DataFrame, role: str) -> DataFrame:
        return rows.alias("w").join(part.where(F.col("role") == role).alias("p"), F.expr(near), "left_semi")

    found = beside(weak.where("role = 'secret'"), "id").unionByName(beside(weak.where("role = 'id'"), "secret")).unionByName(
        beside(beside(weak.where("role = 'endpoint'"), "id"), "secret"))
    return base.unionByName(found.drop("bin"))


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """One row for each row of docs: k, doc_id, and spans, an array of (start, ord, kind, end) in text order.

    - null or empty text: no spans; a null doc_id is a row like any other
    - repeated rows: each gets the spans of its own text
    - very long texts are scanned whole; positions come from a running sum over the matches
    - empty table: no rows; other columns are not read and may have any names
    """
    found = linked(written(candidates(docs.select("doc_id", "text")), "secret-spans"), scope)
    lists = found.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end"))).alias("spans"))
    return docs.select("doc_id", _key().alias("k")).join(lists, "k", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() AS array<struct<start:bigint,ord:int,kind:string,end:bigint>>)")))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query op8 from scan()'s rows."""
    text = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    n = {f"n_{k}": F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)") for k in BASE}
    return scanned.select(
        "doc_id", *(c.alias(k) for k, c in n.items()),
        F.sha2(F.expr(text.format("filter(spans, s -> s.ord <= 2)")), 256).alias("base_sha256"),
        F.expr(text.format("spans")).alias("spans"),
    )


def masked(docs: DataFrame, scope: int = 300) -> DataFrame:
    """docs with every reported span of text replaced by <secret>; overlapping spans become one."""
    cut = """aggregate(spans, named_struct('at', 0L, 'out', cast(array() AS array<string>)),
        (a, s) -> IF(s.end <= a.at, a, named_struct('at', s.end, 'out', IF(s.start >= a.at,
            concat(a.out, array(substring(t, cast(a.at + 1 AS INT), cast(s.start - a.at AS INT)), '<secret>')), a.out))),
        a -> concat(array_join(a.out, ''), substring(t, cast(a.at + 1 AS INT))))"""
    found = written(scan(docs, scope).where("size(spans) > 0").select("k", "spans").dropDuplicates(["k"]), "secrets")
    rows = sieved(docs.select(F.struct("*").alias("d"), _key().alias("k"), F.col("text").alias("t")), "k", found.select(F.col("k").alias("_k")), "_k")
    hits = rows.where("hit").join(found, "k", "left")  # rows without a secret are not shuffled with their texts
    text = F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.expr(cut))
    whole = rows.where("NOT hit").select("d", "t").unionByName(hits.select("d", text.alias("t")))
    return whole.select(*(F.col("t").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
