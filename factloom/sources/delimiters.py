"""Masks of comments and strings, and groups of balanced delimiters with their items, to any depth.

Depth is a running sum over the delimiters of a text, as a window over a row for each of them; nested scopes are folded within
the text's row. A text is the most that one task holds of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.tables import durable, spread

#: Comments and strings of a language, each with its end or that of the text.
MASKS = {
    "sql": r"--[^\n]*|(?s:/\*.*?(?:\*/|\z))|'(?:[^']++|'')*+(?:'|\z)",
    "c": r"//[^\n]*|(?s:/\*.*?(?:\*/|\z))|\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?",
    "hash": r"#[^\n]*|(?s:\"\"\".*?(?:\"\"\"|\z))|(?s:'''.*?(?:'''|\z))|\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?",
}


def masked(text: Column, language: str) -> Column:
    """text of the same length and lines, with spaces for its comments and strings; null for null."""
    pattern = MASKS[language]
    blank = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda t: F.regexp_replace(t, r"[^\n]", " "))
    pairs = F.zip_with(F.split(text, pattern, -1), blank, lambda piece, hole: F.concat(piece, F.coalesce(hole, F.lit(""))))
    return F.array_join(pairs, "")


def delimiters(texts: DataFrame, keys: list[str], code: Column, opening: str = "(", closing: str = ")", parting: str = ",") -> DataFrame:
    """(keys, pos, token, at, depth): the delimiters of code and what stands between them, in order; at is the offset from 0,
    depth the number of groups open before the token.  A closing delimiter with nothing open counts for nothing."""
    special = "".join(f"\\{c}" for c in opening + closing + parting)
    tokens = F.regexp_extract_all("_code", F.lit(f"([{special}]|[^{special}]+)"), F.lit(1))
    # texts are dealt, not their many tokens, and every window below finds them in place
    rows = spread(texts.select(*keys, code.alias("_code")), *keys).select(*keys, F.posexplode(tokens).alias("pos", "token"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("token") == opening, 1).when(F.col("token") == closing, -1).otherwise(0)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))
    rows = rows.withColumn("_sum", F.sum(step).over(here)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(before)))
    return rows.withColumn("depth", F.col("_sum") - step - F.col("_low")).drop("_sum", "_low")


def groups(texts: DataFrame, keys: list[str], code: Column, header: str, opening: str = "(", closing: str = ")", parting: str = ",", empty: bool = False) -> DataFrame:
    """(keys, at, head, item, text): the items of every group whose opening delimiter stands right behind text that ends as the
    header pattern says; at is the delimiter's offset.  Items are parted at the top level only and trimmed, empty ones are left
    out unless they are wanted (then a group without items has one); a group that is not closed before the next one that counts
    begins has none, and other groups inside it are part of its text."""
    return groups_of(texts, keys, code, {"": header}, opening, closing, parting, empty).drop("kind")


def groups_of(texts: DataFrame, keys: list[str], code: Column, headers: dict[str, str], opening: str = "(", closing: str = ")", parting: str = ",", empty: bool = False) -> DataFrame:
    """groups for each kind of header, with the kind: the texts are cut into tokens once for all of them."""
    rows = delimiters(texts, keys, code, opening, closing, parting)
    along = Window.partitionBy(*keys).orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.when(F.col("token") == opening, F.lag("token").over(along)))
    head = lambda header: F.regexp_extract("_before", rf"(?is)({header})\z", 1)
    places = [(kind, f"_o{i}", f"_s{i}") for i, kind in enumerate(headers)]
    rows = rows.withColumns({o: F.max(F.when(head(headers[kind]) != "", F.struct("pos", "at", "depth", head(headers[kind]).alias("head")))).over(upto) for kind, o, _ in places})
    # where the last group was closed; what comes after it belongs to none, and is left out before groups are put in order
    closes = lambda o: (F.col("token") == closing) & (F.col("depth") == F.col(f"{o}.depth") + 1)
    rows = rows.withColumns({s: F.max(F.when(closes(o), F.col("pos"))).over(along.rowsBetween(Window.unboundedPreceding, -1)) for _, o, s in places})
    around = [F.when(F.col(o).isNotNull() & (F.coalesce(F.col(s), F.lit(-1)) < F.col(f"{o}.pos")), F.struct(F.lit(kind).alias("kind"), F.col(o).alias("_open"))) for kind, o, s in places]
    rows = rows.select(*keys, "pos", "token", "depth", F.array(*around).alias("_around")).select(*keys, "pos", "token", "depth", F.explode("_around").alias("_g")).where("_g IS NOT NULL")
    rows = rows.select(*keys, "pos", "token", "depth", "_g.kind", "_g._open")
    inside = Window.partitionBy(*keys, "kind", "_open.pos").orderBy("pos")
    own = Window.partitionBy(*keys, "kind", "_open.pos")
    over = (F.col("token") == closing) & (F.col("depth") == F.col("_open.depth") + 1)
    rows = rows.withColumn("_end", F.min(F.when(over, F.col("pos"))).over(own)).where(F.col("pos") < F.col("_end"))
    rows = rows.withColumn("token", F.when(F.col("pos") > F.col("_open.pos"), F.col("token")).otherwise(""))
    part = F.col("token").isin(list(parting)) & (F.col("depth") == F.col("_open.depth") + 1)
    rows = rows.withColumn("item", F.count_if(part).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where(~part)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")
    out = rows.groupBy("kind", *keys, F.col("_open.at").alias("at"), F.col("_open.head").alias("head"), "item").agg(F.regexp_replace(joined, r"^\s+|\s+\z", "").alias("text"))
    return out if empty else out.where("text <> ''")


#: Delimiters, and what stands for them inside strings.
_PLAIN, _HIDDEN = "()[]{},", "\x01\x02\x03\x04\x05\x06\x07"


def shielded(text: Column, language: str) -> Column:
    """text without its comments (and, of indented languages, its strings of several lines), the delimiters inside its strings
    put out of sight."""
    pattern = MASKS[language]
    token = lambda t: F.when(t.rlike(r"^(#|//|--|/\*|\"\"\"|'{3})"), F.regexp_replace(t, r"[^\n]", "")).otherwise(F.translate(t, _PLAIN, _HIDDEN))
    held = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), token)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), held, lambda piece, t: F.concat(piece, F.coalesce(t, F.lit("")))), "")


def unshielded(text: Column) -> Column:
    return F.translate(text, _HIDDEN, _PLAIN)


def calls(texts: DataFrame, keys: list[str], code: Column, header: str) -> DataFrame:
    """(keys, at, head, args): the calls whose name ends as the header says, with their arguments in order."""
    return calls_of(texts, keys, code, {"": header}).drop("kind")


def calls_of(texts: DataFrame, keys: list[str], code: Column, headers: dict[str, str]) -> DataFrame:
    """calls for each kind of header, with the kind, from one pass over the texts."""
    items = groups_of(texts, keys, code, headers, empty=True)
    listed = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]), lambda t: t != "")
    return items.groupBy("kind", *keys, "at", "head").agg(listed.alias("args"))


#: Comments and strings of any of the languages: a quote that begins three ends with three, other strings end at their quote.
_COMMENT = r"//[^\n]*|#[^\n]*|(?s:/\*.*?(?:\*/|\z))|(?s:\"{3}.*?(?:\"{3}|\z))|(?s:'{3}.*?(?:'{3}|\z))"
_STRING = r"(?s:\"(?:[^\"\\]++|\\.)*+(?:\"|\z))|(?s:'(?:[^'\\]++|\\.)*+(?:'|\z))|(?s:`(?:[^`\\]++|\\.)*+(?:`|\z))"


def code_text(text: Column, strings: bool) -> Column:
    """text of the same length and lines with spaces for comments, whatever its language, and for strings too unless they stay."""
    pattern = f"{_COMMENT}|{_STRING}"
    blank = lambda t: F.regexp_replace(t, r"[^\n]", " ")
    kept = lambda t: F.when(t.rlike(f"\\A(?:{_COMMENT})"), blank(t)).otherwise(t) if strings else blank(t)
    held = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), kept)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), held, lambda piece, t: F.concat(piece, F.coalesce(t, F.lit("")))), "")


#: Tokens that are folded at a time: a step copies what its stretch has found, not what the text has.
_STRETCH = 500


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is made once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nested(texts: DataFrame, code: Column, about: str = "pos:int", own: Callable[..., Column] = lambda head, around, pos, depth: F.struct(pos.alias("pos")), opening: str = "{", closing: str = "}", parting: str = ";") -> DataFrame:
    """texts with events and unclosed.  events: of each scope's opening delimiter and of each piece between delimiters, in order, pos,
    at, text (trimmed; before an opening delimiter that of its head), depth, opens, parent (pos of the scope around) and scope: the
    scope that is opened or the one around a piece, a struct as about says, pos among it, which own(head, scope around, pos, depth) gives.
    unclosed: the pos of the scopes left open, by depth.  A text is folded in its row: no token becomes one."""
    trimmed = lambda c: F.trim(c, F.lit(" \t\n\x0b\f\r"))
    scope = f"struct<{about}>"
    found = f"array<struct<pos:int,at:bigint,text:string,depth:int,opens:boolean,parent:int,scope:{scope}>>"
    special = "".join(f"\\{c}" for c in opening + closing + parting)

    def state(pos: Column, at: Column, last: Column, inside: Column, out: Column) -> Column:
        return F.struct(pos.alias("pos"), at.alias("at"), last.alias("last"), inside.alias("inside"), out.alias("out"))

    def step(s: Column, token: Column) -> Column:
        around, depth, head = F.try_element_at(s["inside"], F.lit(-1)), F.size(s["inside"]), trimmed(s["last"])
        then = lambda inside, out: state(s["pos"] + 1, s["at"] + F.length(token), token, inside, out)
        seen = lambda text, opens, scope: F.array_append(s["out"], F.struct(
            s["pos"].alias("pos"), s["at"].alias("at"), text.alias("text"), depth.alias("depth"), F.lit(opens).alias("opens"), around["pos"].alias("parent"), scope.alias("scope")))
        opened = let(own(head, around, s["pos"], depth), lambda me: then(F.array_append(s["inside"], me), seen(head, True, me)))
        closed = then(F.slice(s["inside"], F.lit(1), F.greatest(depth - 1, F.lit(0))), s["out"])
        piece = ~token.isin(list(parting)) & token.rlike(r"\S")
        return F.when(token == opening, opened).when(token == closing, closed).when(piece, then(s["inside"], seen(trimmed(token), False, around))).otherwise(then(s["inside"], s["out"]))

    def stretch(s: Column, tokens: Column) -> Column:
        part = F.aggregate(tokens, state(s["pos"], s["at"], s["last"], s["inside"], F.array().cast(found)), step)
        return let(part, lambda x: state(x["pos"], x["at"], x["last"], x["inside"], F.array_append(s["out"], x["out"])))

    rows = texts.withColumn("_tokens", F.regexp_extract_all(code, F.lit(f"([{special}]|[^{special}]+)"), F.lit(1)))
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_tokens") - 1, F.lit(0)), F.lit(_STRETCH)), lambda i: F.slice("_tokens", i + 1, F.lit(_STRETCH)))
    start = state(F.lit(0), F.lit(0).cast("long"), F.lit(""), F.array().cast(f"array<{scope}>"), F.array().cast(f"array<{found}>"))
    folded = F.aggregate(stretches, start, stretch, lambda s: F.struct(F.flatten(s["out"]).alias("events"), F.transform(s["inside"], lambda x: x["pos"]).alias("unclosed")))
    return rows.withColumn("_folded", folded).select(*texts.columns, "_folded.events", "_folded.unclosed")


def left_open(pos: Column, depth: Column) -> Column:
    """Whether the scope at pos and depth is one of the unclosed."""
    return F.coalesce(F.get("unclosed", depth) == pos, F.lit(False))


def scopes(texts: DataFrame, keys: list[str], code: Column, opening: str = "{", closing: str = "}", parting: str = ";") -> tuple[DataFrame, DataFrame]:
    """(opens, pieces) of nested scopes, to any depth.  opens: keys, pos, at, head (the text before the opening delimiter, trimmed),
    depth, parent (the pos of the scope around it; null outside all) and closed.  pieces: keys, pos, at, text (trimmed, not empty)
    and scope (likewise) of what stands between delimiters.  A closing delimiter with nothing open counts for nothing."""
    rows = nested(spread(texts.select(*keys, code.alias("_code")), *keys), F.col("_code"), opening=opening, closing=closing, parting=parting)
    rows = durable(rows.drop("_code"), broadcast=False).select(*keys, "unclosed", F.inline("events"))  # one pass, two outputs
    opens = rows.where("opens").select(*keys, "pos", "at", F.col("text").alias("head"), "depth", "parent", (~left_open(F.col("pos"), F.col("depth"))).alias("closed"))
    return opens, rows.where("NOT opens").select(*keys, "pos", "at", "text", F.col("parent").alias("scope"))
